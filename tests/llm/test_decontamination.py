import hashlib
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F
from texts import prose

from marlstone.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, size=13):
    words_of = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    ids |= found
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check(spark, docs, items):
    rows = decontamination.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, rows), key=str) == brute(docs, items)


def test_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    check(spark, docs, items)


def test_sql_gives_the_same_rows(spark, sf_dir):
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        wanted = sorted(db.execute(decontamination.REPORT_SQL).fetchall())
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    assert sorted(map(tuple, decontamination.report(docs, items).collect())) == wanted


def test_small_cases(spark):
    item = prose(5, 30)
    docs = [(1, prose(6, 20) + " " + item), (2, item.upper().replace(" ", ", ")), (3, "short item"), (4, "a Short  ITEM twice: short-item."), (5, None), (6, prose(7, 900) + " " + item[:90]), (7, " ".join(item.split()[3:16])), (8, " ".join(item.split()[3:15]))]
    check(spark, docs, [(1, item), (10, "Short item!"), (2, ""), (3, None), (4, item)])


def test_blocks_agree(spark):
    items = spark.createDataFrame([(k, prose(k, 25)) for k in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(k, prose(100 + k, 30) + " " + prose(k, 25) + " " + prose(k + 1, 25)) for k in range(25)], "doc_id long, text string")
    row = lambda r: (r.doc_id, r.hit_spans, r.hit_items)
    one = sorted(map(row, decontamination.find_hits(docs, items).collect()))
    many = sorted(map(row, decontamination.find_hits(docs, items, block_bytes=600).collect()))
    assert one == many and all(len(r[2]) == 2 for r in one)


def test_removal(spark):
    item, clean = prose(5, 30), prose(6, 400)
    docs = spark.createDataFrame([(1, "Start here. " + item + ", the end.", "a"), (2, clean, None)], "doc_id long, text string, n_words string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontamination.drop_documents(docs, items)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, clean, None)]
    assert {r.doc_id: r.text for r in decontamination.cut_spans(docs, items).collect()} == {1: "Start here. , the end.", 2: clean}


def test_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "plain, and a few more of them here some words"), (None, "漢字 and")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.report(edge_docs, items).count() == edge_docs.count()
    assert decontamination.report(edge_docs, none).where("n_hit > 0").count() == 0
    assert decontamination.report(no_docs, items).count() == 0
    assert decontamination.drop_documents(edge_docs, items).columns == edge_docs.columns


def hits(docs, items, **how):
    return sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.hit_spans], r.hit_items) for r in decontamination.find_hits(docs, items, **how).collect()), key=str)


def test_a_joined_benchmark_hits_the_same(spark, sf_dir, edge_docs, monkeypatch):
    """Without any broadcast windows: the tables, short items, nulls, and a filter of a few bits that lets most pass."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    assert hits(docs, items, block_bytes=-1) == hits(docs, items)
    short = spark.createDataFrame([(1, "words that are plain"), (None, "漢字 and"), (3, None), (4, "a"), (1, "words that are plain")], "item_id long, text string")
    assert hits(edge_docs, short, block_bytes=-1) == hits(edge_docs, short)
    none = spark.createDataFrame([], "item_id long, text string")
    assert hits(edge_docs, none, block_bytes=-1) == hits(edge_docs, none)
    monkeypatch.setattr(decontamination, "PART_BITS", 64)
    monkeypatch.setattr(decontamination, "FILTER_BITS", 256)
    monkeypatch.setattr(decontamination, "WINDOW_BITS", 1)
    docs = docs.limit(50)
    assert hits(docs, items, block_bytes=-1) == hits(docs, items)


def test_a_filter_has_all_its_windows_and_few_others(spark):
    items = spark.createDataFrame([(k, prose(k, 200)) for k in range(120)], "item_id long, text string").withColumn("text", F.col("text").cast("binary"))
    windows = decontamination.item_windows(items, 13)
    held = decontamination.window_filter(windows)
    hashes = np.array([r.hash for r in windows.collect()], np.int64).view(np.uint64)
    others = np.random.default_rng(1).integers(0, 2**63, 50_000).astype(np.uint64) * np.uint64(2)
    assert decontamination.passing(held, hashes).all() and decontamination.passing(held, others).mean() < 0.05


def test_documents_are_scanned_once_for_any_benchmark(spark):
    """The text is read by one stored copy of the documents, however many blocks the benchmark would fill."""
    docs = spark.createDataFrame([(k, prose(k, 30)) for k in range(20)], "doc_id long, text string")
    counts = []
    for n in (4, 60):
        items = spark.createDataFrame([(k, prose(500 + k, 40)) for k in range(n)], "item_id long, text string")
        plan = decontamination.find_hits(docs, items, block_bytes=100)._jdf.queryExecution().optimizedPlan().toString()
        counts.append(plan.count("MapInArrow scan"))
    assert counts == [1, 1]

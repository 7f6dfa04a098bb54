import math
import re
from collections import Counter

import numpy as np
import pytest
from texts import prose

from marlstone.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, best=10):
    """Every document scored for every item, by the definition."""
    counted = [(doc, Counter(terms_of(text))) for doc, text in docs]
    counted = [(doc, c, sum(c.values())) for doc, c in counted if c]
    number, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c, n in counted:
            m = 100 - 75 + 75 * n * number // total
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms_of(text) if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, k + 1, doc, -score) for k, (score, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:best])]
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def check(spark, docs, items, **how):
    found = lexical_search.search(*frames(spark, docs, items), **how).collect()
    assert sorted(map(tuple, found), key=str) == brute(docs, items, how.get("best", 10))


def test_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    check(spark, docs, items)


def test_classes_of_copies_and_reordered_words(spark):
    """One text in many copies, one with its words in other orders, ties across both, fewer matches than asked for."""
    docs = [(k, "alpha beta gamma beta") for k in range(0, 60, 2)] + [(k, "beta gamma beta alpha") for k in range(1, 60, 2)]
    docs += [(100 + k, f"alpha {prose(k, 30)}") for k in range(20)] + [(200, "unique words here")]
    check(spark, docs, [(1, "alpha beta"), (2, "beta beta gamma"), (3, "unique"), (4, "absent"), (5, prose(3, 12))])


def test_items_in_blocks_and_in_several_products(spark, monkeypatch):
    docs = [(k, prose(k, 5 + k % 40)) for k in range(300)]
    items = [(k, prose(1000 + k, 1 + k % 9)) for k in range(40)]
    monkeypatch.setattr(lexical_search, "ITEMS", 7)
    monkeypatch.setattr(lexical_search, "CLASSES", 16)
    monkeypatch.setattr(lexical_search, "HELD", 50)
    check(spark, docs, items, item_bytes=400, best=3)


def test_edges(spark, edge_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    items = [(1, "some words of plain text"), (1, "some words of plain text"), (2, None), (None, "漢字 EMOJI"), (3, "!!"), (4, "")]
    wanted = brute(docs, items)
    found = lexical_search.search(edge_docs.withColumnRenamed("score", "n"), frames(spark, [], items)[1]).collect()
    assert sorted(map(tuple, found), key=str) == wanted
    assert lexical_search.search(no_docs, frames(spark, [], items)[1]).count() == 0
    assert lexical_search.search(edge_docs, frames(spark, [], [])[1]).count() == 0


def test_classes_of_equal_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(lexical_search.F, "md5", lambda column: lexical_search.F.lit("same"))
    docs = [(k, prose(k % 7, 12)) for k in range(40)]
    check(spark, docs, [(k, prose(k, 6)) for k in range(8)])


@pytest.mark.parametrize("seed", range(3))
def test_the_best_of_many_small_parts_are_the_best_of_all(seed):
    r = np.random.default_rng(seed)
    best = lexical_search._Best(4, 3)
    item, score, doc = r.integers(0, 4, 500), r.integers(1, 9, 500), r.permutation(500)
    for k in range(0, 500, 20):
        part = slice(k, k + 20)
        keep = score[part] >= best.least[item[part]]
        best.add(item[part][keep], score[part][keep], doc[part][keep], doc[part][keep])
        best.merged()
    wanted = [sorted(zip(-score[item == i], doc[item == i], strict=True))[:3] for i in range(4)]
    held = best.merged()
    assert [[(-s, d) for s, d in zip(held[1][held[0] == i], held[2][held[0] == i], strict=True)] for i in range(4)] == wanted

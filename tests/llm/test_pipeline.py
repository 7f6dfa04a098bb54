from texts import prose
from test_decontamination import brute as contaminated
from test_near_duplicates import brute as groups_of
from test_packing import check as check_packing
from test_secret_scan import brute as secrets

import corpus_pipeline


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    after = {"documents": {r.doc_id: r for r in docs.collect()}}
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, sf_dir)
        if name != "packing":
            assert out.dtypes == docs.dtypes
            rows = spark.createDataFrame(out.collect(), docs.schema)
            after[name] = {r.doc_id: r for r in rows.collect()}
        else:
            check_packing(out.collect(), [(k, r.text) for k, r in after["secrets"].items()])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = after["quality"]
    wrong = [k for k, q in labels.items() if k in after["documents"] and (k in good) != (q == 1)]
    assert len(wrong) <= len(labels) // 20
    text_of = lambda x: [(k, r.text) for k, r in sorted(x.items())]
    assert sorted(after["near_dedup"]) == [g[0] for g in groups_of(text_of(good))]
    assert sorted(after["decontamination"]) == sorted(r[0] for r in contaminated(text_of(after["near_dedup"]), items) if not r[5])
    assert set(after["secrets"]) == set(after["decontamination"])
    for k, r in after["secrets"].items():
        before = after["decontamination"][k]
        assert r == before if not secrets(before.text) else not secrets(r.text) and r.n_chars == len(r.text)


def test_run_reads_and_writes_tables(spark, sf_dir, tmp_path):
    spark.createDataFrame([(1, prose(1, 50), "en", "s", 1), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


LIKE = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, n_words string, hit_spans string, __key string, __of string, __id string, key string, y int"


def tables(spark, folder, rows):
    spark.createDataFrame(rows, LIKE).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, k % 2, 0) for k in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(77, 20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_clashing_columns_and_odd_rows_pass_all_stages(spark, tmp_path):
    text = lambda k: prose(k, 80) if k % 2 else " ".join(w + "***" for w in prose(k, 80).split())
    more = (*"abcdefgh", 7)
    rows = [(k, text(k), "en", "s", len(text(k)), *more) for k in range(60)]
    rows += [(k, t, None, None, None, *more) for k, t in ((61, text(61)), (61, text(61)), (63, text(1)), (65, prose(77, 20)), (67, None), (69, ""), (None, text(71)))]
    tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = spark.createDataFrame(stage(spark, left, str(tmp_path)).collect(), docs.schema)
        assert left.dtypes == docs.dtypes, name
    kept = sorted((str(r.doc_id) for r in left.where("text <> ''").collect()))
    assert kept == sorted([*(str(k) for k in range(1, 62, 2)), "None"])
    assert all(tuple(r)[5:] == more for r in left.collect())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in pieces) == sorted(str(r.doc_id) for r in left.collect())


def test_empty_tables_pass_all_stages(spark, tmp_path):
    tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

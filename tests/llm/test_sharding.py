import zlib
from collections import Counter

from marlstone.llm import sharding


def test_law_and_digests(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.shard_documents(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 40)
        assert r.shard // 8 == r.region and r.shard // 4 == r.rack
    for shard in range(40):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_only_the_key_decides(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    whole = {r.doc_id: r.shard for r in sharding.shard_documents(docs).collect()}
    part = sharding.shard_documents(docs.where("doc_id > 100").selectExpr("doc_id", "'other' as text")).collect()
    assert all(whole[r.doc_id] == r.shard for r in part)


def test_movement_stays_in_changed_subtrees(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = sharding.balanced(40)
    heavy = [list(map(list, region)) for region in tree.regions]
    heavy[1][0][2] = (heavy[1][0][2][0], 3.0)
    changed = sharding.Tree(tuple(tuple(map(tuple, region)) for region in heavy))
    rows = sharding.place(sharding.place(ids, ids.doc_id, tree), ids.doc_id, changed, "new_").collect()
    for r in rows:
        if r.region != r.new_region:
            assert r.new_region == 1  # only the heavier region gains
        elif r.rack != r.new_rack:
            assert r.new_rack == 2
        elif r.shard != r.new_shard:
            assert r.new_shard == 10
    counts = Counter(r.new_shard for r in rows)
    assert 1100 < counts[10] < 1800 and all(300 < counts[s] < 700 for s in counts if s != 10)


def test_edges(spark, edge_docs, no_docs):
    rows = sharding.shard_documents(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert {r.size for r in rows if r.doc_id in (2, 3)} == {16}
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert sharding.shard_documents(no_docs).count() == 0

import math

import duckdb
import pytest

from marlstone.llm import plans, sharding


def values(row):
    return tuple(x if not isinstance(x, float) or not math.isnan(x) else None for x in row)


@pytest.mark.parametrize("name", sorted(plans.oracles()))
def test_query_equals_its_sql(spark, sf_dir, name):
    with duckdb.connect() as db:
        for table in ("documents", "benchmark", "embeddings"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        wanted = db.execute(plans.oracles()[name])
        columns = [c[0] for c in wanted.description]
        rows = sorted(map(values, wanted.fetchall()))
    found = plans.queries()[name](spark, sf_dir)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(values, found.select(*columns).collect())) == rows


def test_placement_sql_of_texts_of_many_kinds(spark):
    rows = [(1, ""), (2, None), (3, "ünï 漢字 \U0001f600"), (4, "a" * 5000), (4, "a" * 5000), (4, "b")]
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        wanted = db.execute(sharding.documents_sql(7, 3))
        columns, wanted = [c[0] for c in wanted.description], sorted(wanted.fetchall())
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 7, 3)
    assert sorted(map(tuple, found.select(*columns).collect())) == wanted


#: The base columns of op3, which SQL can express.
BASE_SQL = r"""
WITH crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
doc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 5 = 1 AS held_out,
  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS tokens FROM documents, crc_table),
word AS (SELECT doc_id, held_out, unnest(tokens) AS token FROM doc),
counted AS (SELECT token, count(*) AS c FROM word WHERE NOT held_out GROUP BY token),
total AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM counted)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) AS base_score
FROM word LEFT JOIN counted USING (token), total GROUP BY doc_id, held_out
"""


def test_base_columns_of_the_language_model_equal_sql(spark, sf_dir):
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        wanted = {r[0]: r[1:] for r in db.execute(BASE_SQL).fetchall()}
    rows = plans.queries()["op3_lm_scores"](spark, sf_dir).collect()
    assert len(rows) == len(wanted)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == wanted[r.doc_id][:4]
        assert r.base_score == pytest.approx(wanted[r.doc_id][4], rel=1e-9)


#: The counts of op7.
SECRETS_SQL = r"""
SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 12)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex
FROM documents
"""


def test_base_counts_of_secrets_equal_sql(spark, sf_dir):
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        wanted = sorted(db.execute(SECRETS_SQL).fetchall())
    found = plans.queries()["op7_secrets"](spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")
    assert sorted(map(tuple, found.collect())) == wanted and sum(sum(r[1:]) for r in wanted) > 0

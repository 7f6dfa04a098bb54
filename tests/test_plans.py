import datetime

import duckdb
import pytest

import __spark_entry__
from marlstone import plans
from marlstone.streaming import event_counts

SF = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, name):
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
        wanted = db.execute(plans.ORACLES[name])
        columns = [c[0] for c in wanted.description]
        rows = sorted(wanted.fetchall())
    found = plans.QUERIES[name](spark, SF)
    assert found.columns == columns
    assert sorted(map(tuple, found.collect())) == rows


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream_drops_late_rows(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, event_type string, value double"
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    add = lambda k, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    add(0, [(1, at(1), "view", 1.0), (2, at(5), "view", 2.0)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = event_counts(stream).writeStream.format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    query.processAllAvailable()
    add(1, [(3, at(1), "view", 9.0), (4, at(9), "view", 1.0)])
    query.processAllAvailable()
    query.stop()
    totals = {r["window"]["start"].hour: r["total"] for r in spark.table("counts").collect()}
    assert totals == {1: 1.0, 5: 2.0}  # 9.0 came too late for its hour, and the last hour is still open

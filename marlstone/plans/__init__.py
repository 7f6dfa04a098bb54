"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import discounted, money
from marlstone.operators import summarise
from marlstone.sources import read_table


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of shipped line items by return flag and line status."""
    shipped = read_table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return summarise(
        shipped,
        ["l_returnflag", "l_linestatus"],
        sum_qty=F.sum("l_quantity"),
        sum_disc_price=money(F.sum(discounted(F.col("l_extendedprice"), F.col("l_discount")))),
        avg_disc=F.round(F.avg("l_discount"), 6),
        count_order=F.count(F.lit(1)),
    )


PRICING_SUMMARY_SQL = """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02'
GROUP BY l_returnflag, l_linestatus
"""

QUERIES = {"pricing_summary": pricing_summary}
ORACLES = {"pricing_summary": PRICING_SUMMARY_SQL}

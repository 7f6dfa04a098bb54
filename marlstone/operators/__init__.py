"""Reusable DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def summarise(df: DataFrame, keys: list[str], **measures: Column) -> DataFrame:
    """One grouped aggregation: partial sums before the only shuffle, a column for each measure."""
    return df.groupBy(*keys).agg(*(c.alias(name) for name, c in measures.items()))

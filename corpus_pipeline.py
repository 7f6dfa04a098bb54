"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

All stages but the last return the columns of `documents`, of their types and in their order, further columns of any
name included. An empty table passes through as one. What each stage does with null and empty texts, null ids and
repeated rows is said below; every text is read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontamination, near_duplicates, packing, quality, secret_scan
from marlstone.llm.common import delete, store, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, fitted on `labels`, rejects. Texts that are null, empty or
    without words all have the same score, repeated rows stay or go together; no id is needed to be scored."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near duplicates: that of the least doc_id, a null id being the greatest.
    Null and empty texts are equal; texts without words have copies only; of rows that repeat in full one stays."""
    return near_duplicates.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold too much of `benchmark`. Null and empty texts stay, and all do if the benchmark
    is empty; repeated rows stay or go together."""
    return decontamination.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; every document stays, null and empty texts as they are."""
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens. A null or empty text is its end alone, a null id stays
    null, repeated rows are packed as often as they come."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the trained stages nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each leaves is a table in the shared folder, until the next has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = store(stage(spark, docs, sf_dir))
        if before:
            delete(spark, before)
        before = path
    return docs

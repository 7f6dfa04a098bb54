"""The bounded training sample that both classifiers fit on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fold, stored

#: Labelled documents that a fit reads at most, those with the least hash of the doc_id, and their bytes together.
SAMPLE, SAMPLE_BYTES = 16_000, 64 << 20


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int = 4, held: int = 2, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, y: 0 or 1, part: a hash of the id) of labelled documents outside the held fold, stored.

    Documents come in the order of the hash, whole and of any length, until there are `most` or the next would begin
    beyond `most_bytes`. Labels that are neither 0 nor 1 are ignored; of an id's several labels the greatest counts,
    of several texts the least. The ids are at most `most` rows, so they are broadcast and no text is shuffled but the
    sample's own.
    """
    wanted = labels.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held) & F.col(label).isin(0, 1))
    ids = wanted.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).withColumn("part", F.xxhash64("doc_id")).orderBy("part", "doc_id").limit(most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = stored(texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y", "part").agg(F.min("text").alias("text")))
    before = 0
    for r in sample.select("part", F.octet_length("text").alias("bytes")).orderBy("part", "doc_id").collect():
        if before > most_bytes:
            return sample.where(F.col("part") < r.part)
        before += r.bytes
    return sample

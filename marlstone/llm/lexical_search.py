"""Ranked lexical search: the highest-scoring documents for each benchmark item, by classes of equal bags of words.

A term is a maximal run of letters, digits and characters from U+0080 on, A-Z lower-cased. Only what the items ask
for is kept of a document: how often it holds each term of their vocabulary, and the one number by which its length
enters a score. Documents that agree in both are a class: they are grouped by a hash of the two, and by the two
themselves, so that classes of equal hash stay apart. A class is scored once, against all items. The ten best classes of
an item, by score and then by their least doc_id, hold its ten best documents, since each class has at least one; only
their members are looked up, by ascending doc_id, ten of a class at most.

A score is a sum of whole numbers, worked out as a product of matrices in doubles, which hold such sums exactly to
2^53. Items are taken some at a time, so that the vocabulary that is broadcast is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.llm.common import as_bytes, chunks, pieces, small, spread, stored
from marlstone.llm.decontamination import words_of

BEST = 10
#: Bytes of item texts whose vocabulary is broadcast at once; more items are searched for in several scans.
ITEM_BYTES = 32 << 20
#: Items and classes of one product of matrices, and classes' scores that a task holds before it drops all but the best.
ITEMS, CLASSES, HELD = 256, 512, 200_000
#: Rows of 32 bytes up to which a side of a join is broadcast.
BROADCAST_ROWS = 200_000
_LAST = np.iinfo(np.int64).max


class Items(NamedTuple):
    """item_ids; vocabulary: a number from 1 for each term; terms: each item's terms, repeats included, as numbers."""

    item_ids: list[Any]
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple[Any, bytes]]) -> Items:
        vocabulary: dict[bytes, int] = {}
        terms = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], np.int64) for _, text in rows]
        return Items([item for item, _ in rows], vocabulary, terms)


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[Any, bytes]]]:
    """The items in blocks of about `block_bytes`; no more reaches the driver at once."""
    rows = items.select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    n = 1 + (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // block_bytes
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        if held := [(item, bytes(text)) for item, text in block.toLocalIterator()]:
            yield held


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n: all terms, bag: pairs of number and tf of the vocabulary's terms, ascending, as 32-bit integers)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, wide = shared.value.get, len(shared.value) + 1
        for chunk in chunks(batches):
            keys, n = [np.zeros(0, np.int64)], np.zeros(chunk.num_rows, np.int64)
            for k, text in enumerate(as_bytes(chunk.column("text"))):
                for piece in pieces(text):
                    words = words_of(piece)
                    n[k] += len(words)
                    keys.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)) + k * wide)
            key, tf = np.unique(np.concatenate(keys), return_counts=True)
            known = key % wide > 0
            key, tf = key[known], tf[known]
            ends = np.cumsum(np.bincount(key // wide, minlength=chunk.num_rows))
            flat = np.stack([key % wide, tf], 1).astype("<u4").tobytes()
            bag = [flat[8 * a : 8 * b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(n), pa.array(bag, pa.binary())], names=["doc_id", "n", "bag"])

    return docs.mapInArrow(count, "doc_id long, n long, bag binary")


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and tf of all pairs of some bags."""
    raw = column.to_pylist()
    flat = np.frombuffer(b"".join(raw), "<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(raw)), [len(b) // 8 for b in raw]), flat[:, 0], flat[:, 1]


def document_frequencies(bagged: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary, by number; each task sends its sums alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            total += np.bincount(_pairs(batch.column("bag"))[1], minlength=size + 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    rows = bagged.select("bag").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size + 1, np.int64)
    out[rows["term"].to_numpy()] = rows["df"].to_numpy()
    return out


def weight(total: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


class _Best:
    """The best classes of each item so far, as arrays of item, score, doc_id and class."""

    def __init__(self, items: int, best: int):
        self.rows, self.size, self.best = [], 0, best
        self.least = np.ones(items, np.int64)  # scores below are out

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, number: np.ndarray) -> None:
        self.rows.append(np.stack([item, score, doc, number]))
        self.size += len(item)
        if self.size > HELD:
            self.merged()

    def merged(self) -> np.ndarray:
        held = np.concatenate([*self.rows, np.zeros((4, 0), np.int64)], 1)
        held = held[:, np.lexsort((held[2], -held[1], held[0]))]
        begins = np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]][: held.shape[1]])
        rank = np.arange(held.shape[1]) - np.repeat(begins, np.diff(np.r_[begins, held.shape[1]]))
        last = rank == self.best - 1
        self.least[held[0][last]] = held[1][last]
        held = held[:, rank < self.best]
        self.rows, self.size = [held], held.shape[1]
        return held


def _best_classes(classes: DataFrame, items: Items, weights: np.ndarray, best: int) -> DataFrame:
    """(item: number, class, doc_id: its least, score) of the best classes of each item in each task."""
    blocks = []
    for first in range(0, len(items.terms), ITEMS):
        terms = items.terms[first : first + ITEMS]
        used = np.unique(np.concatenate([*terms, np.zeros(0, np.int64)]))
        asked = np.zeros((len(used), len(terms)))
        for k, t in enumerate(terms):
            np.add.at(asked, (np.searchsorted(used, t), k), 1)
        at = np.nonzero(asked)
        blocks.append((first, used, len(terms), at, asked[at]))
    shared = classes.sparkSession.sparkContext.broadcast((blocks, weights, len(items.terms)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, weights, n = shared.value
        found = _Best(n, best)
        for batch in (b.slice(k, CLASSES) for b in batches for k in range(0, b.num_rows, CLASSES)):
            row, term, tf = _pairs(batch.column("bag"))
            m = batch.column("m").to_numpy()[row]
            gives = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            doc, number = batch.column("doc_id").fill_null(_LAST).to_numpy(), batch.column("class").to_numpy()
            for first, used, size, at, times in blocks:
                asked = np.zeros((len(used), size))
                asked[at] = times
                place = np.minimum(np.searchsorted(used, term), max(len(used) - 1, 0))
                mine = used[place] == term if len(used) else np.zeros(len(term), bool)
                held = np.zeros((batch.num_rows, len(used)))
                held[row[mine], place[mine]] = gives[mine]
                scores = held @ asked
                k, i = np.nonzero(scores >= found.least[first : first + size])
                found.add(first + i, scores[k, i].astype(np.int64), doc[k], number[k])
        held = found.merged()
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[3]), pa.array(held[2]), pa.array(held[1])], names=["item", "class", "doc_id", "score"])

    return classes.select("class", "m", "bag", "doc_id").mapInArrow(score, "item long, class long, doc_id long, score long")


def _ranked() -> Column:
    return F.row_number().over(W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))


def search(docs: DataFrame, items: DataFrame, best: int = BEST, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The `best` documents (doc_id: integer, text) with a score above 0 for each item (item_id, text): item_id, rank,
    doc_id, score.

    A null or empty text has no terms: such a document isn't counted or found, such an item finds nothing. Of equal
    scores the smaller doc_id ranks first, a null one last. Rows that repeat are documents or items of their own. Other
    columns aren't read; without documents or items there are no rows. Lengths and frequencies are exact 64-bit counts
    over all documents.
    """
    spark = docs.sparkSession
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    kind = items.schema["item_id"].dataType.simpleString()
    found = [_search(docs, Items.of(rows), best, kind) for rows in _blocks(items, item_bytes)]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def _search(docs: DataFrame, items: Items, best: int, kind: str) -> DataFrame:
    spark = docs.sparkSession
    bagged = stored(bags(docs, items.vocabulary))
    total, terms = bagged.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequencies = document_frequencies(bagged, len(items.vocabulary))
    weights = np.array([0, *(weight(total, int(df)) for df in frequencies[1:])], np.int64)
    m = F.expr(f"25L + (75L * n * {total}L) div {max(terms, 1)}L")
    measured = bagged.where(F.length("bag") > 0).select("doc_id", m.alias("m"), "bag")
    hashed = measured.select("doc_id", "m", "bag", F.md5(F.concat("bag", F.col("m").cast("string").cast("binary"))).alias("hash"))
    classes = hashed.groupBy("hash", "m", "bag").agg(F.min("doc_id").alias("doc_id")).withColumn("class", F.monotonically_increasing_id())
    classes = stored(classes)
    top = _best_classes(spread(classes), items, weights, best)
    top = stored(top.withColumn("doc_id", F.when(F.col("doc_id") < _LAST, F.col("doc_id"))).withColumn("at", _ranked()).where(F.col("at") <= best).select("item", "class", "score"))
    wanted = small(stored(classes.join(small(top.select("class").distinct(), BROADCAST_ROWS), "class").select("class", "hash", "m", "bag")), BROADCAST_ROWS // 16)
    members = hashed.join(wanted, ["hash", "m", "bag"]).select("class", "doc_id")
    members = members.withColumn("nth", F.row_number().over(W.partitionBy("class").orderBy(F.col("doc_id").asc_nulls_last()))).where(F.col("nth") <= best)
    named = spark.createDataFrame([(k, item) for k, item in enumerate(items.item_ids)], f"item long, item_id {kind}")
    ranked = members.join(top, "class").withColumn("rank", _ranked()).where(F.col("rank") <= best)
    return ranked.join(small(named, BROADCAST_ROWS), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: DuckDB SQL for the rows of `search(documents, benchmark)`.
SEARCH_SQL = rf"""
WITH doc AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
held AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM doc WHERE len(w) > 0),
asked AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(w) AS term FROM item) GROUP BY ALL),
counted AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM doc) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), held),
scored AS (SELECT item, item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms))))) AS BIGINT) AS score
  FROM counted JOIN weight USING (term) JOIN asked USING (term), held GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= {BEST}
"""

"""Vector code compression: product codes by k-means whose assignments are kept right with adaptive distance bounds.

A vector's components become integers, floor(256 x), and it is cut into `PARTS` equal consecutive parts, each with a
codebook of `ENTRIES` entries at its position. Each round assigns every part to its nearest entry and moves each entry
to the mean of its parts, rounded down; after the last round the parts are assigned once more.

Bounds after Drake and Hamerly: a part keeps its b closest entries, in the order of lower bounds on their distances,
and one outer bound below the distances to all others. When entries move, a bound falls by what its entry moved, the
outer one by the longest move. A part's own distance is then worked out anew: where it is less than the first bound, the
entry stays; where it is less than a later one, only the entries before that are measured; where it isn't even less than
the outer one, all are. b is adapted from round to round: to the least that the last round's parts needed, but for
one in `BEYOND`, and between an eighth and a quarter of the entries.

What is measured is measured in whole numbers, and a bound decides only if it is less by more than its rounding error,
so assignments and errors are exact. The parts' bounds are a table in the shared folder from round to round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import delete, small, spread, store, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: One part in so many may need more entries than it keeps, and then measures all.
BEYOND = 64
#: Integers are less than this, so that squared distances of vectors to 4,096 components are exact.
LEAST_TOO_LARGE = 1 << 24
#: Components that a task holds at once, and rows of a table of keys up to which it is broadcast.
HELD, BROADCAST_ROWS = 1 << 18, 200_000
#: Relative error that floating-point bounds allow for.
_SLACK = 1e-6


class Bounds(NamedTuple):
    """near: numbers of the closest entries of each part, its own first (rows, parts, b); low: lower bounds on the
    distances to the others of them, in order, and to all that aren't among them (rows, parts, b)."""

    near: np.ndarray
    low: np.ndarray

    def cut(self, b: int) -> Bounds:
        """Only the first b entries of each part; the bounds of the others become part of the outer one."""
        return Bounds(self.near[:, :, :b], np.concatenate([self.low[:, :, : b - 1], self.low[:, :, b - 1 :].min(2, keepdims=True)], 2))


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    out = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k, None] - book[None, :, k]
        out += d * d
    return out


def _below(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square) * (1 - _SLACK)


def measured(x: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """near, low and the own squared distance of one part of all rows, from the distances to all entries."""
    d, every = squares(x, book), np.arange(len(x))
    own = d.argmin(1)  # the lower of equal ones
    least = d[every, own]
    d[every, own] = -1
    b = min(b, len(book))
    near = np.argpartition(d, min(b, len(book) - 1), axis=1)
    far = _below(d[every, near[:, b]]) if b < len(book) else np.full(len(x), np.inf)
    near = near[:, :b]
    of = np.take_along_axis(d, near, 1)
    order = np.argsort(of, axis=1, kind="stable")
    low = np.c_[_below(np.take_along_axis(of, order, 1)[:, 1:]), far]
    return np.take_along_axis(near, order, 1), low, least


def reassigned(x: np.ndarray, book: np.ndarray, moved: np.ndarray, near: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`measured` for entries that have `moved` by so much at most, out of near and low before. Fourth: how many
    entries each row measured beside its own; all of those it keeps if it measured every one."""
    b, every = near.shape[1], np.arange(len(x))
    low = low - np.c_[moved[near[:, 1:]], np.full(len(x), moved.max())]
    low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1].copy()
    near = near.copy()
    d = x - book[near[:, 0]]
    least = (d * d).sum(1)
    up = np.sqrt(least) * (1 + _SLACK)
    needed = (low <= up[:, None]).sum(1)  # bounds are in order, so those are the first ones
    full = np.flatnonzero(needed == b)
    some = np.flatnonzero((needed > 0) & (needed < b))
    if len(some):
        mine, bound = near[some], np.c_[_below(least[some]), low[some][:, :-1]]
        best, at = least[some].copy(), np.zeros(len(some), np.int64)
        for k in range(1, int(needed[some].max()) + 1):
            rows = np.flatnonzero(needed[some] >= k)
            d = x[some[rows]] - book[mine[rows, k]]
            square = (d * d).sum(1)
            bound[rows, k] = _below(square)
            now = mine[rows, at[rows]]
            better = (square < best[rows]) | (square == best[rows]) & (mine[rows, k] < now)
            best[rows[better]], at[rows[better]] = square[better], k
        bound[np.arange(len(some)), at] = -1  # the own entry comes first
        order = np.argsort(bound, axis=1, kind="stable")
        near[some] = np.take_along_axis(mine, order, 1)
        # The outer bound stays; a bound beyond it is still one if it is lowered to it.
        low[some, :-1] = np.minimum(np.take_along_axis(bound, order, 1)[:, 1:], low[some, -1:])
        least[some] = best
    if len(full):
        near[full], low[full], least[full] = measured(x[full], book, b)
    return near, low, least, needed


def _rows(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, HELD // max(wide, 1))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def _array(column: pa.Array, kind: str, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector: little-endian 32-bit integers) of the rows whose vector and its components are all there
    and finite. Vectors must have one length, a multiple of the parts, and integers below LEAST_TOO_LARGE."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    kept = vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    kept = kept.select("vec_id", "label", F.when(F.exists("embedding", lambda x: F.abs(x) * SCALE >= LEAST_TOO_LARGE), F.raise_error(F.lit("a component is too large"))).otherwise(whole).alias("values"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("values")
            flat, ends = values.flatten().to_numpy().astype("<i4").tobytes(), np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) * 4
            vector = [flat[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)] if len(ends) else []
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(vector, pa.binary())], names=["vec_id", "label", "vector"])

    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(packed, f"vec_id {types['vec_id']}, label {types['label']}, vector binary")


def first_books(vectors: DataFrame, parts: int, entries: int, wide: int) -> np.ndarray:
    """Codebooks (parts, entries, components) of the vectors of the least vec_ids; a null id comes last, vectors of
    equal ids in the order of their bytes."""
    chosen = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    return np.stack([np.frombuffer(r.vector, "<i4") for r in chosen]).astype(np.int64).reshape(len(chosen), parts, wide // parts).transpose(1, 0, 2).copy()


def _assigned(state: DataFrame, books: np.ndarray, moved: np.ndarray | None, kept: int, b: int) -> DataFrame:
    """Each row's parts with bounds for the entries they are nearest to now; `kept` is the b of the state's bounds,
    and `moved` how far the entries are from where they were then."""
    parts, _, width = books.shape
    context = state.sparkSession.sparkContext
    shared = context.broadcast((books, moved))
    types = {f.name: f.dataType.simpleString() for f in state.schema}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moved = shared.value
        for chunk in _rows(batches, parts * max(width, books.shape[1])):
            x = _array(chunk.column("vector"), "<i4", (parts, width)).astype(np.int64)
            if moved is None:
                found = [(*measured(x[:, p], books[p], b), np.zeros(len(x), np.int64)) for p in range(parts)]
            else:
                old = Bounds(_array(chunk.column("near"), "<u2", (parts, kept)), _array(chunk.column("low"), "<f8", (parts, kept))).cut(b)
                found = [reassigned(x[:, p], books[p], moved[p], old.near[:, p].astype(np.int64), old.low[:, p]) for p in range(parts)]
            near, low, least, needed = (np.stack([f[k] for f in found], 1) for k in range(4))
            columns = [pa.array([bytes(r) for r in a.reshape(len(x), -1)], pa.binary()) for a in (near.astype("<u2"), low.astype("<f8"), needed.astype("<u2"))]
            yield pa.RecordBatch.from_arrays([chunk.column("vec_id"), chunk.column("label"), chunk.column("vector"), *columns, pa.array(least.sum(1))], names=["vec_id", "label", "vector", "near", "low", "needed", "error"])

    return state.mapInArrow(assign, f"vec_id {types['vec_id']}, label {types['label']}, vector binary, near binary, low binary, needed binary, error long")


def _sums(state: DataFrame, parts: int, entries: int, width: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of parts and their sums at each entry of each codebook, and how many parts needed how many entries; each
    task sends one row for each part's position."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total, needs = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64), np.zeros(b + 1, np.int64)
        for chunk in _rows(batches, parts * width):
            x = _array(chunk.column("vector"), "<i4", (parts, width)).astype(np.int64)
            own = _array(chunk.column("near"), "<u2", (parts, b))[:, :, 0].astype(np.int64)
            for p in range(parts):
                number[p] += np.bincount(own[:, p], minlength=entries)
                np.add.at(total[p], own[:, p], x[:, p])
            needs += np.bincount(_array(chunk.column("needed"), "<u2", (parts,)).reshape(-1), minlength=b + 1)
        flat = [np.r_[needs if p == 0 else 0 * needs, number[p], total[p].reshape(-1)].tolist() for p in range(parts)]
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(flat, pa.list_(pa.int64()))], names=["part", "sums"])

    rows = state.select("vector", "near", "needed").mapInArrow(add, "part int, sums array<long>")
    summed = rows.select("part", F.posexplode("sums")).where("col != 0").groupBy("part", "pos").agg(F.sum("col").alias("n")).collect()
    flat = np.zeros((parts, b + 1 + entries * (1 + width)), np.int64)
    for r in summed:
        flat[r.part, r.pos] = r.n
    return flat[:, b + 1 : b + 1 + entries], flat[:, b + 1 + entries :].reshape(parts, entries, width), flat[0, : b + 1]


def adapted(needs: np.ndarray, entries: int, b: int) -> int:
    """The entries to keep after a round in which `needs[k]` parts measured k, b being kept."""
    beyond = np.cumsum(needs[::-1])[::-1]  # parts that needed k or more
    least = 1 + int((beyond[1:] * BEYOND > needs.sum()).sum())
    return max(1, min(b, max(least, entries // 8)))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """A row for each kept vector (vec_id, embedding: array of numbers, label): vec_id, code, error, label_error,
    codebooks_sha256.

    Vectors that are null or hold a null or a component that isn't finite are dropped. A null vec_id is the greatest;
    rows that repeat are vectors of their own; with fewer vectors than entries the codebooks have as many entries as
    there are vectors. All vectors must be of one length, a multiple of `parts`. Null labels are one label, other
    columns aren't read, a table without kept vectors gives no rows. The codebooks, of fixed size, are the only
    broadcast; each task sends their sums alone.
    """
    spark = vectors.sparkSession
    state, path = store(spread(integers(vectors)))
    shape = state.agg(F.min(F.length("vector")).alias("least"), F.max(F.length("vector")).alias("most")).first()
    wide = (shape.most or 0) // 4
    if shape.least != shape.most or wide % parts:
        raise ValueError(f"vectors must have one length that is a multiple of {parts}")
    if shape.most is None:
        return state.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = first_books(state, parts, entries, wide)
    entries, width = books.shape[1], wide // parts
    kept = b = max(1, entries // 4)
    moved = None
    for _ in range(rounds):
        after, after_path = store(_assigned(state, books, moved, kept, b))
        delete(spark, path)
        state, path, kept = after, after_path, b
        number, total, needs = _sums(state, parts, entries, width, b)
        new = np.where(number[:, :, None] > 0, total // np.maximum(number, 1)[:, :, None], books)
        by = ((new - books).astype(np.float64) ** 2).sum(2) ** 0.5 * (1 + _SLACK)
        b = adapted(needs, entries, b) if moved is not None else b
        books, moved = new, by
    final = _assigned(state, books, moved, kept, b).select("vec_id", "label", "near", "error")
    types = {f.name: f.dataType.simpleString() for f in final.schema}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _array(batch.column("near"), "<u2", (parts, b))[:, :, 0] if batch.num_rows else np.zeros((0, parts), np.int64)
            text = ["".join(f"{k:02x}" for k in r) for r in own.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), batch.column("error")], names=["vec_id", "label", "code", "error"])

    coded = stored(final.mapInArrow(code, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    joined = coded.join(small(stored(sums), BROADCAST_ROWS), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the rows of `compress(embeddings)`, by measuring every distance, where vec_ids are unique."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM
  (SELECT part.vec_id, part.p, book{k}.e, list_sum(list_transform(list_zip(part.x, book{k}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM part JOIN book{k} USING (p)) GROUP BY vec_id, p)""")
        if k < rounds:
            steps.append(f"""mean{k} AS (SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS x FROM
  (SELECT p, e, i, sum(x[i])::DOUBLE AS s, count(*) AS n FROM near{k} JOIN part USING (vec_id, p), (SELECT unnest(range(1, w + 1)) AS i FROM wide) GROUP BY p, e, i) GROUP BY p, e)""")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{k}.x, book{k}.x) AS x FROM book{k} LEFT JOIN mean{k} USING (p, e))")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
wide AS (SELECT max(len(v)) // {parts} AS w FROM kept),
part AS MATERIALIZED (SELECT vec_id, p, v[p * w + 1 : (p + 1) * w] AS x FROM kept, wide, (SELECT unnest(range({parts})) AS p)),
book0 AS MATERIALIZED (SELECT p, n AS e, x FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM kept) USING (vec_id) WHERE n < {entries}),
{", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""

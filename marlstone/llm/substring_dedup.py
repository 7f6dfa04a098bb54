"""Substring dedup: removes the words of passages that stand earlier in the corpus already.

A word is a maximal run of bytes other than white space (20 and 09 to 0D, hexadecimal). A window is `SIZE`
consecutive words of one document; one whose word sequence also starts earlier, in a document of a smaller doc_id or
before in the same one, is a repeat, and all words that repeats cover go.

Documents are dealt into units of about `UNIT_BYTES` of text. What a window's hash says deals it to one of the
sketch's slices, whose number grows with the corpus, so no part of the sketch does.

First pass: each unit sends each slice its sketch, in sparse form (the codes of its distinct windows, 32 bits each, as
differences). A slice merges all units' sketches into a count-min table of saturating counters and tells each unit, by
a bit a window, which of its windows the table estimates to be in several units. An estimate is the least of several
counters, each at least the true number, so no repeat is lost; and windows that come twice in one unit need none.

Second pass: units send only the windows estimated as repeated, with 96 bits of hash besides those that chose the
slice, and the place where each starts first in the unit. The slice finds the first place of all exactly and tells each
unit, by a bit again, whether that is its own. A window that comes in every unit is one entry of each unit, however
often it comes there.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import as_bytes, chunks, mixed, pieces, spread, stored

SIZE = 20
#: Bytes of text in a unit, about (a longer text is one), and for each slice of the sketch.
UNIT_BYTES, SLICE_BYTES = 4 << 20, 16 << 20
#: Rows of a slice's count-min table, and counters in each: three times the windows of usual text in a slice.
ROWS, CELLS = 2, 1 << 23
#: Where a null doc_id stands in the order.
_LAST = np.iinfo(np.int64).max


class _Digests(dict):
    def __missing__(self, word: bytes) -> bytes:
        value = xxhash.xxh3_128_digest(word)
        if len(self) < 200_000 and len(word) <= 32:
            self[word] = value
        return value


def _digests(text: bytes, get) -> bytes:
    """16 bytes for each word."""
    return b"".join(b"".join(map(get, piece.split())) for piece in pieces(text))


def rolled(codes: np.ndarray, size: int, factor: int) -> np.ndarray:
    """A hash of the `size` codes from each position on, out of those of 1, 2, 4 and so on codes."""
    out, done, power, width = np.zeros(max(len(codes) - size + 1, 0), np.uint64), 0, codes, 1
    while width <= size and len(out):
        if size & width:
            out = out * np.uint64(pow(factor, width, 1 << 64)) + power[done : done + len(out)]
            done += width
        if 2 * width <= size:
            power = power[:-width] * np.uint64(pow(factor, width, 1 << 64)) + power[width:]
        width *= 2
    return mixed(out)


class Unit(NamedTuple):
    """The windows of some texts. order, rank: the rows by doc_id and each window's row in that order; start: the
    window's first word in its text; word: that in the stream of all words; kind: its number among the distinct
    windows; first: the place of each distinct window's first occurrence; low, high: their hashes."""

    order: np.ndarray
    doc_ids: np.ndarray
    n_words: np.ndarray
    rank: np.ndarray
    start: np.ndarray
    word: np.ndarray
    kind: np.ndarray
    first: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(texts: list[bytes], doc_ids: np.ndarray, size: int) -> Unit:
        # Rows of one id come in the order of their texts, so that a unit's windows have the same order in every pass.
        order = np.lexsort((np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64), doc_ids))
        get = _Digests().__getitem__
        digests = [_digests(texts[k], get) for k in order.tolist()]
        n_words = np.array([len(d) // 16 for d in digests], np.int64)
        codes = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
        del digests
        number = np.maximum(n_words - size + 1, 0)
        rank = np.repeat(np.arange(len(order)), number)
        start = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        word = start + (np.cumsum(n_words) - n_words)[rank]
        low = rolled(np.ascontiguousarray(codes[:, 0]), size, 0x9E3779B97F4A7C15)[word]
        high = rolled(np.ascontiguousarray(codes[:, 1]), size, 0xD6E8FEB86659FD93)[word]
        by = np.argsort(low, kind="stable")
        same = low[by][1:] == low[by][:-1]
        if (same & (high[by][1:] != high[by][:-1])).any():
            by = np.lexsort((high, low))
            same = (low[by][1:] == low[by][:-1]) & (high[by][1:] == high[by][:-1])
        new = np.r_[True, ~same][: len(by)]
        kind = np.empty(len(by), np.int64)
        kind[by] = np.cumsum(new) - 1
        first = by[new]
        return Unit(order, doc_ids[order], n_words, rank, start, word, kind, first, low[first], high[first])

    @property
    def codes(self) -> np.ndarray:
        return (self.low & np.uint64(0xFFFFFFFF)).astype("<u4")

    def slices(self, number: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each slice of the sketch with windows, and those among the distinct ones, in the order of their codes."""
        of = ((self.high >> np.uint64(32)) % np.uint64(number)).astype(np.int64)
        by = np.lexsort((self.first, self.codes, of))
        begins = np.flatnonzero(np.r_[True, of[by][1:] != of[by][:-1]][: len(by)])
        for a, b in zip(begins.tolist(), np.r_[begins[1:], len(by)][: len(begins)].tolist(), strict=True):
            yield int(of[by[a]]), by[a:b]


def _unit(held: pa.Table, size: int) -> Unit:
    ids = held.column("doc_id").combine_chunks()
    return Unit.of(as_bytes(held.column("text")), ids.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64), size)


def packed(values: np.ndarray) -> bytes:
    """32-bit values as differences, first all lowest bytes, then all second ones and so on: small ones compress well."""
    return np.diff(values, prepend=values.dtype.type(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(held: pa.Scalar) -> np.ndarray:
    planes = np.frombuffer(held.as_buffer(), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1), dtype=np.uint32)


def _cells(codes: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mixed(codes.astype(np.uint64) + np.uint64((row + 1) << 40)) % np.uint64(cells)).astype(np.int64)


def estimates(sketches: list[np.ndarray], rows: int = ROWS, cells: int = CELLS) -> list[np.ndarray]:
    """For each sparse sketch (distinct codes) whether the merged table counts each of its codes more than once."""
    least: list[np.ndarray] = [np.ones(len(x), bool) for x in sketches]
    for row in range(rows):
        table = np.zeros(cells, np.uint8)
        for codes in sketches:
            at = _cells(codes, row, cells)
            table[at] = np.minimum(table[at] + 1, 2)  # once a sketch: that counts no code less often than it comes
        for seen, codes in zip(least, sketches, strict=True):
            seen &= table[_cells(codes, row, cells)] > 1
    return least


_BITS = "unit long, slice int, step int, bits binary"


def _bits(held: pa.Table, step: int, bits: list[np.ndarray]) -> pa.Table:
    return pa.table({"unit": held.column("unit"), "slice": held.column("slice"), "step": pa.array([step] * len(bits), pa.int32()), "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})


def _merge(held: pa.Table) -> pa.Table:
    """First pass: the sketches of a slice."""
    held = held.combine_chunks()
    return _bits(held, 1, estimates([unpacked(x) for x in held.column("codes")]))


def _earliest(held: pa.Table) -> pa.Table:
    """Second pass: whether each window of each unit starts first there, among all units of a slice."""
    held = held.combine_chunks()
    number = [len(x.as_buffer()) // 8 for x in held.column("low")]
    low, high, doc = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in held.column(c)]) for c, kind in (("low", "<u8"), ("high", "<u4"), ("docs", "<i8")))
    start = np.concatenate([unpacked(x) for x in held.column("starts")]).astype(np.int64)
    by = np.argsort(low, kind="stable")
    same = low[by][1:] == low[by][:-1]
    if (same & (high[by][1:] != high[by][:-1])).any():  # hardly ever
        by = np.lexsort((high, low))
        same = (low[by][1:] == low[by][:-1]) & (high[by][1:] == high[by][:-1])
    begins = np.flatnonzero(np.r_[True, ~same])
    of = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(by)]))
    mine = doc[by] == np.minimum.reduceat(doc[by], begins)[of]
    least = np.minimum.reduceat(np.where(mine, start[by], _LAST), begins)[of]
    won = np.zeros(len(by), bool)
    won[by] = mine & (start[by] == least)
    return _bits(held, 2, np.split(won, np.cumsum(number)[:-1]))


def _told(held: pa.Table) -> dict[tuple[int, int], bytes]:
    return {(s, step): b for s, step, b in zip(*(held.column(c).to_pylist() for c in ("slice", "step", "bits")), strict=True)}


def _marked(told: dict[tuple[int, int], bytes], key: tuple[int, int], number: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(told.get(key, b""), np.uint8), count=number).astype(bool) if number else np.zeros(0, bool)


def _kept(text: bytes, gone: np.ndarray) -> bytes:
    """The words that aren't `gone`, joined by single spaces."""
    out, at = [], 0
    for piece in pieces(text):
        words = piece.split()
        mask = gone[at : at + len(words)]
        at += len(words)
        out += [w for w, g in zip(words, mask.tolist(), strict=True) if not g] if mask.any() else words
    return b" ".join(out)


def keep_first(docs: DataFrame, size: int = SIZE, unit_bytes: int = UNIT_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A row for each document (doc_id: integer, text): doc_id, n_words, n_removed, kept (the words left, joined by
    single spaces).

    A null text has no words, a text of fewer than `size` no windows. A null doc_id comes after all others. Rows of
    the same doc_id stand at the same place, so none of them is earlier than another by its row: windows that start at
    the same word of both are not repeats of one another. Other columns aren't read, an empty table gives no rows.
    Windows are taken for equal if 96 bits of two independent hashes over their words are, among
    the windows of one slice.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    slices = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // slice_bytes

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for chunk in chunks(batches, most=unit_bytes):
            unit = _unit(pa.Table.from_batches([chunk]), size)
            n = chunk.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.nulls(n, pa.int32()), chunk.column("doc_id"), chunk.column("text"), pa.nulls(n, pa.binary())], names=["unit", "slice", "doc_id", "text", "codes"])
            codes = unit.codes
            rows = [(s, packed(codes[at])) for s, at in unit.slices(slices)]
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array([r[0] for r in rows], pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["unit", "slice", "doc_id", "text", "codes"])
            number += 1

    def several(windows: Unit, told: dict[tuple[int, int], bytes], s: int, at: np.ndarray) -> np.ndarray:
        """Those of a slice's windows that are estimated to be in several units, by their places."""
        at = at[_marked(told, (s, 1), len(at))]
        return at[np.argsort(windows.first[at])]

    def repeated(unit: pa.Table, bits: pa.Table) -> pa.Table:
        told, rows = _told(bits), []
        number = unit.column("unit")[0].as_py()
        windows = _unit(unit, size)
        for s, at in windows.slices(slices):
            at = several(windows, told, s, at)
            if len(at):
                first = windows.first[at]
                rows.append((number, s, windows.low[at].tobytes(), windows.high[at].astype("<u4").tobytes(), windows.doc_ids[windows.rank[first]].tobytes(), packed(windows.start[first].astype(np.uint32))))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["unit", "slice", "low", "high", "docs", "starts"])

    def remove(unit: pa.Table, bits: pa.Table) -> pa.Table:
        told, windows = _told(bits), _unit(unit, size)
        mine = np.ones(len(windows.first), bool)  # whether the unit's first occurrence is the first of all
        for s, at in windows.slices(slices):
            at = several(windows, told, s, at)
            mine[at] = _marked(told, (s, 2), len(at))
        first = windows.first[windows.kind]
        stays = mine[windows.kind] & (windows.start == windows.start[first]) & (windows.doc_ids[windows.rank] == windows.doc_ids[windows.rank[first]])
        ends = np.cumsum(windows.n_words)
        gone, total = windows.word[~stays], int(ends[-1])
        covered = np.cumsum(np.bincount(gone, minlength=total + 1) - np.bincount(gone + size, minlength=total + 1))[:total] > 0
        texts = as_bytes(unit.column("text"))
        kept, removed = [], []
        for k, end, n in zip(windows.order.tolist(), ends.tolist(), windows.n_words.tolist(), strict=True):
            mask = covered[end - n : end]
            kept.append(_kept(texts[k], mask))
            removed.append(int(mask.sum()))
        ids = unit.column("doc_id").combine_chunks().take(pa.array(windows.order))
        return pa.table([ids, pa.array(windows.n_words), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string(), safe=False)], names=["doc_id", "n_words", "n_removed", "kept"])

    dealt = stored(spread(docs).mapInArrow(sketch, "unit long, slice int, doc_id long, text string, codes binary"))
    units = dealt.where("slice is null").select("unit", "doc_id", "text")
    estimated = stored(dealt.where("slice is not null").select("unit", "slice", "codes").groupBy("slice").applyInArrow(_merge, _BITS))
    again = units.groupBy("unit").cogroup(estimated.groupBy("unit")).applyInArrow(repeated, "unit long, slice int, low binary, high binary, docs binary, starts binary")
    first = stored(again.groupBy("slice").applyInArrow(_earliest, _BITS))
    return units.groupBy("unit").cogroup(estimated.unionAll(first).groupBy("unit")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document, by `keep_first`."""
    return keep_first(docs, size).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB SQL for the rows of `remove_repeats(documents)`, where doc_ids are unique.
REPEATS_SQL = rf"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, i, words[i : i + {SIZE - 1}] AS held FROM (SELECT doc_id, words, unnest(range(1, len(words) - {SIZE - 2})) AS i FROM doc)),
repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY held ORDER BY doc_id NULLS LAST, i) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {SIZE})) AS i FROM repeats),
listed AS (SELECT doc_id, list(i) AS places FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(places, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM doc LEFT JOIN listed USING (doc_id)
"""

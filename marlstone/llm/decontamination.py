"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

A benchmark that is too large to broadcast is a table of windows instead. A filter of bounded size over their hashes is
broadcast, so in one scan the documents hand on only windows that may be in it; those are joined to the table by hash
and words.

Words are maximal runs of letters a-z, digits and characters from U+0080, after A-Z are lower-cased. A window is
`size` consecutive words of an item; an item with fewer words, but not none, is one window. A document's word is
hit if it lies in any occurrence of a window in that document.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import as_bytes, chunks, mixed, pieces, set_aside, set_columns, spread, stored

#: Bytes of item texts whose windows are broadcast at most, about 40 MB in a worker; those of a larger benchmark are
#: joined.
BLOCK_BYTES = 4 << 20
#: Bits of the filter for each window of such a benchmark, at most as many bits as this, in parts of so many.
WINDOW_BITS, FILTER_BITS, PART_BITS = 16, 1 << 29, 1 << 19

_KEPT = re.compile(rb"[0-9A-Za-z\x80-\xff]")
_LOWER = bytes(ord(chr(c).lower()) if _KEPT.match(bytes([c])) and c < 128 else c if c >= 128 else 32 for c in range(256))
_SPANS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


class Windows:
    """The windows of a block of items. The items' words are numbers in one array; per length, sorted hashes of the
    windows with a small table that rules most positions out, and for each window a place where it stands in that
    array, for the exact check, and the items that hold it."""

    def __init__(self, items: list[tuple[Any, bytes]], size: int):
        self.names = [item for item, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        number = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32) for _, text in items]
        self.flat = np.concatenate([*number, np.zeros(0, np.int32)])
        self.codes = mixed(np.arange(len(self.vocabulary) + 1, dtype=np.uint64) + np.uint64(1))
        n = np.array([len(x) for x in number], np.int64)
        begins, lengths = np.cumsum(n) - n, np.minimum(n, size)
        self.lengths = {int(length): self._entries(int(length), np.flatnonzero(lengths == length), begins, n) for length in np.unique(lengths[lengths > 0])}

    def _entries(self, length: int, items: np.ndarray, begins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        each = n[items] - length + 1
        owner = np.repeat(items, each)
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + begins[owner]
        hashes = self._rolled(self.codes[self.flat], length)[at]
        order = np.lexsort((owner, hashes))
        hashes, at, owner = hashes[order], at[order], owner[order]
        new = np.ones(len(at), bool)  # neighbours of equal hash and words are one window
        if len(at):
            new[1:] = (hashes[1:] != hashes[:-1]) | ~self._equal(self.flat, at[1:], at[:-1], length)
        first = np.flatnonzero(new)
        table = np.zeros(1 << 20, bool)
        table[hashes >> np.uint64(44)] = True
        return hashes[first], table, at[first].astype(np.int32), np.r_[first, len(at)].astype(np.int32), owner.astype(np.int32)

    def _equal(self, words: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the windows of `words` from a are those of the items' words from b."""
        same = np.ones(len(a), bool)
        for k in range(length):
            same &= words[a + k] == self.flat[b + k]
        return same

    @staticmethod
    def _rolled(codes: np.ndarray, length: int) -> np.ndarray:
        """A hash of the `length` codes from each position on."""
        n = len(codes) - length + 1
        total = np.zeros(max(n, 0), np.uint64)
        for k in range(length if n > 0 else 0):
            total *= np.uint64(0x9E3779B97F4A7C15)
            total += codes[k : k + n]
        return mixed(total)

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set]]]:
        """The texts' numbers of words; by number of the text, of those that are hit: word spans of the occurrences,
        and the items."""
        get, parts, n = self.vocabulary.get, [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            for piece in pieces(text):
                words = words_of(piece)
                parts.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
                n[k] += len(words)
        ids, ends = np.concatenate(parts), np.cumsum(n)
        codes, found = self.codes[ids], defaultdict(lambda: ([], set()))
        for length, (hashes, table, places, offsets, owners) in self.lengths.items():
            rolled = self._rolled(codes, length)
            near = np.flatnonzero(table[rolled >> np.uint64(44)])
            entry, stop = (np.searchsorted(hashes, rolled[near], side) for side in ("left", "right"))
            text_of = np.searchsorted(ends, near, side="right")
            whole = near + length <= ends[text_of] if len(near) else np.zeros(0, bool)
            while (live := (entry < stop) & whole).any():
                near, entry, stop, text_of, whole = near[live], entry[live], stop[live], text_of[live], whole[live]
                hit = self._equal(ids, near, places[entry], length)
                for at, owner, e in zip(near[hit].tolist(), text_of[hit].tolist(), entry[hit].tolist(), strict=True):
                    start = at - int(ends[owner] - n[owner])
                    found[owner][0].append((start, start + length))
                    found[owner][1].update(self.names[i] for i in owners[offsets[e] : offsets[e + 1]].tolist())
                entry = entry + 1
        return n, found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


ADDED = ("n_words", "hit_spans", "hit_items")


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with n_words, hit_spans (disjoint word spans, stop exclusive) and hit_items (sorted item ids as text).

    Added columns replace those of the same name. A null text has no words, a null item id is the text "null",
    items that repeat count once, an empty benchmark hits nothing. The documents are read once, whatever the size of the
    benchmark: they stream past the broadcast windows, or past a filter of theirs, and then only what passes it is
    shuffled, and joined to the documents again.
    """
    kept = spread(docs.drop(*ADDED))
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    schema = (fields and fields + ", ") + _ADDED_TYPES
    context = docs.sparkSession.sparkContext
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) <= block_bytes:
        shared = context.broadcast(_windows([(r.item_id, bytes(r.text)) for r in items.collect()], size))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in chunks(batches):
                n, found = shared.value.scan(as_bytes(chunk.column("text")))
                yield _with_hits(chunk, n, [found[k] if k in found else ([], ()) for k in range(len(n))])

        return kept.mapInArrow(scan, schema)

    aside, back = set_aside(kept, ("__row", "__spans", "__items"))
    numbered = stored(aside.withColumn("__row", F.monotonically_increasing_id()))
    hits = _joined_hits(numbered, items, size)
    joined = numbered.join(hits, "__row", "left").select(*back, "__spans", "__items")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            n = np.array([sum(len(words_of(p)) for p in pieces(t)) for t in as_bytes(chunk.column("text"))], np.int64)
            spans, items = (chunk.column(c).to_pylist() for c in ("__spans", "__items"))
            yield _with_hits(chunk.drop_columns(["__spans", "__items"]), n, [([(x["start"], x["stop"]) for x in s or []], i or ()) for s, i in zip(spans, items, strict=True)])

    return joined.mapInArrow(finish, schema)


_ADDED_TYPES = "n_words long, hit_spans array<struct<start:int,stop:int>>, hit_items array<string>"


def _windows(items: list[tuple[Any, bytes]], size: int) -> Windows:
    return Windows([("null" if i is None else str(i), t) for i, t in items], size)


def _with_hits(chunk: pa.RecordBatch, n: np.ndarray, hits: list[tuple[list[tuple[int, int]], Any]]) -> pa.RecordBatch:
    spans = [[{"start": a, "stop": b} for a, b in _merged(s)] for s, _ in hits]
    return set_columns(chunk, {"n_words": pa.array(n), "hit_spans": pa.array(spans, _SPAN_TYPE), "hit_items": pa.array([sorted(set(i)) for _, i in hits], pa.list_(pa.string()))})


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000 and len(word) <= 32:
            self[word] = value
        return value


_WINDOW = "length int, hash long, words binary"


def _window_rows(words: list[bytes], at: np.ndarray, length: int, hashes: np.ndarray) -> list[pa.Array]:
    held = [b" ".join(words[k : k + length]) for k in at.tolist()]
    return [pa.array(np.full(len(at), length, np.int32)), pa.array(hashes[at].view(np.int64)), pa.array(held, pa.binary())]


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(length, hash, words, items) of the distinct windows of items (item_id, text), stored; `items` as text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for chunk in chunks(batches):
            for item, text in zip(chunk.column("item_id").to_pylist(), as_bytes(chunk.column("text")), strict=True):
                words = words_of(text)
                length = min(size, len(words))
                if length:
                    hashes = Windows._rolled(np.fromiter(map(codes.__getitem__, words), np.uint64, len(words)), length)
                    rows = _window_rows(words, np.arange(len(hashes)), length, hashes)
                    yield pa.RecordBatch.from_arrays([*rows, pa.array(["null" if item is None else str(item)] * len(hashes), pa.string())], names=["length", "hash", "words", "item"])

    rows = spread(items).mapInArrow(cut, f"{_WINDOW}, item string")
    return stored(rows.groupBy("length", "hash", "words").agg(F.collect_set("item").alias("items")))


def window_filter(windows: DataFrame) -> np.ndarray:
    """A bitset, as bytes, that has the bits of every window's hash: two bits in the part that the highest bits of the
    hash choose. Each part is made in one task; together they have at most FILTER_BITS."""
    wanted = min(max(windows.count() * WINDOW_BITS, PART_BITS), FILTER_BITS)
    number = 1 << ((wanted - 1) // PART_BITS).bit_length()

    def fill(held: pa.Table) -> pa.Table:
        bits = np.zeros(PART_BITS, bool)
        for at in _bits_in_part(held.column("hash").to_numpy().view(np.uint64), len(bits)):
            bits[at] = True
        return pa.table({"part": held.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    part = F.shiftrightunsigned("hash", 64 - number.bit_length() + 1) if number > 1 else F.lit(0).cast("long")
    parts = windows.select(part.alias("part"), "hash").groupBy("part").applyInArrow(fill, "part long, bits binary").toArrow()
    out = np.zeros((number, PART_BITS // 8), np.uint8)
    for k, bits in zip(parts["part"].to_pylist(), parts["bits"].to_pylist(), strict=True):
        out[k] = np.frombuffer(bits, np.uint8)
    return out


def _bits_in_part(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes % np.uint64(size)).astype(np.int64), (mixed(hashes) % np.uint64(size)).astype(np.int64)


def passing(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the `window_filter` may have each hash."""
    part = (hashes >> np.uint64(64 - len(held).bit_length() + 1)).astype(np.int64) if len(held) > 1 else np.zeros(len(hashes), np.int64)
    out = np.ones(len(hashes), bool)
    for at in _bits_in_part(hashes, 8 * held.shape[1]):
        out &= (held[part, at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return out


def _joined_hits(numbered: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(__row, __spans, __items) of the documents that windows of the items hit, by one scan and a join."""
    windows = item_windows(items, size)
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())
    shared = numbered.sparkSession.sparkContext.broadcast(window_filter(windows))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for chunk in chunks(batches):
            for row, text in zip(chunk.column("__row").to_pylist(), as_bytes(chunk.column("text")), strict=True):
                words = [w for piece in pieces(text) for w in words_of(piece)]
                coded = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
                for length in lengths:
                    hashes = Windows._rolled(coded, length)
                    at = np.flatnonzero(passing(shared.value, hashes))
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row, np.int64)), pa.array(at.astype(np.int32)), *_window_rows(words, at, length, hashes)], names=["__row", "start", "length", "hash", "words"])

    found = numbered.select("__row", "text").mapInArrow(scan, f"__row long, start int, {_WINDOW}").join(windows, ["length", "hash", "words"])
    span = F.struct("start", (F.col("start") + F.col("length")).alias("stop"))
    return found.groupBy("__row").agg(F.collect_list(span).alias("__spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("__items"))


def n_hit() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, s: total + (s["stop"] - s["start"]))


def contaminated() -> Column:
    return (n_hit() > 0) & (n_hit() * 20 >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document: counts of words and hits, the items, and whether a twentieth of its words is hit."""
    found = find_hits(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def drop_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the contaminated ones; columns and types stay as they are. A null or empty text has no words and
    stays, as do all documents under an empty benchmark; repeated rows share their fate."""
    aside, back = set_aside(docs, ADDED)
    return find_hits(aside, benchmark).where(~contaminated()).select(*back)


def _without(text: bytes, spans: list[dict[str, int]]) -> bytes:
    places = [m.span() for m in _SPANS.finditer(text)]
    for s in reversed(spans):
        text = text[: places[s["start"]][0]] + text[places[s["stop"] - 1][1] :]
    return text


def cut_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` with every hit passage, from its first letter to its last, cut out of the text; every row stays, a text
    without hits, null or empty as it is."""
    aside, back = set_aside(docs, ADDED)
    found, names = find_hits(aside, benchmark), aside.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            texts = chunk.column("text").cast(pa.binary()).to_pylist()
            left = [_without(t, s) if s else t for t, s in zip(texts, chunk.column("hit_spans").to_pylist(), strict=True)]
            kept = {n: chunk.column(i) for i, n in enumerate(chunk.schema.names)}
            yield pa.RecordBatch.from_pydict({n: kept[n] if n != "text" else pa.array(left, pa.binary()).cast(pa.string()) for n in names})

    return found.mapInArrow(cut, aside.schema).select(*back)


#: DuckDB SQL for the rows of `report(documents, benchmark)`.
REPORT_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_window AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item, w, least(13, len(w)) AS n FROM item WHERE len(w) > 0))),
size AS (SELECT DISTINCT n FROM item_window),
doc_window AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item FROM doc_window JOIN item_window USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

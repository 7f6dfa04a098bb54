"""Near-duplicate groups: improved consistent weighted sampling over TF-IDF shingles, banded, then verified.

A text's shingles are its runs of five normalised words (fewer words, but not none, are one shingle). A shingle
weighs (1 + ln tf) times its inverse document frequency, which is the mean of its words': ln(1 + N / df), df being the
exact number of all N documents with the word, as a share of what it is for words in one of `COMMON` documents, at
most 1. The words' frequencies are taken rather than the shingle's own, as the shingles of n near copies have a
frequency of n or so: those would weigh least of all, what the copies changed most, and the larger a group of near
copies, the sooner it would come apart.

Each shingle goes to one of `BINS` bins and draws Ioffe's variates there; a bin's least draw is its consistent
weighted sample, and an empty bin borrows one by a fixed permutation. `ROWS` bins make a band. Equal texts are one
class from the start.

The classes that share a band are a bucket. Some bands at a time, a bucket's most copied class meets the members that
links haven't joined to it yet: their exact weighted Jaccard similarity is computed from the texts, and links join
classes into groups, so a large group is joined in the first round, by about one comparison a member.

What is left, texts that share a bucket with a text of another group, goes through a similarity join. Each text's
shingles are put in the order of their rarity among those texts. Two texts that are similar enough share a shingle of
their prefixes, the rarest fifth by weight, and what each has from the first such shingle on weighs enough for both:
so a text without such a partner in another group is left out (`_postings`, `_alive`). Texts that have only boilerplate
in common differ in their rare shingles, so they go here, without being compared. Of the others each meets one
partner, the one of whose weight least stands before the shared shingle, twice; then those that still have partners in
other groups are compared with all members of their buckets, in blocks of bounded size. The groups thus contain those
of comparing all pairs of each bucket, though only links between groups are looked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import as_bytes, chunks, delete, mixed, pieces, scratch, set_aside, small, spread, store, stored
from marlstone.llm.decontamination import words_of

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
BINS = BANDS * ROWS
#: Words in fewer than 1 / COMMON of all documents have the full inverse document frequency. The others, at most
#: COMMON times the mean number of distinct words of a document, are broadcast.
COMMON = 1024
#: The bands of each round of meetings with a bucket's first class.
ROUNDS = (range(0, 4), range(4, BANDS))
#: Bytes and number of the texts of one side of a block, about.
BLOCK_BYTES, BLOCK_TEXTS = 4_000_000, 1024
#: Rows of 16-byte keys and ids up to which a side is broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 200_000
#: Distinct words whose counts a task holds before it sends them on.
HELD = 1_000_000
#: Bytes of text whose shingles are counted as a unit, and for each slice that the counts are dealt into, about.
UNIT_BYTES, SLICE_BYTES = 2 << 20, 16 << 20
#: Meetings of each text with its likeliest partner by rare shingles.
PARTNERS = 2

_PERMUTED = np.argsort(mixed(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(17)).reshape(BINS, BINS), axis=1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000 and len(word) <= 32:
            self[word] = value
        return value


def word_codes(texts: list[bytes], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words, text after text, and the number of words of each text."""
    get, parts, lengths = hashes.__getitem__, [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        for piece in pieces(text):
            words = words_of(piece)
            parts.append(np.fromiter(map(get, words), np.uint64, len(words)))
            lengths[k] += len(words)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), lengths


class Weights:
    """Inverse document frequencies of words by hash; those that aren't listed have 1."""

    def __init__(self, hashes: np.ndarray | None = None, idf: np.ndarray | None = None):
        order = np.argsort(hashes) if hashes is not None else []
        self.hashes = hashes[order] if len(order) else np.zeros(0, np.uint64)
        self.idf = idf[order] if len(order) else np.zeros(0)

    def of(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(codes))
        at = np.minimum(np.searchsorted(self.hashes, codes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == codes, self.idf[at], 1.0)


class Shingles(NamedTuple):
    """Distinct shingles, text after text: hashes, counts, inverse document frequencies; the number of each text."""

    found: np.ndarray
    counts: np.ndarray
    idf: np.ndarray
    number: np.ndarray

    @property
    def weight(self) -> np.ndarray:
        return self.idf * (1 + np.log(self.counts))

    @staticmethod
    def joined(parts: list[Shingles]) -> Shingles:
        return Shingles(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def shingles(texts: list[bytes], hashes: _Hashes, weights: Weights) -> Shingles:
    codes, lengths = word_codes(texts, hashes)
    n = np.where(lengths >= WORDS, lengths - WORDS + 1, np.minimum(lengths, 1))
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    short = np.repeat(lengths, n)
    own = np.concatenate([weights.of(codes), np.zeros(WORDS)])
    codes = np.concatenate([codes, np.zeros(WORDS, np.uint64)])
    found, idf = np.zeros(len(at), np.uint64), np.zeros(len(at))
    for k in range(WORDS):
        found = found * np.uint64(0x9E3779B97F4A7C15) + np.where(k < short, codes[at + k], np.uint64(0))
        idf += np.where(k < short, own[at + k], 0.0)
    found, idf = mixed(found), idf / np.minimum(short, WORDS)
    order = np.argsort(mixed(found + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), kind="stable")
    found, owner = found[order], owner[order]
    first = np.flatnonzero(np.r_[True, (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])][: len(found)])
    counts = np.diff(np.r_[first, len(found)])
    found, owner, idf = found[first], owner[first], idf[order][first]
    order = np.argsort(owner, kind="stable")
    return Shingles(found[order], counts[order], idf[order], np.bincount(owner, minlength=len(texts)))


def all_shingles(texts: list[bytes], hashes: _Hashes, weights: Weights) -> Shingles:
    """`shingles`, with the words of half a MB or so held at once."""
    taken, block = [], 0
    while block < len(texts):
        stop, size = block, 0
        while stop < len(texts) and (stop == block or size + len(texts[stop]) <= BLOCK_BYTES // 8):
            size += len(texts[stop])
            stop += 1
        taken.append(shingles(texts[block:stop], hashes, weights))
        block = stop
    return Shingles.joined(taken)


def _uniforms(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform variates in (0, 1) from the halves of 64 bits."""
    return ((h >> np.uint64(32)).astype(np.float64) + 0.5) / 2**32, ((h & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) / 2**32


def samples(s: Shingles) -> np.ndarray:
    """A row of BINS consistent weighted samples for each text with shingles; zeros for one without."""
    out = np.zeros((len(s.number), BINS), np.uint64)
    if not len(s.found):
        return out
    owner = np.repeat(np.arange(len(s.number)), s.number)
    h = mixed(s.found + np.uint64(0x632BE59BD9B4E019))
    a, b = _uniforms(mixed(h + np.uint64(1)))
    c, d = _uniforms(mixed(h + np.uint64(2)))
    beta, _ = _uniforms(mixed(h + np.uint64(3)))
    r = -np.log(a * b)
    t = np.floor(np.log(s.weight) / r + beta)
    draw = np.log(-np.log(c * d)) - r * (t - beta + 1)
    bits = draw.astype(np.float32).view(np.uint32)
    bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))  # in the order of the floats
    cell = owner * BINS + (h % np.uint64(BINS)).astype(np.int64)
    order = np.argsort((cell.astype(np.uint64) << np.uint64(32)) | bits, kind="stable")
    first = order[np.flatnonzero(np.r_[True, cell[order][1:] != cell[order][:-1]])]
    flat = out.reshape(-1)
    flat[cell[first]] = mixed(s.found[first] + t[first].astype(np.int64).view(np.uint64) * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
    empty = np.flatnonzero((flat == 0) & np.repeat(s.number > 0, BINS))
    row, column = empty // BINS, empty % BINS
    filled = out.copy()
    for k in range(BINS):
        if not len(row):
            break
        value = out[row, _PERMUTED[column, k]]
        filled[row, column] = value
        left = value == 0
        row, column = row[left], column[left]
    return filled


def bands(sampled: np.ndarray) -> np.ndarray:
    """The BANDS band hashes of each row of samples."""
    total = np.zeros((len(sampled), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + sampled[:, k::ROWS])
    return total


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of (sorted hashes, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    both = np.minimum(a[1][hit], b[1][at[hit]]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def text_key() -> Column:
    """128 bits that stand for the text; a null one is empty."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def word_weights(docs: DataFrame) -> Weights:
    """Inverse document frequencies from the exact counts of every word over all documents, whatever their layout."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = _Hashes(), [], 0

        def sums() -> tuple[np.ndarray, np.ndarray]:
            words, place = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return words, np.bincount(place, np.concatenate([h[1] for h in held])).astype(np.int64)

        for chunk in chunks(batches):
            codes, lengths = word_codes(as_bytes(chunk.column("text")), hashes)
            owner = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
            order = np.lexsort((codes, owner))
            codes, owner = codes[order], owner[order]
            first = np.r_[True, (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])][: len(codes)]
            held.append(np.unique(codes[first], return_counts=True))
            size += len(held[-1][0])
            if size > HELD:
                held = [sums()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["word", "df"])
                    held, size = [], 0
        if held:
            words, df = sums()
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(df)], names=["word", "df"])

    total = docs.count()
    often = docs.select("text").mapInArrow(count, "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).where(F.col("df") * COMMON > total).toArrow()
    return Weights(often["word"].to_numpy().view(np.uint64), np.log1p(total / often["df"].to_numpy()) / np.log1p(COMMON))


def sketches(docs: DataFrame, weights: Weights) -> DataFrame:
    """(key, doc_id, bands) of each document; a text without words has no bands."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for chunk in chunks(batches):
            found = shingles(as_bytes(chunk.column("text")), hashes, shared.value)
            hashed, some = bands(samples(found)).view(np.int64), found.number > 0
            offsets = np.r_[0, np.cumsum(np.where(some, BANDS, 0))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([chunk.column("key"), chunk.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashed[some].reshape(-1)))], names=["key", "doc_id", "bands"])

    return docs.select(text_key().alias("key"), "doc_id", "text").mapInArrow(sketch, f"key binary, doc_id {kind}, bands array<long>")


def _linked(pairs: DataFrame, texts: DataFrame, weights: Weights, least: float) -> DataFrame:
    """Of `pairs` (a, b) those whose `texts` (key, text) are similar by at least `least`."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        last: tuple[bytes, tuple[np.ndarray, np.ndarray]] = b"", (np.zeros(0), np.zeros(0))

        def weighed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
            s = shingles([text], hashes, shared.value)
            order = np.argsort(s.found)
            return s.found[order], s.weight[order]

        for chunk in chunks(batches, "text_a"):
            keep = []
            for key, a, b in zip(chunk.column("b").to_pylist(), as_bytes(chunk.column("text_a")), as_bytes(chunk.column("text_b")), strict=True):
                if key != last[0]:
                    last = key, weighed(b)
                keep.append(similarity(weighed(a), last[1]) >= least)
            yield pa.RecordBatch.from_arrays([chunk.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a binary, b binary")


def _overlaps(sides: list[tuple[Shingles, np.ndarray]], shape: tuple[int, int]) -> np.ndarray:
    """Sums of the lesser weights of shared shingles, of each text of one side with each of the other. A side is its
    shingles and their rows."""
    out = np.zeros(shape)
    names, first_at, place = np.unique(np.concatenate([s.found for s, _ in sides]), return_index=True, return_inverse=True)
    idf = np.concatenate([s.idf for s, _ in sides])[first_at]
    place = np.split(place, [len(sides[0][0].found)])
    n = [np.bincount(at, minlength=len(names)) for at in place]
    for dense in (False, True):
        # Shingles of few pairs are summed pair by pair, those of many as products of matrices.
        pairs = n[0] * n[1]
        wanted = (pairs > 0) & ((pairs > 0.02 * out.size) == dense)
        number = np.cumsum(wanted) - 1
        chosen = []
        for (s, rows), at in zip(sides, place, strict=True):
            kept = np.flatnonzero(wanted[at])
            kept = kept[np.argsort(at[kept], kind="stable")]
            chosen.append((number[at[kept]], s.weight[kept], s.counts[kept], rows[kept]))
        (f, wa, ca, ra), (g, wb, cb, rb) = chosen
        first, size = np.searchsorted(g, np.arange(wanted.sum() + 1)), n[1][wanted]
        if not dense:
            ends = np.cumsum(size[f])
            start = 0
            while start < len(f):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 2_000_000)))
                reps = size[f[start:stop]]
                i = np.repeat(np.arange(start, stop), reps)
                j = np.arange(len(i)) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(first[f[start:stop]], reps)
                out += np.bincount(ra[i] * shape[1] + rb[j], np.minimum(wa[i], wb[j]), out.size).reshape(shape)
                start = stop
            continue
        shared = idf[wanted]
        first_a = np.searchsorted(f, np.arange(len(shared) + 1))
        for low in range(0, len(shared), 1024):
            high = min(low + 1024, len(shared))
            left, right = np.zeros((shape[0], high - low)), np.zeros((shape[1], high - low))
            x, y = slice(first_a[low], first_a[high]), slice(first[low], first[high])
            left[ra[x], f[x] - low] = shared[f[x]]
            right[rb[y], g[y] - low] = 1
            out += left @ right.T
        # What a shingle that repeats weighs beyond its first occurrence.
        for k in np.intersect1d(f[ca > 1], g[cb > 1]):
            x, y = (np.arange(s[k], s[k + 1]) for s in (first_a, first))
            x, y = x[ca[x] > 1], y[cb[y] > 1]
            out[np.ix_(ra[x], rb[y])] += shared[k] * np.minimum.outer(np.log(ca[x]), np.log(cb[y]))
    return out


def crossing(texts: list[bytes], roots: list[bytes], side: np.ndarray | None, weights: Weights, least: float, hashes: _Hashes) -> list[tuple[int, int]]:
    """Links between texts of different roots, enough to join all that are similar by at least `least`: texts of one
    side with those of the other, or, without sides, all of them."""
    s = all_shingles(texts, hashes, weights)
    weight, owner = s.weight, np.repeat(np.arange(len(texts)), s.number)
    total, ends = np.bincount(owner, weight, minlength=len(texts)), np.cumsum(s.number)
    names = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    group = np.array([names[r] for r in roots])
    joined = list(range(len(names)))

    def top(k: int) -> int:
        while joined[k] != k:
            joined[k] = joined[joined[k]]
            k = joined[k]
        return k

    def one(k: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(ends[k] - s.number[k], ends[k])
        order = np.argsort(s.found[span])
        return s.found[span][order], weight[span][order]

    out = []
    sets = [np.arange(len(texts))] * 2 if side is None else [np.flatnonzero(~side), np.flatnonzero(side)]
    blocks = [[rows[k : k + BLOCK_TEXTS] for k in range(0, len(rows), BLOCK_TEXTS)] for rows in sets]
    for rows in blocks[0]:
        for columns in blocks[1]:
            if side is None and rows[0] > columns[0]:
                continue
            sides = []
            for chosen in (rows, columns):
                at = np.full(len(texts), -1)
                at[chosen] = np.arange(len(chosen))
                mine = np.flatnonzero(at[owner] >= 0)
                sides.append((Shingles(s.found[mine], s.counts[mine], s.idf[mine], s.number), at[owner[mine]]))
            both = _overlaps(sides, (len(rows), len(columns)))
            ratio = both / np.maximum(total[rows][:, None] + total[columns][None, :] - both, 1e-300)
            near = (ratio >= least - 1e-9) & (group[rows][:, None] != group[columns][None, :])
            for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                a, b = int(rows[i]), int(columns[j])
                if top(group[a]) == top(group[b]) or ratio[i, j] < least + 1e-9 and similarity(one(a), one(b)) < least:
                    continue
                joined[top(group[a])] = top(group[b])
                out.append((a, b))
    return out


def _crossing(members: DataFrame, texts: DataFrame, roots: DataFrame, weights: Weights, least: float) -> DataFrame:
    """Verified links (a, b) between all `members` (key, band, bytes) of a bucket that have different `roots`."""
    named = stored(_rooted(members, roots).select("key", "band", "bytes", "root"))
    groups = named.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    # The group with most members is the bucket's main one; its members aren't compared with one another.
    buckets = groups.groupBy("band").agg(F.max(F.struct("n", "bytes", "root")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("n > main.n")
    lanes = lambda n, size: F.greatest(F.ceil(n / BLOCK_TEXTS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    other = F.col("n") - F.col("main.n")
    buckets = stored(buckets.select("band", F.col("main.root").alias("main"), lanes(F.col("main.n"), F.col("main.bytes")).alias("mains"), lanes(other, F.col("bytes") - F.col("main.bytes")).alias("others"), (other > 1).alias("several")))
    rows = named.join(small(buckets, BROADCAST_ROWS), "band").withColumn("in_main", F.col("root") == F.col("main"))
    lane = F.pmod(F.xxhash64("key"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    rows = rows.withColumn("lane", lane).join(texts, "key")
    block = lambda across, x, y, side: F.struct(F.lit(across).alias("across"), x.alias("x"), y.alias("y"), side.alias("side"))
    up_to = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    mine = F.col("lane")
    from_main = F.transform(up_to("others"), lambda k: block(True, k, mine, F.lit(True)))
    with_main = F.transform(up_to("mains"), lambda k: block(True, mine, k, F.lit(False)))
    with_others = F.transform(up_to("others"), lambda k: block(False, F.least(k, mine), F.greatest(k, mine), mine > k))
    blocks = F.when(F.col("in_main"), from_main).when(F.col("several"), F.concat(with_main, with_others)).otherwise(with_main)
    dealt = rows.select("band", "key", "root", "text", F.explode(blocks).alias("at")).select("band", "at.*", "key", "root", "text")
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def compare(held: pa.Table) -> pa.Table:
        held = held.sort_by("key").combine_chunks()
        keys, inside = held.column("key").to_pylist(), not held.column("across")[0].as_py() and held.column("x")[0] == held.column("y")[0]
        side = None if inside else held.column("side").to_numpy().astype(bool)
        pairs = crossing(as_bytes(held.column("text")), held.column("root").to_pylist(), side, shared.value, least, _Hashes())
        ends = [(max(keys[a], keys[b]), min(keys[a], keys[b])) for a, b in pairs]
        return pa.table({"a": pa.array([e[0] for e in ends], pa.binary()), "b": pa.array([e[1] for e in ends], pa.binary())})

    return dealt.groupBy("band", "across", "x", "y").applyInArrow(compare, "a binary, b binary").distinct()


class _Counted(NamedTuple):
    """A unit's texts by key with their shingles, and its distinct shingles in slices: of, at: slice and place of each
    among `distinct`, slice after slice; place: each shingle's among `distinct`."""

    keys: list[bytes]
    shingles: Shingles
    distinct: np.ndarray
    place: np.ndarray
    of: np.ndarray
    at: np.ndarray

    @staticmethod
    def of_rows(keys: list[bytes], texts: list[bytes], weights: Weights, slices: int) -> _Counted:
        order = sorted(range(len(keys)), key=keys.__getitem__)
        s = all_shingles([texts[k] for k in order], _Hashes(), weights)
        distinct, place = np.unique(s.found, return_inverse=True)
        of = (distinct >> np.uint64(32)) % np.uint64(slices)
        at = np.argsort(of, kind="stable")
        return _Counted([keys[k] for k in order], s, distinct, place, of[at], at)

    def slices(self) -> Iterator[tuple[int, np.ndarray]]:
        begins = np.flatnonzero(np.r_[True, self.of[1:] != self.of[:-1]][: len(self.of)])
        for a, b in zip(begins.tolist(), np.r_[begins[1:], len(self.of)][: len(begins)].tolist(), strict=True):
            yield int(self.of[a]), self.at[a:b]


def prefixes(s: Shingles, level: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's shingles, in the order of `level` and hash, those before which not more than 1 - `least` of its
    weight stands, and that are not of level 0: place, number of the text, weight before it, the text's weight."""
    weight, owner = s.weight, np.repeat(np.arange(len(s.number)), s.number)
    order = np.lexsort((s.found, level, owner))
    sums = np.cumsum(weight[order])
    begins = np.cumsum(s.number) - s.number
    start = np.r_[0.0, sums][begins][owner]
    total = np.bincount(owner, weight, minlength=len(s.number))[owner]
    before = np.maximum(sums - weight[order] - start, 0.0)
    kept = (level[order] > 0) & (before <= (1 - least + 1e-9) * total)
    return order[kept], owner[kept], before[kept], total[kept]


def _postings(texts: DataFrame, weights: Weights, least: float) -> DataFrame:
    """(shingle, key, before, total) of the prefixes of `texts` (key, text), without the shingles of one text alone.

    Texts are dealt into units. A unit sends each slice of the shingles' hashes its distinct ones, with its number of
    texts that hold them; the slice adds up and returns to each unit how common each is: 0 for a single text, else in
    steps of an eighth of a power of two. So no shingle's texts meet, and what is sent is six bytes a shingle."""
    slices = 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SLICE_BYTES
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = TaskContext.get().partitionId() << 32
        names = ["unit", "slice", "key", "text", "codes", "counts"]
        for chunk in chunks(batches, most=UNIT_BYTES):
            n = chunk.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, unit)), pa.nulls(n, pa.int32()), chunk.column("key"), chunk.column("text"), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)
            held = _Counted.of_rows(chunk.column("key").to_pylist(), as_bytes(chunk.column("text")), shared.value, slices)
            number = np.minimum(np.bincount(held.place, minlength=len(held.distinct)), 65535).astype("<u2")
            rows = [(s, (held.distinct[at] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), number[at].tobytes()) for s, at in held.slices()]
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, unit)), pa.array([r[0] for r in rows], pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.string()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], names=names)
            unit += 1

    def add(held: pa.Table) -> pa.Table:
        held = held.combine_chunks()
        codes, counts = ([np.frombuffer(x.as_buffer(), kind) for x in held.column(c)] for c, kind in (("codes", "<u4"), ("counts", "<u2")))
        _, place = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts))
        level = np.where(total > 1, 1 + np.minimum(8 * np.log2(total), 254), 0).astype(np.uint8)[place]
        return pa.table([held.column("unit"), held.column("slice"), pa.array([x.tobytes() for x in np.split(level, np.cumsum([len(c) for c in codes])[:-1])], pa.binary())], names=["unit", "slice", "levels"])

    def prefix(unit: pa.Table, levels: pa.Table) -> pa.Table:
        told = dict(zip(levels.column("slice").to_pylist(), levels.column("levels").to_pylist(), strict=True))
        held = _Counted.of_rows(unit.column("key").to_pylist(), as_bytes(unit.column("text")), shared.value, slices)
        level = np.zeros(len(held.distinct), np.uint8)
        for s, at in held.slices():
            level[at] = np.frombuffer(told[s], np.uint8)
        place, owner, before, total = prefixes(held.shingles, level[held.place], least)
        keys = pa.array(held.keys, pa.binary()).take(pa.array(owner))
        return pa.table([pa.array(held.shingles.found[place].view(np.int64)), keys, pa.array(before), pa.array(total)], names=["shingle", "key", "before", "total"])

    dealt = stored(texts.select("key", "text").mapInArrow(deal, "unit long, slice int, key binary, text string, codes binary, counts binary"))
    levels = stored(dealt.where("slice is not null").select("unit", "slice", "codes", "counts").groupBy("slice").applyInArrow(add, "unit long, slice int, levels binary"))
    units = dealt.where("slice is null").select("unit", "key", "text")
    return stored(units.groupBy("unit").cogroup(levels.groupBy("unit")).applyInArrow(prefix, "shingle long, key binary, before double, total double"))


def _alive(postings: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """The rows of `postings` (shingle, key, before, total) whose text may be similar to one of another root that has
    the shingle in its prefix, stored, with the text's root and the likeliest partner of all: best.key, best.root."""
    rows = _rooted(postings.select("shingle", "key", "before", "total"), roots)
    best = F.min(F.struct((F.col("before") / F.col("total")).alias("share"), F.col("key"), F.col("root"), F.col("total"), F.col("before"))).alias("best")
    shingles = rows.groupBy("shingle").agg(F.min("root").alias("one"), F.max("root").alias("other"), F.min("total").alias("low"), best).where("one != other").drop("one", "other")
    shingles = small(stored(shingles), BROADCAST_ROWS // 4)  # so that a shingle's rows don't meet in one task
    # The least that both share, if they are similar, must fit into what the text has from the shingle on.
    fits = F.col("total") - F.col("before") >= (F.col("total") + F.greatest("low", F.lit(least) * F.col("total"))) * (least / (1 + least)) - F.col("total") * 1e-9
    return stored(rows.join(shingles, "shingle").where(fits))


def _partners(alive: DataFrame, least: float) -> DataFrame:
    """One pair (a, b) for each text whose likeliest partner, by the shingle with least before it, has another root."""
    fits = F.least(F.col("total") - F.col("before"), F.col("best.total") - F.col("best.before")) >= (F.col("total") + F.col("best.total")) * (least / (1 + least)) - F.col("total") * 1e-9
    first = alive.where((F.col("root") != F.col("best.root")) & fits).groupBy("key").agg(F.min(F.struct("before", F.col("best.key").alias("with"))).alias("first"))
    return first.select(F.greatest("key", "first.with").alias("a"), F.least("key", "first.with").alias("b")).distinct()


def _rooted(rows: DataFrame, roots: DataFrame, key: str = "key", root: str = "root") -> DataFrame:
    """`rows` with the root of `key`, which is the key itself unless `roots` (key, root) has it."""
    named = roots.select(F.col("key").alias(key), F.col("root").alias("__root"))
    return rows.join(named, key, "left").withColumn(root, F.coalesce("__root", key)).drop("__root")


def _contracted(roots: DataFrame, new: DataFrame) -> DataFrame:
    """`roots` after the links `new` (a, b): only what they join anew goes through `components`."""
    ends = _rooted(_rooted(new, roots, "a", "root_a"), roots, "b", "root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).where("a != b").distinct()
    tops = components(ends)
    known = roots.select("key", F.col("root").alias("old")).join(tops.select(F.col("key").alias("old"), "root"), "old", "left").select("key", F.coalesce("root", "old").alias("root"))
    return stored(known.unionAll(tops.join(roots.select("key"), "key", "left_anti").select("key", "root")))


def links(docs: DataFrame, classes: DataFrame, weights: Weights, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between text keys, from `classes` (key, doc_id: one document with that text, n_copies,
    bands): enough of them to join all members of their buckets that are similar. Second: (key, root) of every key
    that has a link, the root being the same throughout a group."""
    spark = docs.sparkSession
    members = classes.select("key", "n_copies", F.posexplode("bands").alias("at", "band"))
    sizes = stored(members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = stored(members.join(small(sizes, BROADCAST_ROWS), "band"))
    wanted = stored(members.select("key").distinct().join(classes.select("key", "doc_id"), "key"))
    wanted = small(wanted.select(F.col("key").alias("__key"), F.col("doc_id").alias("__id")), BROADCAST_ROWS)
    source = docs.select(text_key().alias("key"), "doc_id", "text")
    texts = stored(source.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))).select("key", "text").where(F.col("text").isNotNull()).dropDuplicates(["key"]))
    members = members.join(texts.select("key", F.octet_length("text").alias("bytes")), "key")
    found = seen = spark.createDataFrame([], "a binary, b binary")
    roots = spark.createDataFrame([], "key binary, root binary")
    for at in ROUNDS:
        rows = stored(_rooted(members.where(F.col("at").between(at[0], at[-1])), roots))
        first = F.min(F.struct((-F.col("n_copies")).alias("rank"), F.col("key").alias("head"), F.col("root").alias("head_root"))).alias("first")
        heads = stored(rows.groupBy("band").agg(first).select("band", "first.head", "first.head_root"))
        met = rows.join(small(heads, BROADCAST_ROWS), "band").where("root != head_root").select(F.greatest("key", "head").alias("a"), F.least("key", "head").alias("b")).distinct()
        pairs = stored(met.join(seen, ["a", "b"], "left_anti"))
        seen = seen.unionAll(pairs)
        new = stored(_linked(pairs, texts, weights, least))
        if new.head(1):
            found, roots = found.unionAll(new), _contracted(roots, new)
    # The two members of a bucket of two have met. Of the others, those in buckets of several groups are left.
    rows = stored(_rooted(members.where("n > 2"), roots).select("key", "band", "root"))
    mixed_ = rows.groupBy("band").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one != other").select("band")
    left = stored(rows.join(mixed_, "band").select("key").distinct())
    if not left.head(1):
        return found, roots
    alive = _postings(spread(texts.join(small(left, BROADCAST_ROWS), "key")), weights, least)
    for _ in range(PARTNERS):
        alive = _alive(alive, roots, least)
        pairs = stored(_partners(alive, least).join(seen, ["a", "b"], "left_anti"))
        seen = seen.unionAll(pairs)
        new = stored(_linked(pairs, texts, weights, least))
        if not new.head(1):
            break
        found, roots = found.unionAll(new), _contracted(roots, new)
    else:
        alive = _alive(alive, roots, least)
    left = stored(alive.select("key").distinct())
    new = stored(_crossing(members.where("n > 2").join(small(left, BROADCAST_ROWS), "key"), texts, roots, weights, least))
    if new.head(1):
        found, roots = found.unionAll(new), _contracted(roots, new)
    return found, roots


def components(edges: DataFrame) -> DataFrame:
    """(key, root) of every key in `edges` (a, b): the least key that it is connected with. Each round takes the
    least root among neighbours, then that root's own root, so chains shrink fast."""
    spark = edges.sparkSession
    both = stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots, path = store(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("key"), F.least("a", "low").alias("root")))
    while True:
        near = both.join(roots.select(F.col("key").alias("b"), F.col("root").alias("seen")), "b").groupBy("a").agg(F.min("seen").alias("low"))
        lower = roots.join(near, roots["key"] == near["a"]).select("key", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        jump = roots.select(F.col("key").alias("root"), F.col("root").alias("next"))
        after, after_path = store(lower.join(jump, "root").select("key", "was", F.least("root", "next").alias("root")))
        delete(spark, path)
        roots, path = after.select("key", "root"), after_path
        if not after.where("was != root").head(1):
            return roots


def group_documents(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """A row for each document (doc_id, text): doc_id, class_id, n_links, copy_id, n_copies, kept.

    class_id is the least doc_id of the document's group of near duplicates, copy_id the least with the same text;
    n_links counts the links of that text that were verified to form the group, n_copies its documents; `kept` marks
    the documents with the group's class_id, and of those the ones with the least key. A null text equals an empty
    one; a text without words has copies only. Rows that repeat in full are all kept or none; `keep_one` leaves one.
    Other columns aren't read, an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    with scratch(docs.sparkSession):
        rows, classes, edges = _grouped(spread(docs), least)
        ends = edges.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
        wide = stored(classes.join(ends, "key", "left").select("key", "copy_id", "n_copies", "class_id", "class_key", F.coalesce("n_links", F.lit(0)).alias("n_links")), lasting=True)
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key"))
    return rows.join(wide, "key").select("doc_id", "class_id", "n_links", "copy_id", "n_copies", kept.alias("kept"))


def _grouped(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (key, doc_id), lasting, texts (key, copy_id, n_copies, class_id, class_key) and links (a, b)."""
    weights = word_weights(docs)
    sketched = stored(sketches(docs, weights), lasting=True)
    rows = sketched.select("key", "doc_id")
    classes = stored(sketched.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands")))
    edges, roots = links(docs, classes, weights, least)
    classes = stored(_rooted(classes.select("key", "doc_id", "n_copies"), roots))
    # The least id leads a group; a null id comes last.
    leader = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key").alias("class_key"))).alias("leader")
    leaders = stored(classes.groupBy("root").agg(leader).select("root", F.col("leader.id").alias("class_id"), F.col("leader.class_key").alias("class_key")))
    return rows, stored(classes.join(leaders, "root").select("key", F.col("doc_id").alias("copy_id"), "n_copies", "class_id", "class_key")), edges


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """`docs` with one document of each group: that with the least doc_id, of full copies with that id any one.

    Columns and types stay as they are. Null and empty texts are one group, a null doc_id comes last in a group, an
    empty table stays empty.
    """
    aside, back = set_aside(docs, ("__key", "__of", "__id"))
    with scratch(docs.sparkSession):
        rows, classes, _ = _grouped(spread(docs.select("doc_id", "text")), least)
        leads = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key"))
        gone = stored(rows.join(classes, "key").where(~leads).select(F.col("key").alias("__key"), F.col("doc_id").alias("__id")).distinct(), lasting=True)
        repeats = bool(rows.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1))
    left = aside.withColumn("__of", text_key()).join(small(gone, BROADCAST_ROWS), (F.col("__of") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")
    return (left.dropDuplicates(["__of", "doc_id"]) if repeats else left).select(*back)

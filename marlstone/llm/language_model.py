"""Scores of documents under a context-tree-weighting model that Spark gathers from the training fold.

Documents are dealt into units of some MB of text. A unit counts its distinct byte grams (see context_tree) and its
distinct tokens, and how often each comes in its training documents, which may be never. It asks for what the score
needs to know of each: the model's log probability of a gram, the training count of a token.

Grams are dealt by hash into slices, whose number grows with the corpus; a slice adds up the units' counts, so a
common gram is one number of each unit. The distinct grams then meet by their two latest context bytes, where the tree
below those is weighted; 65,536 sums at most reach the driver, for the top of the tree, which is broadcast. With it the
grams' probabilities are worked out where their tree is, go back to the slices and from there to the units that asked.
All contexts that come are held, so the model grows with the input, and no task holds more of it than the grams of a slice
or the distinct ones that share two bytes. Tokens are answered by their slices directly.

Long texts are counted and scored in pieces, each with the bytes before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import CHUNK_BYTES, as_bytes, chunks, fold, mixed, pieces, spread, stored
from marlstone.llm.context_tree import DEPTH, END, Top, escaped, gram_codes, gram_logs, packet_of, tally, top_sums

#: Bytes of text in a unit, about, and for each slice of the counts.
UNIT_BYTES, SLICE_BYTES = 24 << 20, 32 << 20
#: Groups that the 65,536 pairs of latest bytes are dealt into at most.
BUCKETS = 1024
#: Distinct grams or tokens that a unit counts apart before it merges them.
HELD = 1_000_000
_END_HASH = xxhash.xxh3_64_intdigest(b"", 1)


class _Hashes(dict):
    def __missing__(self, token: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(token)
        if len(self) < 200_000 and len(token) <= 32:
            self[token] = value
        return value


def _parts(texts: list[bytes]) -> Iterator[tuple[list[int], list[list[bytes]], list[bytes], list[bytes]]]:
    """The texts in parts, some at a time: number of the text, tokens, the bytes to score, the bytes before them.
    The bytes of a text are its tokens with single spaces, then END."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    size = 0
    for k, text in enumerate(texts):
        before, begun = END * DEPTH, False
        slices = [*pieces(text)] if len(text) > CHUNK_BYTES else [text]
        for number, piece in enumerate(slices):
            words = piece.lower().split()
            body = escaped((b" " if begun and words else b"") + b" ".join(words)) + (END if number == len(slices) - 1 else b"")
            for column, value in zip(out, (k, words, body, before), strict=True):
                column.append(value)
            before, begun, size = (before + body)[-DEPTH:], begun or bool(words), size + len(body)
            if size > CHUNK_BYTES:
                yield out
                out, size = ([], [], [], []), 0
    if out[0]:
        yield out


def _hashed(tokens: list[list[bytes]], bodies: list[bytes], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each part's tokens, and the end's after a text's last part; how many of each part."""
    get = hashes.__getitem__
    out: list[int] = []
    number = []
    for words, body in zip(tokens, bodies, strict=True):
        out.extend(map(get, words))
        last = body.endswith(END)
        number.append(len(words) + last)
        if last:
            out.append(_END_HASH)
    return np.array(out, np.uint64), np.array(number, np.int64)


class _Tally:
    """Counts of codes, merged when enough have come."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, codes: np.ndarray, trained: np.ndarray) -> None:
        """`trained`: whether each code is of a training document."""
        for chosen, weight in ((trained, 1), (~trained, 0)):
            distinct, counts = np.unique(codes[chosen], return_counts=True)
            self.parts.append((distinct, weight * counts.astype(np.int64)))
            self.size += len(distinct)
        if self.size > HELD and len(self.parts) > 8:
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) != 1:
            self.parts = [tally(np.concatenate([*(c for c, _ in self.parts), np.zeros(0, np.uint64)]), np.concatenate([*(n for _, n in self.parts), np.zeros(0, np.int64)]))]
        self.size = len(self.parts[0][0])
        return self.parts[0]


def packed(values: np.ndarray) -> bytes:
    """64-bit values as differences, first all lowest bytes, then all second ones and so on: small ones compress well."""
    return np.diff(values.astype(np.uint64), prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(held: pa.Scalar) -> np.ndarray:
    planes = np.frombuffer(held.as_buffer(), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def _column(held: pa.Table, name: str) -> list[np.ndarray]:
    return [unpacked(x) for x in held.column(name)]


def _split(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key, and where it is, in the order there."""
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]][: len(keys)]).tolist()
    for a, b in zip(starts, [*starts[1:], len(keys)][: len(starts)], strict=True):
        yield int(keys[order[a]]), order[a:b]


_ASKED = "unit long, kind int, slice int, codes binary, counts binary"


def ask(texts: DataFrame, slices: int) -> DataFrame:
    """The documents with their units (unit, doc_id, held_out, text), kind being null, and in other rows what the units
    ask: kind 0: grams, 1: tokens; slice; codes, ascending; their counts in the unit's training documents."""
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, hashes, size = TaskContext.get().partitionId() << 32, _Hashes(), 0
        grams, tokens = _Tally(), _Tally()
        id_kind = None

        def asked() -> pa.RecordBatch:
            rows = []
            for kind, tallied in ((0, grams), (1, tokens)):
                codes, counts = tallied.merged()
                of = (mixed(codes) % np.uint64(slices)).astype(np.int64)
                rows += [(unit, kind, s, packed(codes[at]), packed(counts[at])) for s, at in _split(of)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            n = len(rows)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.nulls(n, id_kind), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.string())], names=names)

        names = ["unit", "kind", "slice", "codes", "counts", "doc_id", "held_out", "text"]
        for chunk in chunks(batches):
            n, id_kind = chunk.num_rows, chunk.column("doc_id").type
            trained = ~np.array(chunk.column("held_out").to_pylist(), bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, unit)), *(pa.nulls(n, k) for k in (pa.int32(), pa.int32(), pa.binary(), pa.binary())), *(chunk.column(c) for c in names[5:])], names=names)
            for owners, words, bodies, before in _parts(as_bytes(chunk.column("text"))):
                codes, lengths = gram_codes(bodies, before)
                grams.add(codes, np.repeat(trained[owners], lengths))
                hashed, number = _hashed(words, bodies, hashes)
                tokens.add(hashed, np.repeat(trained[owners], number))
                size += int(lengths.sum())
            if size > UNIT_BYTES:
                yield asked()
                unit, size, grams, tokens = unit + 1, 0, _Tally(), _Tally()
        if size:
            yield asked()

    return texts.mapInArrow(deal, f"{_ASKED}, doc_id {id_type}, held_out boolean, text string")


def _added(held: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of some rows, and their counts added up."""
    return tally(np.concatenate(_column(held, "codes")), np.concatenate(_column(held, "counts")).astype(np.int64))


#: Values in the order of the codes that a unit has asked a slice for.
_ANSWERS = "unit long, kind int, slice int, answers binary"


def token_answers(asked: DataFrame) -> DataFrame:
    """The training counts of what units asked of tokens, and in one row of each slice `total` and `distinct`: the
    slice's training tokens, with repeats and without."""

    def count(held: pa.Table) -> pa.Table:
        held = held.combine_chunks()
        tokens, counts = _added(held)
        answers = [packed(counts[np.searchsorted(tokens, x)]) for x in _column(held, "codes")]
        n = len(answers)
        first = np.arange(n) == 0
        return pa.table({"unit": held.column("unit"), "kind": held.column("kind"), "slice": held.column("slice"), "answers": pa.array(answers, pa.binary()), "total": pa.array(first * counts.sum()), "distinct": pa.array(first * (counts > 0).sum())})

    return asked.where("kind = 1").select("unit", "kind", "slice", "codes", "counts").groupBy("slice").applyInArrow(count, f"{_ANSWERS}, total long, distinct long")


def gram_answers(asked: DataFrame, slices: int) -> DataFrame:
    """The log10 of the model's probability of each gram that units asked for."""
    spark, buckets = asked.sparkSession, min(slices, BUCKETS)
    asked = asked.where("kind = 0").select("unit", "kind", "slice", "codes", "counts")

    def merge(held: pa.Table) -> pa.Table:
        number = held.column("slice")[0].as_py()
        codes, counts = _added(held.combine_chunks())
        rows = [(number, b, packed(codes[at]), packed(counts[at])) for b, at in _split((mixed(packet_of(codes).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64))]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["slice", "bucket", "codes", "counts"])

    def sums(held: pa.Table) -> pa.Table:
        keys, total = top_sums(*_added(held.combine_chunks()))
        return pa.table({"at": pa.array(keys), "zeros": pa.array(total[:, 0].astype(np.int64)), "ones": pa.array(total[:, 1].astype(np.int64)), "log": pa.array(total[:, 2])})

    def weigh(held: pa.Table) -> pa.Table:
        held = held.combine_chunks()
        codes, counts = _added(held)
        logs = gram_logs(codes, counts, shared.value).astype("<f4")
        found = [logs[np.searchsorted(codes, x)].tobytes() for x in _column(held, "codes")]
        return pa.table({"slice": held.column("slice"), "codes": held.column("codes"), "logs": pa.array(found, pa.binary())})

    def answer(held: pa.Table, known: pa.Table) -> pa.Table:
        codes, logs = np.concatenate(_column(known, "codes")), np.concatenate([np.frombuffer(x.as_buffer(), "<f4") for x in known.column("logs")])
        order = np.argsort(codes)
        codes, logs = codes[order], logs[order]
        found = [logs[np.searchsorted(codes, x)].tobytes() for x in _column(held, "codes")]
        return pa.table({"unit": held.column("unit"), "kind": held.column("kind"), "slice": held.column("slice"), "answers": pa.array(found, pa.binary())})

    grams = stored(asked.groupBy("slice").applyInArrow(merge, "slice int, bucket int, codes binary, counts binary"))
    by_bucket = grams.groupBy("bucket")
    top = by_bucket.applyInArrow(sums, "at long, zeros long, ones long, log double").groupBy("at").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "log"))).toArrow()
    shared = spark.sparkContext.broadcast(Top(top["at"].to_numpy(), np.stack([top[c].to_numpy().astype(np.float64) for c in ("zeros", "ones", "log")], 1).reshape(-1, 3)))
    logs = by_bucket.applyInArrow(weigh, "slice int, codes binary, logs binary")
    return asked.select("unit", "kind", "slice", "codes").groupBy("slice").cogroup(logs.groupBy("slice")).applyInArrow(answer, _ANSWERS)


def score_documents(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    """A row for each document (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The text that is scored is the lower-cased (A-Z) tokens with single spaces, then an end byte: the very events
    that the base counts. A null text is empty and has its end alone. Repeated rows have a score each. With no
    training documents all bytes are equally likely. Tokens are told apart by 64-bit hashes. Other columns aren't
    read; an empty table gives no rows.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = 1 + size // SLICE_BYTES
    texts = spread(docs.select("doc_id", "text", (fold(F.col("doc_id"), folds) == held).alias("held_out")))
    fewer = max(spark_cores(docs), 1 + size // UNIT_BYTES)
    dealt = stored(ask(texts.coalesce(fewer), slices))
    tokens = stored(token_answers(dealt))
    total, distinct = tokens.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    over = float(np.log10(total + 0.5 * (distinct + 1)))
    answers = gram_answers(dealt, slices).unionAll(tokens.drop("total", "distinct"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def answered(codes: list[np.ndarray], answers: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """A unit's distinct codes, ascending, and the values for them."""
        distinct = np.unique(np.concatenate([*codes, np.zeros(0, np.uint64)]))
        mine = answers.filter(pc.equal(answers.column("kind"), kind))
        told = {s: unpacked(x) if kind else np.frombuffer(x.as_buffer(), "<f4") for s, x in zip(mine.column("slice").to_pylist(), mine.column("answers"), strict=True)}
        values = np.zeros(len(distinct))
        for s, at in _split((mixed(distinct) % np.uint64(slices)).astype(np.int64)):
            values[at] = told[s]
        return distinct, values

    def score(unit: pa.Table, answers: pa.Table) -> pa.Table:
        hashes, parts, first = _Hashes(), [], 0
        for chunk in chunks(iter(unit.to_batches())):
            for owners, words, bodies, before in _parts(as_bytes(chunk.column("text"))):
                codes, lengths = gram_codes(bodies, before)
                some, place = np.unique(codes, return_inverse=True)
                parts.append((np.array(owners) + first, lengths, some, place.astype(np.int32), *_hashed(words, bodies, hashes)))
            first += chunk.num_rows
        grams, logs = answered([p[2] for p in parts], answers, 0)
        tokens, counts = answered([p[4] for p in parts], answers, 1)
        sums = np.zeros((5, first))  # tokens, known ones, their logs, score, bytes
        for owners, lengths, some, place, hashed, number in parts:
            low = int(owners[0])
            wide = int(owners[-1]) - low + 1
            own, c = owners - low, counts[np.searchsorted(tokens, hashed)]
            of = np.repeat(own, number)
            for k, by, x in ((0, own, number), (1, of, c > 0), (2, of, np.log10(c + 0.5)), (3, np.repeat(own, lengths), logs[np.searchsorted(grams, some)][place]), (4, own, lengths)):
                sums[k, low : low + wide] += np.bincount(by, x, wide)
        values = [pa.array(x) for x in (sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2] - sums[0] * over, sums[3], sums[4].astype(np.int64))]
        return pa.table([unit.column("doc_id"), unit.column("held_out"), *values], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"])

    units = dealt.where("kind is null").select("unit", "doc_id", "held_out", "text")
    scored = units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    bits = -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


def spark_cores(docs: DataFrame) -> int:
    return docs.sparkSession.sparkContext.defaultParallelism

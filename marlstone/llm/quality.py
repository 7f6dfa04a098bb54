"""Quality classifier: supervised subword embeddings.

A document's features are its words, the words' character 3- and 4-grams (bounds included) and its word pairs, hashed
into `BUCKETS` vectors; a pair of equal words has one bucket for all words. The vectors' mean goes through a softmax.
Vectors and softmax are trained by stochastic gradient descent in numpy on a bounded sample. For scoring, what a
bucket adds to the difference of the two logits is one number, so a task hashes half a megabyte of text at once, looks
the numbers up and adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import CHUNK_BYTES, as_bytes, chunks, fold, mixed, pieces, set_aside, set_columns, spread
from marlstone.llm.labelled import training_sample

BUCKETS, WIDTH = 1 << 16, 8
_SAME = 0  # the bucket of two equal words
#: Labelled documents to fit on and their bytes, about; passes over them; step size.
SAMPLE, SAMPLE_BYTES, EPOCHS, RATE = 4_000, 32 << 20, 8, 0.5
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (mixed(hashes + np.uint64(kind)) >> np.uint64(32)).astype(np.int64) & (BUCKETS - 1)


def _pairs(words: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, from the words' hashes."""
    a, b = words[:-1], words[1:]
    return np.where(a == b, _SAME, _bucket(a * _FACTOR + b, 2))


def occurrences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every feature that the texts have, as often as it comes: number of the text and bucket. Third: the hashes
    of all words, text after text. A word is framed by < and >; a hash is a polynomial in its letters' own hashes."""
    letters = [t.decode("utf-8", "replace") for t in texts]
    text = np.frombuffer("\n".join(letters).encode("utf-32-le"), "<u4")
    inside = ~((text == 32) | ((text >= 9) & (text <= 13)))
    first = inside & np.r_[True, ~inside[:-1]][: len(inside)]
    at, n = np.flatnonzero(inside), int(first.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = np.cumsum(first)[at] - 1
    sizes = np.bincount(word, minlength=n) + 2
    starts = np.cumsum(sizes) - sizes
    framed = np.full(len(at) + 2 * n, ord("<"), np.uint64)
    framed[np.arange(len(at)) + 2 * word + 1] = text[at]
    framed[starts + sizes - 1] = ord(">")
    hashes, of = mixed(framed + np.uint64(1)), np.repeat(np.arange(n), sizes)
    powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(sizes.max()), _FACTOR)])
    words = mixed(np.add.reduceat(hashes * powers[np.arange(len(of)) - starts[of]], starts))
    three = (hashes[:-2] * _FACTOR + hashes[1:-1]) * _FACTOR + hashes[2:]
    four = three[:-1] * _FACTOR + hashes[3:]
    in_three, in_four = of[:-2] == of[2:], of[:-3] == of[3:]
    text_of = np.searchsorted(np.cumsum([len(x) + 1 for x in letters]), np.flatnonzero(first), side="right")
    together = text_of[:-1] == text_of[1:]
    owners = (text_of, text_of[of[:-2][in_three]], text_of[of[:-3][in_four]], text_of[:-1][together])
    buckets = (_bucket(words, 1), _bucket(three[in_three], 3), _bucket(four[in_four], 4), _pairs(words)[together])
    return np.concatenate(owners), np.concatenate(buckets), words


def _in_pieces(text: bytes) -> Iterator[np.ndarray]:
    """The buckets of a long text, piece after piece."""
    last = np.zeros(0, np.uint64)
    for piece in pieces(text):
        _, buckets, words = occurrences([piece])
        yield np.r_[buckets, _pairs(np.r_[last[-1:], words[:1]])]
        last = words if len(words) else last


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each comes."""
    number = sum((np.bincount(x, minlength=BUCKETS) for x in _in_pieces(text)), np.zeros(BUCKETS, np.int64))
    ids = np.flatnonzero(number)
    return ids, number[ids]


class Model:
    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7):
        """rows: buckets, counts and label of each document. Without both labels, all scores are the labels' mean."""
        random = np.random.default_rng(seed)
        vectors = random.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
        out, bias = random.normal(0, 0.1, (WIDTH, 2)), np.zeros(2)
        rows = [(ids, counts / counts.sum(), y) for ids, counts, y in rows if len(ids)]
        positive = sum(y for _, _, y in rows)
        steps = EPOCHS * len(rows) if 0 < positive < len(rows) else 0
        for epoch in range(EPOCHS if steps else 0):
            for k, row in enumerate(random.permutation(len(rows))):
                rate = RATE * (1 - (epoch * len(rows) + k) / steps)
                ids, share, y = rows[row]
                own = vectors[ids]
                mean = share @ own
                logits = mean @ out + bias
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[y] -= 1
                vectors[ids] = own - np.outer(share, rate * len(ids) ** 0.5 * (out @ p))
                out -= rate * np.outer(mean, p)
                bias -= 0.1 * rate * p
        if not steps:
            vectors[:] = 0
            mean = (positive + 1) / (len(rows) + 2)
            bias = np.array([0, np.log(mean / (1 - mean))])
        self.trained = steps > 0
        self.weight, self.bias = vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    total, number = np.zeros(len(texts)), np.zeros(len(texts))
    for k, text in enumerate(texts):
        for buckets in _in_pieces(text) if len(text) > CHUNK_BYTES else ():
            total[k] += model.weight[buckets].sum()
            number[k] += len(buckets)
    owners, buckets, _ = occurrences([t if len(t) <= CHUNK_BYTES else b"" for t in texts])
    total += np.bincount(owners, model.weight[buckets], len(texts))
    number += np.bincount(owners, minlength=len(texts))
    return 1 / (1 + np.exp(-(total / np.maximum(number, 1) + model.bias)))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Trains on at most `most` labelled documents outside the held fold, of about `most_bytes` together."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            found = [features(t) for t in as_bytes(chunk.column("text"))]
            packed = ([x[0].astype("<i4").tobytes() for x in found], [x[1].astype("<i4").tobytes() for x in found])
            yield pa.RecordBatch.from_arrays([chunk.column("part"), chunk.column("y"), *(pa.array(x, pa.binary()) for x in packed)], names=["part", "y", "ids", "counts"])

    sample = training_sample(docs, labels, "quality", most=most, most_bytes=most_bytes).mapInArrow(extract, "part long, y int, ids binary, counts binary")
    found = sample.toArrow().sort_by("part")
    ids, counts = ([np.frombuffer(x.as_buffer(), "<i4") for x in found[c]] for c in ("ids", "counts"))
    return Model([*zip(ids, counts, found["y"].to_pylist(), strict=True)])


def scored(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """`docs` with score and predicted (1 if the score is at least `threshold`); columns of those names are replaced.
    A null or empty text has the score of no features, the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            p = scores(shared.value, as_bytes(chunk.column("text")))
            yield set_columns(chunk, {"score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))})

    return spread(kept).mapInArrow(score, fields + "score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted. Only the text is scored; repeated rows have a
    score each, and without usable labels every score is one half."""
    texts = docs.select("doc_id", "text", (fold(F.col("doc_id"), 4) == 2).alias("held_out"))
    return scored(texts, fit(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without those that the classifier rejects; columns and types stay as they are. A null or empty text
    stays or goes by the bias, repeated rows share their fate, an empty table stays empty; without labels of both kinds
    nothing is known of quality, and all documents stay."""
    model = fit(docs, labels)
    if not model.trained:
        return docs
    aside, back = set_aside(docs, ("score", "predicted"))
    return scored(aside, model).where("predicted = 1").select(*back)

"""Toxicity: maximum-scoring segments over token log-odds.

The log-odds of a word against the corpus come from labelled documents. Its toxic share has a Dirichlet prior whose
mean is the share of the words with the same first five letters, theirs that of the first four, theirs that of all:
a rare form of a known word inherits, a rare word without a known kin stays near zero. Log-odds of less than
`CERTAIN` of their standard errors count as zero. A small drift is taken off
every token, so that a text without toxic words runs downhill; a word that repeats the one before it has no more
than the drift.

One pass in linear time finds all maximal scoring segments of a text (after Ruzzo and Tompa). Under the null model
the best segment of n tokens follows an extreme-value law with parameters lambda and K. Each segment's evidence is
lambda S - ln(K n), and a logistic curve turns the best and the summed evidence into a probability. Word scores are
fitted on one half of the sample, lambda, K and the curve on the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import as_bytes, chunks, fold, pieces, set_columns, spread, stored
from marlstone.llm.labelled import SAMPLE_BYTES, training_sample

#: Labelled documents to fit on, prior weight, drift a token, the least count that gives a word its own
#: score, and standard errors.
SAMPLE, PRIOR, DRIFT, LEAST, CERTAIN = 16_000, 20.0, 0.3, 3, 3.0
_PREFIXES = (4, 5)
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
KEPT_WORDS = 200_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def segments(scores: list[float], gaps: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first, last) of the positive tokens: scores[k] is positive token k's,
    gaps[k] the sum of what lies between it and the one before."""
    stack: list[list] = []  # left sum, right sum, first, last, place of the nearest entry with a lower left sum
    total = 0.0
    for k, (score, gap) in enumerate(zip(scores, gaps, strict=True)):
        left = total + gap
        total = left + score
        entry = [left, total, k, k, -1]
        at = len(stack) - 1
        while True:
            while at >= 0 and stack[at][0] >= entry[0]:
                at = stack[at][4]
            if at < 0 or stack[at][1] >= entry[1]:
                break
            entry[0], entry[2] = stack[at][0], stack[at][2]
            link = stack[at][4]
            del stack[at:]
            at = link
        entry[4] = at
        stack.append(entry)
    return [(e[1] - e[0], e[2], e[3]) for e in stack]


class Lexicon(dict):
    """Log-odds less drift of a word, by its own entry or its longest known prefix."""

    def __init__(self, words: dict[bytes, float], prefixes: dict[str, float]):
        super().__init__()
        self._words, self._prefixes = words, prefixes

    def __missing__(self, word: bytes) -> float:
        value = self._words.get(word)
        if value is None:
            text = word.decode("utf-8", "replace")
            value = next((v for n in reversed(_PREFIXES) if len(text) >= n and (v := self._prefixes.get(text[:n])) is not None), 0.0)
        value -= DRIFT
        if len(self) < KEPT_WORDS and len(word) <= 48:
            self[word] = value
        return value

    def token_scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the texts' words, text after text, and the number of words of each text."""
        parts, lengths, get = [np.zeros(0)], np.zeros(len(texts), np.int64), self.__getitem__
        for k, text in enumerate(texts):
            last = b""
            for piece in pieces(text):
                words = [last, *words_of(piece)]
                scores = np.fromiter(map(get, words), np.float64, len(words))
                near = np.flatnonzero((scores[1:] > 0) & (scores[1:] == scores[:-1])) + 1
                scores[[i for i in near.tolist() if words[i] == words[i - 1]]] = -DRIFT
                parts.append(scores[1:])
                lengths[k] += len(words) - 1
                last = words[-1]
        return np.concatenate(parts), lengths


def passages(scores: np.ndarray, lengths: np.ndarray) -> Iterator[list[tuple[float, int, int]]]:
    """For each text its maximal segments: score, first token, last token."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    positive = np.flatnonzero(scores > 0)
    ends = np.cumsum(lengths)
    cuts = np.searchsorted(positive, np.r_[ends - lengths, ends[-1:]])
    for a, b, start in zip(cuts[:-1], cuts[1:], (ends - lengths).tolist(), strict=True):
        at = positive[a:b]
        if not len(at):
            yield []
            continue
        before = np.r_[start, at[:-1] + 1]
        places = (at - start).tolist()
        yield [(s, places[i], places[j]) for s, i, j in segments(scores[at].tolist(), (sums[at] - sums[before]).tolist())]


class Model:
    def __init__(self, lexicon: Lexicon, rate: float = 1.0, size: float = 1.0, curve: tuple[float, float, float] = (-2.0, 1.0, 0.0)):
        self.lexicon, self.rate, self.size, self.curve = lexicon, rate, size, curve

    def evidence(self, found: list[tuple[float, int, int]], n: int) -> tuple[float, float]:
        """Of the best passage, and the sum over the significant ones; both are 0 without any."""
        least = np.log(max(self.size * n, 1e-9))
        over = [x for s, _, _ in found if (x := self.rate * s - least) > 0]
        return (max(over), sum(over)) if over else (0.0, 0.0)

    def probability(self, best: float, total: float) -> float:
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * best + c * np.log1p(total), -30, 30))))

    def significant(self, found: list[tuple[float, int, int]], n: int) -> list[tuple[int, int]]:
        least = np.log(max(self.size * n, 1e-9))
        return [(i, j + 1) for s, i, j in found if self.rate * s > least]


def _log_odds(sample: DataFrame) -> Lexicon:
    """Scores of words and prefixes; bounded by the sample's own words, of which only those in LEAST documents count."""
    words = sample.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.expr("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"), F.lit(_WORD), 0))).alias("word"))
    counted = stored(words.groupBy("word").agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n")))
    total = counted.agg(F.sum("toxic"), F.sum("n")).first()
    share = ((total[0] or 0) + 0.5) / ((total[1] or 0) + 1)
    kin = {n: counted.where(F.length("word") >= n).groupBy(F.substring("word", 1, n).alias("prefix")).agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")) for n in _PREFIXES}
    shares: dict[str, float] = {}

    def odds(p: float, n: int) -> float:
        value = float(np.log(p / (1 - p)) - np.log(share / (1 - share)))
        return value if abs(value) >= CERTAIN / ((n + PRIOR) * p * (1 - p)) ** 0.5 else 0.0

    def rows(table: DataFrame, name: str) -> Iterator[tuple[str, int, int]]:
        found = table.where(F.col("n") >= LEAST).select(name, "toxic", "n").toArrow()
        return zip(*(c.to_pylist() for c in found.columns), strict=True)

    prefixes = {}
    for n in _PREFIXES:
        for prefix, toxic, number in rows(kin[n], "prefix"):
            above = shares.get(prefix[:-1], share) if n > _PREFIXES[0] else share
            shares[prefix] = (toxic + PRIOR * above) / (number + PRIOR)
            prefixes[prefix] = odds(shares[prefix], number)
    own = {}
    for word, toxic, number in rows(counted, "word"):
        above = next((v for n in reversed(_PREFIXES) if len(word) >= n and (v := shares.get(word[:n])) is not None), share)
        own[word.encode()] = odds((toxic + PRIOR * above) / (number + PRIOR), number)
    return Lexicon(own, prefixes)


def _null_rate(scores: np.ndarray) -> float:
    """The positive lambda with mean exp(lambda s) = 1 over the clean tokens."""
    if not len(scores) or scores.max() <= 0 or scores.mean() >= 0:
        return 1.0
    low, high = 1e-6, 50.0 / scores.max()
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if np.mean(np.exp(middle * scores)) > 1 else (middle, high)
    return low


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a light ridge; more evidence never lowers the result."""
    for used in ([0, 1, 2], [0, 2], [0, 1]):
        design, w = np.c_[np.ones(len(x)), x][:, used], np.zeros(len(used))
        ridge = np.eye(len(used)) * len(x) * 1e-4
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        if (w[1:] >= 0).all():
            break
    out = np.zeros(3)
    out[used] = np.maximum(w, [-np.inf] + [0] * (len(used) - 1))
    return tuple(map(float, out))


def _measured(sample: DataFrame, lexicon: Lexicon) -> list[tuple[int, int, list[float], np.ndarray, np.ndarray]]:
    """Label, length, segments and tallied token scores of each document, in the order of the sample's hash."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            scores, lengths = shared.value.token_scores(as_bytes(chunk.column("text")))
            found = list(passages(scores, lengths))
            ends = np.cumsum(lengths)
            values = [np.unique(np.round(scores[e - n : e], 2), return_counts=True) for e, n in zip(ends, lengths, strict=True)]
            yield pa.RecordBatch.from_arrays([chunk.column("part"), chunk.column("y"), pa.array(lengths), pa.array([[s for s, _, _ in f] for f in found], pa.list_(pa.float64())), *(pa.array([v[k].astype(np.float64) for v in values], pa.list_(pa.float64())) for k in (0, 1))], names=["part", "y", "n", "segments", "values", "counts"])

    found = sample.select("part", "y", "text").mapInArrow(measure, "part long, y int, n long, segments array<double>, values array<double>, counts array<double>").toArrow().sort_by("part")
    lists = ([x.values.to_numpy(zero_copy_only=False) for x in found[c]] for c in ("values", "counts"))
    return [*zip(found["y"].to_pylist(), found["n"].to_pylist(), found["segments"].to_pylist(), *lists, strict=True)]


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on at most `most` labelled documents outside the held fold, of about `most_bytes` together."""
    sample = training_sample(docs, labels, "toxic", most=most, most_bytes=most_bytes)
    lexicon = _log_odds(sample.where("part % 2 = 0"))
    rows = _measured(sample.where("part % 2 != 0"), lexicon)
    clean = [r for r in rows if r[0] == 0 and r[1]]
    if not clean or len({r[0] for r in rows}) < 2:
        return Model(lexicon)
    values, inverse = np.unique(np.concatenate([r[3] for r in clean]), return_inverse=True)
    weights = np.bincount(inverse, np.concatenate([r[4] for r in clean]))
    rate = _null_rate(np.repeat(values, np.maximum(1, np.round(weights / weights.sum() * 1e5)).astype(int)))
    size = float(np.exp(np.mean([rate * max(r[2], default=0.0) - np.log(r[1]) for r in clean]) - np.euler_gamma))
    model = Model(lexicon, rate, size)
    x = np.array([model.evidence([(s, 0, 0) for s in r[2]], r[1]) for r in rows])
    model.curve = _curve(np.c_[x[:, 0], np.log1p(x[:, 1])], np.array([r[0] for r in rows], float))
    return model


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """`docs` with score, predicted (1 if the score is at least `threshold`) and passages (word spans of the
    significant segments, stop exclusive); columns of those names are replaced. A null or empty text has none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted", "passages")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for chunk in chunks(batches):
            scores, lengths = model.lexicon.token_scores(as_bytes(chunk.column("text")))
            found = list(passages(scores, lengths))
            p = np.array([model.probability(*model.evidence(f, n)) for f, n in zip(found, lengths.tolist(), strict=True)])
            spans = [[{"start": a, "stop": b} for a, b in model.significant(f, n)] for f, n in zip(found, lengths.tolist(), strict=True)]
            yield set_columns(chunk, {"score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32)), "passages": pa.array(spans, _SPANS)})

    return spread(kept).mapInArrow(score, fields + "score double, predicted int, passages array<struct<start:int,stop:int>>")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted, n_passages. Only the text is scored; repeated
    rows have a score each; without labels of both kinds nothing is significant."""
    texts = docs.select("doc_id", "text", (fold(F.col("doc_id"), 4) == 2).alias("held_out"))
    return scored(texts, fit(docs, labels)).select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))

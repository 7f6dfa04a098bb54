"""Secret scans: formats of credentials by grammar inference.

Base patterns find assigned, access-key and hexadecimal credentials. Their matches are the labelled examples: a
bounded sample of their values, a kind at a time, makes a prefix tree whose statistically compatible states are
merged into a probabilistic automaton (after Carrasco and Oncina). Only states of the same depth are merged, up to
`LAYERS` characters, so the automaton keeps lengths and what stands where; deeper ones may be merged into loops.
Ordinary long tokens, sampled likewise and merged at any depth, give the automaton of what isn't a secret. Every candidate token of every text
that doesn't lie within a base match is then scored by the log-likelihood ratio of the best credential automaton
against what an ordinary token may be; those far above become spans of kind `format`.

An ordinary token may be of a shape that stands in none of the examples. So the ordinary automaton is one of three
models, each with a third of the prior: the others are open to any token. `run_score` takes characters in runs of
digits, small letters, capitals and marks, so long numbers cost little. `group_score` takes three groups or more between
marks, each of an alphabet of its own, so dates, times, telephone numbers, ISBNs, paths and UUIDs cost little. A token
drawn from such a model has a ratio of t or more with a probability of exp(-t) at most for each automaton of
credentials; the least ratio follows from that and from the stated rate of false alarms.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import nsmallest
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import as_text, chunks, spread, stored

# Fixed values of the base patterns.
KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")

#: As short as the least value of a base pattern.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Values of each kind to learn from, and their characters together, about; merge confidence; depth up to which states
#: are told apart; observations that the kind's characters as a whole weigh in each state; the share of ordinary tokens
#: that may be flagged if the models of them hold; nats a character must have over them.
SAMPLE, SAMPLE_CHARS, ALPHA, LAYERS, PRIOR, FALSE_ALARMS, LEAST_RATE = 300, 1 << 16, 0.05, 64, 4.0, 1e-5, 0.5
#: Values of one length that are learnt apart from a kind's others.
FORMAT = 30
#: Models of ordinary tokens: the automaton and the two that are open to any token.
ORDINARY_MODELS = 3
#: Of the open models: the probability that a run goes on; the mean length of a token.
STAY, MEAN_LENGTH = 0.995, 24
_MARKS = re.compile(r"[+/_.=-]")
#: Alphabets of a group, the smallest first.
_GROUPS = [(re.compile(f"[{letters}]*"), size) for letters, size in (("0-9", 10), ("0-9a-f", 16), ("0-9A-F", 16), ("a-z", 26), ("A-Z", 26), ("A-Za-z0-9", 62))]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, in that order."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def _value(text: str, span: tuple[int, int, int]) -> str:
    found = text[span[0] : span[2]]
    return _ASSIGN.match(found)[2] if span[1] == 0 else found


class _Tree:
    """A prefix tree with counts of arrivals and ends; states are numbers."""

    def __init__(self, words: list[str], layers: int = LAYERS):
        self.layers = layers
        self.arrived, self.ended, self.next, self.layer = [0], [0], [{}], [0]
        for word in words:
            state = 0
            self.arrived[0] += 1
            for c in word:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.arrived.append(0)
                    self.ended.append(0)
                    self.next.append({})
                    self.layer.append(min(self.layer[state] + 1, layers))
                state = self.next[state][c]
                self.arrived[state] += 1
            self.ended[state] += 1
        # Arrivals over an edge are kept apart from the state's own, which merging adds up.
        self.over = [{c: self.arrived[s] for c, s in edges.items()} for edges in self.next]

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        """Hoeffding's bound on two observed shares."""
        return n1 > 0 < n2 and abs(f1 / n1 - f2 / n2) > (0.5 * np.log(2 / ALPHA)) ** 0.5 * (n1**-0.5 + n2**-0.5)

    def compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.arrived[a], self.arrived[b]
            if self._differ(self.ended[a], n, self.ended[b], m):
                return False
            for c in {*self.over[a], *self.over[b]}:
                if self._differ(self.over[a].get(c, 0), n, self.over[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the tree below b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.arrived[a] += self.arrived[b]
            self.ended[a] += self.ended[b]
            for c, child in self.next[b].items():
                self.over[a][c] = self.over[a].get(c, 0) + self.over[b][c]
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def merge(self) -> list[int]:
        """Merges each state below the kept ones into the first kept one of its layer that it is compatible with, or
        keeps it; those of the lowest layer first, and there those with most arrivals."""
        kept: dict[int, list[int]] = {0: [0]}
        known = {0}
        for layer in range(self.layers + 1):
            while True:
                above = [s for k in ((layer - 1, layer) if layer == self.layers else (layer - 1,)) for s in kept.get(k, [])]
                fringe = [(self.arrived[t], -s, c) for s in above for c, t in self.next[s].items() if t not in known]
                if not fringe:
                    break
                _, s, c = max(fringe)
                state = self.next[-s][c]
                into = next((k for k in kept.get(layer, []) if self.compatible(k, state)), None)
                if into is None:
                    kept.setdefault(layer, []).append(state)
                    known.add(state)
                else:
                    self.next[-s][c] = into
                    self.fold(into, state)
        return [s for layer in sorted(kept) for s in kept[layer]]


class Automaton:
    """Log probabilities of tokens. A state's shares of characters and ends are its own counts with `PRIOR`
    observations spread like those of all states together; a character that a state has not seen leads to the first
    state of the next layer."""

    def __init__(self, words: list[str], layers: int = LAYERS):
        tree = _Tree(words, layers)
        kept = tree.merge()
        number = {s: k for k, s in enumerate(kept)}
        self.layers = [tree.layer[s] for s in kept]
        following = [next((k for k, below in enumerate(self.layers) if below == min(layer + 1, layers)), 0) for layer in self.layers]
        size = len(_ALPHABET) + 1
        overall = {c: sum(tree.over[s].get(c, 0) for s in kept) + 1 / size for c in _ALPHABET}
        ends = sum(tree.ended[s] for s in kept) + 1 / size
        total = sum(overall.values()) + ends
        self.go, self.log = np.zeros((len(kept), 128), np.int32), np.full((len(kept), 128), -np.inf)
        self.end = np.zeros(len(kept))
        for k, s in enumerate(kept):
            arrived = np.log(tree.ended[s] + sum(tree.over[s].values()) + PRIOR)
            self.end[k] = np.log(tree.ended[s] + PRIOR * ends / total) - arrived
            for c in _ALPHABET:
                self.log[k, ord(c)] = np.log(tree.over[s].get(c, 0) + PRIOR * overall[c] / total) - arrived
                self.go[k, ord(c)] = number[tree.next[s][c]] if c in tree.next[s] else following[k]

    def score(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """tokens: rows of ASCII codes, padded with zeros, longest rows first."""
        state, total = np.zeros(len(tokens), np.int32), np.zeros(len(tokens))
        for k in range(tokens.shape[1]):
            live = slice(0, int(np.searchsorted(-lengths, -k, side="left")))
            c = tokens[live, k]
            total[live] += self.log[state[live], c]
            state[live] = self.go[state[live], c]
        return total + self.end[state]


def _runs() -> tuple[np.ndarray, np.ndarray]:
    """Class and log of the size of that class, for each ASCII code."""
    kind, size = np.full(128, 3), np.full(128, np.log(6))
    for k, (letters, n) in enumerate((("0123456789", 10), ("abcdefghijklmnopqrstuvwxyz", 26), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26))):
        for c in letters:
            kind[ord(c)], size[ord(c)] = k, np.log(n)
    return kind, size


_KIND, _SIZE = _runs()


def run_score(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log probability of tokens (rows of ASCII codes, padded with zeros) as runs of characters of four classes."""
    inside = np.arange(tokens.shape[1]) < lengths[:, None]
    kind = _KIND[tokens]
    stays = (kind[:, 1:] == kind[:, :-1]) & inside[:, 1:]
    moves = (kind[:, 1:] != kind[:, :-1]) & inside[:, 1:]
    steps = stays.sum(1) * np.log(STAY) + moves.sum(1) * np.log((1 - STAY) / 3)
    return steps - np.where(inside, _SIZE[tokens], 0.0).sum(1) - np.log(4) + (lengths - 1) * np.log(1 - 1 / MEAN_LENGTH) - np.log(MEAN_LENGTH)


def group_score(token: str) -> float:
    """Log probability of a token as groups between marks; none of fewer than three groups, or with an empty one."""
    groups = _MARKS.split(token)
    if len(groups) < 3 or not all(groups):
        return -np.inf
    total = -np.log(4) * len(groups) - np.log(6) * (len(groups) - 1)
    for group in groups:
        size = next(size for letters, size in _GROUPS if letters.fullmatch(group))
        total -= np.log(len(_GROUPS)) + np.log(16) + max(0, len(group) - 16) * np.log(2) + len(group) * np.log(size)
    return total


def _formats(words: list[str]) -> list[list[str]]:
    of_length: dict[int, list[str]] = {}
    for w in words:
        of_length.setdefault(len(w), []).append(w)
    rest = [w for some in of_length.values() if len(some) < FORMAT for w in some]
    return [some for _, some in sorted(of_length.items()) if len(some) >= FORMAT] + ([rest] if rest else [])


class Model:
    """Automata for each kind with examples, and the ordinary one; without examples nothing is found. Values of one kind
    and length are a format, with an automaton of its own, if there are at least FORMAT of them; the rest share one."""

    def __init__(self, examples: dict[int, list[str]]):
        self.secret = [Automaton(words) for kind, of_kind in sorted(examples.items()) if kind < 3 for words in _formats(of_kind)]
        labelled = {v for kind, words in examples.items() if kind < 3 for v in words}
        # Ordinary tokens have no common layout: their states may all be merged, so no single one is learnt by heart.
        self.ordinary = Automaton([v for v in examples.get(3, []) if v not in labelled], 0)

    def likely(self, tokens: list[str]) -> np.ndarray:
        """Whether each token's format is far likelier that of a credential."""
        if not tokens or not self.secret:
            return np.zeros(len(tokens), bool)
        lengths = np.array([len(t) for t in tokens])
        order = np.argsort(-lengths, kind="stable")
        secret, ordinary = np.empty(len(tokens)), np.empty(len(tokens))
        start = 0
        while start < len(order):  # blocks of a bounded area
            stop = start + max(1, 4_000_000 // int(lengths[order[start]]))
            rows, wide = order[start:stop], int(lengths[order[start]])
            codes = np.frombuffer("".join(tokens[k].ljust(wide, "\x00") for k in rows.tolist()).encode("ascii"), np.uint8).reshape(-1, wide)
            own = lengths[rows]
            secret[rows] = np.max([a.score(codes, own) for a in self.secret], axis=0)
            ordinary[rows] = np.maximum(self.ordinary.score(codes, own), run_score(codes, own))
            start = stop
        # The least ratio, beside what the choices among automata and among models of ordinary tokens are worth.
        over = np.maximum(np.log(len(self.secret) * ORDINARY_MODELS / FALSE_ALARMS), LEAST_RATE * lengths)
        likely = secret - ordinary >= over
        for k in np.flatnonzero(likely).tolist():
            likely[k] = secret[k] - group_score(tokens[k]) >= over[k]
        return likely


def _candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """Candidate tokens that lie in no base span, and whether one overlaps a base span."""
    found, k = [], 0
    ends = np.maximum.accumulate([e for _, _, e in spans]).tolist() if spans else []
    for m in _CANDIDATE.finditer(text):
        while k < len(spans) and ends[k] <= m.start():
            k += 1
        inside, touched, at = False, False, k
        while not inside and at < len(spans) and spans[at][0] < m.end():
            touched |= spans[at][2] > m.start()
            inside |= spans[at][0] <= m.start() and m.end() <= spans[at][2]
            at += 1
        if not inside:
            found.append((*m.span(), touched))
    return found


def _first(values: list[tuple[int, str]], sample: int, most_chars: int) -> list[tuple[int, str]]:
    """The values (hash, value) of the least hashes, until there are `sample` or the next begins beyond `most_chars`."""
    out, chars = [], 0
    for h, v in nsmallest(sample, values):
        if chars > most_chars:
            break
        out.append((h, v))
        chars += len(v)
    return out


def fit(docs: DataFrame, sample: int = SAMPLE, most_chars: int = SAMPLE_CHARS) -> Model:
    """Learns from at most `sample` values of each kind and about `most_chars` characters of them, those with the
    least hash over all documents; a value is whole, however long."""

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: list[set[tuple[int, str]]] = [set() for _ in KINDS]
        for chunk in chunks(batches):
            for text in as_text(chunk.column("text")):
                spans = base_spans(text)
                for span in spans:
                    v = _value(text, span)
                    least[span[1]].add((crc32(v.encode()), v))
                least[3] |= {(crc32(v.encode()), v) for a, b, touched in _candidates(text, spans) if not touched for v in (text[a:b],)}
            least = [set(_first(list(x), sample, most_chars)) for x in least]
        rows = [(k, h, v) for k, x in enumerate(least) for h, v in sorted(x)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["kind", "hash", "value"])

    values = stored(spread(docs.select("text")).mapInArrow(examples, "kind int, hash long, value string")).distinct()
    chosen: dict[int, list[str]] = {}
    for k in range(len(KINDS)):
        rows = values.where(F.col("kind") == k).orderBy("hash", "value").limit(sample).toLocalIterator()
        chosen[k] = sorted(v for _, v in _first([(r.hash, r.value) for r in rows], sample, most_chars))
    return Model(chosen)


def _found(texts: list[str], model: Model) -> list[list[tuple[int, int, int]]]:
    """All spans of each text: the base ones, then what the automata add."""
    all_spans = [base_spans(t) for t in texts]
    places = [(k, a, b) for k, (t, spans) in enumerate(zip(texts, all_spans, strict=True)) for a, b, _ in _candidates(t, spans)]
    likely = model.likely([texts[k][a:b] for k, a, b in places])
    added: dict[int, list[tuple[int, int, int]]] = {}
    for k, a, b in (places[i] for i in np.flatnonzero(likely).tolist()):
        added.setdefault(k, []).append((a, 3, b))
    return [sorted([*spans, *added[k]]) if k in added else spans for k, spans in enumerate(all_spans)]


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row for each document (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format.

    Spans are kind:start:end in code points of the whole match, end exclusive. A null text is empty, repeated rows
    have a row each, other columns aren't read. Spans of different kinds may overlap; added ones lie within none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            found = _found(as_text(chunk.column("text")), shared.value)
            number = [pa.array([sum(s[1] == k for s in spans) for spans in found], pa.int64()) for k in range(len(KINDS))]
            base = [hashlib.sha256(_shown([s for s in spans if s[1] < 3]).encode()).hexdigest() for spans in found]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *number[:3], pa.array(base, pa.string()), pa.array(map(_shown, found), pa.string()), number[3]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"])

    docs = docs.select("doc_id", "text")
    return spread(docs).mapInArrow(find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")


def redact(docs: DataFrame, mark: str = "[secret]", model: Model | None = None) -> DataFrame:
    """`docs` with every found span replaced by `mark`, overlapping ones by one, and n_chars, if there is such a
    column, counted anew for those. Every row stays; texts without a span, null or empty ones are as they were, an
    empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            texts = as_text(chunk.column("text"))
            hit = {k: spans for k, spans in enumerate(_found(texts, shared.value)) if spans}
            for k, spans in hit.items():
                parts, at = [], 0
                for start, _, stop in spans:
                    if start >= at:
                        parts += [texts[k][at:start], mark]
                    at = max(at, stop)
                texts[k] = "".join([*parts, texts[k][at:]])
            if hit:
                null = chunk.column("text").is_null().to_pylist()
                columns = {n: chunk.column(i) for i, n in enumerate(chunk.schema.names)}
                columns["text"] = pa.array([None if x else t for t, x in zip(texts, null, strict=True)], pa.string())
                if "n_chars" in columns:
                    kind = columns["n_chars"].type
                    columns["n_chars"] = pa.array([len(texts[k]) if k in hit else n for k, n in enumerate(columns["n_chars"].to_pylist())], kind)
                chunk = pa.RecordBatch.from_pydict(columns)
            yield chunk

    return spread(docs).mapInArrow(clean, docs.schema)

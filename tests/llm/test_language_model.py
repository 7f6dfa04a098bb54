import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from texts import prose

from marlstone.llm import context_tree, language_model

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def base(docs):
    tokens = {k: TOKEN.findall(lowered(t)) + [None] for k, t in docs}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in docs}
    counts = Counter(t for k, ts in tokens.items() if not held[k] for t in ts)
    n, v = sum(counts.values()), len(counts)
    score = lambda t: math.log10((counts.get(t, 0) + 0.5) / (n + 0.5 * (v + 1)))
    return {k: (held[k], len(ts), sum(counts.get(t, 0) > 0 for t in ts), n, sum(map(score, ts))) for k, ts in tokens.items()}


def test_base_and_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    wanted = base([tuple(r) for r in docs.collect()])
    rows = language_model.score_documents(docs).collect()
    assert len(rows) == len(wanted)
    for r in rows:
        held, n, known, total, score = wanted[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9)
    held = [r for r in rows if r.held_out]
    # 200 documents teach the bytes, not yet the words: far below the 8 bits of a byte without a model.
    assert sum(r.bits_per_byte for r in held) / len(held) < 4


def weighted(strings, depth):
    """Log weighted probability of the texts by the definition: nodes by their bytes, decisions by their bits."""
    counts = Counter()
    for s in strings:
        data = b"\xff" * depth + s + b"\xff"
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                node = 1
                for bit in format(data[i], "08b"):
                    counts[data[i - d : i][::-1], node, bit] += 1
                    node = node * 2 + int(bit)
    return counts


def codes_of(texts):
    return context_tree.gram_codes([t + context_tree.END for t in texts], [context_tree.END * context_tree.DEPTH] * len(texts))


def model_of(texts):
    """A function from grams to their log10 probabilities after training on the texts."""
    grams, counts = np.unique(codes_of(texts)[0], return_counts=True) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def logs(codes):
        every, seen = context_tree.tally(np.concatenate([grams, np.unique(codes)]), np.concatenate([counts, np.zeros(len(np.unique(codes)), np.int64)]))
        top = context_tree.Top(*context_tree.top_sums(every, seen))
        return context_tree.gram_logs(every, seen, top)[np.searchsorted(every, codes)]

    return logs


def score(model, texts):
    codes, lengths = codes_of(texts)
    return np.add.reduceat(model(codes), np.cumsum(lengths) - lengths)


def test_tree_is_context_tree_weighting():
    """Every byte's probability against a direct recursion over all contexts."""
    r = random.Random(3)
    texts = ["".join(r.choice("aab ") for _ in range(12)).encode() for _ in range(6)]
    depth = context_tree.DEPTH
    model = model_of(texts)
    seen = weighted(texts, depth)
    contexts = {c for c, _, _ in seen}

    def log_kt(c, node):
        a, b = seen[c, node, "0"], seen[c, node, "1"]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def children(c):
        return [x for x in contexts if len(x) == len(c) + 1 and x[: len(c)] == c]

    cache = {}

    def log_weighted(c, node):
        if (c, node) not in cache:
            own = log_kt(c, node)
            cache[c, node] = own if len(c) == depth else np.logaddexp(own, sum(log_weighted(x, node) for x in children(c))) - math.log(2)
        return cache[c, node]

    def p_one(context, node):
        p, left = 0.0, 1.0
        for d in range(depth + 1):
            c = context[:d]
            kt = (seen[c, node, "1"] + 0.5) / (seen[c, node, "0"] + seen[c, node, "1"] + 1)
            if d == depth or not seen[context[: d + 1], node, "0"] + seen[context[: d + 1], node, "1"]:
                return p + left * kt  # below what this decision has visited there is nothing to mix
            stop = math.exp(log_kt(c, node) - math.log(2) - log_weighted(c, node))
            p, left = p + left * stop * kt, left * (1 - stop)

    for text in [texts[0], b"abba b", b"zq", b""]:
        data, total = b"\xff" * depth + text + b"\xff", 0.0
        for i in range(depth, len(data)):
            node = 1
            for bit in format(data[i], "08b"):
                one = p_one(data[i - depth : i][::-1], node)
                total += math.log10(one if bit == "1" else 1 - one)
                node = node * 2 + int(bit)
        assert score(model, [text])[0] == pytest.approx(total, rel=1e-9)


def test_probabilities_after_any_context_sum_to_one():
    r = random.Random(5)
    for texts in ([], [b"the cat and the dog and the cow", b"then there they them", b"", b"the"]):
        model = model_of(texts)
        for context in [b"\xff" * 5, b"ehT d", b"eht d", b"eht q", b" eht ", *(bytes(r.choices(b"the andog", k=5)) for _ in range(20))]:
            code = int.from_bytes(context, "big") << 8
            assert (10.0 ** model(np.arange(256, dtype=np.uint64) + np.uint64(code))).sum() == pytest.approx(1, abs=1e-9)


def test_probabilities_of_short_texts_sum_to_one():
    """Whatever bytes the texts hold, the end's included: all texts of one byte, and whatever goes on after each."""
    model = model_of([b"ab", b"a", b"", b"b\x00"])
    logs = score(model, [context_tree.escaped(bytes([b])) for b in range(256)] + [b""])
    on = context_tree.gram_codes([context_tree.escaped(bytes([b])) for b in range(256)], [context_tree.END * context_tree.DEPTH] * 256)
    assert len({context_tree.escaped(bytes(x)) for x in ((254,), (255,), (254, 0), (254, 1))}) == 4
    totals = np.add.reduceat(model(on[0]), np.cumsum(on[1]) - on[1])
    assert (10.0**logs).sum() < 1 and (10.0**totals).sum() + 10.0 ** logs[-1] <= 1 + 1e-9


def test_whole_packets_in_any_groups_give_the_same():
    texts = [prose(k, 60).encode() for k in range(20)]
    grams, counts = np.unique(codes_of(texts)[0], return_counts=True)
    counts = counts * (grams % np.uint64(7) > 0)  # some are asked for only
    whole = context_tree.Top(*context_tree.top_sums(grams, counts))
    of = context_tree.packet_of(grams) % 5
    total = np.zeros((1 << 16, 3))
    for k in range(5):
        at, sums = context_tree.top_sums(grams[of == k], counts[of == k])
        total[at] += sums
    parted = context_tree.Top(np.arange(1 << 16), total)
    logs = context_tree.gram_logs(grams, counts, whole)
    for k in range(5):
        assert np.allclose(context_tree.gram_logs(grams[of == k], counts[of == k], parted), logs[of == k], atol=1e-9)


def test_scores_do_not_depend_on_units_and_slices(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(80)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    whole = {r.doc_id: r for r in language_model.score_documents(docs).collect()}
    monkeypatch.setattr(language_model, "UNIT_BYTES", 10_000)
    monkeypatch.setattr(language_model, "SLICE_BYTES", 20_000)
    monkeypatch.setattr(language_model, "HELD", 5_000)
    parted = language_model.score_documents(docs.repartition(7)).collect()
    assert len(parted) == len(whole)
    for r in parted:
        assert r[:5] == whole[r.doc_id][:5] and r.score == pytest.approx(whole[r.doc_id].score, rel=1e-6)
    model = model_of([b" ".join(r.text.encode().lower().split()) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 1])
    for r in docs.collect()[:10]:
        assert whole[r.doc_id].score == pytest.approx(score(model, [b" ".join(r.text.encode().lower().split())])[0], rel=1e-6)


def test_more_text_teaches_more(spark):
    """Held-out bits a byte fall as the training documents grow tenfold, and tenfold again."""
    bits = []
    for n in (20, 200, 2000):
        docs = spark.createDataFrame([(k, prose(k, 40)) for k in range(n)], "doc_id long, text string")
        held = [r.bits_per_byte for r in language_model.score_documents(docs).collect() if r.held_out]
        bits.append(sum(held) / len(held))
    assert bits[0] > 1.03 * bits[1] and bits[1] > bits[2]


def test_long_texts_are_scored_in_pieces(spark):
    long = prose(8, 200_000)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([long, long[:-1], "a b", long])], "doc_id long, text string")
    rows = {r.doc_id: r for r in language_model.score_documents(docs).collect()}
    assert rows[0].score == rows[3].score and rows[0].n_tokens == 200_001
    parts = [x for x in language_model._parts([long.encode()])]
    assert b"".join(b for x in parts for b in x[2]) == long.encode() + b"\xff" and len(parts) > 1
    codes = np.concatenate([context_tree.gram_codes(x[2], x[3])[0] for x in parts])
    assert (codes == codes_of([long.encode()])[0]).all()


def test_edges(spark, edge_docs, no_docs):
    rows = language_model.score_documents(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 6)} == {1}
    assert language_model.score_documents(no_docs).count() == 0

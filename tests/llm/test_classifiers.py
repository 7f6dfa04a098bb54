import random
import re
import zlib
from collections import Counter

import numpy as np
from texts import prose

from marlstone.llm import labelled as labelled_rows
from marlstone.llm import quality, toxicity

BAD = ("vile", "rotten", "foul")


def labelled(spark, n=400):
    r, docs, labels = random.Random(9), [], []
    for k in range(n):
        words = prose(k, 60).split()
        toxic, junk = k % 5 == 0, k % 4 == 1
        if toxic:
            for _ in range(3):
                words[r.randrange(60)] = r.choice(BAD)
        if junk:
            words = [w + "***" for w in words] if k % 8 == 1 else [w for w in words[:6] for _ in range(10)]
        docs.append((k, " ".join(words)))
        if k % 10 != 7:
            labels.append((k, int(not junk), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(rows, wrong):
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    return sum(not wrong(r) for r in held) / len(held)


def test_quality(spark):
    docs, labels = labelled(spark)
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == 400 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert accuracy(rows, lambda r: r.predicted != (r.doc_id % 4 != 1)) > 0.97


def mix(x):
    x %= 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def plain_features(text):
    """Words, character 3- and 4-grams of each framed word, and neighbouring pairs, as a list."""
    factor, out, hashes = 0x9E3779B97F4A7C15, [], []
    bucket = lambda h, kind: (mix(h + kind) >> 32) % quality.BUCKETS
    for word in re.findall(r"[^\x20\x09-\x0D]+", text):
        codes = [mix(ord(c) + 1) for c in f"<{word}>"]
        hashes.append(mix(sum(c * pow(factor, k, 2**64) for k, c in enumerate(codes))))
        out.append(bucket(hashes[-1], 1))
        for n in (3, 4):
            for i in range(len(codes) - n + 1):
                gram = 0
                for c in codes[i : i + n]:
                    gram = gram * factor + c
                out.append(bucket(gram, n))
    return out + [0 if a == b else bucket(a * factor + b, 2) for a, b in zip(hashes, hashes[1:], strict=False)]


TEXTS = ["", "one", "the the cat", "ünï x y", "a b c d a b c d", "漢字 naïve <b> ***", prose(4, 150_000)]


def test_features_by_definition():
    for text in TEXTS:
        ids, counts = quality.features(text.encode())
        assert dict(zip(ids.tolist(), counts.tolist(), strict=True)) == Counter(plain_features(text))


def test_training_by_definition(monkeypatch):
    """Vectors and softmax after all passes, against plain loops over features and classes."""
    monkeypatch.setattr(quality, "BUCKETS", 64)
    rows = [(np.array([1, 5, 9]), np.array([2, 1, 1]), 1), (np.array([2, 5]), np.array([1, 3]), 0), (np.array([1, 60]), np.array([1, 1]), 1)]
    random_ = np.random.default_rng(7)
    vectors, out, bias = random_.uniform(-1 / quality.WIDTH, 1 / quality.WIDTH, (64, quality.WIDTH)).tolist(), random_.normal(0, 0.1, (quality.WIDTH, 2)).tolist(), [0.0, 0.0]
    steps, done, width = quality.EPOCHS * 3, 0, range(quality.WIDTH)
    for _ in range(quality.EPOCHS):
        for k in random_.permutation(3):
            ids, counts, y = rows[k]
            rate, n = quality.RATE * (1 - done / steps), sum(counts)
            mean = [sum(c * vectors[i][d] for i, c in zip(ids, counts, strict=True)) / n for d in width]
            raised = [np.exp(sum(mean[d] * out[d][c] for d in width) + bias[c]) for c in (0, 1)]
            wrong = [raised[c] / sum(raised) - (c == y) for c in (0, 1)]
            for i, c in zip(ids, counts, strict=True):
                for d in width:
                    vectors[i][d] -= rate * len(ids) ** 0.5 * c / n * (out[d][0] * wrong[0] + out[d][1] * wrong[1])
            for c in (0, 1):
                for d in width:
                    out[d][c] -= rate * mean[d] * wrong[c]
                bias[c] -= 0.1 * rate * wrong[c]
            done += 1
    model = quality.Model(rows)
    assert np.allclose(model.weight, [sum(v[d] * (out[d][1] - out[d][0]) for d in width) for v in vectors]) and np.isclose(model.bias, bias[1] - bias[0])


def test_quality_scores_by_definition():
    """A task's sums against the plain mean of the features."""
    model = quality.Model([(*quality.features(t.encode()), k % 2) for k, t in enumerate(TEXTS)])
    for text, score in zip(TEXTS, quality.scores(model, [t.encode() for t in TEXTS]), strict=True):
        found = plain_features(text)
        assert np.isclose(score, 1 / (1 + np.exp(-(sum(model.weight[b] for b in found) / max(len(found), 1) + model.bias))))


def test_samples_are_bounded_and_whole(spark):
    docs = spark.createDataFrame([(k, prose(k, 40 if k else 90_000)) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    everything = labelled_rows.training_sample(docs, labels, "quality", held=9).orderBy("part").collect()
    assert len(everything) == 60 and max(len(r.text) for r in everything) > 300_000
    few = labelled_rows.training_sample(docs, labels, "quality", held=9, most=20, most_bytes=2_000).orderBy("part").collect()
    sizes = [len(r.text.encode()) for r in few]
    assert few == everything[: len(few)] and len(few) <= 20 and sum(sizes[:-1]) <= 2_000 < sum(sizes)


def test_toxicity(spark):
    docs, labels = labelled(spark)
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == 400 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert accuracy(rows, lambda r: r.predicted != (r.doc_id % 5 == 0 and r.doc_id % 4 != 1) and not (r.doc_id % 5 == 0 and r.doc_id % 4 == 1)) > 0.97


def test_log_odds_by_definition(spark):
    """Scores of words and prefixes against counts and priors worked out in plain Python."""
    texts = [(f"{prose(k, 30)} {BAD[k % 3] if k % 4 == 0 else 'plain'} {BAD[0] + 'er' if k % 8 == 0 else ''} Rottenly", int(k % 4 == 0)) for k in range(120)]
    lexicon = toxicity._log_odds(spark.createDataFrame(texts, "text string, y int"))
    seen, bad = Counter(), Counter()
    for text, y in texts:
        for w in set(text.lower().split()):
            seen[w] += 1
            bad[w] += y
    share = (sum(bad.values()) + 0.5) / (sum(seen.values()) + 1)
    starts = lambda c, p: sum(n for w, n in c.items() if len(w) >= len(p) and w.startswith(p))

    def of_prefix(p):
        above = of_prefix(p[:-1]) if len(p) > 4 and starts(seen, p[:-1]) >= toxicity.LEAST else share
        return (starts(bad, p) + toxicity.PRIOR * above) / (starts(seen, p) + toxicity.PRIOR)

    def odds(p, n):
        value = np.log(p / (1 - p)) - np.log(share / (1 - share))
        return value if abs(value) >= toxicity.CERTAIN / ((n + toxicity.PRIOR) * p * (1 - p)) ** 0.5 else 0.0

    for word in {*seen, "foulness", "unseen"}:
        known = [word[:n] for n in (5, 4) if len(word) >= n and starts(seen, word[:n]) >= toxicity.LEAST]
        above = of_prefix(known[0]) if known else share
        if seen[word] >= toxicity.LEAST:
            expected = odds((bad[word] + toxicity.PRIOR * above) / (seen[word] + toxicity.PRIOR), seen[word])
        else:
            expected = odds(above, starts(seen, known[0])) if known else 0.0
        assert np.isclose(lexicon[word.encode()], expected - toxicity.DRIFT), word
    scores, lengths = lexicon.token_scores([b"foul Foul plain", b"plain foul"])
    assert lengths.tolist() == [3, 2] and scores[1] == -toxicity.DRIFT < scores[0] == scores[4]


def test_calibration_by_definition():
    """The rate solves mean exp(rate s) = 1; evidence is rate S - ln(K n) of what is above 0."""
    scores = np.array([-1.0] * 30 + [0.5] * 5 + [2.0] * 3)
    rate = toxicity._null_rate(scores)
    assert rate > 0 and np.isclose(np.mean(np.exp(rate * scores)), 1)
    model = toxicity.Model(toxicity.Lexicon({}, {}), rate=0.7, size=0.2)
    best, total = model.evidence([(9.0, 0, 3), (4.0, 5, 6), (0.5, 8, 8)], 50)
    assert np.isclose(best, 6.3 - np.log(10)) and np.isclose(total, best + 2.8 - np.log(10))


def brute_segments(x):
    """Ruzzo and Tompa's maximal segments by repeated search for the best one."""
    out = []

    def find(a, b):
        best = max(((sum(x[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] > 0:
            i = -best[2]
            j = i - best[1]
            out.append((round(best[0], 9), i, j))
            find(a, i)
            find(j, b)

    find(0, len(x))
    return sorted(out)


def test_segments_by_definition():
    r = random.Random(1)
    for _ in range(200):
        x = [r.choice([-3, -2, -1, 1, 2, 4]) + r.random() / 100 for _ in range(r.randrange(25))]
        cut = r.randrange(len(x) + 1)
        found = list(toxicity.passages(np.array(x), np.array([cut, len(x) - cut])))
        for part, segments in zip((x[:cut], x[cut:]), found, strict=True):
            assert sorted((round(s, 9), i, j + 1) for s, i, j in segments) == brute_segments(part)


def test_edges(spark, edge_docs, no_docs):
    docs, labels = labelled(spark, 120)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = labels.unionAll(spark.createDataFrame([(None, 1, 1), (5, None, None), (6, 7, 7), (8, 0, 0), (8, 1, 1)], "doc_id long, quality int, toxic int"))
    for module, keep in ((quality, quality.keep_good), (toxicity, None)):
        for truth in (labels, empty, odd):
            assert module.score_documents(edge_docs, truth).count() == edge_docs.count()
        assert module.score_documents(no_docs, labels).count() == 0
        assert module.score_documents(docs.unionAll(docs), odd).count() == 240
        if keep:
            assert keep(edge_docs, labels).schema == edge_docs.schema
            assert keep(edge_docs, empty).count() == edge_docs.count()  # nothing is known, so nothing goes
    assert {r.score for r in quality.score_documents(docs, empty).collect()} == {0.5}

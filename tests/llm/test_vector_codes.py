import hashlib
import math
import random

import numpy as np
import pytest

from marlstone.llm import vector_codes


def brute(rows, parts=16, entries=64, rounds=2):
    """The contract by plain loops over whole numbers."""
    kept = [(v, [math.floor(256 * x) for x in e], label) for v, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
    width = len(kept[0][1]) // parts
    part = lambda x, p: tuple(x[p * width : (p + 1) * width])
    books = [[part(x, p) for _, x, _ in kept[:entries]] for p in range(parts)]

    def nearest(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(x, p), c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, x, _ in kept:
                members.setdefault(nearest(x, p)[1], []).append(part(x, p))
            books[p] = [tuple(sum(c) // len(members[e]) for c in zip(*members[e], strict=True)) if e in members else b for e, b in enumerate(books[p])]
    found = [(v, label, [nearest(x, p) for p in range(parts)]) for v, x, label in kept]
    sums = {}
    for _, label, near in found:
        sums[label] = sums.get(label, 0) + sum(d for d, _ in near)
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted(((v, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), sums[label], digest) for v, label, near in found), key=str)


def check(spark, rows, kind="float", **how):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    assert sorted(map(tuple, vector_codes.compress(frame, **how).collect()), key=str) == brute(rows, **how)


def made(seed, n, wide, kinds=5):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(kinds, wide))
    of = r.integers(0, kinds, n)
    return [(k, (middle[o] + 0.3 * r.normal(size=wide)).astype(np.float32).tolist(), int(o)) for k, o in enumerate(of.tolist())]


def test_tables(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").limit(150).collect()]
    check(spark, rows)


@pytest.mark.parametrize("parts, entries, rounds, wide", [(4, 16, 6, 8), (2, 40, 5, 6), (3, 3, 4, 3), (1, 1, 2, 2)])
def test_many_rounds_equal_brute_force(spark, parts, entries, rounds, wide):
    check(spark, made(wide, 400, wide), parts=parts, entries=entries, rounds=rounds)


def test_edges(spark):
    r = random.Random(4)
    ok = lambda: [r.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(16)]
    rows = [(k, ok(), k % 3 or None) for k in range(30)] + [(5, ok(), 1), (None, ok(), None), (None, ok(), 2)]
    rows += [(k, rows[3][1], 7) for k in range(40, 50)]  # ties
    rows += [(50, None, 1), (51, [*ok()[:15], None], 1), (52, [*ok()[:15], float("nan")], 1), (53, [*ok()[:15], float("-inf")], 1)]
    check(spark, rows)
    check(spark, rows, "double")
    wide = spark.createDataFrame([(*x, "more", 1) for x in rows], "vec_id long, embedding array<float>, label int, code string, error int")
    assert vector_codes.compress(wide).count() == len(rows) - 4
    for none in ([], [(1, None, 1)], [(1, [None] * 16, 1)]):
        assert vector_codes.compress(spark.createDataFrame(none, "vec_id long, embedding array<float>, label int")).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 15, 1)], "vec_id long, embedding array<float>, label int"))


@pytest.mark.parametrize("seed", range(5))
def test_bounds_hold_and_settle_most(seed):
    """After moves of any size: the nearest entry is exact, no bound exceeds a true distance, most rows measure little."""
    r = np.random.default_rng(seed)
    x, book, b = r.integers(-60, 60, (800, 4)), r.integers(-60, 60, (64, 4)), 16
    near, low, _ = vector_codes.measured(x, book, b)
    for step in range(4):
        new = book + r.integers(-2, 3, book.shape) * (step != 2) + r.integers(-30, 30, book.shape) * (step == 2)
        moved = ((new - book) ** 2).sum(1) ** 0.5 * (1 + vector_codes._SLACK)
        near, low, least, needed = vector_codes.reassigned(x, new, moved, near, low)
        true = ((x[:, None] - new[None]) ** 2).sum(2)
        assert (near[:, 0] == true.argmin(1)).all() and (least == true.min(1)).all()
        assert (np.diff(low, axis=1) >= 0).all() and all(len(set(n)) == b for n in near.tolist())
        for k in range(len(x)):
            others = np.delete(true[k], near[k]) ** 0.5
            assert (low[k, :-1] <= true[k, near[k, 1:]] ** 0.5).all() and low[k, -1] <= others.min()
        if step < 2:
            assert (needed == b).mean() < 0.2 and (needed == 0).mean() > 0.1
        book, cut = new, vector_codes.Bounds(near[:, None], low[:, None]).cut(b - 1)
        near, low, b = cut.near[:, 0], cut.low[:, 0], b - 1


def test_adapted():
    assert vector_codes.adapted(np.array([900, 50, 40, 5, 3, 2, *[0] * 11]), 64, 16) == 8  # an eighth at least
    needs = np.zeros(17, np.int64)
    needs[[0, 11, 16]] = 900, 90, 10
    assert vector_codes.adapted(needs, 64, 16) == 12 and vector_codes.adapted(needs[:11], 64, 10) == 8

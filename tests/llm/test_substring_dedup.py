import hashlib
import random
import re

import numpy as np
import pytest
from texts import prose

from marlstone.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, size=20):
    words = [(doc, WORD.findall(text or "")) for doc, text in docs]
    place = lambda doc, k: (doc is None, doc or 0, k)
    first = {}
    for doc, w in words:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, (2,)), place(doc, k))
    out = []
    for doc, w in words:
        gone = {k + j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < place(doc, k) for j in range(size)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, docs, size=20, **how):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = substring_dedup.keep_first(frame, size, **how).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in found), key=str) == brute(docs, size)


def passages(seed, n):
    """Texts that share passages, copies, a common line, and a text that repeats itself."""
    r = random.Random(seed)
    shared = [prose(900 + k, 19 + k) for k in range(8)]
    docs = []
    for k in range(n):
        parts = [prose(seed + k, r.randrange(40)) for _ in range(3)]
        parts += r.choices(shared, k=r.randrange(3)) + ([shared[5]] if k % 3 == 0 else [])
        r.shuffle(parts)
        docs.append(r.choice([" ", "\n", " \t"]).join(parts))
    docs += [docs[3]] * 5 + [" ".join([prose(1, 25)] * 4), "a " * 70]
    ids = r.sample(range(-50, 5 * len(docs)), len(docs))
    return list(zip(ids, docs, strict=True))


def test_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.remove_repeats(frame).collect()), key=str) == brute(docs)


@pytest.mark.parametrize("seed, unit_bytes, slice_bytes", [(1, 2_000, 3_000), (2, 1 << 20, 1 << 20), (3, 1, 500)])
def test_units_and_slices_of_any_size(spark, seed, unit_bytes, slice_bytes):
    check(spark, passages(seed, 60), unit_bytes=unit_bytes, slice_bytes=slice_bytes)


def test_windows_of_other_sizes(spark):
    docs = passages(5, 25)
    for size in (1, 7, 32):
        check(spark, docs, size)


def test_a_full_table_loses_nothing(spark, monkeypatch):
    """With far too few counters every window is estimated as repeated, and the second pass settles them all."""
    monkeypatch.setattr(substring_dedup, "CELLS", 5)
    monkeypatch.setattr(substring_dedup.estimates, "__defaults__", (2, 5))
    check(spark, passages(8, 30), unit_bytes=3_000)


def test_edges(spark, edge_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    found = substring_dedup.remove_repeats(edge_docs.withColumnRenamed("score", "n_words").withColumnRenamed("key", "unit")).collect()
    assert sorted(map(tuple, found), key=str) == brute(docs)
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    long = prose(2, 30)
    check(spark, [(None, long), (None, long), (None, "x " + long), (9, long), (9, long), (9, "x " + long), (4, None), (5, "")], unit_bytes=10)


def test_estimates_are_never_below_the_true_counts():
    r = np.random.default_rng(1)
    for cells in (64, 1024, 1 << 16):
        sketches = [np.unique(r.integers(0, 3000, 400)).astype(np.uint32) for _ in range(12)]
        codes, counts = np.unique(np.concatenate(sketches), return_counts=True)
        several = set(codes[counts > 1].tolist())
        marked = substring_dedup.estimates(sketches, 2, cells)
        assert all(m for s, bits in zip(sketches, marked, strict=True) for c, m in zip(s.tolist(), bits.tolist(), strict=True) if c in several)
        falsely = sum(m and c not in several for s, bits in zip(sketches, marked, strict=True) for c, m in zip(s.tolist(), bits.tolist(), strict=True))
        assert falsely < 40 or cells < 1 << 16


def test_rolled_hashes_tell_windows_apart():
    r = np.random.default_rng(2)
    codes = r.integers(0, 3, 4000).astype(np.uint64) * np.uint64(0x123456789ABCDEF1)
    for size in (1, 2, 3, 7, 20):
        hashes = substring_dedup.rolled(codes, size, 0x9E3779B97F4A7C15)
        assert len(hashes) == 4000 - size + 1
        assert len({tuple(codes[k : k + size].tolist()) for k in range(len(hashes))}) == len(set(hashes.tolist()))
    assert len(substring_dedup.rolled(codes[:4], 5, 3)) == 0

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from texts import prose

from marlstone.llm import near_duplicates
from marlstone.llm.common import clear_stored, scratch, shared_folder, stored
from marlstone.llm.decontamination import words_of


def weights(docs):
    """Shingle weights from the definition: (1 + ln tf) times the mean idf of the words."""
    texts = [words_of((text or "").encode()) for _, text in docs]
    df = Counter(w for words in texts for w in set(words))
    idf = {w: min(1, math.log(1 + len(docs) / n) / math.log(1025)) if n * 1024 > len(docs) else 1 for w, n in df.items()}
    counted = [Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))) for w in texts]
    return [{s: (1 + math.log(n)) * sum(idf[w] for w in s) / len(s) for s, n in c.items()} for c in counted]


def brute(docs, least=0.8):
    """Groups of ids by comparing all pairs."""
    sets, root = weights(docs), list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in itertools.combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        both = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
        if (docs[i][1] or "") == (docs[j][1] or "") or both and both >= least * (sum(a.values()) + sum(b.values()) - both):
            root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for k, (doc, _) in enumerate(docs):
        groups.setdefault(find(k), []).append(doc)
    return sorted(sorted(g) for g in groups.values())


def edited(text, seed, share):
    r, words = random.Random(seed), text.split()
    for _ in range(max(1, int(len(words) * share))):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def groups_of(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.class_id, []).append(r.doc_id)
    return sorted(sorted(g) for g in groups.values())


def test_groups_equal_brute_force(spark):
    docs, k = [], itertools.count()
    passage = prose(999, 60)
    for seed in range(40):
        text = prose(seed, 20 + 15 * seed)
        docs += [(next(k), t) for t in (text, text, edited(text, seed, 0.005), edited(text, seed + 50, 0.02), edited(text, seed, 0.3))]
        docs.append((next(k), passage + " " + prose(seed + 500, 30)))
    big = prose(77, 200)
    docs += [(next(k), edited(big, s, 0.01)) for s in range(60)] + [(next(k), big)] * 30
    docs = [(n, t) for n, (_, t) in enumerate(docs)]
    rows = near_duplicates.group_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert groups_of(rows) == brute(docs)
    assert sum(r.kept for r in rows) == len(brute(docs)) and all(r.kept == (r.doc_id == r.class_id) for r in rows)
    copies = Counter(t for _, t in docs)
    assert all(r.n_copies == copies[dict(docs)[r.doc_id]] for r in rows)


def test_tables(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in frame.collect()]
    assert groups_of(near_duplicates.group_documents(frame).collect()) == brute(docs)
    left = near_duplicates.keep_one(frame)
    assert left.schema == frame.schema
    assert sorted(r.doc_id for r in left.collect()) == [g[0] for g in brute(docs)]


def test_components_of_long_chains(spark):
    edges = [(b"%04d" % k, b"%04d" % (k + 1)) for k in range(60) if k != 30] + [(b"x", b"y")]
    roots = {bytes(r.key): bytes(r.root) for r in near_duplicates.components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary")).collect()}
    assert all(roots[b"%04d" % k] == (b"0000" if k <= 30 else b"0031") for k in range(61)) and roots[b"y"] == b"x"


def test_edges(spark, edge_docs, no_docs):
    rows = near_duplicates.group_documents(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].class_id == by_id[3].class_id == 2 and by_id[6].class_id == 6 and by_id[8].class_id == 8
    assert near_duplicates.group_documents(no_docs).count() == 0
    left = near_duplicates.keep_one(edge_docs)
    assert left.schema == edge_docs.schema
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "4", "5", "6", "7", "8", "None"]


def test_chains_in_large_buckets_equal_all_pairs_of_the_buckets(spark):
    words, r = prose(5, 400).split(), random.Random(7)

    def changed(places, mark):
        return " ".join(f"{mark}{k}" if k in places else w for k, w in enumerate(words))

    # 1 of 396 shingles' words changed in an edit; 8 more in an edit of it, which is then similar to that edit only.
    firsts, seconds = [], []
    for n in range(300):
        places = [6 * k for k in r.sample(range(66), 9)]
        firsts.append(changed(places[:1], f"new{n}x"))
        if n < 60:
            seconds.append(changed(places, f"new{n}x"))
    docs = [" ".join(words)] * 3 + firsts + seconds
    weighing = near_duplicates.word_weights(spark.createDataFrame([(t,) for t in docs], "text string"))
    found = near_duplicates.shingles([t.encode() for t in docs], near_duplicates._Hashes(), weighing)
    weight, ends = found.weight, found.number.cumsum()
    sets = [dict(zip(found.found[e - n : e].tolist(), weight[e - n : e].tolist(), strict=True)) for e, n in zip(ends, found.number, strict=True)]
    root, buckets = list(range(len(docs))), {}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, row in enumerate(near_duplicates.bands(near_duplicates.samples(found)).tolist()):
        for band in row:
            buckets.setdefault(band, []).append(k)
    assert max(map(len, buckets.values())) > 150
    for i, j in {p for b in buckets.values() for p in itertools.combinations(b, 2)}:
        both = sum(min(w, sets[j].get(s, 0)) for s, w in sets[i].items())
        if top(i) != top(j) and both >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - both):
            root[max(top(i), top(j))] = min(top(i), top(j))
    expected = {}
    for k in range(len(docs)):
        expected.setdefault(top(k), []).append(k)
    rows = near_duplicates.group_documents(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert groups_of(rows) == sorted(expected.values())


def weighed(text, weights, hashes):
    s = near_duplicates.shingles([text], hashes, weights)
    order = np.argsort(s.found)
    return s.found[order], s.weight[order]


def test_overlaps_of_blocks_equal_pairs():
    texts = [edited(prose(3, 120) + " again and again and again and again and again", s, 0.02).encode() for s in range(40)] + [prose(s, 50).encode() for s in range(20)]
    hashes = near_duplicates._Hashes()
    codes = np.unique(near_duplicates.word_codes(texts[:1], hashes)[0])[:20]
    weights = near_duplicates.Weights(codes, np.linspace(0.1, 0.9, len(codes)))
    links = near_duplicates.crossing(texts, [b"%d" % k for k in range(60)], None, weights, 0.6, hashes)
    root = list(range(60))
    for a, b in links:
        assert near_duplicates.similarity(weighed(texts[a], weights, hashes), weighed(texts[b], weights, hashes)) >= 0.6
        root = [root[a] if r == root[b] else r for r in root]
    for a, b in itertools.combinations(range(60), 2):
        assert root[a] == root[b] or near_duplicates.similarity(weighed(texts[a], weights, hashes), weighed(texts[b], weights, hashes)) < 0.6


def test_weights_do_not_depend_on_layout(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    one, many = (near_duplicates.word_weights(texts.repartition(n)) for n in (1, 150))
    assert len(one.hashes) and (one.hashes == many.hashes).all() and (one.idf == many.idf).all()


def test_long_texts_are_split_into_the_same_words():
    text = (prose(3, 100_000) + " " + "y" * 700_000 + " end").encode()
    codes, lengths = near_duplicates.word_codes([b"", text, b"a b"], near_duplicates._Hashes())
    hashes = near_duplicates._Hashes()
    assert codes.tolist() == [hashes[w] for w in words_of(text)] + [hashes[b"a"], hashes[b"b"]] and lengths.tolist() == [0, 100_002, 2]


def test_bands_find_similar_pairs():
    """Recall over pairs of similarity 0.8 or more, of texts of 20 to 400 words."""
    hashes, weights, found, all_pairs = near_duplicates._Hashes(), near_duplicates.Weights(), 0, 0
    for seed in range(150):
        text = prose(seed, 20 + 380 * seed // 150)
        pair = [text.encode(), edited(text, seed, 0.015).encode()]
        if near_duplicates.similarity(*(weighed(t, weights, hashes) for t in pair)) >= 0.8:
            a, b = near_duplicates.bands(near_duplicates.samples(near_duplicates.shingles(pair, hashes, weights)))
            found, all_pairs = found + bool((a == b).any()), all_pairs + 1
    assert all_pairs > 80 and found >= 0.97 * all_pairs


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", "y", "z"), (2, "a b c d e f", "u", "v", "w")], "doc_id long, text string, __key string, __of string, __id string")
    left = near_duplicates.keep_one(docs)
    assert left.schema == docs.schema and [tuple(r) for r in left.collect()] == [(1, "a b c d e f", "x", "y", "z")]


def test_similar_texts_share_a_prefix_shingle_that_leaves_enough():
    """For every pair of similar texts the first shingle both prefixes hold leaves each the weight the other needs."""
    r, texts = random.Random(3), []
    for seed in range(12):
        base = prose(seed, r.randrange(8, 120))
        texts += [base, *(edited(base, 50 * seed + k, r.choice((0.01, 0.03, 0.1))) for k in range(5)), base + " " + prose(seed + 70, r.randrange(1, 12))]
    s = near_duplicates.shingles([t.encode() for t in texts], near_duplicates._Hashes(), near_duplicates.Weights())
    common = Counter(s.found.tolist())
    level = np.array([0 if common[f] == 1 else min(255, 1 + int(8 * math.log2(common[f]))) for f in s.found.tolist()], np.uint8)
    place, owner, before, total = near_duplicates.prefixes(s, level, 0.8)
    held = [{} for _ in texts]
    for p, o, b in zip(place.tolist(), owner.tolist(), before.tolist(), strict=True):
        held[o][int(s.found[p])] = b
    ends, weight, near = s.number.cumsum(), s.weight, 0
    sides = [(s.found[e - n : e], weight[e - n : e]) for e, n in zip(ends, s.number, strict=True)]
    sides = [(f[np.argsort(f)], w[np.argsort(f)]) for f, w in sides]
    for i, j in itertools.combinations(range(len(texts)), 2):
        if near_duplicates.similarity(sides[i], sides[j]) >= 0.8:
            near += 1
            first = min(held[i].keys() & held[j].keys(), key=lambda f: held[i][f])
            wi, wj = sides[i][1].sum(), sides[j][1].sum()
            assert all(w - held[k][first] >= 0.8 / 1.8 * (wi + wj) - 1e-9 for k, w in ((i, wi), (j, wj)))
    assert near > 25


def test_boilerplate_is_not_compared(spark, monkeypatch):
    """Texts of 200 shared and 80 own words fill common buckets; none of them meets all others of its bucket."""
    shared = prose(4, 200)
    met = {}

    def crossing(members, texts, roots, weights, least):
        met["members"] = members.select("key").distinct().count()
        return spark.createDataFrame([], "a binary, b binary")

    def partners(alive, least):
        pairs = real(alive, least)
        met["pairs"] = met.get("pairs", 0) + pairs.count()
        return pairs

    real = near_duplicates._partners
    monkeypatch.setattr(near_duplicates, "_crossing", crossing)
    monkeypatch.setattr(near_duplicates, "_partners", partners)
    for n in (100, 400):
        met.clear()
        docs = spark.createDataFrame([(k, f"{shared} {prose(10_000 + k, 80)}") for k in range(n)], "doc_id long, text string")
        assert len({r.class_id for r in near_duplicates.group_documents(docs).collect()}) == n
        assert met == {"members": 0, "pairs": 0}


def test_only_what_the_result_reads_stays_stored(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def tables():
        return {x.getPath().getName() for x in files.listStatus(folder)} if files.exists(folder) else set()

    before = tables()
    rows = near_duplicates.group_documents(docs)
    assert len(tables() - before) == 2 and rows.count() == docs.count()
    left = near_duplicates.keep_one(docs)
    assert len(tables() - before) == 4 and left.count() < docs.count()
    with pytest.raises(ZeroDivisionError), scratch(spark):
        stored(docs.select("doc_id"))
        raise ZeroDivisionError
    assert len(tables() - before) == 4
    clear_stored(spark)
    assert not tables()

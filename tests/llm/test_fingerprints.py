import hashlib
import random

from pyspark.sql import functions as F
from texts import prose

from marlstone.llm import fingerprints


def test_edits(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    assert sorted(rows, reverse=True) == ids
    for doc, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, cut = texts[doc], len(texts[doc]) // 3
        r = rows[doc]
        edited = text[: len(text) - cut] + texts[after][:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        same = lambda a, b: sum(x == y for x, y in zip(a.split("-"), b.split("-"), strict=True)) / 16
        assert r.near_edited == same(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == same(r.fingerprint, rows[after].fingerprint)
    by_text = {}
    for doc, r in rows.items():
        assert by_text.setdefault(texts[doc], r.fingerprint) == r.fingerprint
    near = sorted(r.near_edited for r in rows.values())
    assert near[len(near) // 2] >= 0.25 and sum(r.near_next for r in rows.values()) / len(rows) < 0.05


def test_word_order_and_common_words_do_not_matter(spark):
    words = [prose(k, 40) for k in range(200)]
    mixed = " ".join(reversed(words[0].split()))
    docs = spark.createDataFrame([*enumerate(words), (200, mixed)], "doc_id long, text string")
    marks = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs).collect()}
    assert marks[0] == marks[200] != marks[1]


def test_edges(spark, edge_docs, no_docs):
    rows = fingerprints.fingerprint_edits(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    empty = [r for r in rows if r.doc_id in (2, 3)]
    assert len({r.fingerprint for r in empty}) == 1 and {r.n_chars for r in empty} == {0}
    assert fingerprints.fingerprint_edits(no_docs).count() == 0
    one = fingerprints.fingerprint_edits(edge_docs.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert set(edge_docs.columns) < set(fingerprints.fingerprint(edge_docs).columns)


def test_every_term_has_a_place_and_no_other_word_has():
    r = random.Random(2)
    for n in (0, 1, 2, 3, 50, 5_000):
        terms = r.sample(range(2**52), n)
        table = fingerprints.table_of(terms)
        half, factors = len(table) // 2, [fingerprints._factors(fingerprints.PARTS + side) for side in (0, 1)]
        places = lambda t: [side * half + (t % fingerprints.PRIME * a + b) % fingerprints.PRIME % half for side, (a, b) in enumerate(factors)]  # noqa: E731, B023
        assert len(table) <= 3.5 * n + 2 and sorted(x for x in table if x >= 0) == sorted(terms)
        assert all(any(table[p] == t for p in places(t)) for t in terms)


def test_only_words_in_the_band_are_terms(spark):
    """Words of every frequency, told one by one."""
    r = random.Random(3)
    words = [f"word{k}" for k in range(600)]
    texts = [" ".join(w for k, w in enumerate(words) if r.random() < (k + 1) / 2000) for _ in range(400)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    held = fingerprints.lexicon(docs, (0.05, 0.1))
    df = {w: sum(w in t.split() for t in texts) for w in words}
    alone = spark.createDataFrame([(w,) for w in words], "word string").select("word", held.has(fingerprints.word_hashes(F.col("word"))[0]).alias("inside"))
    assert {x.word: x.inside for x in alone.collect()} == {w: 20 <= df[w] <= 40 for w in words}

import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from texts import prose
from tokenizers import Tokenizer

from marlstone.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def token_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, docs, capacity=2048):
    """Every document's ids come back whole and in order; every sequence is gapless and within its capacity."""
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {k for k, _ in docs}
    for doc, text in docs:
        ids, own = token_ids(text), sorted(pieces[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])
        assert sum(r.length for r in own) == len(ids)
        assert all(r.length == capacity for r in own[1:]) and (len(own) == 1) == (len(ids) <= capacity)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    used = check(rows, docs)
    assert used <= -(-sum(r.length for r in rows) // 2048) * 1.03 + 4


def test_odd_texts(spark, edge_docs, no_docs):
    texts = ["", None, "<|endoftext|> is text", "  a  b\n\n\nc\t d ", "it's we'll they'd", "x²³ ¼ ª", "naïve ǅ ɏ", "漢字 \U0001f600", " ", " nb", "\x1cfs\x1f", "tab\tend ", "word " * 3000, "12345 67.8% #!", "İstanbul", "a\r\nb", "\x85 \x85x"]
    docs = list(enumerate(texts))
    check(packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
    rows = packing.pack_documents(edge_docs).collect()
    assert sum(r.piece == 0 for r in rows) == edge_docs.count()
    assert packing.pack_documents(no_docs).count() == 0


def test_long_texts_and_added_tokens():
    encoder, long = packing.Encoder(PATH), prose(5, 60_000)
    odd = ["", "a b", "a  b", "\n\n a", "a b", "<|endoftext|>", "é è", "漢字 and"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(odd)] == [token_ids(t)[:-1] for t in odd]
    for text in (long, long[:150_000] + " 漢字 " + long, long + "<|endoftext|>" + long, "x" * 300_000, "a <|endoftext|> b", "<|endoftext|", long.replace(" ", "  ")):
        assert np.frombuffer(next(encoder.encode([text])), "<u4").tolist() == token_ids(text)[:-1]
    assert token_ids("<|endoftext|>")[:-1] == [50256]


def test_kept_words_are_given_up_in_time(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 40)
    monkeypatch.setattr(packing, "AT_ONCE", 300)
    r, encoder = random.Random(3), packing.Encoder(PATH)
    words = ["".join(r.choices("aeinst'é 1.", k=r.randint(1, 9))) for _ in range(400)]
    for _ in range(30):
        texts = [" ".join(r.choices(words, k=r.randint(0, 30))) for _ in range(5)] + [" ".join(words)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [token_ids(t)[:-1] for t in texts]
        assert len(encoder.known) < 40 + 300


def test_new_words_cost_less_than_the_tokenizers_call_for_words():
    r = random.Random(6)
    words = [" " + "".join(r.choices(["th", "on", "er", "re", "ti", "an", "ed", "le"], k=r.randint(3, 7))) for _ in range(40_000)]
    text, distinct = ["".join(words[k : k + 1000]) for k in range(0, len(words), 1000)], list(dict.fromkeys(words))
    ratios = []
    for _ in range(3):
        encoder, before = packing.Encoder(PATH), time.process_time()
        list(encoder.encode(text))
        between = time.process_time()
        TOKENIZER.encode(distinct, is_pretokenized=True, add_special_tokens=False)
        ratios.append((between - before) / (time.process_time() - between))
    assert min(ratios) < 0.85


def test_a_tokenizer_of_another_kind_gets_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, texts = Tokenizer.from_file(path), ["IT'S  what they'LL do", "", " a\nb"]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.Encoder(path).encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x260, exclude_categories=["Cs"]), max_size=30))
def test_words_are_the_tokenizers(text):
    assert np.frombuffer(next(packing.encoder(PATH).encode([text])), "<u4").tolist() == token_ids(text)[:-1]


def test_best_fit_by_definition():
    r = random.Random(4)
    lengths = [r.randint(1, 60) for _ in range(400)]
    bins = packing.OpenBins(64, 5)
    open_bins, used = {}, 0
    for length in lengths:
        number, offset = bins.place(length)
        fitting = sorted((free, k) for k, free in open_bins.items() if free >= length)
        if fitting:
            assert open_bins[number] == fitting[0][0] and offset == 64 - fitting[0][0]
        else:
            assert (number, offset) == (used, 0)
            used += 1
            if len(open_bins) == 5:
                least = min(open_bins.values())
                fullest = [k for k, free in open_bins.items() if free == least]
                closed = fullest[0] if len(fullest) == 1 else next(k for k in fullest if k not in {b for bs in bins._bins for b in bs})
                del open_bins[closed]
            open_bins[number] = 64
        open_bins[number] -= length
        if not open_bins[number]:
            del open_bins[number]
        assert {b for bs in bins._bins for b in bs} == set(open_bins)


def test_rows_without_an_id_are_spread_over_partitions(spark):
    docs = spark.createDataFrame([(None, "the same text")] * 4000, "doc_id long, text string")
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = packing.pack_documents(docs, 64).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    number = Counter(r.sequence_id >> 40 for r in rows)
    assert len(rows) == 4000 and len(number) == 4 and max(number.values()) < 1500

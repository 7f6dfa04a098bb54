"""Sequence packing: bounded-space online best fit over tokenised documents."""

from __future__ import annotations

import codecs
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import as_text, chunks, spread

#: Words after which a task begins to keep new ones only, and those of the kept ones that come again; letters of a long
#: text that it encodes at once, about.
KEPT_WORDS, AT_ONCE = 200_000, 1 << 17

# Below U+0250 these are all the letters, numbers and white space of the tokenizer's own split pattern.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
_WORDS = re.compile(f" [{_L}]+|[{_L}]+|'(?:[stmd]|re|ve|ll)| [{_N}]+|[{_N}]+| [^{_S}{_L}{_N}]+|[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\\x00-ɏ]")
#: A place where the split pattern always begins a word: a space between two letters.
_CUT = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")


def _beyond(text: str) -> bool:
    return not text.isascii() and _BEYOND.search(text) is not None


#: The character that byte-level tokenizers write for each byte: itself if it shows, else the next one from U+0100.
_SHOWN, _OTHERS = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}, itertools.count(0x100)
SPELLING = "".join(chr(b if b in _SHOWN else next(_OTHERS)) for b in range(256))


class Words(dict[str, bytes | bytearray]):
    """Ids by word. A word that hasn't come yet gets an empty array, which is filled before it is read: so each word
    of a text is looked up once."""

    def __init__(self, before: dict[str, bytes | bytearray]):
        self._before, self.new = before, {}

    def __missing__(self, word: str) -> bytes | bytearray:
        if (ids := self._before.get(word)) is None:
            ids = self.new[word] = bytearray()
        self[word] = ids
        return ids


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes. Merges never cross the words of the split pattern, so a
    text's ids are its words' ids in a row, and words that haven't come yet are encoded together; a text with
    characters from U+0250, or with one of the tokenizer's added tokens in it, goes to the tokenizer as it is, and
    so does any text if the tokenizer isn't a plain byte-level one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [str(t.content) for t in self._tokenizer.get_added_tokens_decoder().values()]
        split, model = self._tokenizer.pre_tokenizer, self._tokenizer.model
        bytewise = isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space and isinstance(model, models.BPE)
        self._by_words = bytewise and self._tokenizer.normalizer is None and not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix)
        if self._by_words:
            # Words of the pattern, spelt, need only the merges. A token has as many characters as it has bytes.
            vocabulary = self._tokenizer.get_vocab(with_added_tokens=False)
            self._by_words = all(c in vocabulary for c in SPELLING)
            self._merges, self._sizes = Tokenizer(model), np.zeros(max(vocabulary.values()) + 1, np.int64)
            self._sizes[[*vocabulary.values()]] = [*map(len, vocabulary)]
        self.forget()

    def forget(self) -> None:
        self.known = Words({})

    def _ids(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _slices(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > AT_ONCE and (cut := _CUT.search(text, start + AT_ONCE)):
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def _learn(self) -> None:
        """Fills in the ids of new words. Where a word ends, so does a token, after as many bytes."""
        if new := self.known.new:
            spelt = [codecs.charmap_decode(word.encode(), "strict", SPELLING)[0] for word in new]
            ids = np.array(self._merges.encode_batch_fast([spelt], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * np.searchsorted(np.cumsum(self._sizes[ids]), np.cumsum([*map(len, spelt)])) + 4
            start, found = 0, ids.tobytes()
            for (word, room), end in zip(new.items(), ends.tolist(), strict=True):
                self.known[word] = own = found[start:end]
                room += own
                start = end
            self.known.new = {}
        if len(self.known) > KEPT_WORDS:
            self.known = Words(dict(self.known))

    def _look_up(self, text: str) -> list[bytes | bytearray]:
        return list(map(self.known.__getitem__, _WORDS.findall(text)))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; all that aren't long learn their new words at once."""
        # An added token may hold any characters, so a text that has one isn't sliced.
        whole = [not self._by_words or any(t in x for t in self._added) for x in texts]
        short = [None if w or len(x) > AT_ONCE or _beyond(x) else self._look_up(x) for x, w in zip(texts, whole, strict=True)]
        self._learn()
        for text, as_it_is, words in zip(texts, whole, short, strict=True):
            if as_it_is:
                yield self._ids(text)
            elif words is not None:
                yield b"".join(words)
            else:
                yield b"".join(map(self._slice_ids, self._slices(text)))

    def _slice_ids(self, text: str) -> bytes:
        if _beyond(text):
            return self._ids(text)
        words = self._look_up(text)
        self._learn()
        return b"".join(words)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker; its kept words are forgotten when a task ends, as workers outlive stages."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class OpenBins:
    """At most `most` open bins, in a bitset keyed by free space.

    An item goes to the open bin with the least free space that holds it. If none does, a new bin opens, and if
    that is one too many the fullest closes first. A bin without free space closes by itself.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.used, self._open, self._bits = capacity, most, 0, 0, 0
        self._bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self._bins[free]
        chosen = bins.pop()
        if not bins:
            self._bits &= ~(1 << free)
        self._open -= 1
        return chosen

    def place(self, length: int) -> tuple[int, int]:
        """Number of the bin and the offset in it."""
        fits = self._bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            chosen = self._take(free)
        else:
            if self._open == self.most:
                self._take((self._bits & -self._bits).bit_length() - 1)
            free, chosen = self.capacity, self.used
            self.used += 1
        if left := free - length:
            self._bins[left].append(chosen)
            self._bits |= 1 << left
            self._open += 1
        return chosen, self.capacity - free


_PIECES = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def token_pieces(docs: DataFrame, capacity: int, path: str, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece; only documents over `capacity` are cut."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for chunk in chunks(batches):
            rows: list[list[int]] = [[], [], [], []]
            owners = []
            for k, ids in enumerate(encode.encode(as_text(chunk.column("text")))):
                ids += end
                n = len(ids) // 4
                stops = range((n - 1) % capacity + 1, n + 1, capacity)
                for piece, stop in enumerate(stops):
                    start = stops[piece - 1] if piece else 0
                    owners.append(k)
                    for column, value in zip(rows, (piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").take(pa.array(owners, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(rows, _PIECES, strict=True))], names=["doc_id", *(n for n, _ in _PIECES)])
        encode.forget()

    docs = docs.select("doc_id", "text")
    return spread(docs).mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int, open_bins: int = 256) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of 1 to `capacity`.

    Rows are dealt to partitions by doc_id, piece and their number in the input, so that rows of one id, or of none,
    are spread like any others. Each partition packs by itself, in order of doc_id and piece; a sequence_id holds the
    partition in its upper bits. What packing by partitions costs is at most the last
    `open_bins` bins of each, and partitions are few: pieces are small, and adaptive execution joins them.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = np.array([bins.place(n) for n in batch.column("length").to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(placed[:, 0] + first), pa.array(placed[:, 1].copy())], names=[*batch.schema.names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    dealt = pieces.withColumn("__row", F.monotonically_increasing_id()).repartition("doc_id", "piece", "__row").drop("__row")
    return dealt.sortWithinPartitions("doc_id", "piece", "start", "length", "ids_crc32").mapInArrow(fill, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 2048, open_bins: int = 256, path: str | None = None) -> DataFrame:
    """Packs documents (doc_id, text) into sequences of at most `capacity` tokens.

    A document is its token ids and one id 0. One that is longer than a sequence is cut from its end into whole
    sequences, and what is left is its first piece. A null text is empty: one id. Repeated rows are packed as
    often as they come, a null doc_id is kept, an empty table gives no rows, other columns are not read.
    """
    return pack(token_pieces(docs, capacity, path or public_tokenizers.path("byte_bpe_50k.json")), capacity, open_bins)

"""Byte-level BPE: frequent words come from a minimal acyclic transducer that workers memory-map, all others are merged exactly."""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import struct
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import KEPT, fresh_path, in_turn, read_table, stored

#: Words in the transducer at most; it is the same work at every size of the corpus.
LEXICON_WORDS = 65_536
#: Words of a generation of a worker's memory, of which it keeps two, and distinct words a task counts before it hands them on.
REMEMBERED, COUNTED = 200_000, 150_000
#: Bytes of the words of a generation, of the words that a task counts before it hands them on, and of a word that is kept or may be in the transducer.
KEPT_BYTES, WORD_BYTES = 16 << 20, 256
#: Bytes up to which a word is merged pair by pair; bytes of a long one that are looked at together.
SHORT, WINDOW = 200, 1 << 20

WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters that this pattern and the tokenizer's own classes surely treat alike; texts with others are split by the library.
UNSURE = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ԧ‐-‧‰-⁞₠-₿ぁ-ゖァ-ヺ一-龥가-힣]")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1 as it is, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The merges and token bytes of a tokenizer file of the byte-level kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.path = path
        self.token_bytes: dict[int, bytes] = {i: bytes(letters[ch] for ch in token) for token, i in vocab.items()}
        self.byte_ids = [0] * 256
        for token, i in vocab.items():
            if len(token) == 1:
                self.byte_ids[letters[token]] = i
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {i: content.encode() for content, i in self.special.items()}
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 20 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.never = len(self.merged)
        #: Pairs of bytes that stand side by side in some token: between all others no merge can reach.
        self.beside = np.zeros(1 << 16, bool)
        for i in set(self.merged):
            token = np.frombuffer(self.token_bytes[i], np.uint8).astype(np.int64)
            self.beside[token[:-1] << 8 | token[1:]] = True
        pairs = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(pairs)
        self.pairs, self.pair_ranks = pairs[order], np.fromiter(self.rank.values(), np.int64, len(pairs))[order]
        made = {token: rank for rank, token in enumerate(self.merged)}
        #: Whether merges of a token come after all that make it, so that equal pairs may be merged together.
        self.rising = all(rank > max(made.get(pair >> 20, -1), made.get(pair & 0xFFFFF, -1)) for pair, rank in self.rank.items())

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: always the pair of least rank, the leftmost first."""
        ids = [self.byte_ids[b] for b in word]
        get, never = self.rank.get, self.never
        ranks = [get(a << 20 | b, never) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            least = min(ranks)
            if least == never:
                break
            i = ranks.index(least)
            ids[i : i + 2] = [self.merged[least]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], never)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], never)
        return ids

    def packed(self, word: bytes) -> bytes:
        """The same, packed, for words of any length: they are cut where no token reaches across, and long parts merged by ranks."""
        if len(word) <= SHORT:
            return array("I", self.merge(word)).tobytes()
        out = bytearray()
        for part in self._parts(word):
            out += array("I", self.merge(part)).tobytes() if len(part) <= SHORT or not self.rising else self._merge_long(part)
        return bytes(out)

    def _parts(self, word: bytes) -> Iterator[bytes]:
        """``word`` in parts that merge apart, found a window at a time."""
        begin = at = 0
        while at < len(word):
            window = np.frombuffer(word, np.uint8, min(WINDOW + 1, len(word) - at), at).astype(np.int64)
            for cut in (np.flatnonzero(~self.beside[window[:-1] << 8 | window[1:]]) + at + 1).tolist():
                yield word[begin:cut]
                begin = cut
            at += WINDOW
        if begin < len(word):
            yield word[begin:]

    def _merge_long(self, word: bytes) -> bytes:
        """All equal pairs of the least rank at once; of those that overlap the first, third and so on from the left.

        A token's place is that of its first byte. Places wait by the rank of their pair and are looked at when its turn comes; a
        merge makes pairs of later ranks only. A few bytes are held for each byte of the word.
        """
        n = len(word)
        kind = np.uint16 if max(self.token_bytes) < 0xFFFF else np.uint32
        gone = kind(np.iinfo(kind).max)
        ids = np.array(self.byte_ids, kind)[np.frombuffer(word, np.uint8)]
        size, before = np.ones(n + 1, np.uint16), np.ones(n + 1, np.uint16)  # bytes of the token at a place, and of the one before it
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def rank_of(at: np.ndarray) -> np.ndarray:
            """Rank of the pair that begins at each place, -1 for none; all have a token after them."""
            pair = ids[at].astype(np.int64) << 20 | ids[at + size[at]]
            found = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            return np.where((self.pairs[found] == pair) & (ids[at] != gone), self.pair_ranks[found], -1)

        def wait(at: np.ndarray) -> None:
            rank = rank_of(at)
            order = np.argsort(rank, kind="stable")
            order = order[np.searchsorted(rank[order], 0) :]
            rank, at = rank[order], at[order].astype(np.int32)
            if not len(at):
                return
            edge = np.flatnonzero(np.diff(rank, prepend=-1))
            for value, places in zip(rank[edge].tolist(), np.split(at, edge[1:]), strict=True):
                if value not in waiting:
                    waiting[value] = []
                    heapq.heappush(ranks, value)
                waiting[value].append(places)

        for i in range(0, n - 1, WINDOW):
            wait(np.arange(i, min(i + WINDOW, n - 1)))
        while ranks:
            rank = heapq.heappop(ranks)
            places = np.concatenate(waiting.pop(rank))
            if (np.diff(places) <= 0).any():
                places = np.unique(places)
            for i in range(0, len(places), WINDOW):  # from the left: what a window has merged is seen by the next
                at = places[i : i + WINDOW].astype(np.int64)
                at = at[at + size[at] < n]
                at = at[rank_of(at) == rank]
                if not len(at):
                    continue
                follows = np.r_[False, at[1:] == at[:-1] + size[at[:-1]]]  # overlaps the pair before it: runs keep every second
                start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
                second = at + size[at]
                ids[second], ids[at] = gone, self.merged[rank]
                size[at] += size[second]
                before[at + size[at]] = size[at]
                left = at[at > 0]
                wait(np.unique(np.concatenate([left - before[left], at[at + size[at] < n]])))
        return ids[ids != gone].astype("<u4").tobytes()


class Splitter:
    """Texts to words, as the tokenizer file's pre-tokenizer splits them."""

    def __init__(self, vocabulary: Vocabulary):
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.library = None

    def pieces(self, text: str) -> list[str]:
        """Runs of ordinary text, and at odd places special tokens."""
        return self.special.split(text) if self.special else [text]

    def words(self, piece: str) -> list[str]:
        if not UNSURE.search(piece):
            return WORD.findall(piece)
        if self.library is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self.library = ByteLevel(add_prefix_space=False)
        return [piece[a:b] for _, (a, b) in self.library.pre_tokenize_str(piece)]


def write_transducer(file: BinaryIO, entries: Iterable[tuple[bytes, list[int]]]) -> None:
    """Write to ``file`` the minimal acyclic transducer of ``entries`` (word, ids), which must be sorted by word and distinct.

    States with equal futures are one state, so suffixes are shared. An arc holds the number of words that come before
    those behind it; the sum along a word's path is the word's number, and its ids are those at that number.
    """
    states: dict[tuple, int] = {}
    arcs: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path_labels, open_states = bytearray(), [[False, []]]
    outputs: list[list[int]] = []

    def close(depth: int) -> None:
        while len(open_states) > depth + 1:
            final, out = open_states.pop()
            key = (final, tuple(out))
            number = states.get(key)
            if number is None:
                number = states[key] = len(arcs)
                arcs.append(key)
            open_states[-1][1].append((path_labels.pop(), number))

    for word, ids in entries:
        shared = len(os.path.commonprefix([bytes(path_labels), word]))
        close(shared)
        for label in word[shared:]:
            path_labels.append(label)
            open_states.append([False, []])
        open_states[-1][0] = True
        outputs.append(ids)
    close(0)
    final, out = open_states[0]
    arcs.append((final, tuple(out)))
    behind = []
    first, finals, labels, targets, skips = [0], bytearray(), bytearray(), array("I"), array("I")
    for final, out in arcs:
        total = int(final)
        for label, target in out:
            labels.append(label)
            targets.append(target)
            skips.append(total)
            total += behind[target]
        behind.append(total)
        finals.append(final)
        first.append(len(labels))
    ends, flat = array("I", [0]), array("I")
    for ids in outputs:
        flat.extend(ids)
        ends.append(len(flat))
    parts = [array("I", first).tobytes(), targets.tobytes(), skips.tobytes(), ends.tobytes(), flat.tobytes(), bytes(finals), bytes(labels)]
    file.write(struct.pack("<8I", len(arcs), *map(len, parts)))
    for part in parts:
        file.write(part)


class Transducer:
    """A memory-mapped file of ``write_transducer``."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        n, *sizes = struct.unpack_from("<8I", self.map, 0)
        view, at, parts = memoryview(self.map), 32, []
        for size in sizes:
            parts.append((at, view[at : at + size]))
            at += size
        self.root = n - 1
        self.first, self.targets, self.skips, self.ends, self.flat = (p.cast("I") for _, p in parts[:5])
        self.finals, self.label_at = parts[5][1], parts[6][0]

    def ids(self, word: bytes) -> bytes | None:
        """The ids of a word of the lexicon, packed; null for others."""
        state, number, find, base = self.root, 0, self.map.find, self.label_at
        for i in range(len(word)):
            arc = find(word[i : i + 1], base + self.first[state], base + self.first[state + 1]) - base
            if arc < 0:
                return None
            number += self.skips[arc]
            state = self.targets[arc]
        if not self.finals[state]:
            return None
        return self.flat[self.ends[number] : self.ends[number + 1]].tobytes()


class Codec:
    """Encoder and decoder of one worker. Ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer: str, lexicon: str | None):
        self.vocabulary = Vocabulary(tokenizer)
        self.splitter = Splitter(self.vocabulary)
        self.lexicon = Transducer(lexicon) if lexicon else None
        self.special = {content: struct.pack("<I", i) for content, i in self.vocabulary.special.items()}
        codec = self

        class Known(dict):
            """Ids of words met lately: a full generation becomes the older one, from which words still in use come back."""

            older: dict[str, bytes] = {}
            size = 0

            def __missing__(self, word: str) -> bytes:
                found = self.older.get(word)
                if found is None:
                    found = codec.word_ids(word.encode())
                if len(word) > WORD_BYTES:
                    return found
                if len(self) >= REMEMBERED or self.size >= KEPT_BYTES:
                    self.older, self.size = dict(self), 0
                    self.clear()
                self[word] = found
                self.size += len(word) + len(found)
                return found

        self.known = Known()

    def word_ids(self, word: bytes) -> bytes:
        found = self.lexicon.ids(word) if self.lexicon else None
        return found if found is not None else self.vocabulary.packed(word)

    def encode(self, text: str) -> bytes:
        out = []
        for i, piece in enumerate(self.splitter.pieces(text)):
            if i % 2:
                out.append(self.special[piece])
            elif piece:
                out += map(self.known.__getitem__, self.splitter.words(piece))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Ids that the vocabulary lacks decode to nothing; bytes that are not UTF-8 to U+FFFD."""
        token, every = self.vocabulary.token_bytes, memoryview(ids).cast("I")
        out = bytearray()
        for i in range(0, len(every), WINDOW):
            out += b"".join([token.get(k, b"") for k in every[i : i + WINDOW]])
        return out.decode("utf-8", "replace")


_CODECS: dict[tuple[str, str | None], Codec] = {}
KEPT["bpe"] = _CODECS.clear


def _codec(tokenizer: str, lexicon: str | None) -> Codec:
    """The worker's codec; ``lexicon`` is the address of a file that Spark has sent to every node."""
    if (tokenizer, lexicon) not in _CODECS:
        _CODECS.clear()
        _CODECS[tokenizer, lexicon] = Codec(tokenizer, SparkFiles.get(os.path.basename(lexicon)) if lexicon else None)
    return _CODECS[tokenizer, lexicon]


def word_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(word, n) over all whole texts of ``docs`` (text); a task hands on what it has counted whenever it holds COUNTED words or KEPT_BYTES."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, found, size = _codec(tokenizer, None).splitter, Counter(), 0
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for piece in splitter.pieces(text)[::2]:
                    found.update(splitter.words(piece))
                size += len(text)  # no less than the words it adds
                if len(found) >= COUNTED or size >= KEPT_BYTES:
                    yield rows()
                    found.clear()
                    size = 0
        yield rows()

    return docs.filter("text is not null").select("text").mapInArrow(in_turn("bpe", count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, words: int) -> DataFrame:
    """(word) of at most ``words`` of the most frequent words of up to WORD_BYTES: all above a count that a histogram of some hundred bars gives."""
    short, bar = counts.filter(F.octet_length("word") <= WORD_BYTES), F.floor(F.log2("n") * 16)
    total, least = 0, None
    for row in sorted(short.groupBy(bar.alias("bar")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["bar"]):
        total += row["n"]
        if total > words:
            break
        least = row["bar"]
    return short.filter(bar >= least if least is not None else F.lit(False)).select("word")


def compile_lexicon(docs: DataFrame, tokenizer: str, words: int = LEXICON_WORDS) -> str:
    """Compile up to ``words`` of the most frequent words of the corpus with their ids, send the file to every node and give its address.

    Only that many words, of WORD_BYTES at most, reach the driver. The file is written to the shared folder. Encoding gives
    the same ids with any lexicon, or none.
    """
    from pyarrow import fs

    spark = docs.sparkSession
    top = frequent_words(stored(word_counts(docs, tokenizer), "word-counts"), words).collect()
    vocabulary = Vocabulary(tokenizer)
    address = fresh_path(spark, "lexicon") + ".bin"
    store, path = fs.FileSystem.from_uri(address)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path, compression=None) as file:
        write_transducer(file, ((w, vocabulary.merge(w)) for w in sorted(r["word"].encode() for r in top)))
    spark.sparkContext.addFile(address)
    return address


def encode_documents(docs: DataFrame, tokenizer: str, lexicon: str | None) -> DataFrame:
    """doc_id and ids (packed little-endian unsigned 32-bit integers) of every row of ``docs`` (doc_id, text).

    Special tokens' strings become those tokens, as the library does by default. A null text is an empty one; repeated
    rows each get a row; other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer, lexicon)
        for batch in batches:
            ids = [codec.encode(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(in_turn("bpe", encode), "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and the decoded text of every row of ``encoded`` (doc_id, ids); null ids are empty."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer, None)
        for batch in batches:
            texts = [codec.decode(ids or b"") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(in_turn("bpe", decode), "doc_id long, ids binary, text string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_digests(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them, by a lexicon of ``docs`` itself."""
    tokenizer = tokenizer or default_tokenizer()
    decoded = decode_documents(encode_documents(docs, tokenizer, compile_lexicon(docs, tokenizer)), tokenizer)
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op1_bpe_lexicon(spark, sf_dir) -> DataFrame:
    return token_digests(spark, read_table(spark, sf_dir, "documents"))


QUERIES = {"op1_bpe_lexicon": op1_bpe_lexicon}
ORACLE_SQL: dict[str, str] = {}

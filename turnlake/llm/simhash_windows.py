"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

A text's windows have as many words as the benchmark item they are held against; a text of fewer words is one window, whole.
Only windows that hold a shingle of some item can be similar to one, so only those get fingerprints. The features of a window
are its shingles with the number of their occurrence in it, first, second and so on, each of weight 1: then the weighted
Jaccard similarity of two windows is that of their feature sets, and however often one shingle repeats, no single bit of its
hash weighs more than another's. At a similarity of 3/4 sets of m and n features share at least 3/7 of m + n, a cosine of 6/7
or more, so a bit of two fingerprints differs with a probability of arccos(6/7) / pi = 0.172 at the most.

Of ``BITS`` bits 44 differ then on average, with a deviation of 6: more than ``RADIUS`` in about one of 10,000 windows at
that very margin, and fewer above it. Windows of unrelated texts differ in 128, with a deviation of 8. Fingerprints are cut to
blocks. Each block has a radius of its own, and these radii plus one add up to RADIUS + 1, so fingerprints within RADIUS are
near in some block; those that are near in none, three of four unrelated ones, are never compared in whole. Candidates within
the radius are verified on the shingles themselves, by sums that slide with the window, so an item may have any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import BY_PUNCTUATION, groups_of, mix, shingles, word_hashes
from .storage import in_turn, read_table

WORDS, SIMILARITY = 5, 0.75
BITS, RADIUS, BLOCKS = 256, 66, 16
#: Cells of windows and items that are looked at together, and windows whose bits are summed together.
CELLS, STEP = 1 << 21, 1 << 11
#: Words of items that one pass over the corpus takes; what is sent to tasks is bounded by it.
PASS_WORDS = 400_000


@dataclass
class Items:
    """Benchmark items: ids, number of words, and their shingles with counts, sorted by shingle within an item; ``by_size`` finds those of a number of words."""

    ids: np.ndarray
    words: np.ndarray
    shingle: np.ndarray
    count: np.ndarray
    before: np.ndarray

    def __post_init__(self):
        order = np.argsort(self.shingle, kind="stable")
        self.sorted = self.shingle[order]
        self.item_of = np.repeat(np.arange(len(self.ids)), np.diff(self.before))[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.sorted & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        prints = [Window(np.repeat(self.shingle[a:b], self.count[a:b]), int(self.count[a:b].sum())).prints()[0] for a, b in zip(self.before[:-1], self.before[1:], strict=True)]
        self.by_size = {}
        for n in np.unique(self.words):
            items = np.flatnonzero(self.words == n)
            known = np.unique(np.concatenate([self.shingle[self.before[i] : self.before[i + 1]] for i in items]))
            self.by_size[int(n)] = HammingIndex(items, np.array([prints[i] for i in items]), known)


def _bits(shingles: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """BITS bits, 0 or 1, of the feature that the n-th ``occurrence`` of each shingle is."""
    feature = shingles + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    words = np.stack([mix(mix(feature ^ np.uint64(0xD1342543DE82EF95 * (2 * j + 1) & 0xFFFFFFFFFFFFFFFF)) + np.uint64(j)) for j in range(BITS // 64)], axis=1)
    return np.unpackbits(words.view(np.uint8), axis=1)


class Window:
    """A window of ``width`` shingles that slides over ``shingles`` from their first to their last."""

    def __init__(self, shingles: np.ndarray, width: int):
        self.shingles, self.width = shingles, width
        n = len(shingles)
        order = np.argsort(shingles, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        new = np.diff(shingles[order], prepend=shingles[order[:1]] + np.uint64(1)) != 0
        group = np.empty(n, np.int64)
        group[order] = np.cumsum(new)
        key = group[order] * (n + 1) + order  # rising: equal shingles together, by their place
        first = np.arange(width)
        #: Number of each shingle of the first window among its equals there; of what leaves and what enters at each step, in the window that has it.
        self.occurrence = place[:width] - np.searchsorted(key, group[first] * (n + 1)) + 1
        leave, enter = np.arange(n - width), np.arange(width, n)
        self.leaving = np.searchsorted(key, group[leave] * (n + 1) + leave + width - 1, "right") - place[leave]
        self.entering = place[enter] + 1 - np.searchsorted(key, group[enter] * (n + 1) + leave + 1)

    def prints(self) -> np.ndarray:
        """SimHash of every window, as rows of 64-bit words; a bit is set if most features have it."""
        steps = len(self.leaving)
        ones = np.zeros(BITS, np.int32)
        for a in range(0, self.width, STEP):
            ones += _bits(self.shingles[a : min(a + STEP, self.width)], self.occurrence[a : a + STEP]).sum(0, dtype=np.int32)
        out = [np.packbits(2 * ones > self.width)[None]]
        for a in range(0, steps, STEP):
            b = min(a + STEP, steps)
            moved = _bits(self.shingles[self.width + a : self.width + b], self.entering[a:b]).astype(np.int32) - _bits(self.shingles[a:b], self.leaving[a:b])
            sums = ones + np.cumsum(moved, axis=0, dtype=np.int32)
            ones = sums[-1]
            out.append(np.packbits(2 * sums > self.width, axis=1))
        return np.concatenate(out).view(np.uint64)

    def shared(self, shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
        """For every window the sum of the smaller counts with those of an item (``shingle`` is sorted)."""
        at = np.minimum(np.searchsorted(shingle, self.shingles), len(shingle) - 1)
        most = np.where(shingle[at] == self.shingles, count[at], 0)
        gained = (self.entering <= most[self.width :]).astype(np.int64) - (self.leaving <= most[: len(self.leaving)])
        return (self.occurrence <= most[: self.width]).sum() + np.concatenate([[0], np.cumsum(gained)])


class HammingIndex:
    """Items of one size by the blocks of their fingerprints; finds all within RADIUS."""

    def __init__(self, items: np.ndarray, prints: np.ndarray, shingles: np.ndarray):
        self.items, self.prints, self.shingles = items, prints, shingles
        #: Radii of the blocks: these plus one add up to RADIUS + 1, so a fingerprint within RADIUS is near in some block.
        self.radii = [(RADIUS + 1) // BLOCKS - 1 + (b < (RADIUS + 1) % BLOCKS) for b in range(BLOCKS)]
        self.blocks = [np.unique(block, return_inverse=True) for block in prints.view(np.uint16).T]
        self.seen = self.near = 0

    def lookup(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all within RADIUS."""
        found = []
        step = max(1, CELLS // len(self.items))
        for begin in range(0, len(prints), step):
            some = prints[begin : begin + step]
            candidate = np.zeros((len(some), len(self.items)), bool)
            for block, (values, which), radius in zip(some.view(np.uint16).T, self.blocks, self.radii, strict=True):
                own, mine = np.unique(block, return_inverse=True)
                near = np.bitwise_count(own[:, None] ^ values[None]) <= radius
                candidate |= near[mine][:, which]
            window, item = np.nonzero(candidate)
            self.seen, self.near = self.seen + candidate.size, self.near + len(window)
            distance = np.bitwise_count(some[window] ^ self.prints[item]).sum(1, dtype=np.int64)
            within = distance <= RADIUS
            found.append((window[within] + begin, self.items[item[within]], distance[within]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def read_items(items: DataFrame) -> list[Items]:
    """The items in passes of about PASS_WORDS words, by a hash of their text; equal rows count once.

    Only one pass is on the driver, and sent to tasks, at a time. Items without words or id are no items.
    """
    rows = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    passes = max(1, math.ceil(total / PASS_WORDS))
    for n in range(passes):
        part = rows.filter(F.pmod(F.xxhash64("text"), F.lit(passes)) == n).orderBy("item_id", "text").collect()
        words, counts = word_hashes([r["text"].lower().encode() for r in part], BY_PUNCTUATION)
        values, before = shingles(words, counts, WORDS)
        kept = [i for i in range(len(part)) if before[i] < before[i + 1]]
        pairs = [np.unique(values[before[i] : before[i + 1]], return_counts=True) for i in kept]
        if kept:
            yield Items(
                np.array([part[i]["item_id"] for i in kept]), np.diff(counts)[kept], np.concatenate([p[0] for p in pairs]),
                np.concatenate([p[1] for p in pairs]).astype(np.int32), np.cumsum([0, *(len(p[0]) for p in pairs)]),
            )


def _stretches(hits: np.ndarray, width: int, last: int) -> list[tuple[int, int]]:
    """(first, last) start of each row of windows of ``width`` shingles, none beyond ``last``, that hold one of the sorted places ``hits``."""
    low, high = np.maximum(hits - width + 1, 0), np.minimum(hits, last)
    new = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1] + 1]))
    return list(zip(low[new].tolist(), high[np.append(new[1:], len(hits)) - 1].tolist(), strict=True))


def _short_matches(words: np.ndarray, n: int) -> np.ndarray:
    return shingles(np.lib.stride_tricks.sliding_window_view(words, n).ravel(), np.arange(0, (len(words) - n + 1) * n + 1, n), WORDS)[0]


def _members(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def matches_of(text_words: np.ndarray, text_shingles: np.ndarray, items: Items) -> list[tuple[int, float, int, int, int]]:
    """(item id, similarity, first word, words, distance) of the most similar window of each item that reaches SIMILARITY; the first of equals."""
    best: dict[int, tuple[float, int, int, int]] = {}
    n_words = len(text_words)

    def hits_in(values: np.ndarray) -> np.ndarray:
        likely = np.flatnonzero(items.filter[(values & np.uint64((1 << 20) - 1)).astype(np.int64)])
        return likely[_members(values[likely], items.sorted)]

    long_hits = hits_in(text_shingles) if n_words >= WORDS else np.zeros(0, np.int64)
    for size, index in items.by_size.items():
        if size > n_words and n_words - WORDS + 1 < SIMILARITY * (size - WORDS + 1):
            continue  # the text's shingles are too few, or its only one is shorter than the item's
        if size < WORDS:
            values, width = _short_matches(text_words, size), 1
            hits = hits_in(values)
        else:
            values, width, hits = text_shingles, min(size, n_words) - WORDS + 1, long_hits
        hits = hits[_members(values[hits], index.shingles)]
        if not len(hits):
            continue
        for low, high in _stretches(hits, width, len(values) - width):
            window = Window(values[low : high + width], width)
            start, item, distance = index.lookup(window.prints())
            for i in np.unique(item):
                mine = start[item == i]
                a, b = items.before[i], items.before[i + 1]
                both = window.shared(items.shingle[a:b], items.count[a:b])[mine]
                similarity = both / (width + items.count[a:b].sum() - both)
                top = int(similarity.argmax())
                if similarity[top] >= SIMILARITY and similarity[top] > best.get(i, (0.0,))[0]:
                    best[i] = (float(similarity[top]), low + int(mine[top]), min(size, n_words), int(distance[item == i][top]))
    return [(int(items.ids[i]), *found) for i, found in sorted(best.items())]


MATCHES = "doc_id long, item_id long, similarity double, first_word long, n_words long, distance long"


def _matcher(shared):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        names = [x.split()[0] for x in MATCHES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            ids, out = batch.column(0).cast(pa.int64()).to_pylist(), []
            for first, texts in groups_of([(t or "").lower().encode() for t in batch.column(1).to_pylist()]):
                words, counts = word_hashes(texts, BY_PUNCTUATION)
                values, before = shingles(words, counts, WORDS)
                likely = items.filter[(values & np.uint64((1 << 20) - 1)).astype(np.int64)]
                short = min(items.by_size) < WORDS
                seen = np.concatenate([[0], np.cumsum(likely)])
                for k in range(len(texts)):
                    if short or seen[before[k + 1]] > seen[before[k]]:
                        out += [(ids[first + k], *m) for m in matches_of(words[counts[k] : counts[k + 1]], values[before[k] : before[k + 1]], items)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

    return match


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item of which it holds a window that is similar: doc_id, item_id, similarity, and where.

    Words are runs of letters and digits, in lower case; shingles have 5 words, an item of fewer words is one shingle.
    ``similarity`` is the weighted Jaccard similarity (sum of least over sum of largest counts) of the best window, at least
    0.75; a text of fewer words than the item is one window. ``first_word`` and ``n_words`` place it, ``distance`` is that of the fingerprints. Null or empty texts have no
    window; repeated rows each give their rows; a null doc_id is kept. Whole texts are scanned, once for each pass of items.
    """
    spark, found = docs.sparkSession, None
    for items in read_items(benchmark):
        rows = docs.select("doc_id", "text").mapInArrow(in_turn("windows", _matcher(spark.sparkContext.broadcast(items))), MATCHES)
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else spark.createDataFrame([], MATCHES)


def op8_simhash_windows(spark, sf_dir) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_simhash_windows": op8_simhash_windows}
ORACLE_SQL: dict[str, str] = {}

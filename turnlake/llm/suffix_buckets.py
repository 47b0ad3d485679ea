"""Suffix-array dedup by bucket-pointer refinement over sampled suffixes.

Every 200-byte string has one suffix that stands for it: the start of its least ``GRAM``-byte string by hash, the leftmost of
equals. The choice depends on the 200 bytes alone, so equal strings choose alike, and only one position in about 70 becomes a
row. A run is the range of string starts that share a sampled suffix.

Initial buckets are those of the q-gram at the sampled suffix. A bucket identifier is a hash of content, so every offset of a
text has that of its q-gram at hand without a look-up, and so have refined buckets: the identifier of twice the length is that
of an offset together with that of a later one, level by level (``Identifiers``). Buckets are refined by sorting their members
on such identifiers of other offsets, in three rounds that each start from the last one's identifier:

1. runs, by the identifiers that span all bytes which any of their strings holds;
2. parts of runs, of ``STEP`` neighbouring strings, by what all of the part's strings hold and by what any of them does;
3. single strings, by the identifiers of their two overlapping stretches.

A bucket of one is done: nothing in it repeats. Within larger buckets, members that are equal are done: all their strings
repeat. What is left goes to the next round, and of those that are done one goes along as a witness for the others.

Spark sorts and counts buckets with partial aggregation, so a passage that a third of all documents hold makes no large task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import RollingHash, mix
from .storage import in_turn, marked_likely, read_table, stored

#: Bytes of a string that counts as repeated, and of the strings that initial buckets are made by.
LENGTH, GRAM = 200, 64
#: Strings of a part of a run.
STEP = 16
#: Bytes handled at once; a longer text is handled in parts that overlap.
PART = 1 << 18

#: Bytes of the longest stretch that identifiers are made for: a run's strings are at most LENGTH - GRAM to either side of their suffix.
LONGEST = 3 * LENGTH - 2 * GRAM

ANCHORS = "bucket long, run long, doc long, fingerprint long, at long, left int, right int"
PARTS = f"{ANCHORS}, witness boolean"
_NO_ID = -(1 << 63)


class Identifiers:
    """Bucket identifiers of every offset of ``data``: of its q-gram, then of twice the bytes from those of two offsets, and so on."""

    def __init__(self, data: np.ndarray, which: int):
        self.levels, size = [mix(RollingHash(data, which).grams(GRAM))], GRAM
        while 2 * size <= LONGEST:
            known = self.levels[-1]
            self.levels.append(_paired(known[: max(len(known) - size, 0)], known[size:]))
            size *= 2

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Identifiers of ``size`` bytes, GRAM to LONGEST, from ``start`` on: of two stretches that cover them."""
        out = np.empty(len(start), np.uint64)
        level = np.minimum(np.log2(size // GRAM).astype(np.int64), len(self.levels) - 1)
        for k, known in enumerate(self.levels):
            some = np.flatnonzero(level == k)
            if len(some):
                out[some] = _paired(known[start[some]], known[start[some] + size[some] - (GRAM << k)])
        return mix(out + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _paired(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0xC2B2AE3D27D4EB4F) + later)


def sampled_suffixes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, gram, run, at, left, right) of the runs of several texts.

    ``starts`` has where each text starts in ``data``, and the end. ``at`` counts from the text's start; the run's strings
    start ``left`` before to ``right`` after it.
    """
    n, none = len(data), np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none, none
    first = RollingHash(data, 0)
    grams = mix(first.grams(GRAM))
    # the upper bits order, the lower 20 are the position: minima are leftmost
    best = (grams & ~np.uint64((1 << 20) - 1)) | np.arange(len(grams), dtype=np.uint64)
    width, have = LENGTH - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[: len(best) - step], best[step:])
        have += step
    pick = (best & np.uint64((1 << 20) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.maximum(np.diff(starts) - LENGTH + 1, 0))
    begin = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(np.maximum(np.diff(starts) - LENGTH + 1, 0))[:-1]]), np.maximum(np.diff(starts) - LENGTH + 1, 0))
    where = begin + starts[:-1][text]  # all starts of strings within a text
    if not len(where):
        return none, none, none, none, none, none
    pick = pick[where]
    edge = np.flatnonzero((np.diff(pick, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    last = np.append(edge[1:], len(pick)) - 1
    low, high, at, text = where[edge], where[last], pick[edge], text[edge]
    left, right = at - low, high - at
    run = mix(Identifiers(data, 1).of(low, high - low + LENGTH) + mix((left * 4096 + right + 2048).astype(np.uint64)))
    return text, grams[at].view(np.int64), run.view(np.int64), at - starts[:-1][text], left, right


def _parts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[int]]]:
    """(data, starts, index of the text, offset in it) of parts of PART bytes and a little at most."""
    chunk, owners, offsets, size = [], [], [], 0

    def ready():
        data = np.frombuffer(b"".join(chunk), np.uint8)
        return data, np.cumsum([0, *map(len, chunk)]), list(owners), list(offsets)

    for i, text in enumerate(texts):
        for offset in range(0, max(len(text) - LENGTH + 1, 0), PART):
            piece = text[offset : offset + PART + LENGTH - 1]
            if size + len(piece) > PART + LENGTH and chunk:
                yield ready()
                chunk.clear(), owners.clear(), offsets.clear()
                size = 0
            chunk.append(piece)
            owners.append(i)
            offsets.append(offset)
            size += len(piece)
    if chunk:
        yield ready()


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or b"" for x in batch.column("bytes").to_pylist()]
        doc = batch.column("doc").to_numpy(zero_copy_only=False)
        fingerprint = batch.column("fingerprint").to_numpy(zero_copy_only=False)
        for data, starts, owners, offsets in _parts(texts):
            text, gram, run, at, left, right = sampled_suffixes(data, starts)
            who, moved = np.array(owners)[text], np.array(offsets)[text]
            columns = [gram, run, doc[who], fingerprint[who], at + moved, left.astype(np.int32), right.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in ANCHORS.split(", ")])


def _opened(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Per text: its keys, its bytes, and the buckets, suffixes, left and right ends and witness marks of its open runs."""
    for doc, fingerprint, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc", "fingerprint", "bytes", "runs")), strict=True):
        bucket, at, left, right = (np.array([r[c] for r in runs], np.int64) for c in ("bucket", "at", "left", "right"))
        yield doc, fingerprint, np.frombuffer(text, np.uint8), bucket.view(np.uint64), at, left, right, np.array([r["witness"] for r in runs])


def _repeated(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, number within it) of each of ``counts`` items."""
    index = np.repeat(np.arange(len(counts)), counts)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)


class _Stretches:
    """Identifiers of stretches of a text around some places in it; only bytes near those places are read."""

    def __init__(self, data: np.ndarray, low: np.ndarray, high: np.ndarray, which: int):
        sizes = high - low
        index, within = _repeated(sizes)
        self.shift = np.cumsum(sizes) - sizes - low
        self.identifiers = Identifiers(data[low[index] + within], which)

    def of(self, index: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.identifiers.of(start + self.shift[index], end - start)


def _part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each open run in parts of STEP string starts, aligned by their distance to the suffix."""
    for batch in batches:
        out = []
        for doc, fingerprint, data, bucket, at, left, right, witness in _opened(batch):
            first, last = np.floor_divide(-right, STEP), np.floor_divide(left, STEP)
            run, within = _repeated(last - first + 1)
            block = (first[run] + within) * STEP
            near, far = np.maximum(block, -right[run]), np.minimum(block + STEP - 1, left[run])
            held, spanned = (_Stretches(data, at - left, at + right + LENGTH, which) for which in (0, 1))
            place = mix((block + 4096).astype(np.uint64))
            common = mix(held.of(run, at[run] - block, at[run] - block - STEP + 1 + LENGTH) + bucket[run] + place)
            whole = mix(spanned.of(run, at[run] - far, at[run] - near + LENGTH) + mix((near * 8192 + far + (1 << 30)).astype(np.uint64)))
            n = len(run)
            out.append((common.view(np.int64), whole.view(np.int64), np.full(n, doc), np.full(n, fingerprint), at[run], far.astype(np.int32), (-near).astype(np.int32), witness[run]))
        if out:
            yield _table(out)


def _string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A run per string of each open part, by the part's bucket and the identifiers of the string."""
    for batch in batches:
        out = []
        for doc, fingerprint, data, bucket, at, left, right, witness in _opened(batch):
            run, within = _repeated(left + right + 1)
            start = at[run] - left[run] + within
            keys = [mix(_Stretches(data, at - left, at + right + LENGTH, which).of(run, start, start + LENGTH) + bucket[run]).view(np.int64) for which in (0, 1)]
            n, nothing = len(run), np.zeros(len(run), np.int32)
            out.append((keys[0], keys[1], np.full(n, doc), np.full(n, fingerprint), start, nothing, nothing, witness[run]))
        if out:
            yield _table(out)


def _table(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], [x.split()[0] for x in PARTS.split(", ")])


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the key that a document's rows are joined by: ``doc`` (doc_id, or a fixed value for null) and ``fingerprint`` of the text."""
    return docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "fingerprint": F.xxhash64("text", F.lit(6))})


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc, fingerprint, low, high): byte ranges that repeated strings cover, of the texts of ``keyed`` documents; ranges may overlap."""
    texts = docs.select("doc", "fingerprint", F.col("text").cast("binary").alias("bytes")).filter(F.length("bytes") >= LENGTH)
    anchors = stored(texts.mapInArrow(in_turn("suffixes", _anchor_rows), ANCHORS), "suffixes")
    buckets = stored(anchors.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "initial-buckets")
    shared = stored(marked_likely(anchors, "bucket", buckets, "bucket").filter("likely").drop("likely").join(buckets, "bucket").withColumn("witness", F.lit(False)), "shared-suffixes")
    whole, rest = _refined(shared, "runs")
    ranges = [whole]
    for rows, name in ((_part_rows, "parts"), (_string_rows, "strings")):
        found, rest = _refined(stored(_with_text(texts, rest).mapInArrow(in_turn("suffixes", rows), PARTS), name), f"{name}-of-runs")
        ranges.append(found)
    return ranges[0].unionByName(ranges[1]).unionByName(ranges[2])


def _refined(runs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(byte ranges of the runs that repeat as a whole, runs to refine further with their witnesses)."""
    classes = stored(
        runs.groupBy("bucket", "run").agg(
            F.count("*").alias("n"), F.min("witness").alias("witness"), F.min(F.struct("doc", "fingerprint", "at", "left", "right")).alias("one")  # of one row, whatever ties
        ).select("bucket", "run", "n", "witness", "one.*"),
        name,
    )
    several = classes.filter("n > 1").select("bucket", "run")
    settled = runs.filter("not witness").join(several, ["bucket", "run"], "left_semi")
    whole = settled.select("doc", "fingerprint", (F.col("at") - F.col("left")).alias("low"), (F.col("at") + F.col("right") + LENGTH).alias("high"))
    alone = (F.col("n") == 1) & ~F.col("witness")
    open_ = classes.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(alone).alias("alone")).filter("n > 1 and alone").select("bucket")
    rest = classes.join(stored(open_, f"{name}-open"), "bucket", "left_semi").select("bucket", "doc", "fingerprint", "at", "left", "right", (~alone).alias("witness"))
    return whole, rest


def _with_text(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs`` gathered by text, with its bytes; texts without any are not shuffled."""
    by_text = stored(runs.groupBy("doc", "fingerprint").agg(F.collect_list(F.struct("bucket", "at", "left", "right", "witness")).alias("runs")), "open-texts")
    return marked_likely(texts, "fingerprint", by_text, "fingerprint").filter("likely").drop("likely").join(by_text, ["doc", "fingerprint"]).dropDuplicates(["doc", "fingerprint"])


def _merged(low: list[int], high: list[int]) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for a, b in sorted(zip(low, high, strict=True)):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], b))
        else:
            spans.append((a, b))
    return spans


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, count = [], [], []
        for text, ranges in zip(batch.column("bytes").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            spans = _merged([r["low"] for r in ranges], [r["high"] for r in ranges])
            parts, at = [], 0
            for a, b in spans:
                parts.append(text[at:a])
                at = b
            kept.append(b"".join([*parts, text[at:]]))
            removed.append(len(text) - len(kept[-1]))
            count.append(len(spans))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("fingerprint"), pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()), pa.array(removed, pa.int64()), pa.array(count, pa.int64())], ["doc", "fingerprint", "kept", "text", "n_removed", "n_spans"])


def remove_repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text, any others) with its key columns, and (doc, fingerprint, kept, text, n_removed, n_spans) of the texts that lose bytes.

    A byte goes if a ``LENGTH``-byte string that covers it also starts anywhere else, in the same text or another, whatever
    goes elsewhere; nothing crosses texts. ``kept`` is binary, for a cut may fall inside a character; ``text`` is
    ``kept`` without what is left of such characters. Null and short texts
    lose nothing. Repeated rows are texts of their own, so each loses all of 200 bytes or more that they share. Texts are
    shuffled only if a fixed-size bitmap says that they may lose bytes.
    """
    docs = keyed(docs)
    ranges = stored(repeated_ranges(docs), "ranges")
    by_text = stored(ranges.groupBy("doc", "fingerprint").agg(F.collect_set(F.struct("low", "high")).alias("ranges")), "ranges-by-text")  # a set: repeated rows give equal ranges
    touched = marked_likely(docs.select("doc", "fingerprint", F.col("text").cast("binary").alias("bytes")), "fingerprint", by_text, "fingerprint").filter("likely and bytes is not null").drop("likely")
    cut = touched.join(by_text, ["doc", "fingerprint"]).dropDuplicates(["doc", "fingerprint"]).mapInArrow(in_turn("suffixes", _cut), "doc long, fingerprint long, kept binary, text string, n_removed long, n_spans long")
    return docs, cut


def op6_suffix_buckets(spark, sf_dir) -> DataFrame:
    docs, cut = remove_repeated(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    facts = docs.select("doc_id", "doc", "fingerprint", F.length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("whole"))
    cut = stored(cut.select("doc", "fingerprint", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "cut-texts")
    out = facts.join(cut, ["doc", "fingerprint"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


QUERIES = {"op6_suffix_buckets": op6_suffix_buckets}
ORACLE_SQL: dict[str, str] = {}

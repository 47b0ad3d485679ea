"""N-gram Jaccard join by universe-partition pigeonhole.

The universe of shingles is hashed into segments. Two sets whose symmetric difference has at most H shingles differ in at
most H segments, so of any choice of H + 1 segments one agrees. Links bound H by the sizes: H <= (s + t) / 7 at a similarity
of 3/4, and s / t >= 3/4.

* Size bands: a band holds the pairs whose bound H lies in a range, its segments number a multiple of the largest H. A
  set is indexed in the one or two bands that its own and its partners' sizes allow.
* Allocation by cost: a set indexes the H + 1 of its non-empty segments that cost least. A segment costs what its rarest
  shingle does, by counts that tasks take of the shingles that many of their texts have; ties go by hash. The order is one
  for all sets, so two sets that agree on enough segments agree on one that both index. A set with too few non-empty segments
  is indexed by all of them and by each of its shingles, one of which it shares with any partner.
* One-deletion neighbourhoods: where H is 1 at most, a segment's subset would be a single shingle, of which common lines
  make long lists. There the whole set is the segment, indexed with its subsets of one shingle less.

Sets that share a key are linked through the least set of the key's list, its hub: each set first with the hub that it shares
most keys with. Pairs are verified on the exact sets, and links that verify are joined to components. Then come the pairs with
other hubs, and then the lists whose sets are still in different components. Of the pairs there that sketches do not rule out
a forest of the nearest is verified, at most one pair for each member, and again without the pairs that failed and those that
the links have joined. Once few pairs of a forest verify, and after ``FORESTS`` rounds at the latest, all that is left is verified
at once. So a group of near copies costs a few pairs for each member, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components, joined_components
from .rolling import BY_SPACE, groups_of, mix, sets_of, shingles, word_hashes
from .storage import in_turn, marked_likely, read_table, stored

WORDS = 5
#: Segments per possible difference.
SPREAD = 2
#: Slots that shingles are counted in to find frequent ones, and slots that a task reports at most. They only order segments.
SLOTS, REPORTED = 1 << 20, 8_192
_NO_SLOT = -1
#: Members of a block of a list; rounds of forests before all pairs that are left.
BLOCK, FORESTS = 512, 2
#: Members of a list up to which sketches are compared one by one.
FEW = 24


def _text_sets(batch: pa.RecordBatch, column: str = "bytes") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, sets of shingles one after another, where each begins)."""
    for first, texts in groups_of([x or b"" for x in batch.column(column).to_pylist()]):
        values, before = shingles(*word_hashes(texts, BY_SPACE), WORDS)
        yield first, *sets_of(values, before)


def _sums(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; 0 where there are none."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(values)])
    return total[before[1:]] - total[before[:-1]]


def set_ids(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """An identifier of each set, made of its shingles in any order."""
    n = np.diff(before).astype(np.uint64)
    return mix(_sums(mix(values ^ np.uint64(0x5851F42D4C957F2D)), before) + mix(n * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


def odd_sketches(values: np.ndarray, before: np.ndarray) -> list[bytes]:
    """A bit array of each set, at least two bits a shingle: the parity of the shingles that hash to each bit.

    A shingle that one of two sets lacks flips one bit, so the bits that differ never outnumber the shingles that do.
    """
    n = np.diff(before)
    bits = np.left_shift(1, np.clip(np.ceil(np.log2(np.maximum(2 * n, 1))), 6, 20).astype(np.int64))
    start = np.cumsum(bits) - bits
    owner = np.repeat(np.arange(len(n)), n)
    at = start[owner] + (mix(values + np.uint64(0x41C64E6D)) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8))
    return [packed[a // 8 : (a + b) // 8].tobytes() for a, b in zip(start.tolist(), bits.tolist(), strict=True)]


def sketch_distance(a: bytes, b: bytes) -> int:
    """Bits that differ, the longer sketch folded to the length of the shorter; no more than the sets' difference."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ _folded(y.tobytes(), len(x))).sum())


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its set's size and identifier; at the end of a task the slots of its frequent shingles."""
    counts = np.zeros(SLOTS, np.int32)
    names = ["doc_id", "fingerprint", "n_shingles", "cls", "sketch", "slot", "count"]
    for batch in batches:
        sizes, ids, sketches = [], [], []
        for _, values, before in _text_sets(batch):
            sketches += odd_sketches(values, before)
            sizes.append(np.diff(before))
            ids.append(set_ids(values, before))
            np.add.at(counts, (values & np.uint64(SLOTS - 1)).astype(np.int64), 1)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("fingerprint"), pa.array(np.concatenate(sizes) if n else [], pa.int64()), pa.array(np.concatenate(ids) if n else [], pa.int64()), pa.array(sketches, pa.binary()), pa.array(np.full(n, _NO_SLOT, np.int32)), pa.array(np.zeros(n, np.int64))], names)
    mean = counts.mean()
    often = np.flatnonzero(counts > mean + 8 * np.sqrt(mean) + 16)
    often = often[np.argsort(-counts[often], kind="stable")[:REPORTED]]
    none = pa.nulls(len(often), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(often), pa.binary()), pa.array(often.astype(np.int32)), pa.array(counts[often].astype(np.int64))], names)


def differences(size: int) -> tuple[int, int]:
    """The least and the largest H of a set of that size with any partner."""
    return (size + -(-3 * size // 4)) // 7, (size + 4 * size // 3) // 7


def bands(low: int, high: int) -> Iterator[tuple[int, int]]:
    """(number, largest H) of the bands that hold an H of ``low`` to ``high``; they end at 1, 3, 15, 63 and so on without end."""
    band, least, largest = 0, 0, 1
    while least <= high:
        if low <= largest:
            yield band, largest
        band, least, largest = band + 1, largest + 1, 3 if not band else 4 * largest + 3


def segment_keys(values: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """The keys that one set of shingles is indexed by; ``costs`` are those of its shingles."""
    low, high = differences(len(values))
    keys = []
    for band, largest in bands(low, high):
        tag = mix(np.array([band + 1], np.uint64) * np.uint64(0xA24BAED4963EE407))[0]
        if not band:
            mixed = mix(values ^ tag)
            total = mixed.sum()
            keys.append(mix(np.append(total - mixed, total) + tag))
            continue
        need = min(high, largest) + 1
        segment = (mix(values + tag) >> np.uint64(7)) % np.uint64(SPREAD * (largest + 1))
        order = np.lexsort((costs, segment))
        segment, mixed = segment[order], mix(values[order] ^ tag)
        first = np.flatnonzero(np.diff(segment, prepend=segment[0] + np.uint64(1)) != 0)
        if len(first) < need:  # partners may agree on empty segments alone, but share a shingle
            keys.append(mix(mixed + np.uint64(0x632BE59BD9B4E019)))
        key = mix(np.add.reduceat(mixed, first) + mix(segment[first] + tag))
        cost = costs[order][first]  # the least of the segment
        keys.append(key[np.lexsort((key, cost))[:need]])
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _key_rows(frequent):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, values, before in _text_sets(batch):
                cost = frequent.value[(values & np.uint64(SLOTS - 1)).astype(np.int64)]
                keys, owner = [], []
                for i, cls in enumerate(set_ids(values, before).tolist()):
                    a, b = before[i], before[i + 1]
                    if a == b or cls in seen:  # an equal set of this task has been indexed
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(cls)
                    keys.append(segment_keys(values[a:b], cost[a:b]))
                    owner.append(np.full(len(keys[-1]), cls))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owner))], ["key", "cls"])

    return rows


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, values, before in _text_sets(batch):
            packed = [values[a:b].tobytes() for a, b in zip(before[:-1], before[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(set_ids(values, before)), pa.array(packed, pa.binary())], ["cls", "shingles"])


def _near_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("m", "x", "n", "y"))
        near = [7 * sketch_distance(x, y) <= m + n for m, x, n, y in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near, pa.bool_()))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            linked.append(100 * both >= 75 * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _links(texts: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` of set identifiers whose sets reach the similarity.

    Sizes and sketches, a small part of a set, rule out pairs without doubt; only sets of the others are shuffled.
    """
    side = lambda x, y: classes.select(F.col("cls").alias(x), F.struct("n_shingles", "sketch").alias(y))
    likely = pairs.join(side("a", "left"), "a").join(side("b", "right"), "b").filter("4 * left.n_shingles >= 3 * right.n_shingles and 4 * right.n_shingles >= 3 * left.n_shingles")
    near = likely.select("a", "b", F.col("left.n_shingles").alias("m"), F.col("left.sketch").alias("x"), F.col("right.n_shingles").alias("n"), F.col("right.sketch").alias("y")).mapInArrow(in_turn("shingles", _near_sketches), "a long, b long")
    return _verified_links(texts, classes, near)


def _verified_links(texts: DataFrame, classes: DataFrame, near: DataFrame) -> DataFrame:
    """The (a, b) of ``near`` whose exact sets reach the similarity."""
    fits = stored(near, "candidates")
    if fits.isEmpty():
        return fits
    used = fits.select(F.col("a").alias("cls")).union(fits.select("b")).distinct()
    wanted = stored(classes.select("cls", "fingerprint").join(used, "cls", "left_semi").select("fingerprint").distinct(), "wanted")
    found = marked_likely(texts, "fingerprint", wanted, "fingerprint").filter("likely").join(wanted, "fingerprint", "left_semi").dropDuplicates(["fingerprint"])
    sets = stored(found.select("bytes").mapInArrow(in_turn("shingles", _set_rows), "cls long, shingles binary"), "sets").dropDuplicates(["cls"])
    both = fits.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("left")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("right")), "b")
    return stored(both.select("a", "b", "left", "right").mapInArrow(in_turn("shingles", _verified), "a long, b long"), "verified")


class _Lists:
    """Near pairs of one block pair of a list at a time: of different components, with sizes and sketches that allow a link."""

    def __init__(self, everything: bool):
        self.everything = everything

    def pairs(self, cls: list[int], component: list[int], size: list[int], block: list[int], sketches: list[bytes], failed: set, crossing: bool) -> tuple[list[int], list[int]]:
        near = self._few if len(cls) <= FEW else self._many
        i, j, distance = near(np.array(cls), np.array(component), np.array(size), np.array(block), sketches, crossing)
        if failed and len(i):
            new = np.array([(cls[a], cls[b]) not in failed for a, b in zip(i.tolist(), j.tolist(), strict=True)])
            i, j, distance = i[new], j[new], distance[new]
        if not self.everything and len(i) > 1:
            kept = _forest(i, j, distance, np.unique(component, return_inverse=True)[1])
            i, j = i[kept], j[kept]
        return [cls[x] for x in i.tolist()], [cls[x] for x in j.tolist()]

    @staticmethod
    def _few(cls, component, size, block, sketches, crossing):
        """All pairs (i, j, distance), cls[i] < cls[j], one by one."""
        numbers, lengths, out = [int.from_bytes(x) for x in sketches], [len(x) for x in sketches], []
        c, n, b = component.tolist(), size.tolist(), block.tolist()
        order = np.argsort(cls, kind="stable").tolist()
        for at, i in enumerate(order):
            for j in order[at + 1 :]:
                if c[i] == c[j] or (crossing and b[i] == b[j]) or 4 * n[i] < 3 * n[j] or 4 * n[j] < 3 * n[i]:
                    continue
                x, y, p, q = (numbers[i], numbers[j], lengths[i], lengths[j]) if lengths[i] <= lengths[j] else (numbers[j], numbers[i], lengths[j], lengths[i])
                while q > p:  # the longer folded to the length of the shorter
                    q //= 2
                    y = (y >> 8 * q) ^ (y & ((1 << 8 * q) - 1))
                if 7 * (distance := (x ^ y).bit_count()) <= n[i] + n[j]:
                    out.append((i, j, distance))
        return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    @staticmethod
    def _many(cls, component, size, block, sketches, crossing):
        lengths, out = np.array([len(x) for x in sketches]), ([], [], [])
        for short in np.unique(lengths):
            other = np.flatnonzero((lengths >= short) & (lengths <= 2 * short))
            folded = np.stack([_folded(sketches[j], int(short)) for j in other])
            for i in np.flatnonzero(lengths == short).tolist():
                may = (component[other] != component[i]) & (4 * size[other] >= 3 * size[i]) & (4 * size[i] >= 3 * size[other])
                may &= (block[other] != block[i]) if crossing else True
                may &= (lengths[other] > short) | (cls[other] > cls[i])
                j = np.flatnonzero(may)
                if len(j):
                    distance = np.bitwise_count(folded[j] ^ np.frombuffer(sketches[i], np.uint8)).sum(1, dtype=np.int64)
                    near = 7 * distance <= size[other[j]] + size[i]
                    j, distance = other[j[near]], distance[near]
                    first = cls[j] > cls[i]
                    for column, x in zip(out, (np.where(first, i, j), np.where(first, j, i), distance), strict=True):
                        column.append(x)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by their group: key, low, high; a group is no more than two blocks."""
        group, held, failed, out = None, ([], [], [], [], []), set(), ([], [], [], [], [])

        def close() -> None:
            if len(held[0]) > 1:
                a, b = self.pairs(*held, failed, group[1] != group[2])
                for column, x in zip(out, (*([g] * len(a) for g in group), a, b), strict=True):
                    column.extend(x)
            for column in held:
                column.clear()
            failed.clear()

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high")), strict=True))
            rows = zip(*(batch.column(c).to_pylist() for c in ("cls", "component", "n_shingles", "block", "sketch", "failed")), strict=True)
            for own, (cls, *facts, other) in zip(keys, rows, strict=True):
                if own != group:
                    close()
                    group = own
                if other is not None:
                    failed.add((cls, other))
                    continue
                for column, x in zip(held, (cls, *facts), strict=True):
                    column.append(x)
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], NEAR_NAMES)
                out = ([], [], [], [], [])
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], NEAR_NAMES)


NEAR = "key long, low long, high long, a long, b long"
NEAR_NAMES = [x.split()[0] for x in NEAR.split(", ")]


def _forest(i: np.ndarray, j: np.ndarray, distance: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Which of the pairs make a forest of the nearest over components: each takes its nearest pair, until no pair joins two."""
    label, taken = np.arange(component.max() + 1), np.zeros(len(i), bool)
    rank = np.empty(len(i), np.int64)
    rank[np.lexsort((j, i, distance))] = np.arange(len(i))
    while True:
        a, b = label[component[i]], label[component[j]]
        open_ = np.flatnonzero(a != b)
        if not len(open_):
            return np.flatnonzero(taken)
        nearest = np.full(len(label), len(i))
        np.minimum.at(nearest, a[open_], rank[open_])
        np.minimum.at(nearest, b[open_], rank[open_])
        chosen = open_[(nearest[a[open_]] == rank[open_]) | (nearest[b[open_]] == rank[open_])]
        taken[chosen] = True
        while True:  # the least label of each tree
            x, y = label[component[i[chosen]]], label[component[j[chosen]]]
            if (x == y).all():
                break
            least = np.arange(len(label))
            np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
            while (least[least] != least).any():
                least = least[least]
            label = least[label]


def _folded(sketch: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _in_blocks(rows: DataFrame) -> DataFrame:
    """(key, cls, component, block, low, high): the rows (key, cls, component) of lists, each once for every pair of blocks of its list that it is in.

    Of lists with the same members one is looked at.
    """
    lists = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
    one = stored(lists.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "different-lists")
    dealt = rows.join(one, "key").withColumn("block", F.pmod(F.xxhash64("cls", "key"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    return dealt.select("key", "cls", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def _list_links(texts: DataFrame, classes: DataFrame, rows: DataFrame, component: DataFrame) -> DataFrame:
    """``component`` (node, component) once it has the links between different components of the lists ``rows`` (key, cls, component)."""
    facts = stored(classes.join(rows.select("cls").distinct(), "cls", "left_semi").select("cls", "n_shingles", "sketch"), "list-sketches")
    dealt, failed, everything = stored(_in_blocks(rows), "dealt-lists"), None, False
    group = ["key", "low", "high"]
    for n in range(FORESTS + 1):
        given = dealt.join(facts, "cls").select(*group, "cls", "component", "n_shingles", "block", "sketch", F.lit(None).cast("long").alias("failed"))
        if failed is not None:
            nothing = F.lit(None).cast("long")
            given = given.unionByName(failed.select(*group, F.col("a").alias("cls"), nothing.alias("component"), nothing.alias("n_shingles"), nothing.alias("block"), F.lit(None).cast("binary").alias("sketch"), F.col("b").alias("failed")))
        given = given.repartition(*group).sortWithinPartitions(*group)
        found = stored(given.mapInArrow(in_turn("shingles", _Lists(everything)), NEAR), "near-in-lists")
        pairs = stored(found.select("a", "b").distinct(), "near-pairs")
        near = pairs.count()
        if not near:
            break
        good = _verified_links(texts, classes, pairs)
        component = stored(joined_components(component, good), "components-so-far")
        if everything:
            break
        everything = n + 1 == FORESTS or 4 * good.count() < near
        # groups that gave no pair never will; of the others those that still hold several components go on
        bad = found.join(good, ["a", "b"], "left_anti").select(*group, "a", "b")
        failed = stored(bad if failed is None else failed.unionByName(bad), "failed-pairs")
        open_ = dealt.drop("component").join(found.select(*group).distinct(), group, "left_semi")
        dealt = stored(open_.join(component.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls")), "open-groups")
    return component


def _placed(rows: DataFrame, column: str, component: DataFrame, out: str) -> DataFrame:
    """``rows`` with the component of a set as ``out``: itself where it has no links. Only sets that likely have some are shuffled."""
    marked = marked_likely(rows, column, component, "node")
    linked = marked.filter("likely").join(component.select(F.col("node").alias(column), F.col("component").alias(out)), column, "left").withColumn(out, F.coalesce(out, column))
    return linked.drop("likely").unionByName(marked.filter("not likely").withColumn(out, F.col(column)).drop("likely"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of the text, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    A set is the distinct 5-word shingles of the whole text, A-Z lower-cased, words between white space; a text of fewer
    words is one shingle, one without words has none and is linked with nothing. Sets link at a Jaccard similarity of 3/4;
    ``component_id`` is the least doc_id that links reach, a document without links is its own. Equal sets are one set
    throughout. A null text has no words, a null doc_id takes part but is never least unless all are null.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.xxhash64("text").alias("fingerprint"), F.col("text").cast("binary").alias("bytes"))
    schema = "doc_id long, fingerprint long, n_shingles long, cls long, sketch binary, slot int, count long"
    facts = stored(texts.mapInArrow(in_turn("shingles", _facts), schema), "shingle-sets")
    members = facts.filter(F.col("slot") == _NO_SLOT).select("doc_id", "fingerprint", "n_shingles", "cls")
    frequent = np.zeros(SLOTS, np.int64)  # a fixed number of counters, so what is sent to every task is bounded
    for row in facts.filter(F.col("slot") != _NO_SLOT).groupBy("slot").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "slot").limit(1 << 16).collect():
        frequent[row["slot"]] = row["n"]
    texts = texts.filter(F.length("bytes") > 0)
    classes = stored(facts.filter("n_shingles > 0").groupBy("cls").agg(F.min("n_shingles").alias("n_shingles"), F.min("fingerprint").alias("fingerprint"), F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch")), "set-classes")
    costs = spark.sparkContext.broadcast(frequent)
    keys = texts.mapInArrow(in_turn("shingles", _key_rows(costs)), "key long, cls long")
    same = Window.partitionBy("key")
    listed = keys.select("key", "cls", F.min("cls").over(same).alias("hub"), F.max("cls").over(same).alias("last")).filter("hub <> last")
    lists = stored(listed.select("key", "cls", "hub").distinct(), "key-lists")  # dealt by key already
    costs.destroy()
    # each set with the hub that it shares most keys with, then with other hubs of other components
    stars = stored(lists.filter("cls <> hub").groupBy("hub", "cls").agg(F.count("*").alias("n")), "stars")
    nearest = stars.groupBy("cls").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("a")).select("a", F.col("cls").alias("b"))
    links = _links(texts, classes, nearest)
    component = stored(connected_components(links, "a", "b"), "nearest-components")
    apart = stars.join(nearest.select(F.col("a").alias("hub"), F.col("b").alias("cls")), ["hub", "cls"], "left_anti").select("hub", "cls")
    apart = _placed(_placed(stored(apart, "other-hubs"), "cls", component, "x"), "hub", component, "y").filter("x <> y")
    component = stored(joined_components(component, _links(texts, classes, apart.select(F.col("hub").alias("a"), F.col("cls").alias("b")))), "hub-components")
    # lists that still hold several components, of three sets or more (a pair has been compared)
    placed = stored(_placed(lists.select("key", "cls"), "cls", component, "component"), "placed-lists")
    several = stored(placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).filter("x <> y and n > 2").select("key"), "open-lists")
    rest = stored(marked_likely(placed, "key", several, "key").filter("likely").drop("likely").join(several, "key", "left_semi").select("key", "cls", "component"), "open-rows")
    component = _list_links(texts, classes, rest, component)
    placed = stored(classes.join(component.select(F.col("node").alias("cls"), "component"), "cls", "left").select("cls", "doc_id", F.coalesce("component", "cls").alias("component")), "placed-classes")
    least = stored(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least-ids")
    named = stored(placed.join(least, "component").select("cls", "component_id"), "named-classes")
    out = members.join(named, "cls", "left")
    return out.select("doc_id", "fingerprint", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op2_partition_join(spark, sf_dir) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op2_partition_join": op2_partition_join}
ORACLE_SQL: dict[str, str] = {}

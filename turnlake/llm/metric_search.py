"""Exact top-k inner products: M-trees below global pivots, searched best first with stored covering radii and parent distances.

Vectors become integers, floor(1024 * x). With one more coordinate, sqrt(M - |x|^2) for the largest squared length M, all
have the same length, so the largest inner product with a query (whose own extra coordinate is 0) is the least Euclidean
distance. The top page of the index are pivots, a bounded sample of the vectors: every vector belongs to its nearest pivot,
whose covering radius is the distance of the farthest. Below a pivot are M-trees of a bounded number of vectors, each built
and searched inside a task. Every query searches the trees of its nearest pivot first; its k-th score there is a bound for
all others, and goes along to those pivots that it does not rule out. Only rows that reach it leave their trees.

Distances only choose what to skip, with a margin for rounding; scores are integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import in_turn, read_table, stored

SCALE = 1024
#: Distinct vectors of a tree and entries of a page, at the most on average; queries that a task searches for at once.
TREE_ROWS, PAGE, BLOCK = 8_192, 256, 4_096
#: Pivots at most, and numbers in them: what is sent to every task. Vectors are dealt to pivots whatever their number.
PIVOTS, CELLS = 1_024, 1 << 22
#: Rounding of a distance as a share of the largest length: a difference of squares is exact to 2**-40 of it, its root to this.
MARGIN = 2e-6
#: Scores below this are exact in double precision; above, they are summed as Python integers.
EXACT = float(1 << 52)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class MTree:
    """Pages of entries (vector, covering radius, distance to the parent); leaves hold the indexed vectors.

    Built from above: a page's vectors are dealt to the nearest of up to PAGE pivots that lie far apart. A page of equal
    vectors is a leaf however many it holds.
    """

    def __init__(self, points: np.ndarray, extra: np.ndarray, whole: list | None = None):
        #: ``whole`` has the vectors as Python integers, where products of ``points`` are not exact.
        self.points, self.extra, self.whole = points, extra, whole
        #: Page to (pivots or rows, radii or None for a leaf, distances to the page's own pivot, child pages or None).
        self.pages: list[tuple[np.ndarray, np.ndarray | None, np.ndarray, list[int] | None]] = []
        self.root = self._build(np.arange(len(points)), None) if len(points) else -1

    def distances(self, row: int, rows: np.ndarray) -> np.ndarray:
        d = self.points[rows] - self.points[row]
        return np.sqrt((d * d).sum(1) + (self.extra[rows] - self.extra[row]) ** 2)

    def _build(self, rows: np.ndarray, parent: int | None) -> int:
        own = np.zeros(len(rows)) if parent is None else self.distances(parent, rows)
        number = len(self.pages)
        self.pages.append(None)
        if len(rows) <= PAGE or (parent is not None and own.max() == 0):
            order = np.argsort(own, kind="stable")
            self.pages[number] = (rows[order], None, own[order], None)
            return number
        pivots, nearest, which = [int(rows[0])], self.distances(int(rows[0]), rows), np.zeros(len(rows), np.int64)
        while len(pivots) < min(PAGE, math.ceil(len(rows) / PAGE) + 1):
            far = int(nearest.argmax())
            if nearest[far] == 0:
                break
            pivots.append(int(rows[far]))
            d = self.distances(pivots[-1], rows)
            closer = d < nearest
            which[closer], nearest[closer] = len(pivots) - 1, d[closer]
        if len(pivots) == 1:
            self.pages[number] = (rows, None, own, None)
            return number
        radii, children, kept = [], [], []
        for i, pivot in enumerate(pivots):
            part = rows[which == i]
            if len(part):
                kept.append(pivot)
                radii.append(float(nearest[which == i].max()))
                children.append(self._build(part, pivot))
        to_parent = np.zeros(len(kept)) if parent is None else self.distances(parent, np.array(kept))
        self.pages[number] = (np.array(kept), np.array(radii), to_parent, children)
        return number

    def search(self, query: list[int], largest: float, k: int, worst: float = -math.inf) -> list[tuple[int, int]]:
        """(score, row) of the k best rows and those that tie with the last; ``worst`` is a score that k rows reach already."""
        asked, query = query, np.asarray(query, np.float64)
        length, best, found = float(query @ query), [], []
        margin = MARGIN * math.sqrt(max(largest, length, 1.0))

        def limit() -> float:
            score = float(best[0]) if len(best) == k else -math.inf
            score = max(score, worst)
            return math.inf if score == -math.inf else math.sqrt(max(length + largest - 2 * score, 0.0)) + margin

        queue = [(0.0, self.root, -1.0)] if self.root >= 0 else []
        while queue:
            bound, number, to_pivot = heapq.heappop(queue)
            if bound > limit():
                break
            rows, radii, own, children = self.pages[number]
            if to_pivot >= 0:  # |d(q, parent) - d(entry, parent)| - radius bounds without computing d(q, entry)
                low = np.abs(to_pivot - own) - (radii if radii is not None else 0.0)
                open_ = np.flatnonzero(low <= limit())
            else:
                open_ = np.arange(len(rows))
            if not len(open_):
                continue
            scores = self.points[rows[open_]] @ query
            if radii is None:
                mine = rows[open_].tolist()
                exact = scores.tolist() if self.whole is None else [sum(a * b for a, b in zip(asked, self.whole[row], strict=True)) for row in mine]
                for score, row in zip(exact, mine, strict=True):
                    if len(best) < k:
                        heapq.heappush(best, score)
                    elif score > best[0]:
                        heapq.heapreplace(best, score)
                    found.append((int(score), row))
            else:
                d = np.sqrt(np.maximum(length + largest - 2 * scores, 0))
                bounds = np.maximum(np.maximum(d - radii[open_], 0), bound)
                far = limit()
                for i, lower, distance in zip(open_.tolist(), bounds.tolist(), d.tolist(), strict=True):
                    if lower <= far:
                        heapq.heappush(queue, (lower, children[i], distance))
        least = max(best[0] if len(best) == k else -math.inf, worst)
        return [x for x in found if x[0] >= least]


def integer_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v): floor(1024 * x) of each component; rows with a null id, vector or component, or one that is not finite, are out.

    Integers that no long holds become the nearest that one does.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = table.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    bound = 2.0**62
    whole = lambda x: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), F.lit(SCALE) * x.cast("double")))).cast("long")
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("v"))


def _padded(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; missing components are 0."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    return out


class _Top:
    """The top page: pivots in the space of one more coordinate, and how far from each its vectors are."""

    def __init__(self, pivots: np.ndarray, largest: float):
        self.pivots, self.largest = pivots, largest
        self.extra = np.sqrt(np.maximum(largest - (pivots * pivots).sum(1), 0))
        self.radii = np.zeros(len(pivots))
        self.parts = np.zeros(len(pivots), np.int64)

    def distances(self, points: np.ndarray, indexed: bool) -> np.ndarray:
        """Of every point to every pivot; a query's extra coordinate is 0."""
        square = (points * points).sum(1)
        extra = np.sqrt(np.maximum(self.largest - square, 0)) if indexed else np.zeros(len(points))
        length = self.largest if indexed else square[:, None]
        return np.sqrt(np.maximum(length + self.largest - 2 * (points @ self.pivots.T + extra[:, None] * self.extra[None]), 0))


def _dealt(shared, width: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value
        for batch in batches:
            d = top.distances(_padded(batch.column("v"), width), True)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("ids"), pa.array(near), pa.array(d[np.arange(len(d)), near])], ["v", "ids", "pivot", "d"])

    return deal


ASKED = "query_id long, v array<long>, worst double, pivot long, part long"


def _asked(shared, width: int, first: bool):
    """Each query with the trees that it has to search: those of its nearest pivot, or of all others that ``worst`` leaves."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value
        used = np.flatnonzero(top.parts)
        for batch in batches:
            points = _padded(batch.column("v"), width)
            d = top.distances(points, False)[:, used]
            nearest = (d - top.radii[used]).argmin(1)
            worst = np.array([-math.inf if x is None else x for x in batch.column("worst").to_pylist()])
            length = (points * points).sum(1)
            limit = np.sqrt(np.maximum(length + top.largest - 2 * np.where(np.isinf(worst), 0, worst), 0))
            limit = np.where(np.isinf(worst), math.inf, limit + 4 * MARGIN * np.sqrt(np.maximum(np.maximum(length, top.largest), 1)))
            chosen = np.zeros(d.shape, bool)
            chosen[np.arange(len(d)), nearest] = True
            if not first:
                chosen = ~chosen & (d - top.radii[used] <= limit[:, None])
            row, column = np.nonzero(chosen)
            parts = top.parts[used[column]]
            again = np.repeat(np.arange(len(row)), parts)
            part = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
            row, pivot = row[again], used[column[again]]
            for a in range(0, len(row), 4096):
                some = pa.array(row[a : a + 4096])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(some), batch.column("v").take(some), batch.column("worst").take(some), pa.array(pivot[a : a + 4096]), pa.array(part[a : a + 4096])], [x.split()[0] for x in ASKED.split(", ")])

    return ask


FOUND = "query_id long, vec_id long, score long"


def _search_block(k: int, largest: float, width: int):
    """One tree and one block of queries: the k best of each, with all copies that can matter."""

    def search(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not vectors.num_rows or not queries.num_rows:
            return kinds.empty_table()
        points, ids = _padded(vectors.column("v"), width), vectors.column("ids").to_pylist()
        extra = np.sqrt(np.maximum(largest - (points * points).sum(1), 0))
        pad = lambda v: v + [0] * (width - len(v))
        asked = [pad(v) for v in queries.column("v").to_pylist()]
        longest = max(float(np.abs(points).max(initial=0)), max((abs(x) for v in asked for x in v), default=0))
        tree = MTree(points, extra, None if longest * longest * max(width, 1) < EXACT else [pad(v) for v in vectors.column("v").to_pylist()])
        out: tuple[list, list, list] = ([], [], [])
        for query_id, v, worst in zip(queries.column("query_id").to_pylist(), asked, queries.column("worst").to_pylist(), strict=True):
            # k + 1: the query's own vector may be among them
            rows = tree.search(v, largest, k + 1, -math.inf if worst is None else worst)
            hits = sorted((-int(score), i) for score, row in rows for i in ids[row] if i != query_id)[:k]
            out[0].extend([query_id] * len(hits))
            out[1].extend(i for _, i in hits)
            out[2].extend(min(max(-s, LEAST), MOST) for s, _ in hits)
        return pa.table([pa.array(x, pa.int64()) for x in out], schema=kinds)

    return search


def top_k(table: DataFrame, queries: DataFrame, k: int = 10, tree_rows: int = TREE_ROWS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the ``k`` rows of ``table`` of the largest inner product.

    Both have vec_id and v (integers), as ``integer_vectors`` gives them; a shorter vector counts as filled up with zeros. A
    query's own id is no candidate; ties go to the smaller vec_id; with fewer rows there are fewer ranks. Repeated ids count
    once per different vector. Scores that no long holds become the nearest that one does. Equal vectors are one entry of a
    tree with its k + 1 least ids, which is all that any answer can hold, so a vector that a third of all rows share is one
    entry. Pivots are those vectors of the least hash; a pivot that most rows are near has as many trees as they ask for.
    Trees are searched by blocks of the queries; only rows that reach a query's bound leave a task.
    """
    spark = table.sparkSession
    salted = table.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    least = lambda ids: F.slice(F.array_sort(ids), 1, k + 1)
    # the least ids of each salted part first, then of the parts: no task ever holds the ids of a hot vector
    part = Window.partitionBy("v", "salt").orderBy("vec_id")
    few = salted.withColumn("n", F.row_number().over(part)).filter(F.col("n") <= k + 1).drop("n")
    distinct = stored(few.groupBy("v").agg(least(F.collect_list("vec_id")).alias("ids")), "distinct-vectors")
    length = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    count, largest, width = distinct.agg(F.count("*"), F.max(length("v")), F.max(F.size("v"))).first()
    queries = stored(queries.select("vec_id", "v").distinct(), "queries")
    asked, longest = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    if not count or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, largest = max(width, longest), float(largest) * (1 + 1e-12)
    pivots = max(1, min(math.ceil(count / tree_rows), PIVOTS, CELLS // max(width, 1)))
    sample = distinct.orderBy(F.xxhash64("v", F.lit(5))).limit(pivots).select("v").collect()
    top = _Top(_padded(pa.chunked_array([pa.array([r["v"] for r in sample], pa.list_(pa.int64()))]), width), largest)
    context = spark.sparkContext
    near = stored(distinct.mapInArrow(in_turn("vectors", _dealt(context.broadcast(top), width)), "v array<long>, ids array<long>, pivot long, d double"), "pivots")
    for row in near.groupBy("pivot").agg(F.max("d").alias("d"), F.count("*").alias("n")).collect():  # a row for each pivot
        top.radii[row["pivot"]], top.parts[row["pivot"]] = row["d"], math.ceil(row["n"] / tree_rows)
    shared, blocks = context.broadcast(top), max(1, math.ceil(asked / block))
    sizes = spark.createDataFrame([(i, int(n)) for i, n in enumerate(top.parts) if n], "pivot long, parts long")
    trees = near.join(F.broadcast(sizes), "pivot").select("v", "ids", "pivot", F.pmod(F.xxhash64("v", F.lit(7)), F.col("parts")).alias("part"))
    by = ["pivot", "part", "block"]

    def search(waiting: DataFrame, first: bool) -> DataFrame:
        given = waiting.mapInArrow(in_turn("vectors", _asked(shared, width, first)), ASKED).withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(blocks)))
        given = stored(given, "asked")
        # a tree goes to the blocks of queries that ask for it, and to no others
        sent = trees.join(given.select(*(F.col(c).alias(c) for c in by)).distinct(), ["pivot", "part"])
        found = sent.groupBy(*by).cogroup(given.groupBy(*by)).applyInArrow(_search_block(k, largest, width), FOUND)
        return stored(found, "nearest" if first else "others")

    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda rows: rows.distinct().withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    nearest = search(queries.withColumn("worst", F.lit(None).cast("double")), True)
    bounds = best(nearest).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("worst"))
    others = search(queries.join(bounds, "vec_id", "left").select("vec_id", "v", "worst"), False)
    return best(nearest.unionByName(others)).select("query_id", "rank", "vec_id", "score")


def op9_metric_search(spark, sf_dir) -> DataFrame:
    vectors = integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


QUERIES = {"op9_metric_search": op9_metric_search}

ORACLE_SQL = {
    "op9_metric_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
}

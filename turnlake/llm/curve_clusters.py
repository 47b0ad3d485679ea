"""Exact k-means over integers, with zone maps along a space-filling curve.

Vectors are sorted by their place on a Hilbert curve through coarse cells and stored in blocks with the least and greatest value
of every component. In each round a block first compares its box with the centroids: one that is farther than another from every
point of the box is no candidate. The rest are compared with the block's vectors exactly, in one matrix operation. A block of
equal vectors has a box of one point. Each round reads the stored blocks and gives sums of a row for each cluster and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metric_search import SCALE
from .storage import in_turn, read_table, stored

DIMENSIONS, CLUSTERS, ROUNDS, SEED = 64, 8, 10, 3
#: Vectors of a block, and bits of a component on the curve.
BLOCK, BITS = 256, 5
#: Squared distances of 64 components below this are exact in double precision; greater ones are computed with Python's integers.
EXACT = 1 << 22
#: Integers that no long holds become the nearest that one does; components at most 2**62.
MOST, COMPONENT = (1 << 63) - 1, 2.0**62


def kept_vectors(table: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, v: floor(1024 * x) of each component of the vectors of so many components, none null, infinite or not a number."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = lambda x: F.floor(F.greatest(F.lit(-COMPONENT), F.least(F.lit(COMPONENT), F.lit(SCALE) * x.cast("double")))).cast("long")
    return table.filter((F.size("embedding") == dimensions) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("v"))


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve of rows of cells, each from 0 to 2 ** bits - 1, as bytes that sort like them.

    Skilling's transform: from the highest bit down, each axis is reflected or exchanged with the first; then the Gray code is undone.
    """
    x = cells.astype(np.int64).T.copy()
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for axis in x:
            flip = (axis & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(flip, low, swap)
            axis ^= swap
        bit >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)])  # bit, axis, row
    packed = np.packbits(planes.reshape(-1, x.shape[1]).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def _matrix(column, dimensions: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, dimensions)


def _on_curve(spread: float, dimensions: int):
    """Adds each vector's place; cells divide the range of four mean absolute components, what is beyond counts as its end."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("v"), dimensions) / (4 * spread)
            cells = np.clip((points + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(hilbert_keys(cells, BITS), pa.binary())], ["vec_id", "v", "curve"])

    return place


BLOCKS = "ids array<long>, points binary, low binary, high binary"


def _to_blocks(dimensions: int, size: int):
    def block(ids: list, points: list[np.ndarray]) -> pa.RecordBatch:
        m = np.concatenate(points)
        cells = [pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (m, m.min(0), m.max(0))]
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *cells], ["ids", "points", "low", "high"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, held = [], [], 0
        for batch in batches:
            m, names, at = _matrix(batch.column("v"), dimensions), batch.column("vec_id").to_pylist(), 0
            while at < len(m):
                some = m[at : at + size - held]
                points.append(some)
                ids += names[at : at + len(some)]
                at, held = at + len(some), held + len(some)
                if held == size:
                    yield block(ids, points)
                    ids, points, held = [], [], 0
        if held:
            yield block(ids, points)

    return cut


def zone_maps(vectors: DataFrame, dimensions: int = DIMENSIONS, size: int = BLOCK) -> DataFrame:
    """The vectors in blocks of ``size`` along the curve, with each block's box; written to the shared folder.

    Ranges are of the place, then vec_id, then the row's own number: copies of one vector, however many, lie in many partitions.
    """
    spread = vectors.agg(F.avg(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")) / dimensions))).first()[0]
    placed = vectors.mapInArrow(_on_curve(max(spread or 0.0, 1.0), dimensions), "vec_id long, v array<long>, curve binary")
    placed = stored(placed, "curve").withColumn("row", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange("curve", "vec_id", "row").sortWithinPartitions("curve", "vec_id", "row").select("vec_id", "v")
    return stored(ranged.mapInArrow(in_turn("blocks", _to_blocks(dimensions, size)), BLOCKS), "blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be the nearest of some point of the box, or tie with it.

    First by the box's least and greatest distance from each; then against the one nearest to the middle: the difference of two
    squared distances is linear, so its least value over the box is that of one corner, component by component.
    """
    beyond = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    across = np.maximum(np.abs(centroids - low), np.abs(high - centroids))
    can = (beyond * beyond).sum(1) <= (across * across).sum(1).min()
    middle = (low + high) / 2 - centroids
    best = centroids[int((middle * middle).sum(1).argmin())]
    slope = centroids - best
    most = 2 * np.maximum(slope * low, slope * high).sum(1) + (best * best).sum() - (centroids * centroids).sum(1)
    return np.flatnonzero(can & (most >= 0))  # below 0: farther than ``best`` everywhere


def nearest(points: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """Of each point of a block, the nearest centroid (ties: the smaller number) and the squared distance."""
    largest = max(int(high.max()), -int(low.min()), *(abs(x) for c in centroids for x in c))
    if largest < EXACT and len(low) <= DIMENSIONS:
        c = np.array(centroids, float)
        numbers = candidates(low.astype(float), high.astype(float), c)
        d = np.stack([((points - c[i]) ** 2).sum(1) for i in numbers])
        at = d.argmin(0)
        return numbers[at], d[at, np.arange(len(points))].astype(np.int64).tolist()
    which, distance = [], []
    for point in points.tolist():
        d = [sum((a - b) ** 2 for a, b in zip(point, c, strict=True)) for c in centroids]
        distance.append(min(d))
        which.append(d.index(distance[-1]))
    return np.array(which, np.int64), [min(d, MOST) for d in distance]


def _blocks_of(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple]:
    for ids, points, low, high in zip(*(batch.column(c) for c in ("ids", "points", "low", "high")), strict=True):
        of = lambda x: np.frombuffer(x.as_py(), "<i8")
        yield ids, of(points).reshape(-1, dimensions), of(low), of(high)


def _sums(shared, dimensions: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        members, totals = [0] * len(centroids), np.zeros((len(centroids), dimensions), object)
        for batch in batches:
            for _, points, low, high in _blocks_of(batch, dimensions):
                which, _ = nearest(points, low, high, centroids)
                wide = max(int(high.max()), -int(low.min())) >= 1 << 40
                for i in np.unique(which).tolist():
                    own = points[which == i]
                    members[i] += len(own)
                    totals[i] += (own.astype(object) if wide else own).sum(0).astype(object)
        used = [i for i, n in enumerate(members) if n]
        rows = [(i, d, Decimal(int(totals[i, d])), members[i]) for i in used for d in range(dimensions)]
        kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], ["cluster", "d", "total", "members"])

    return add


def _assigned(shared, dimensions: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, points, low, high in _blocks_of(batch, dimensions):
                which, distance = nearest(points, low, high, shared.value)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(which, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return assign


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the least digests of seed and vec_id; rows without vec_id come last, rows of one vec_id by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in vectors.select(digest.alias("digest"), "v").orderBy(F.asc_nulls_last("digest"), "v").limit(clusters).collect()]


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each row of ``vectors`` (vec_id, v of integers).

    Centroids begin as ``first_centroids``; a round gives each cluster the floor of its vectors' mean, by integers; an empty one
    stays. Fewer vectors make fewer clusters, repeated rows count each, no vectors give no rows. Distances and inertias that no long
    holds become the greatest that one does. Rounds end early where nothing moved any more, which changes no result.
    """
    spark = vectors.sparkSession
    vectors = stored(vectors.select("vec_id", "v"), "vectors")
    centroids = first_centroids(vectors, clusters, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    blocks = zone_maps(vectors, dimensions, block)
    share = spark.sparkContext.broadcast
    for _ in range(rounds):
        found = blocks.mapInArrow(in_turn("blocks", _sums(share(centroids), dimensions)), "cluster int, d int, total decimal(38,0), members long")
        moved = [list(c) for c in centroids]
        for row in found.groupBy("cluster", "d").agg(F.sum("total").alias("total"), F.sum("members").alias("members")).collect():  # a row for each cluster and component
            moved[row["cluster"]][row["d"]] = int(row["total"]) // row["members"]
        if moved == centroids:
            break
        centroids = moved
    given = stored(blocks.mapInArrow(in_turn("blocks", _assigned(share(centroids), dimensions)), "vec_id long, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: int(r["total"]) for r in given.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}  # a row for each cluster
    whole = min(sum(sums.values()), MOST)
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    facts = [(i, min(total, MOST), whole, digest(centroids[i])) for i, total in sums.items()]
    return given.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_curve_clusters(spark, sf_dir) -> DataFrame:
    return clustered(kept_vectors(read_table(spark, sf_dir, "embeddings")))


QUERIES = {"op12_curve_clusters": op12_curve_clusters}


def _sql() -> str:
    """Each round by name: centroids c0, c1, ... and the vectors' nearest a0, a1, ..."""
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        "f AS (SELECT v, sha256('3:' || CAST(vec_id AS VARCHAR)) AS h FROM v ORDER BY h, v LIMIT 8)",
        "c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS c FROM f)",
    ]
    for i in range(ROUNDS + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT row, vec_id, v, min_by(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM (SELECT row, vec_id, v, cluster,
  CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance FROM v, c{i}) GROUP BY row, vec_id, v)"""
        )
        if i < ROUNDS:
            parts.append(
                f"""m{i} AS (SELECT cluster, list(m ORDER BY d) AS c FROM (SELECT cluster, d, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
  FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS d FROM a{i}) GROUP BY cluster, d) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m ON m.cluster = o.cluster)"""
            )
    last = ROUNDS
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{last} a JOIN c{last} c ON c.cluster = a.cluster"""
    )


ORACLE_SQL = {"op12_curve_clusters": _sql()}

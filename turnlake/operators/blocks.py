"""Two sides that all meet under a key, in groups of bounded size: only what a group keeps leaves its task."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scored_in_blocks(left: DataFrame, right: DataFrame, ids: tuple[str, str], prepare: Callable[[pa.Table], Callable[[pa.Table], pa.Table]], schema: str, key: str | None = None, tile: tuple[int, int] = (512, 8192), most: tuple[int, int] = (65536, 65536), indexed: bool = False) -> DataFrame:
    """``prepare(y)(x)`` for tiles ``x`` of ``left`` and ``y`` of ``right`` that together are all pairs, of one ``key`` where there is one.

    Blocks of up to ``most`` rows are dealt by a hash of the side's id and counted from the rows of the key, so a key with a third of
    all rows has as many more. A row is copied once for each block of the other side. A task holds a block of ``left`` and reads the
    block of ``right`` tile by tile, so blocks may be large, copies are few and memory is bounded. Null keys, and keys that one
    side lacks, meet nothing. Where ``prepare`` makes an index (``indexed``), a block of ``right`` is one tile, and where there
    would be fewer blocks than tasks both sides are divided, so an index is as large as may be.
    """
    spark = left.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total, least = right.count(), 1024
    if indexed:
        # the hash of an id deals a few rows more than ``most`` to some blocks
        asked, few, tile = left.count(), 4 * spark.sparkContext.defaultParallelism, (tile[0], 2 * most[1])
        indexes = max(32768, min(most[1], math.ceil(total / math.sqrt(few))))
        most = max(4096, min(most[0], math.ceil(asked * (1 if key else math.ceil(total / indexes)) / few))), indexes
        tasks = 2 * few
    # blocks of the right side are smaller where there would be fewer than tasks
    if key is None:
        n = max(1, math.ceil((asked if indexed else left.count()) / most[0]))
        m = max(math.ceil(total / most[1]), 0 if indexed else min(math.ceil(tasks / n), math.ceil(total / least)), 1)
        counts = lambda df: df.withColumns({"lbs": F.lit(n), "rbs": F.lit(m)})
    else:
        blocks = lambda df, size, name: df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
        both = blocks(left, most[0], "lbs").join(blocks(right, most[1] if indexed else max(least, min(most[1], total // tasks)), "rbs"), key)
        counts = lambda df: df.join(both, key)
    own = lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    by = [*([key] if key else []), "lb", "rb"]
    names = [[c for c in df.columns if c != key] for df in (left, right)]
    whole = lambda df, side, mark: df.select(*by, F.lit(side).alias("side"), *(F.col(c).alias(f"{mark}_{c}") for c in names[side]))
    a = whole(counts(left).withColumn("lb", own(ids[0], "lbs")).withColumn("rb", every("rbs")), 0, "l")
    b = whole(counts(right).withColumn("rb", own(ids[1], "rbs")).withColumn("lb", every("lbs")), 1, "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, x, y = None, [], []

        def scored() -> Iterator[pa.RecordBatch]:
            if x and y:
                x[:] = [pa.concat_tables(x).combine_chunks()]
                whole = pa.concat_tables(y).combine_chunks()
                y.clear()
                score = prepare(whole)
                del whole
                for begin in range(0, x[0].num_rows, tile[0]):
                    yield from score(x[0].slice(begin, tile[0])).to_batches()
            y.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*by, "side")]
            cuts = np.flatnonzero(np.logical_or.reduce([m[1:] != m[:-1] for m in marks])) + 1
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if (now := tuple(m[begin] for m in marks[:-1])) != group:
                    yield from scored()
                    x.clear()
                    group = now
                side = int(marks[-1][begin])
                rows = pa.table([batch.column(f"{'lr'[side]}_{c}").slice(begin, end - begin) for c in names[side]], names[side])
                if not side:
                    x.append(rows)
                    continue
                while rows.num_rows:
                    some = rows.slice(0, tile[1] - sum(t.num_rows for t in y))
                    y.append(some)
                    rows = rows.slice(some.num_rows)
                    if sum(t.num_rows for t in y) == tile[1]:
                        yield from scored()
        yield from scored()

    dealt = a.unionByName(b, allowMissingColumns=True).repartition(tasks, *by).sortWithinPartitions(*by, "side", f"l_{ids[0]}")
    return dealt.mapInArrow(run, schema)


def every_pair(rows: DataFrame, others: DataFrame, by: str, key: str | None = None, at_once: int = 1024, tasks: int | None = None, long: bool = False) -> DataFrame:
    """Each row of ``rows`` with each of ``others``, of one ``key`` where there is one.

    ``others`` are dealt by a hash of ``by`` to parts of about ``at_once`` rows; ``rows`` are copied once for each part. A merge join gives
    one row with all others of a part, then the next, so pairs are neither shuffled nor sorted, and files of them hold runs of the
    one side and repeats of the other. Parts are dealt to ``tasks``, four for each core if not said. A merge join makes all pairs of a
    row of its left side before the first is taken: where ``rows`` are ``long`` and few, those of each of ``others`` in turn instead.
    """
    n = tasks or 4 * rows.sparkSession.sparkContext.defaultParallelism
    if key is None:
        parts = max(1, math.ceil(others.count() / at_once))
        counted = lambda df: df.withColumn("parts", F.lit(parts))
    else:
        counts = others.filter(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count("*") / at_once).cast("int").alias("parts"))
        counted = lambda df: df.join(counts, key)
    on = [*([key] if key else []), "part"]
    a = counted(rows).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").repartition(n, *on)
    b = counted(others).withColumn("part", F.pmod(F.xxhash64(by), F.col("parts")).cast("int")).drop("parts").repartition(n, *on)
    return (b.join(a.hint("merge"), on) if long else a.join(b.hint("merge"), on)).drop("part")


KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(x.split()[0], KINDS[x.split()[1]]) for x in ddl.split(", ")])


def made(schema: str, *columns) -> pa.Table:
    """A table of ``schema`` from its columns."""
    fields = _schema(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Length of each list (0 for null) and all their values."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(pc.list_value_length(whole), 0).to_numpy(zero_copy_only=False).astype(np.int64), whole.flatten()


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in it) of the values of lists of these lengths."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows in double precision; missing components are 0."""
    sizes, values = _flat(column)
    out = np.zeros((len(sizes), width))
    out[_places(sizes)] = pc.fill_null(values.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    return out


def lengths(column: pa.ChunkedArray) -> np.ndarray:
    return _flat(column)[0]


def widest(*columns: pa.ChunkedArray) -> int:
    return max((int(lengths(c).max(initial=0)) for c in columns), default=0)


class Vectors:
    """Vectors to take cosines with; null ones count as empty."""

    def __init__(self, column: pa.ChunkedArray):
        self.there = column.combine_chunks().is_valid().to_numpy(zero_copy_only=False) if isinstance(column, pa.ChunkedArray) else column.is_valid().to_numpy(zero_copy_only=False)
        self.lengths = lengths(column)
        self.matrix = matrix(column, int(self.lengths.max(initial=0)))
        self.size = np.linalg.norm(self.matrix, axis=1)

    def cosines(self, column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Cosine of every vector of ``column`` with every one of these, 0 for empty, zero or unequally long ones; and where neither is null."""
        x = Vectors(column)
        width = min(x.matrix.shape[1], self.matrix.shape[1])
        size = x.size[:, None] * self.size[None]
        alike = (size > 0) & (x.lengths[:, None] == self.lengths[None])
        return np.divide(x.matrix[:, :width] @ self.matrix[:, :width].T, size, out=np.zeros_like(size), where=alike), x.there[:, None] & self.there[None]


def best_in_rows(scores: np.ndarray, k: int, margin: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest of each row, and of all within ``margin`` of the last of them."""
    if scores.shape[1] <= k:
        return tuple(x.ravel() for x in np.indices(scores.shape))
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] - margin
    return np.nonzero(scores >= least[:, None])

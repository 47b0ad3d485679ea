"""Stored tables that keyed changes are merged into: files in partitions by a hash of the key, of which a merge replaces those it touches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch
from .tables import replace_partitions

#: What a merge makes of the stored rows of the touched partitions and the changes.
Combine = Callable[[DataFrame, DataFrame], DataFrame]
BUCKET = "key_bucket"


@dataclass(frozen=True)
class KeyedTable:
    """A table at ``path`` with the columns of ``schema``, in ``buckets`` partitions by its ``keys``.

    A merge reads and writes the partitions that hold keys of its changes and leaves the files of all others as they are. The new
    rows are written apart first, then take the place of the old ones partition by partition, so a merge that failed, or one
    that is delivered twice, is run again: ``combine`` functions by key give the same rows each time. One merge runs at a time.
    """

    path: str
    schema: T.StructType
    keys: Sequence[str]
    buckets: int = 64

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _stored(self, spark: SparkSession) -> DataFrame | None:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return None
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        return spark.read.schema(schema).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows; none before the first merge."""
        found = self._stored(spark)
        return spark.createDataFrame([], self.schema) if found is None else found.drop(BUCKET)

    def merge(self, changes: DataFrame, combine: Combine) -> list[int]:
        """Merge ``changes``, which have the keys and whatever else ``combine`` needs; the numbers of the partitions replaced, ``buckets`` at most."""
        spark = changes.sparkSession
        changes = self._bucketed(changes)
        touched = sorted(r[0] for r in changes.select(BUCKET).distinct().collect())
        if not touched:
            return []
        stored = self._stored(spark)
        old = spark.createDataFrame([], self.schema) if stored is None else stored.filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
        aside = scratch(spark, "merge")
        self._bucketed(combine(old, changes.drop(BUCKET)).select(*self.schema.names)).repartition(BUCKET).write.parquet(aside)
        made = spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(aside)
        replace_partitions(made, self.path, BUCKET)
        self._remove(spark, set(touched) - {r[0] for r in made.select(BUCKET).distinct().collect()})
        return touched

    def _remove(self, spark: SparkSession, buckets: set[int]) -> None:
        """Partitions of which no row is left."""
        for bucket in buckets:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={bucket}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def upsert_rows(keys: Sequence[str], order: Sequence[str]) -> Combine:
    """The last row of each key by ``order``."""
    from ..operators.upsert import upsert_last

    return lambda old, new: upsert_last(old.unionByName(new.select(*old.columns)), keys, order)


def coalesce_rows(key: str, keep_if_empty: Sequence[str] = (), keep_first: Sequence[str] = ()) -> Combine:
    from ..operators.upsert import upsert_coalesce

    return lambda old, new: upsert_coalesce(old, new, key, keep_if_empty, keep_first)


def insert_rows(key: str) -> Combine:
    from ..operators.upsert import insert_if_absent

    return lambda old, new: insert_if_absent(old, new, key)


def replace_rows(key: str, order: Sequence[str]) -> Combine:
    from ..operators.upsert import insert_or_replace

    return lambda old, new: insert_or_replace(old, new, key, order)


def patch_rows(now: int) -> Combine:
    from ..operators.upsert import profile_patch

    return lambda old, new: profile_patch(old, new, now)


def replace_groups(*keys: str) -> Combine:
    """All rows of a key that the changes have are theirs, as the chunks of a document that is imported again."""
    return lambda old, new: old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new.select(*old.columns))


def delete_groups(*keys: str) -> Combine:
    return lambda old, new: old.join(new.select(*keys).distinct(), list(keys), "left_anti")

"""Shared scratch space: the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests, a single machine) is a temporary
    folder taken.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(context, "_turnlake_folder", None)
        if folder is None:
            folder = context._turnlake_folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and no lineage to replay when executors are lost."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and about 4 MB: texts and sets of shingles can be long. These stay set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def marked_likely(df: DataFrame, column: str, keys: DataFrame, key: str, least_bits: int = 1 << 20, most_bits: int = 1 << 27) -> DataFrame:
    """``df`` with ``likely``: true where the long ``column`` is among the values ``key`` of ``keys``, false for most others and for null.

    One bit stands for each slot of a value's hash, 16 slots for each key and never more than ``most_bits``: 16 MB, which is
    the proven bound of what is broadcast, as rows of 4 KB. It only spares rows a shuffle; an exact join has to follow.
    With more keys than that many bits can tell apart, about 10**8, most rows are likely and all of them take that join.
    """
    bits, count = least_bits, keys.count()
    while bits < min(16 * count, most_bits):
        bits *= 2
    slot = lambda c: F.pmod(F.col(c), F.lit(bits)) + 1  # noqa: E731  bucket n holds slots 32768 * (n - 1) + 1 and on
    maps = keys.select(slot(key).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("likely_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("likely_bits"))
    maps = stored(maps, "bitmap")
    at = F.bitmap_bit_position(slot(column))
    byte = F.conv(F.hex(F.substring("likely_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    likely = F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    joined = df.join(F.broadcast(maps), F.bitmap_bucket_number(slot(column)) == F.col("likely_bucket"), "left")
    return joined.withColumn("likely", likely).drop("likely_bucket", "likely_bits")


#: What modules keep between the tasks of a Python worker: name to a function that lets go of it.
KEPT: dict[str, Callable[[], None]] = {}


def in_turn(owner: str, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``f`` for mapInArrow, such that a worker that Spark uses again holds what ``owner`` keeps and nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, let_go in KEPT.items():
            if name != owner:
                let_go()
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return run

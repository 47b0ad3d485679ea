"""Session settings that the operators rely on, and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Set on every session the operators run in; all may be set while it runs.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: For Parquet files of scores rounded to 6 places: a dictionary of 16 MB holds all of -1 to 1, so a row takes the some 20 bits of its place
#: in it; the usual 1 MB holds 131,072 values. Pages are large enough that the first shows that values come again.
SCORES_CONF = {
    "parquet.dictionary.page.size": str(16 << 20),
    "parquet.page.size": str(4 << 20),
    "parquet.page.row.count.limit": "4000000",
}

#: For Parquet files of few long texts that many rows repeat: each is held once, up to 64 MB of them in a file; the usual 1 MB does not hold one of that length.
LISTS_DICTIONARY = 64 << 20


def conform(spark: SparkSession) -> SparkSession:
    """Pin the settings that results depend on (UTC days) and that plans need (AQE)."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def keep_scores_small(spark: SparkSession) -> None:
    """Have Parquet files that this session writes from now on hold rounded scores by dictionary; settings that it has already stay."""
    for key, value in SCORES_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def keep_lists_once(spark: SparkSession) -> None:
    """Have Parquet files that this session writes from now on hold a long repeated text once; a setting that it has already stays, but for that of ``keep_scores_small``."""
    if spark.conf.get(key := "parquet.dictionary.page.size", None) in (None, SCORES_CONF[key]):
        spark.conf.set(key, str(LISTS_DICTIONARY))


def keep_plain(spark: SparkSession, column: str) -> None:
    """Have Parquet files that this session writes from now on hold a column of this name without a dictionary; a setting that it has already stays."""
    if spark.conf.get(key := f"parquet.enable.dictionary#{column}", None) is None:
        spark.conf.set(key, "false")


def local_session(app: str = "turnlake", cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    options = RUNTIME_CONF | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": memory,
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in options.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be any that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A path that nothing has used in the folder that driver and executors share, which ``spark.checkpoint.dir`` names; a local one only on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"

"""Schema conformance, JSON columns, vector codecs, append-only writes and document readers."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: missing ones are added, with their default or null, others dropped."""
    defaults = defaults or {}
    column = lambda f: F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
    return df.select(*((F.coalesce(column(f), F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else column(f)).alias(f.name) for f in schema.fields))


def parse_json(c: Column, schema: str, empty: Column | None = None) -> Column:
    """A JSON text by a schema; null, blank or broken text is ``empty``."""
    parsed = F.from_json(c, schema)
    return F.coalesce(parsed, empty) if empty is not None else parsed


def json_vector(c: Column) -> Column:
    """A JSON array of numbers as floats; null if it is not one, empty, or holds anything else."""
    v = F.from_json(c, "array<float>")
    return F.when((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull()), v)


def encode_vec(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``out``: the vector as little-endian 32-bit floats."""
    return _coded(df, column, out, "binary", lambda v: None if v is None else _floats(v).tobytes())


def decode_vec(df: DataFrame, column: str, out: str, dim: int | None = None) -> DataFrame:
    """Adds ``out``: the floats of a binary; with ``dim`` an array of vectors of that length, null if the bytes do not divide."""

    def whole(b: bytes | None):
        return None if b is None or len(b) % 4 else _array(b).tolist()

    def windows(b: bytes | None):
        return None if b is None or len(b) % (4 * dim) else _array(b).reshape(-1, dim).tolist()

    return _coded(df, column, out, "array<float>" if dim is None else "array<array<float>>", whole if dim is None else windows)


def _floats(v):
    import numpy as np

    return np.asarray(v, "<f4")


def _array(b: bytes):
    import numpy as np

    return np.frombuffer(b, "<f4")


def _coded(df: DataFrame, column: str, out: str, kind: str, f) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(kind))])
    arrow = {"binary": pa.binary(), "array<float>": pa.list_(pa.float32()), "array<array<float>>": pa.list_(pa.list_(pa.float32()))}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f(x) for x in batch.column(column).to_pylist()], arrow)], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def append_events(df: DataFrame, path: str) -> None:
    """Append rows to an append-only table."""
    df.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Write ``df`` in place of the partitions of the table at ``path`` that its rows belong to; all others keep their files."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_files(files: DataFrame, folder: str) -> int:
    """Write each row (name, content) as a file of its own below ``folder``, from the tasks; the number of files. A name may begin with folders."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        made = path
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if (inner := f"{path}/{name}".rpartition("/")[0]) != made:
                    store.create_dir(made := inner, recursive=True)
                with store.open_output_stream(f"{path}/{name}", compression=None) as file:
                    file.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = files.select("name", F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(path, content) of every file below ``folder`` whose name ends in ``suffix``, without those that Spark's readers leave out (hidden, empty).

    Tasks list the folders and read the files, so the driver holds no list of them and small files share a task; a task holds the names
    of one folder. What is not the plain path of a local or HDFS folder that the driver can open (other stores, patterns) is listed by
    Spark's reader on the driver.
    """
    from pyarrow import fs

    store, local = None, (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:").startswith("file:")
    if re.fullmatch(r"(file:(//)?|hdfs://[\w.:-]+)/[\w.~/@-]*" + (r"|/[\w.~/@-]*" if local else ""), folder, re.ASCII):
        with contextlib.suppress(OSError, ValueError):
            store, top = fs.FileSystem.from_uri(folder)
    if store is None or store.get_file_info(top).type != fs.FileType.Directory:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "content")
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    begin = "/".join(folder.split("/")[:3]) if folder.startswith("hdfs:") else "file:"

    def entries(deep: bool):
        """What a folder holds, or all below it, one folder at a time."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            store, _ = fs.FileSystem.from_uri(folder)
            shown = lambda name: not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))
            for batch in batches:
                paths, files = batch.column("path").to_pylist(), batch.column("file").to_pylist()
                done, left = [x for x, file in zip(paths, files, strict=True) if file], [x for x, file in zip(paths, files, strict=True) if not file]
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()), pa.array([True] * len(done), pa.bool_())], ["path", "file"])
                while left:
                    inside = [x for x in store.get_file_info(fs.FileSelector(left.pop())) if shown(x.base_name)]
                    inner = [x.path for x in inside if x.type == fs.FileType.Directory]
                    found = [x.path for x in inside if x.type == fs.FileType.File and x.size and x.base_name.endswith(suffix)]
                    if deep:
                        left += inner
                        inner = []
                    yield pa.RecordBatch.from_arrays([pa.array(found + inner, pa.string()), pa.array([True] * len(found) + [False] * len(inner), pa.bool_())], ["path", "file"])

        return run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array([f"{begin}{p}" for p, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.binary())], ["path", "content"])
        rows, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_file(path) as file:
                    rows.append((path, file.read()))
                size += len(rows[-1][1]) + 64
                if size > 4 << 20:
                    yield out(rows)
                    rows, size = [], 0
        yield out(rows)

    schema = "path string, file boolean"
    first = spark.range(0, 1, 1, 1).select(F.lit(top).alias("path"), F.lit(False).alias("file")).mapInArrow(entries(False), schema)
    found = first.repartition(tasks, "path").mapInArrow(entries(True), schema)
    return found.select("path").repartition(tasks, "path").mapInArrow(read, "path string, content binary")


def slug(name: Column) -> Column:
    """Letters, digits and underscores, all else dashes, 80 characters at most; of a name without any, a hash."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), r"(?U)[^\w]+", "-"), "^-+|-+$", ""), 1, 80)
    return F.when(s != "", s).otherwise(F.substring(F.sha1(name.cast("binary")), 1, 16))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc_id, sha256, text, front): every ``*.md`` below a folder; ``front`` are its front matter's pairs."""
    files = read_files(spark, path, ".md")
    text = F.decode("content", "UTF-8")
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    pairs = F.filter(F.transform(F.split(head, "\n"), lambda line: F.split(line, r":\s*", 2)), lambda p: F.size(p) == 2)
    front = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(p[0]).alias("k"), F.trim(p[1]).alias("v"))))
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    return files.select("path", slug(stem).alias("doc_id"), F.sha2("content", 256).alias("sha256"), F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "").alias("text"), front.alias("front"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Calibration cases of JSON lines; blank lines and those that start with # are passed over."""
    schema = "question string, expect array<string>, expect_pages array<array<int>>, note string"
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return lines.select(F.from_json("value", schema).alias("c")).select("c.*").filter("question is not null")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Cleaning profiles of a JSON file, with defaults for what is missing, in file order."""
    schema = "doc string, path_glob string, keep_sections array<string>, drop_sections array<string>, min_chars int, max_chars int, min_heading_level int, default_kind string"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    none = F.array().cast("array<string>")
    return raw.select("doc", "path_glob", F.coalesce("keep_sections", none).alias("keep_sections"), F.coalesce("drop_sections", none).alias("drop_sections"), F.coalesce("min_chars", F.lit(40)).alias("min_chars"), F.coalesce("max_chars", F.lit(600)).alias("max_chars"), F.coalesce("min_heading_level", F.lit(1)).alias("min_heading_level"), F.coalesce("default_kind", F.lit("reference")).alias("default_kind"))

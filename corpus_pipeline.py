"""A training corpus from ``documents``: toxic, near-duplicate, repeated and leaked text goes, the rest is tokenised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.bpe_lexicon import compile_lexicon, decode_documents, default_tokenizer, encode_documents
from turnlake.llm.partition_join import jaccard_components
from turnlake.llm.quality_rules import hash_fold
from turnlake.llm.simhash_windows import contaminated
from turnlake.llm.storage import fresh_path, marked_likely, read_table, small_batches, stored
from turnlake.llm.suffix_buckets import remove_repeated
from turnlake.llm.toxicity_kernel import score_toxicity


def whole() -> Column:
    """A document as it came, whatever its columns are named, while a stage adds columns of its own."""
    return F.struct("*").alias("whole_row")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the kernel machine predicts to be toxic go; it learns from the labels of the training fold."""
    small_batches(spark)
    rows = docs.select("doc_id", "text", whole())
    scored = score_toxicity(rows, read_table(spark, sf_dir, "labels"), hash_fold(4, 2), keep=("whole_row",))
    return scored.filter("predicted = 0").select("whole_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays, of repeated rows one; documents without words stay.

    Rows without doc_id go if their group has a row with one. Only texts that may go are shuffled.
    """
    small_batches(spark)
    found = jaccard_components(docs.select("doc_id", "text")).filter("n_shingles > 0").withColumn("goes", F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
    groups = found.groupBy("doc_id", "fingerprint").agg(F.max("goes").alias("goes"), F.count("*").alias("n"))
    odd = stored(groups.filter("goes or (n > 1 and doc_id is not null)").select(F.col("doc_id").alias("odd_id"), F.col("fingerprint").alias("odd_print"), "goes"), "odd-documents")
    keyed = marked_likely(docs.select("doc_id", F.xxhash64("text").alias("odd_print"), whole()), "odd_print", odd, "odd_print")
    same = keyed.filter("likely").join(odd.withColumnRenamed("odd_print", "print"), F.col("odd_id").eqNullSafe(F.col("doc_id")) & (F.col("odd_print") == F.col("print")), "left")
    fine = same.filter("print is null").select("whole_row.*")
    one = same.filter("print is not null and not goes").dropDuplicates(["doc_id", "odd_print"]).select("whole_row.*")
    return keyed.filter("not likely").select("whole_row.*").unionByName(fine).unionByName(one)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte that a repeated 200-byte string covers goes, with what is left of a character that is cut; n_chars follows."""
    small_batches(spark)
    keyed, cut = remove_repeated(docs.select("doc_id", "text", whole()))
    cut = stored(cut.select(F.col("doc").alias("cut_doc"), F.col("fingerprint").alias("cut_print"), F.col("text").alias("cut_text")), "cut")
    keyed = marked_likely(keyed, "fingerprint", cut, "cut_print")
    joined = keyed.filter("likely").join(cut, (F.col("doc") == F.col("cut_doc")) & (F.col("fingerprint") == F.col("cut_print")), "left")
    kept = F.col("whole_row").withField("text", F.col("cut_text")).withField("n_chars", F.length("cut_text").cast(docs.schema["n_chars"].dataType))
    joined = joined.select(F.when(F.col("cut_doc").isNull(), F.col("whole_row")).otherwise(kept).alias("whole_row"))
    return keyed.filter("not likely").select("whole_row.*").unionByName(joined.select("whole_row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window similar to a benchmark item go."""
    small_batches(spark)
    keyed = docs.select(F.xxhash64("text").alias("leak_print"), "text", whole())
    found = contaminated(keyed.select(F.col("leak_print").alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    leaks = stored(found.select(F.col("doc_id").alias("leak_print")).distinct(), "leaks")
    keyed = marked_likely(keyed.drop("text"), "leak_print", leaks, "leak_print")
    kept = keyed.filter("likely").join(leaks, "leak_print", "left_anti")
    return keyed.filter("not likely").select("whole_row.*").unionByName(kept.select("whole_row.*"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit integers), their number and digest, and the digest of the decoded text."""
    small_batches(spark)
    tokenizer = default_tokenizer()
    decoded = decode_documents(encode_documents(docs, tokenizer, compile_lexicon(docs, tokenizer)), tokenizer)
    return decoded.select("doc_id", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written to the shared folder and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Training, components over near duplicates and tokenising are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None

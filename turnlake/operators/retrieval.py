"""Brute-force and hybrid retrieval over chunks, and the calibration gate."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import MAX_QUERIES, lexical_terms, split_queries, term_jaccard
from ..session import scratch
from .blocks import best_in_rows, made, matrix, scored_in_blocks, widest


def brute_force_topk(queries: DataFrame, chunks: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` largest inner products of each query vector with all chunks.

    The stated queries meet the chunks in blocks that are counted from the rows; a block is one matrix product, of which each
    query's best ``k`` leave it. Scores are rounded to 6 places; ties go to the smaller id. Missing components count as 0,
    rows without a vector take no part.
    """
    schema = "query_id long, chunk_id long, score double"

    def best(y: pa.Table):
        width, ids = widest(y["embedding"]), y["chunk_id"].to_numpy()
        rows = matrix(y["embedding"], width)

        def of(x: pa.Table) -> pa.Table:
            scores = matrix(x["embedding"], max(width, widest(x["embedding"])))[:, :width] @ rows.T
            row, column = best_in_rows(scores, k, 1e-6)  # all that may tie once rounded
            return made(schema, x["query_id"].to_numpy()[row], ids[column], scores[row, column])

        return of

    asked = queries.filter("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    rows = chunks.filter("embedding is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding")
    scored = scored_in_blocks(asked, rows, ("query_id", "chunk_id"), best, schema).withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def user_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, w): the inner product of each query vector with each chunk of its ``user_id``, to 6 places; ``w`` is the chunk's.

    Tiles meet as matrix products. Missing components and vectors count as 0.
    """
    schema = "query_id long, chunk_id long, score double, w double"

    def every(y: pa.Table):
        width, ids, best = widest(y["embedding"]), y["chunk_id"].to_numpy(), y["w"].combine_chunks()
        rows = matrix(y["embedding"], width)

        def of(x: pa.Table) -> pa.Table:
            scores = rows @ matrix(x["embedding"], max(width, widest(x["embedding"])))[:, :width].T
            row, column = (i.ravel() for i in np.indices(scores.shape))
            return made(schema, x["query_id"].to_numpy()[column], ids[row], np.round(scores, 6).ravel(), best.take(pa.array(row)))

        return of

    return scored_in_blocks(queries.select("query_id", "user_id", "embedding"), chunks.select("chunk_id", "user_id", "embedding", "w"), ("query_id", "chunk_id"), every, schema, "user_id", (256, 512))


def inverted_lexical(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of all pairs that share a term: Jaccard over bigrams and words, by an equi-join on terms.

    ``questions`` (query_id, question); ``chunks`` (chunk_id, text). Pairs without a common term score 0 and are not made.
    """
    q = questions.select("query_id", lexical_terms(F.coalesce("question", F.lit(""))).alias("terms")).withColumn("m", F.size("terms"))
    c = chunks.select("chunk_id", lexical_terms(F.coalesce("text", F.lit(""))).alias("terms")).withColumn("n", F.size("terms"))
    shared = q.select("query_id", "m", F.explode("terms").alias("term")).join(c.select("chunk_id", "n", F.explode("terms").alias("term")), "term")
    both = shared.groupBy("query_id", "chunk_id").agg(F.count("*").alias("both"), F.first("m").alias("m"), F.first("n").alias("n"))
    return both.select("query_id", "chunk_id", (F.col("both") / (F.col("m") + F.col("n") - F.col("both"))).alias("score"))


def rank(questions: DataFrame, chunks: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, chunk_id, score, rank): of all questions of a text the best score of each chunk, then the best ``k``."""
    parts = questions.select("query_id", F.posexplode(split_queries(F.col("question"))).alias("part", "sub")).select(
        F.concat_ws("#", "query_id", "part").alias("query_id"), F.col("sub").alias("question"), F.col("query_id").alias("whole")
    )
    scored = inverted_lexical(parts, chunks).join(parts.select("query_id", "whole"), "query_id")
    best = scored.groupBy("whole", "chunk_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("whole").orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("whole").alias("query_id"), "chunk_id", "score", "rank")


def rank_hybrid(questions: DataFrame, chunks: DataFrame, k: int = 20, pool: int = 20) -> DataFrame:
    """(query_id, chunk_id, score, rank): each question's ``pool`` nearest chunks by vector, scored anew by vector and words, the best ``k``.

    ``questions`` (query_id, question, embedding), ``chunks`` (chunk_id, text, embedding). With a column ``part`` (from 0, below
    MAX_QUERIES) a row is one question of a text, each with its own vector and pool; a chunk has the best score of any of them.
    Chunks without a vector are ranked by their words, as all are for a question without one (``rank``). Only pooled pairs get
    to see texts; an id below 2**59 keeps its parts apart.
    """
    from .memory import hybrid_score

    part = F.col("part") if "part" in questions.columns else F.lit(0)
    asked = questions.select((F.col("query_id").cast("long") * MAX_QUERIES + part).alias("query_id"), "question", F.col("embedding").alias("vector"))
    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "text", "embedding")
    near = brute_force_topk(asked.withColumnRenamed("vector", "embedding"), rows, pool).select("query_id", "chunk_id")
    text = F.coalesce("text", F.lit(""))
    scored = near.join(asked, "query_id").join(rows, "chunk_id").select("query_id", "chunk_id", hybrid_score(F.coalesce("question", F.lit("")), F.col("vector"), text, text, F.col("embedding")).alias("score"))
    plain = rank_all(asked.filter("vector is null").select("query_id", "question"), rows.select("chunk_id", "text"), k)
    bare = rank_all(asked.filter("vector is not null").select("query_id", "question"), rows.filter("embedding is null").select("chunk_id", "text"), k)
    each = scored.unionByName(plain.select("query_id", "chunk_id", "score")).unionByName(bare.select("query_id", "chunk_id", "score"))
    both = each.groupBy(F.floor(F.col("query_id") / MAX_QUERIES).alias("query_id"), "chunk_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def document_chunks(documents: DataFrame, max_chars: int = 600) -> DataFrame:
    """(doc_id, chunk_id, text): each text, whole, in chunks of at most ``max_chars`` characters that end before white space where they can.

    Chunks of a text, joined in order, are the text. ``chunk_id`` is doc_id * 2**23 + place; doc_id is below 2**40.
    """
    chunk = rf"(?s)(.{{1,{max_chars}}}(?!\S)|.{{1,{max_chars}}})"
    cut = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.regexp_extract_all("text", F.lit(chunk), 1)).alias("place", "text"))
    return cut.select("doc_id", (F.shiftleft("doc_id", 23) + F.col("place")).alias("chunk_id"), "text")


class _Asked:
    """Questions as a matrix, terms by parts; the parts of a question stand together."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["query_id"])
        ids = np.array([r["query_id"] for r in rows], np.int64)
        self.ids, self.starts = np.unique(ids, return_index=True)
        self.vocabulary = sorted({t for r in rows for t in r["terms"]})
        place = {t: i for i, t in enumerate(self.vocabulary)}
        self.size = np.array([len(r["terms"]) for r in rows], float)
        self.matrix = np.zeros((len(place), len(rows)), np.float32)
        for j, r in enumerate(rows):
            self.matrix[[place[t] for t in r["terms"]], j] = 1


def _best_chunks(shared, k: int, cells: int = 1 << 22):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        kept = {(b, q): (np.zeros(0, np.int64), np.zeros(0)) for b, block in enumerate(blocks) for q in range(len(block.ids))}
        least = [np.zeros(len(block.ids)) for block in blocks]
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            length = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            before, values = np.concatenate([[0], np.cumsum(length)]), batch.column(1).flatten()
            for b, block in enumerate(blocks):
                code = pc.fill_null(pc.index_in(values, value_set=pa.array(block.vocabulary, values.type)), -1).to_numpy(zero_copy_only=False)
                step = max(1, cells // len(block.vocabulary))
                for begin in range(0, len(ids), step):
                    n = length[begin : begin + step]
                    some = code[before[begin] : before[begin + len(n)]]
                    has = np.zeros((len(n), len(block.vocabulary)), np.float32)
                    has[np.repeat(np.arange(len(n)), n)[some >= 0], some[some >= 0]] = 1
                    both = (has @ block.matrix).astype(float)
                    score = np.maximum.reduceat(both / (block.size + n[:, None] - both), block.starts, axis=1)
                    enough = (score > 0) & (score >= least[b])
                    for q in np.flatnonzero(enough.any(0)):
                        new = np.flatnonzero(enough[:, q])
                        chunk, by = np.concatenate([kept[b, q][0], ids[begin + new]]), np.concatenate([kept[b, q][1], score[new, q]])
                        order = np.lexsort((chunk, -by))
                        chunk, by = chunk[order], by[order]
                        first = np.sort(np.unique(chunk, return_index=True)[1])[:k]
                        kept[b, q] = chunk[first], by[first]
                        if len(first) == k:
                            least[b][q] = by[first][-1]
        for b, block in enumerate(blocks):
            found = [kept[b, q] for q in range(len(block.ids))]
            query = np.repeat(block.ids, [len(f[0]) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["query_id", "chunk_id", "score"])

    return best


def rank_all(questions: DataFrame, chunks: DataFrame, k: int = 20, block: int = 256, at_once: int = 4096) -> DataFrame:
    """What ``rank`` gives, over chunks of any number: each task scores its chunks against all questions by matrix products and keeps the best ``k``.

    About ``at_once`` of the stated questions go to every task; more are asked in passes over the chunks, each written before the
    next, so what is at the driver and sent to tasks is bounded. Neither chunks, terms nor pairs are shuffled, only each task's
    best. No term is left out for being common. Ids are longs; rows without one are not ranked.
    """
    spark = chunks.sparkSession
    parts = questions.filter("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), F.explode(split_queries(F.col("question"))).alias("sub"))
    asked = parts.select("query_id", lexical_terms(F.col("sub")).alias("terms")).filter(F.size("terms") > 0)
    terms = chunks.filter("chunk_id is not null").select(F.col("chunk_id").cast("long"), lexical_terms(F.coalesce("text", F.lit(""))).alias("terms"))
    passes = max(1, math.ceil(asked.select("query_id").distinct().count() / at_once))
    if passes == 1:
        best = _best_of(asked.collect(), terms, k, block)
    else:
        folder = scratch(spark, "ranked")
        for n in range(passes):
            some = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == n).collect()
            _best_of(some, terms, k, block).write.parquet(f"{folder}/{n}")
        best = spark.read.schema(BEST).parquet(*(f"{folder}/{n}" for n in range(passes)))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


BEST = "query_id long, chunk_id long, score double"


def _best_of(rows: list, terms: DataFrame, k: int, block: int) -> DataFrame:
    """Each task's best chunks of some questions (rows of query_id, terms), a chunk once."""
    spark, ids = terms.sparkSession, sorted({r["query_id"] for r in rows})
    if not ids:
        return spark.createDataFrame([], BEST)
    which = {q: i // block for i, q in enumerate(ids)}
    blocks = [_Asked([r for r in rows if which[r["query_id"]] == n]) for n in range(which[ids[-1]] + 1)]
    return terms.mapInArrow(_best_chunks(spark.sparkContext.broadcast(blocks), k), BEST).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def judge_cases(cases: DataFrame, expected: DataFrame, ranked: DataFrame, served: DataFrame, reranked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows for ``calibration_gate``: one for each case, and one for each case and document that it expects.

    ``cases`` (query_id); ``expected`` (query_id, doc_id), where a case without rows is a negative; ``ranked`` (query_id, chunk_id,
    score) and ``served`` (query_id, chunk_id, doc_id, score, and place where there is a second stage). A hit is the first served chunk
    of an expected document and has its score; any other case scores as its best chunk, 0 without one. ``reranked`` (as ``rerank`` gives
    it) adds ``rerank``: a hit's own second score, a negative's best.
    """
    top = ranked.groupBy("query_id").agg(F.max("score").alias("top"))
    pairs = expected.select("query_id", "doc_id").distinct()
    place = F.col("place") if "place" in served.columns else F.struct((-F.col("score")).alias("by"), "chunk_id")
    first = F.min(F.struct(place.alias("place"), F.col("score").alias("hit_score"), F.col("chunk_id").alias("hit")))
    found = pairs.join(served, ["query_id", "doc_id"])
    whole = found.groupBy("query_id").agg(first.alias("f")).select("query_id", "f.hit_score", "f.hit")
    each = pairs.join(found.groupBy("query_id", "doc_id").agg(first.alias("f")).select("query_id", "doc_id", "f.hit_score", "f.hit"), ["query_id", "doc_id"], "left").withColumn("wanted", F.lit(False))
    whole = cases.select("query_id").distinct().join(pairs.select("query_id", F.lit(False).alias("wanted")).distinct(), "query_id", "left").join(whole, "query_id", "left")
    rows = [F.coalesce("wanted", F.lit(True)).alias("is_negative"), F.col("hit_score").isNotNull().alias("hit"), F.coalesce("hit_score", "top", F.lit(0.0)).alias("score")]
    if reranked is not None:
        scored = reranked.filter("rerank is not null")
        own, most = scored.select("query_id", F.col("chunk_id").alias("hit"), "rerank"), scored.groupBy("query_id").agg(F.max("rerank").alias("most"))
        whole, each = (df.join(own, ["query_id", "hit"], "left").join(most, "query_id", "left") for df in (whole, each))
        rows.append(F.when(F.coalesce("wanted", F.lit(True)), F.col("most")).otherwise(F.col("rerank")).alias("rerank"))
    return whole.join(top, "query_id", "left").select("query_id", *rows), each.join(top, "query_id", "left").select("query_id", "doc_id", *rows)


def weak_candidates(ranked: DataFrame, questions: DataFrame, texts: DataFrame, rerank_below: float = 0.70) -> DataFrame:
    """(query_id, rank, question, chunk_id, text): the pools that a second stage reads, those of queries whose best score is below ``rerank_below``."""
    weak = ranked.groupBy("query_id").agg(F.max("score").alias("top")).filter(F.col("top") < rerank_below).select("query_id")
    pool = ranked.join(weak, "query_id", "left_semi").join(questions.select("query_id", "question"), "query_id")
    return pool.join(texts.select("chunk_id", "text"), "chunk_id").select("query_id", "rank", "question", "chunk_id", "text")


def retrieve(ranked: DataFrame, floor: float = 0.623, n: int = 4, reranked: DataFrame | None = None, rerank_below: float = 0.70, rerank_floor: float = -5.0, sanity: float = 0.45, keep: int = 5) -> DataFrame:
    """(query_id, chunk_id, score, stage, place): the first ``n`` rows of each query that pass.

    A row passes by its score and its own ``floor`` (a column, where there is one and it is not null) or else the given one. Where the
    best score of a query is below ``rerank_below`` and ``reranked`` (as ``rerank`` gives it) has a decision, that alone counts: of its
    first ``keep``, scored ones pass by ``rerank_floor``, picked ones by ``sanity`` of the score, in its order; none passes
    nothing. A query whose second stage failed stays with the first.
    """
    own = F.coalesce("floor", F.lit(floor)) if "floor" in ranked.columns else F.lit(floor)
    kept = ranked.filter(F.col("score") >= own).select("query_id", "chunk_id", "score", F.lit(1).alias("stage"), (-F.col("score")).alias("by"))
    if reranked is not None:
        weak = ranked.groupBy("query_id").agg(F.max("score").alias("top")).filter(F.col("top") < rerank_below).select("query_id")
        decided = reranked.filter("status <> 'failed'").join(weak, "query_id", "left_semi")
        again = decided.filter(F.col("place") <= keep).join(ranked.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"])
        again = again.filter(F.when(F.col("status") == "scored", F.col("rerank") >= rerank_floor).otherwise(F.col("score") >= sanity))
        kept = kept.join(decided.select("query_id"), "query_id", "left_anti").unionByName(again.select("query_id", "chunk_id", "score", F.lit(2).alias("stage"), F.col("place").cast("double").alias("by")))
    w = Window.partitionBy("query_id").orderBy("by", "chunk_id")
    return kept.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("query_id", "chunk_id", "score", "stage", "place")


def max_window_score(chunk_scores: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Scores raised to the best of the chunk's windows: ``windows`` (query_id, chunk_id, window_score); without them, ``chunk_scores`` has that best as ``w``."""
    if windows is not None:
        chunk_scores = chunk_scores.join(best_windows(windows), ["query_id", "chunk_id"], "left")
    return chunk_scores.withColumn("score", F.greatest("score", F.coalesce("w", F.lit(0.0)))).drop("w")


def best_windows(windows: DataFrame) -> DataFrame:
    """(query_id and chunk_id, where there are such columns, w): the best ``window_score`` of each."""
    return windows.groupBy(*(c for c in ("query_id", "chunk_id") if c in windows.columns)).agg(F.max("window_score").alias("w"))


def calibration_gate(cases: DataFrame, by: str | None = None, least_rate: float = 0.80) -> DataFrame:
    """Per group, or in all: cases, hits, rate, lowest_hit, highest_negative, overlap, margin, suggested_floor, stage, passed.

    ``cases``: query_id, is_negative, hit, score (the best of the query) and, where a second stage ran, rerank. If there are hits and
    negatives with a second score, its bands are the ones that are tested (stage 2), as it is what admits; lowest_hit and
    highest_negative are of the tested bands. Overlap is false where either band is empty or 0.
    """
    hit, negative = F.expr("hit AND NOT is_negative"), F.col("is_negative")
    second = F.col("rerank") if "rerank" in cases.columns else F.lit(None).cast("double")
    grouped = cases.groupBy(by) if by else cases.groupBy()
    out = grouped.agg(
        F.count_if(~negative).alias("cases"), F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("score"))).alias("low1"), F.max(F.when(negative, F.col("score"))).alias("high1"),
        F.min(F.when(hit, second)).alias("low2"), F.max(F.when(negative, second)).alias("high2"),
    )
    again = F.col("low2").isNotNull() & F.col("high2").isNotNull()
    out = out.withColumns({"stage": F.when(again, 2).otherwise(1), "lowest_hit": F.when(again, F.col("low2")).otherwise(F.col("low1")), "highest_negative": F.when(again, F.col("high2")).otherwise(F.col("high1"))}).drop("low1", "high1", "low2", "high2")
    both = (F.coalesce("lowest_hit", F.lit(0.0)) != 0) & (F.coalesce("highest_negative", F.lit(0.0)) != 0)
    out = out.withColumn("rate", F.when(F.col("cases") > 0, F.col("hits") / F.col("cases")).otherwise(0.0))
    out = out.withColumn("overlap", F.when(both, F.col("highest_negative") >= F.col("lowest_hit")).otherwise(F.lit(False)))
    out = out.withColumns({"margin": F.when(both, F.col("lowest_hit") - F.col("highest_negative")), "suggested_floor": F.when(both, (F.col("lowest_hit") + F.col("highest_negative")) / 2)})
    return out.withColumn("passed", (F.col("rate") >= least_rate) & ~F.col("overlap"))


def export_matrix(chunks: DataFrame, path: str) -> None:
    """Write (chunk_id, embedding), sorted by document and place, for a scorer of its own."""
    chunks.filter("embedding is not null").repartitionByRange("doc_id", "ord").sortWithinPartitions("doc_id", "ord").select("chunk_id", "embedding").write.mode("overwrite").parquet(path)

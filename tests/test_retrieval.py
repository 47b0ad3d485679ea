"""Retrieval over whole documents against every question and every chunk in plain Python."""

import random
import re

from pyspark.sql import functions as F

from turnlake.operators import retrieval as R
from turnlake.plans.registry import QUERIES


def terms(text):
    compact = re.sub(r"[\s\W_]+", "", text.lower())
    pairs = {compact[i : i + 2] for i in range(len(compact) - 1)} if len(compact) > 1 else set(compact)
    return pairs | set(re.findall(r"\w+", text.lower()))


def brute(questions, chunks, k):
    out = []
    for query, question in questions:
        parts = [terms(p) for p in re.split("[?!.,;]", question.replace(".", " ")) if p.strip()]
        best = {}
        for chunk, text in chunks:
            b = terms(text)
            score = max((len(a & b) / len(a | b) for a in parts if a | b), default=0)
            if score > 0:
                best[chunk] = max(score, best.get(chunk, 0))
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(query, chunk, round(score, 9), i + 1) for i, (chunk, score) in enumerate(ranked)]
    return sorted(out)


def data():
    rng = random.Random(5)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + rng.choice(["", "s", "ing", "_x"])
    text = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, text(rng.choice((3, 40, 400)))) for i in range(30)]
    passage = "where the copper kettle stands, a quiet robin sings"
    docs += [(30, text(900) + " " + passage + " " + text(300)), (31, "y" * 1500), (32, ""), (33, None), *docs[:4], *((40 + i, docs[1][1]) for i in range(9))]
    return docs, [(1, passage), (2, docs[7][1][:60]), (3, text(6) + ", " + text(5)), (4, ",;"), (5, "qqq"), (6, "a")]


def test_all_chunks_of_whole_documents_are_ranked(spark):
    docs, questions = data()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    chunks = R.document_chunks(d, 200)
    rows = [tuple(r) for r in chunks.select("chunk_id", "text").collect()]
    assert max(len(t) for _, t in rows) <= 200
    for doc, text in docs[:32]:
        assert "".join(t for _, t in sorted({r for r in rows if r[0] >> 23 == doc})) == text
    q = spark.createDataFrame(questions, "query_id long, question string")
    for block, at_once in ((2, 4096), (256, 4096), (256, 2)):
        got = sorted((r.query_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in R.rank_all(q, chunks, 5, block, at_once).collect())
        assert got == brute(questions, rows, 5)
    assert next(c >> 23 for n, c, _, place in got if n == 1 and place == 1) == 30
    assert R.rank_all(q.limit(0), chunks).count() == 0 and R.rank_all(q, chunks.limit(0)).count() == 0


def test_negatives_are_cases_that_no_document_holds(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    expected = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "query_id long, doc_id long")
    ranked = spark.createDataFrame([(1, 5, 11, 0.6), (1, 6, 12, 0.9), (2, 7, 12, 0.5), (3, 5, 11, 0.3)], "query_id long, chunk_id long, doc_id long, score double")
    whole, each = R.judge_cases(cases, expected, ranked, ranked)
    assert sorted(map(tuple, whole.collect())) == [(1, False, True, 0.6), (2, False, False, 0.5), (3, True, False, 0.3), (4, True, False, 0.0)]
    assert sorted(map(tuple, each.collect())) == [(1, 10, False, False, 0.9), (1, 11, False, True, 0.6), (2, 10, False, False, 0.5)]


def test_queries_over_documents(spark):
    sf = "/root/testdata/sf0.001"
    ranked = QUERIES["r05_rank_documents"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert ranked.select(F.shiftright("chunk_id", 23)).distinct().subtract(docs.select("doc_id")).count() == 0 and ranked.count() == 20 * 40
    gate = {r.doc_id: r for r in QUERIES["a13_calibration_documents"](spark, sf).collect()}
    items, texts = spark.read.parquet(f"{sf}/benchmark.parquet").collect(), docs.collect()
    held = {(i.item_id, d.doc_id) for i in items for d in texts if i.text[:60] in (d.text or "")}
    assert gate[None].cases == len({i for i, _ in held}) and set(gate) - {None} == {d for _, d in held}


def test_a_second_stage_decides_for_weak_queries_only(spark):
    ranked = spark.createDataFrame([(q, c, s, r) for q in (1, 2, 3, 4, 5) for c, s, r in ((10, 0.65, 1), (11, 0.5, 2), (12, 0.4, 3))] + [(6, 10, 0.9, 1)], "query_id long, chunk_id long, score double, rank int")
    again = spark.createDataFrame([(1, "scored", 1, 12, 3.0), (1, "scored", 2, 11, -4.0), (1, "scored", 3, 10, -9.0), (2, "failed", None, None, None), (3, "none", None, None, None), (4, "picked", 1, 12, None), (4, "picked", 2, 11, None), (6, "scored", 1, 10, -99.0)], "query_id long, status string, place int, chunk_id long, rerank double")
    served = lambda **options: sorted((r.query_id, r.place, r.chunk_id, r.stage) for r in R.retrieve(ranked, reranked=again, **options).collect())
    assert served() == [(1, 1, 12, 2), (1, 2, 11, 2), (2, 1, 10, 1), (4, 1, 11, 2), (5, 1, 10, 1), (6, 1, 10, 1)]
    assert served(keep=1) == [(1, 1, 12, 2), (2, 1, 10, 1), (5, 1, 10, 1), (6, 1, 10, 1)]
    own = ranked.withColumn("floor", F.when(F.col("query_id") == 5, 0.95))
    assert sorted(r.query_id for r in R.retrieve(own).collect()) == [1, 2, 3, 4, 6]
    questions, texts = spark.createDataFrame([(1, "a"), (6, "b")], "query_id long, question string"), spark.createDataFrame([(10, "x"), (11, "y"), (12, "z")], "chunk_id long, text string")
    assert sorted((r.query_id, r.chunk_id) for r in R.weak_candidates(ranked, questions, texts).collect()) == [(1, 10), (1, 11), (1, 12)]


def test_the_gate_tests_the_bands_of_the_stage_that_admits(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    expected = spark.createDataFrame([(1, 10), (2, 11)], "query_id long, doc_id long")
    ranked = spark.createDataFrame([(q, c, s, r) for q in (1, 2, 3, 4) for c, s, r in ((10, 0.65, 1), (11, 0.6, 2))], "query_id long, chunk_id long, score double, rank int")
    again = spark.createDataFrame([(1, "scored", 1, 10, 4.0), (1, "scored", 2, 11, 1.0), (2, "scored", 1, 11, 3.0), (2, "scored", 2, 10, 0.0), (3, "scored", 1, 10, -2.0), (4, "failed", None, None, None)], "query_id long, status string, place int, chunk_id long, rerank double")
    served = R.retrieve(ranked, reranked=again).withColumn("doc_id", F.col("chunk_id"))
    whole, each = R.judge_cases(cases, expected, ranked, served, again)
    assert sorted(map(tuple, whole.collect())) == [(1, False, True, 0.65, 4.0), (2, False, True, 0.6, 3.0), (3, True, False, 0.65, -2.0), (4, True, False, 0.65, None)]
    gate = R.calibration_gate(whole).first()
    assert (gate.stage, gate.lowest_hit, gate.highest_negative, gate.overlap, gate.margin, gate.passed) == (2, 3.0, -2.0, False, 5.0, True)
    first = R.calibration_gate(R.judge_cases(cases, expected, ranked, served)[0]).first()
    assert (first.stage, first.lowest_hit, first.highest_negative, first.overlap, first.passed) == (1, 0.6, 0.65, True, False)
    assert each.count() == 2

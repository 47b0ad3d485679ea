"""What grows with pairs: how often rows are sent, what stands above a join of pairs, how large their files are."""

import pytest

from turnlake.operators import memory as M
from turnlake.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def above_pairs(df):
    """The plan's nodes above its first join."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return "\n".join(lines[: next(i for i, line in enumerate(lines) if "Join" in line)])


@pytest.mark.parametrize("name", ["r14_attribute", "k01_rank_chunks", "k02_select_relevant", "k04_inject_cap"])
def test_pairs_are_not_shuffled_for_what_each_user_has_once(spark, name):
    above = above_pairs(QUERIES[name](spark, SF))
    assert "Exchange" not in above and "Window" not in above and "Aggregate" not in above


def test_visible_pairs_make_small_files(spark, tmp_path):
    QUERIES["j04_visible"](spark, "/root/testdata/sf0.1").write.parquet(f"{tmp_path}/seen")
    assert spark.read.parquet(f"{tmp_path}/seen").count() == 3_378_599
    assert sum(f.stat().st_size for f in (tmp_path / "seen").glob("*.parquet")) < 2_500_000


def test_tiles_are_all_pairs_once_and_rows_are_sent_to_few_blocks(spark):
    from turnlake.operators.blocks import made, scored_in_blocks

    left, right = spark.range(20_000).selectExpr("id as a", "id % 2 as k"), spark.range(3000).selectExpr("id as b", "id % 3 as k")
    schema = "n long, a long, b long"

    def prepare(y):
        return lambda x: made(schema, [x.num_rows * y.num_rows], [x.num_rows], [y.num_rows])

    tiles = scored_in_blocks(left, right, ("a", "b"), prepare, schema, "k").collect()
    assert sum(t.n for t in tiles) == 20_000 * 1000 and max(t.a for t in tiles) == 512
    assert sum(t.n for t in scored_in_blocks(left.drop("k"), right.drop("k"), ("a", "b"), prepare, schema, tile=(4096, 100)).collect()) == 60_000_000


@pytest.mark.parametrize("name", ["f14_cosine", "r04_max_window_score", "f15_hybrid_score"])
def test_scores_of_pairs_are_matrix_products(spark, name):
    lines = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    assert not any("Join" in line or "Exchange" in line for line in lines[:at])


def test_files_of_all_pairs_hold_scores_by_dictionary(spark, tmp_path):
    from pyspark.sql import functions as F

    from turnlake.operators.identity import identify

    rows = lambda name, seed: spark.range(2000).select(F.col("id").alias(name), (F.col("id") % 10).alias("user_id"), F.array(*(F.randn(seed + i).cast("float") for i in range(64))).alias("embedding"))
    identify(rows("probe_id", 1), rows("template_id", 99)).coalesce(1).write.parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs")
    assert pairs.count() == 4_000_000 == pairs.select("probe_id", "template_id").distinct().count()
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 5 * 4_000_000


def test_cosines_go_from_tiles_to_files_without_a_step_between(spark, tmp_path):
    import numpy as np
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from turnlake.operators import identity as I

    rows = lambda name, n, seed: spark.range(n).select(F.col("id").alias(name), (F.col("id") % 3).alias("user_id"), F.array(*(F.randn(seed + i).cast("float") for i in range(8))).alias("embedding")).localCheckpoint()
    probes, templates = rows("probe_id", 700, 1), rows("template_id", 1300, 50)
    I.identify(probes, templates)  # sets dictionaries for its own scores, not for these
    df = QUERIES["f14_cosine"](spark, SF)
    assert df.columns == ["probe_id", "template_id", "cosine"] and not any(f.nullable for f in df.schema)
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not any("Project" in line for line in plan[: next(i for i, line in enumerate(plan) if "MapInArrow" in line)])
    I.own_scores(probes, templates, "cosine").coalesce(1).write.parquet(f"{tmp_path}/own")
    file = next((tmp_path / "own").glob("*.parquet"))
    kinds = {c["path_in_schema"]: c["encodings"] for c in pq.ParquetFile(file).metadata.row_group(0).to_dict()["columns"]}
    assert not any("DICTIONARY" in e for e in kinds["cosine"]) and any("DICTIONARY" in e for e in kinds["probe_id"])
    got = {(r.probe_id, r.template_id): r.cosine for r in spark.read.parquet(f"{tmp_path}/own").collect()}
    a, b = ({r[0]: np.array(r.embedding, float) for r in x.collect()} for x in (probes, templates))
    assert len(got) == sum(1 for i in a for j in b if i % 3 == j % 3)
    assert all(i % 3 == j % 3 and abs(a[i] @ b[j] / np.linalg.norm(a[i]) / np.linalg.norm(b[j]) - s) < 1e-6 for (i, j), s in got.items())


@pytest.mark.parametrize("name", ["w08_best_second", "f18_classify_scores"])
def test_the_best_users_need_no_pairs_of_templates(spark, name):
    lines = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    line = next(line for line in lines if "MapInArrow" in line)
    assert "probe_id" in line.rsplit("[", 1)[1] and "template_id" not in line.rsplit("[", 1)[1]


def test_documents_without_vectors_are_not_dealt_for_memories(spark):
    from turnlake.plans.fixtures import view

    assert "doc_id#" in (plan := view(spark, SF, "memory")._jdf.queryExecution().optimizedPlan().toString()) and ">= 0" in plan


def test_bigrams_take_one_pass_and_keep_characters_whole(spark):
    import time

    from pyspark.sql import functions as F

    from turnlake.functions.text import bigrams

    df = spark.createDataFrame([("a😀bé𠮷",), (" x ",), ("",)], "t string")
    assert [r.x for r in df.select(bigrams(F.col("t")).alias("x")).collect()] == [["ab", "bé", "é𠮷"], ["x"], []]
    began = time.time()
    assert spark.range(1).select(F.size(bigrams(F.repeat(F.lit("abcdefghij"), 40_000)))).first()[0] == 10
    assert time.time() - began < 15


def test_proposals_of_a_key_with_many_rows_take_time_by_their_number():
    import time

    state = M._OwnMemories(M.MemorySettings(), M.SINGLE_VALUED, 200, 99)
    row = {"slot_key": "pet", "probe": "p", "importance": 0.5, "approved": False, "embedding": [1.0, 0.0], "statement_vec": None}
    for n in range(20_000):
        state.add(row | {"owner_user_id": 1, "chunk_id": n, "text": f"old {n}", "created_at": n})
    began = time.time()
    for n in range(3000):
        state.apply(row | {"owner_user_id": 1, "prop_id": n, "ord": n, "text": f"new {n}" if n % 3 else f"old  {n}", "embedding": None})
    assert time.time() - began < 10
    assert [a for *_, a in state.out()].count("merged") == 1000 and len(state.changed) == 3000


def test_files_hold_a_users_long_list_once(spark, tmp_path):
    from pyspark.sql import functions as F

    tables = {
        "embeddings": spark.range(60).select(F.col("id").alias("vec_id"), F.lit(1).cast("long").alias("label"), F.array(F.lit(1.0).cast("float")).alias("embedding")),
        "documents": spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 280 * 4000).alias("text")),
        "conversations": spark.range(600).select((F.col("id") % 300 * 17 + 1).alias("conv_id"), F.when(F.col("id") < 300, 1).otherwise(2).alias("turn"), F.when(F.col("id") < 300, "user").otherwise("assistant").alias("role"), F.lit("hi").alias("text")),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    QUERIES["r14_attribute"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/lists")
    lists = spark.read.parquet(f"{tmp_path}/lists")
    assert lists.agg(F.count("*"), F.min(F.length("used_ids")), F.max(F.length("used_ids"))).first()[:] == (300, *[sum(len(str(d * 4096 + p)) + 1 for d in range(60) for p in range(4000)) - 1] * 2)
    assert sum(f.stat().st_size for f in (tmp_path / "lists").glob("*.parquet")) < 5_000_000


def test_an_index_of_terms_finds_what_all_pairs_give():
    import numpy as np
    import pyarrow as pa

    from turnlake.operators.termindex import TermIndex, best_rows

    rng, kind = np.random.default_rng(3), pa.list_(pa.int64())
    for n, words in ((50, 30), (2000, 400), (4000, 5000)):
        weight = 1 / np.arange(1, words + 1)
        some = lambda most: sorted({int(x) * 7919 - 10**9 for x in rng.choice(words, rng.integers(0, most), p=weight / weight.sum())}) if rng.random() > 0.05 else None  # noqa: E731, B023
        texts, probes, questions = [some(120) for _ in range(n)], [some(60) for _ in range(n)], [some(90) or [] for _ in range(25)]
        index = TermIndex(pa.chunked_array([pa.array(texts, kind)]), pa.array(probes, kind))
        ids, kinds = rng.permutation(n), np.arange(n) % 3
        sets = [[set(x or ()) for x in rows] for rows in (texts, probes)]
        jaccard = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
        for q, asked in zip(index.asked(pa.chunked_array([pa.array(questions, kind)])), map(set, questions), strict=True):
            scores = np.array([max(jaccard(asked, a), jaccard(asked, b)) for a, b in zip(*sets, strict=True)])
            assert np.array_equal(index.common(q, index.place[0]), [len(asked & a) for a in sets[0]])
            for need in ([0.05, 0.14, 0.3], [0.68, 0.68, 0.1], [1e-9] * 3):
                need = np.array(need)
                wanted = np.flatnonzero(scores >= need[kinds])
                row, score = best_rows(*index.search(q, need, kinds), ids)
                assert np.array_equal(row, wanted) and np.array_equal(score, scores[wanted])
                for keep in (1, 16):
                    best = wanted[np.lexsort((ids[wanted], -scores[wanted]))][:keep]
                    assert sorted(best_rows(*index.search(q, need, kinds, keep), ids, keep)[0]) == sorted(best)
                row, score = best_rows(*index.search(q, need, kinds, 1, True, 0.4), ids)
                assert set(wanted[scores[wanted] >= 0.4]) <= set(row) <= set(wanted)
                assert all(score[kinds[row] == k].max(initial=0) == scores[wanted[kinds[wanted] == k]].max(initial=0) for k in range(3))


@pytest.mark.parametrize("name", ["r07_recall", "r07_recall_vectors", "r07_recall_report", "u02_merge_basics", "k03_lexical_retrieve"])
def test_questions_are_looked_up_once_for_shared_and_once_for_own_rows(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_terms_are_hashed_before_they_are_told_apart(spark):
    from pyspark.sql import functions as F

    from turnlake.functions.text import hashed_terms, lexical_terms

    df = spark.createDataFrame([("a😀bé𠮷",), (" x ",), ("",), (None,), ("The the_x  THE, a",)], "t string")
    for r in df.select(hashed_terms(F.col("t")).alias("a"), F.transform(lexical_terms(F.col("t")), lambda t: F.xxhash64(t)).alias("b")).collect():
        assert r.b is None and r.a is None or sorted(r.a) == sorted(r.b)


def test_an_owners_memories_are_held_in_few_bytes_and_given_in_batches(spark):
    import tracemalloc

    from pyspark.sql import functions as F

    tracemalloc.start()
    state = M._OwnMemories(M.MemorySettings(), M.SINGLE_VALUED, 200, 99)
    row = {"owner_user_id": 1, "slot_key": "pet", "probe": "p", "importance": 0.5, "approved": False, "statement_vec": None}
    for n in range(5000):
        state.add(row | {"chunk_id": n, "text": f"old {n} " * 20, "created_at": n, "embedding": [float(n % 7)] * 64})
    for n in range(3000):
        state.apply(row | {"prop_id": n, "ord": n, "text": f"new {n} " * 20, "embedding": [float(n % 5)] * 64})
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(state.rows) == 8000 and held / 8000 < 1600
    many = spark.range(5000).select(F.col("id").alias("prop_id"), F.lit(1).cast("long").alias("owner_user_id"), F.col("id").alias("ord"), F.lit("").alias("slot_key"), F.concat(F.lit("t"), "id").alias("text"), F.lit("p").alias("probe"), F.lit(0.5).alias("importance"), F.lit(True).alias("approved"), F.lit(None).cast("array<float>").alias("embedding"))
    memory = many.filter("prop_id < 0").withColumns({"chunk_id": F.col("prop_id"), "created_at": F.col("prop_id"), "active": F.lit(True)})
    assert M.upsert_memories(many, memory, 99).count() == 5000

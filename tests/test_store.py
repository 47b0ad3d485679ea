"""Merges into stored tables: results, what stays untouched, deletions, repeats."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from turnlake.operators.analytics import persist_turns
from turnlake.sources import store as S
from turnlake.sources.store import KeyedTable


def table(spark, tmp_path, ddl, *keys, buckets=8):
    schema = spark.createDataFrame([], ddl).schema
    return KeyedTable(f"file://{tmp_path}/table", schema, keys, buckets)


def files(t):
    """Files by partition, with when they were written."""
    found = {}
    for path in glob.glob(t.path.removeprefix("file://") + "/*/*.parquet"):
        found.setdefault(int(path.split(S.BUCKET + "=")[1].split("/")[0]), set()).add((path, os.stat(path).st_mtime_ns))
    return found


def rows(spark, t):
    return sorted(map(tuple, t.read(spark).collect()), key=str)


def test_a_merge_replaces_the_partitions_it_touches_only(spark, tmp_path):
    t = table(spark, tmp_path, "id long, v string, at long", "id")
    assert t.read(spark).count() == 0
    t.merge(spark.range(100).select("id", F.lit("old").alias("v"), F.lit(1).cast("long").alias("at")), S.upsert_rows(["id"], ["at"]))
    before = files(t)
    change = spark.createDataFrame([(3, "new", 2), (3, "newer", 3), (4, "late", 0), (200, "added", 1)], "id long, v string, at long")
    touched = t.merge(change, S.upsert_rows(["id"], ["at"]))
    after = files(t)
    assert 0 < len(touched) < 8 and {b for b in before if before[b] != after.get(b)} == set(touched)
    want = sorted([(i, "newer" if i == 3 else "old", 3 if i == 3 else 1) for i in range(100)] + [(200, "added", 1)], key=str)
    assert rows(spark, t) == want
    t.merge(change, S.upsert_rows(["id"], ["at"]))  # delivered again
    assert rows(spark, t) == want
    assert t.merge(change.limit(0), S.upsert_rows(["id"], ["at"])) == [] and rows(spark, t) == want


def test_documents_are_replaced_and_deleted_whole(spark, tmp_path):
    t = table(spark, tmp_path, "doc_id long, ord int, text string", "doc_id", buckets=4)
    chunks = lambda *pairs: spark.createDataFrame([(d, i, f"{d}-{i}-{tag}") for d, n, tag in pairs for i in range(n)], "doc_id long, ord int, text string")
    t.merge(chunks((1, 3, "a"), (2, 2, "a"), (None, 1, "a")), S.replace_groups("doc_id"))
    t.merge(chunks((1, 1, "b"), (3, 1, "b")), S.replace_groups("doc_id"))
    assert {r[2] for r in rows(spark, t)} == {"1-0-b", "2-0-a", "2-1-a", "3-0-b", "None-0-a"}
    t.merge(spark.createDataFrame([(1,), (2,), (3,)], "doc_id long"), S.delete_groups("doc_id"))
    assert [r[2] for r in rows(spark, t)] == ["None-0-a"]


@pytest.mark.parametrize(("combine", "ddl", "first", "second", "want"), [
    (S.insert_rows("id"), "id long, v string", [(1, "a")], [(1, "b"), (2, "c")], [(1, "a"), (2, "c")]),
    (S.replace_rows("id", ["v"]), "id long, v string", [(1, "a")], [(1, None), (2, "c"), (2, "d")], [(1, None), (2, "d")]),
    (S.coalesce_rows("id", ["v"]), "id long, v string", [(1, "a"), (3, "k")], [(1, ""), (2, "c")], [(1, "a"), (2, "c"), (3, "k")]),
])
def test_merge_kinds(spark, tmp_path, combine, ddl, first, second, want):
    t = table(spark, tmp_path, ddl, "id")
    for part in (first, second, second):
        t.merge(spark.createDataFrame(part, ddl), combine)
    assert rows(spark, t) == want


def test_profiles_are_patched_in_place(spark, tmp_path):
    ddl = "user_id long, display_name string, status string, age_at_registration int, age_recorded_at long"
    t = table(spark, tmp_path, ddl, "user_id")
    t.merge(spark.createDataFrame([(1, "A", "active", 30, 1), (2, "B", "active", 30, 1)], ddl), S.insert_rows("user_id"))
    t.merge(spark.createDataFrame([(1, "new", "bogus", 31)], "user_id long, new_name string, new_status string, new_age int"), S.patch_rows(9))
    assert rows(spark, t) == [(1, "new", "active", 31, 9), (2, "B", "active", 30, 1)]


def test_turns_are_persisted_once(spark, tmp_path):
    turn = spark.createDataFrame([(1, 7, "hi", "yo", "neutral", 5, 1, "none", []), (2, 7, "sad", "oh", "negative", 6, 2, "urgent", ["sad"])], "turn_id long, user_id long, input_text string, response_text string, emotion string, created_at long, seq int, risk_level string, evidence array<string>")
    for name, part in persist_turns(turn).items():
        t = KeyedTable(f"file://{tmp_path}/{name}", part.schema, ["conversation_id"], 4)
        for _ in range(2):
            t.merge(part, S.insert_rows("conversation_id"))
        assert t.read(spark).count() == (1 if name == "risk_events" else 2)

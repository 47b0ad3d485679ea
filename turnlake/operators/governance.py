"""Consent, ownership, sessions, login bursts and erasure."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def drop_tombstoned(rows: DataFrame, users: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows whose user is not deleted and, where known, is active; an unknown user is fine."""
    blocked = deleted.select("user_id").unionByName(users.filter("status <> 'active'").select("user_id"))
    return rows.join(blocked.distinct(), "user_id", "left_anti")


def latest_consent(consents: DataFrame, users: DataFrame, purpose: str) -> DataFrame:
    """(user_id, granted) for every user: the newest decision for the purpose, of equal times the later row; none is no."""
    last = consents.filter(F.col("purpose") == purpose).groupBy("user_id").agg(F.max_by("granted", F.struct("decided_at", "seq")).alias("granted"))
    return users.select("user_id").distinct().join(last, "user_id", "left").select("user_id", F.coalesce("granted", F.lit(False)).alias("granted"))


def consent_asof(turns: DataFrame, consents: DataFrame, purpose: str) -> DataFrame:
    """Turns (turn_id, user_id, created_at) with whether the purpose was granted at that time; a decision at the same time counts."""
    decided = consents.filter(F.col("purpose") == purpose).select("user_id", F.col("decided_at").alias("at"), F.lit(0).alias("kind"), F.col("seq").alias("n"), "granted", F.lit(None).cast("long").alias("turn_id"))
    asked = turns.select("user_id", F.col("created_at").alias("at"), F.lit(1).alias("kind"), F.col("turn_id").alias("n"), F.lit(None).cast("boolean").alias("granted"), "turn_id")
    w = Window.partitionBy("user_id").orderBy("at", "kind", "n").rowsBetween(Window.unboundedPreceding, 0)
    both = decided.unionByName(asked).withColumn("granted", F.last("granted", ignorenulls=True).over(w))
    return both.filter("kind = 1").select("turn_id", "user_id", F.coalesce("granted", F.lit(False)).alias("granted"))


def active_sessions(sessions: DataFrame, now: int) -> DataFrame:
    """Sessions that are neither revoked nor over."""
    return sessions.filter(F.col("revoked_at").isNull() & (F.col("expires_at") > now))


def failed_login_bursts(attempts: DataFrame, failures: int = 5, seconds: int = 60) -> DataFrame:
    """(client, actor_id, ts, n): failed attempts at which ``failures`` or more have failed within ``seconds``; a success clears the count."""
    w = Window.partitionBy("client", "actor_id").orderBy("ts", "attempt_id")
    island = attempts.withColumn("island", F.coalesce(F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(w), F.lit(0)))
    span = Window.partitionBy("client", "actor_id", "island").orderBy("ts").rangeBetween(-seconds, 0)
    failed = island.filter(~F.col("ok")).withColumn("n", F.count("*").over(span))
    return failed.filter(F.col("n") >= failures).select("client", "actor_id", "attempt_id", "ts", "n")


def erase_user(tables: Mapping[str, DataFrame], ids: DataFrame, keys: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Each table without the rows of the users of ``ids`` (user_id); ``keys`` names a table's owner column if it is another."""
    gone = ids.select("user_id").distinct()
    return {name: df.join(gone.withColumnRenamed("user_id", (keys or {}).get(name, "user_id")), (keys or {}).get(name, "user_id"), "left_anti") for name, df in tables.items()}


def erasure_counts(tables: Mapping[str, DataFrame], ids: DataFrame, keys: Mapping[str, str] | None = None) -> DataFrame:
    """(table_name, removed): rows that ``erase_user`` removes."""
    gone, out = ids.select("user_id").distinct(), None
    for name, df in tables.items():
        key = (keys or {}).get(name, "user_id")
        n = df.select(F.col(key).alias("user_id")).join(gone, "user_id", "left_semi").agg(F.count("*").alias("removed")).select(F.lit(name).alias("table_name"), "removed")
        out = n if out is None else out.unionByName(n)
    return out


def manifest_check(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, fault): files of the manifest (name, sha256) that are missing or differ; ``files`` has name and content."""
    have = files.select("name", F.sha2("content", 256).alias("found"))
    joined = manifest.join(have, "name", "left")
    return joined.withColumn("fault", F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.lower("sha256"), "mismatched")).filter("fault is not null").select("name", "fault")

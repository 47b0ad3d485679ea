"""Keyed merges as unions with a latest-row rule or outer joins; they hold for any table format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert_last(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def upsert_coalesce(old: DataFrame, new: DataFrame, key: str, keep_if_empty: Sequence[str] = (), keep_first: Sequence[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` merged in by ``key``: new values win, but an empty one never does in ``keep_if_empty``,
    nor any in ``keep_first`` where there is an old one."""
    o, n = old.alias("o"), new.withColumn("is_new", F.lit(True)).alias("n")
    joined = o.join(n, key, "full")
    out = [F.col(key)]
    for c in old.columns:
        if c == key:
            continue
        before, after = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keep_if_empty:
            value = F.coalesce(F.when(after != "", after), before)
        elif c in keep_first:
            value = F.coalesce(before, after)
        else:
            value = F.when(F.col("n.is_new"), after).otherwise(before)
        out.append(value.alias(c))
    return joined.select(*out)


def insert_if_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and the first of ``new``'s rows for each key that it lacks."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti").select(*old.columns))


def insert_or_replace(old: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Whole rows of ``new``, the last of each key, in place of those of ``old``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(upsert_last(new, [key], order).select(*old.columns))


def profile_patch(users: DataFrame, patches: DataFrame, now: int, statuses: Sequence[str] = ("active", "disabled")) -> DataFrame:
    """Users after ``patches`` (user_id, new_name, new_status, new_age): null changes nothing, an unknown status neither; a new age is stamped."""
    joined = users.join(patches, "user_id", "left")
    changed = F.col("new_age").isNotNull() & ~F.col("new_age").eqNullSafe(F.col("age_at_registration"))
    return joined.withColumns({
        "age_recorded_at": F.when(changed, F.lit(now).cast("long")).otherwise(F.col("age_recorded_at")),
        "display_name": F.coalesce("new_name", "display_name"),
        "status": F.coalesce(F.when(F.col("new_status").isin(*statuses), F.col("new_status")), F.col("status")),
        "age_at_registration": F.coalesce("new_age", "age_at_registration"),
    }).select(*users.columns)

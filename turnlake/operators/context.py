"""Short-term context: recent turns, summary planning, messages for a model. Rows are (user_id, created_at, session_id, seq, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clip, squeeze

MAX_TURNS = 40
ORDER = ("created_at", "session_id", "seq")


def _newest_first() -> list[Column]:
    return [F.desc(c) for c in ORDER]


def recent_turns(turns: DataFrame, n: int = 10, chars: int = 240) -> DataFrame:
    """(user_id, position, input, reply): each user's last ``n`` (40 at most) turns, oldest first from 1.

    Texts are squeezed and clipped; a turn with an empty side is left out, after the last ``n`` are taken.
    """
    n = max(0, min(n, MAX_TURNS))
    w = Window.partitionBy("user_id").orderBy(*_newest_first())
    last = turns.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    side = lambda c: clip(squeeze(F.coalesce(c, F.lit(""))), chars)
    kept = last.select("user_id", "r", side("input_text").alias("input"), side("response_text").alias("reply")).filter("input <> '' and reply <> ''")
    again = Window.partitionBy("user_id").orderBy(F.desc("r"))
    return kept.select("user_id", F.row_number().over(again).alias("position"), "input", "reply")


def turn_slice(turns: DataFrame, start: int, stop: int) -> DataFrame:
    """Each user's turns from the ``start``-th (from 0) to before the ``stop``-th, oldest first."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    return turns.withColumn("position", F.row_number().over(w) - 1).filter((F.col("position") >= start) & (F.col("position") < stop))


def plan_summary(turns: DataFrame, summaries: DataFrame, window: int = 10, every: int = 6, slice_: int = 30) -> DataFrame:
    """Per user what to summarise and what to replay: total, covered, backlog, due, stop, replay, gap.

    ``covered`` (of ``summaries``: user_id, covered_count) is clamped to the turns there are. A refresh is due at a backlog of
    ``every``; it covers up to ``stop``, ``slice_`` turns at most. Replayed are the window and the backlog, 40 turns at
    most; ``gap`` counts turns that are then in neither place, before a refresh.
    """
    totals = turns.groupBy("user_id").agg(F.count("*").cast("long").alias("total"))
    c = F.greatest(F.lit(0).cast("long"), F.least(F.coalesce("covered_count", F.lit(0)).cast("long"), F.col("total")))
    out = totals.join(summaries.select("user_id", "covered_count"), "user_id", "left").withColumn("covered", c).drop("covered_count")
    out = out.withColumn("backlog", F.greatest(F.lit(0).cast("long"), F.col("total") - window - F.col("covered")))
    out = out.withColumn("due", F.col("backlog") >= every)
    out = out.withColumn("stop", F.when(F.col("due"), F.least(F.col("total") - window, F.col("covered") + slice_)).otherwise(F.col("covered")))
    out = out.withColumn("replay", F.least(F.lit(MAX_TURNS).cast("long"), window + F.col("backlog"), F.col("total")))
    return out.withColumn("gap", F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("covered") - F.col("replay")))


def effective_language(turns: DataFrame, users: DataFrame, default: str = "zh-CN") -> DataFrame:
    """Turns with ``language``: the user's preferred one, else ``default``."""
    return turns.join(users.select("user_id", "preferred_language"), "user_id", "left").withColumn("language", F.coalesce("preferred_language", F.lit(default))).drop("preferred_language")


def assemble_messages(turns: DataFrame, history: DataFrame, system: str, memory_label: str = "[record {}] ") -> DataFrame:
    """(turn_id, messages): system, then the user's history as pairs, then the turn with its record and excerpt blocks.

    ``turns``: turn_id, user_id, input_text, and optional summary, memories (array of struct id, text), excerpts (array of
    string). ``history``: rows of ``recent_turns``. A blank side of a pair leaves the pair out.
    """
    have = set(turns.columns)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    before, after = memory_label.split("{}")
    pairs = (
        history.filter((F.trim("input") != "") & (F.trim("reply") != ""))
        .groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("position", F.trim("input").alias("input"), F.trim("reply").alias("reply")))).alias("pairs"))
    )
    summary = F.coalesce(F.col("summary"), F.lit("")) if "summary" in have else F.lit("")
    first = message("system", F.when(summary != "", F.concat(F.lit(system + "\n"), summary)).otherwise(F.lit(system)))
    lines = []
    if "memories" in have:
        lines.append(F.transform(F.coalesce("memories", F.array()), lambda m: F.concat(F.lit(before), m["id"].cast("string"), F.lit(after), m["text"])))
    if "excerpts" in have:
        lines.append(F.transform(F.coalesce("excerpts", F.array()), lambda x: F.concat(F.lit("- "), x)))
    current = F.concat_ws("\n", F.array(F.trim(F.coalesce("input_text", F.lit("")))), *lines)
    spread = F.flatten(F.transform(F.coalesce("pairs", F.array()), lambda p: F.array(message("user", p["input"]), message("assistant", p["reply"]))))
    joined = turns.join(pairs, "user_id", "left")
    return joined.select("turn_id", F.concat(F.array(first), spread, F.array(message("user", current))).alias("messages"))


def attribute(used: DataFrame) -> DataFrame:
    """(turn_id, citations, used_ids) from rows (turn_id, rank, chunk_id, citation, owner_user_id, user_id).

    Citations are those of knowledge chunks, in rank order; used ids are the chunks that the turn's user owns.
    """
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"])
    cited = F.when(F.col("citation").isNotNull(), F.struct("rank", F.col("citation").alias("v")))
    own = F.when(F.col("owner_user_id") == F.col("user_id"), F.struct("rank", F.col("chunk_id").alias("v")))
    return used.groupBy("turn_id").agg(ordered(cited).alias("citations"), ordered(own).alias("used_ids"))

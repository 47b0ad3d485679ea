"""Conversation analytics: labels, distributions, trends and rollups. Times are epoch seconds, days are UTC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L

DAY = 86_400


def annotate_turns(turns: DataFrame, negative: Sequence[str], positive: Sequence[str], urgent: Sequence[str], attention: Sequence[str]) -> DataFrame:
    """Adds emotion, risk_level, evidence, needs_review to turns (input_text; optional model_emotion, model_risk, model_evidence).

    A valid model emotion overrides the local one; the higher risk counts; the model's evidence is added to the local.
    """
    text = F.col("input_text")
    model = {c: F.col(c) if c in turns.columns else F.lit(None) for c in ("model_emotion", "model_risk", "model_evidence")}
    emotion = F.when(model["model_emotion"].cast("string").isin(*L.EMOTIONS), model["model_emotion"].cast("string")).otherwise(L.emotion_of(text, negative, positive))
    risk = L.merge_risk(L.risk_level(text, urgent, attention), model["model_risk"].cast("string"))
    evidence = L.evidence_union(L.risk_evidence(text, urgent, attention), model["model_evidence"].cast("array<string>"))
    return turns.withColumns({"emotion": emotion, "risk_level": risk, "evidence": evidence}).withColumn("needs_review", F.col("risk_level") != "none")


def persist_turns(annotated: DataFrame) -> dict[str, DataFrame]:
    """One annotated frame as the rows of four tables; risk events of the two higher levels only."""
    base = annotated.withColumnRenamed("turn_id", "conversation_id")
    return {
        "conversations": base.select("conversation_id", "user_id", "input_text", "response_text", "emotion", "created_at", "seq"),
        "emotion_events": base.select("conversation_id", "user_id", "emotion", "created_at"),
        "conversation_analysis": base.select("conversation_id", "user_id", "created_at"),
        "risk_events": base.filter("risk_level <> 'none'").select("conversation_id", "user_id", "risk_level", "evidence", "created_at", F.lit("unreviewed").alias("review_status")),
    }


def _label_frame(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(x,) for x in L.EMOTIONS], "emotion string")


def emotion_distribution(turns: DataFrame) -> DataFrame:
    """(emotion, n): 0 for the three labels that do not occur, other labels kept."""
    counts = turns.groupBy("emotion").agg(F.count("*").alias("n"))
    return counts.join(_label_frame(turns), "emotion", "full").select("emotion", F.coalesce("n", F.lit(0)).alias("n"))


def rounded_mean(c: Column) -> Column:
    """Mean rounded half to even, as an integer."""
    return F.bround(F.avg(c), 0).cast("long")


def device_status(last_seen: Column, now: int, online: int = 60, stale: int = 300) -> Column:
    """online below ``online`` seconds of age, stale up to ``stale``, else offline; never seen is offline."""
    age = F.greatest(F.lit(now) - last_seen, F.lit(0))
    return F.when(age < online, "online").when(age <= stale, "stale").otherwise("offline")


def dashboard_summary(turns: DataFrame, analysis: DataFrame, devices: DataFrame, now: int, online: int = 60, stale: int = 300) -> DataFrame:
    """One row of totals: each table is aggregated in one scan of its own."""
    t = turns.agg(
        F.count("*").alias("conversation_count"), F.count_distinct("user_id").alias("active_user_count"),
        *(F.count_if(F.col("emotion") == e).alias(f"n_{e}") for e in L.EMOTIONS),
    )
    a = analysis.agg(rounded_mean(F.col("latency_ms")).alias("average_latency_ms"))
    status = device_status(F.col("last_seen"), now, online, stale)
    d = devices.agg(*(F.count_if(status == s).alias(f"n_{s}") for s in ("online", "stale", "offline")), F.coalesce(F.bool_or("is_simulator"), F.lit(False)).alias("simulator_mode"))
    one = F.lit(1)
    return t.withColumn("k", one).join(a.withColumn("k", one), "k").join(d.withColumn("k", one), "k").drop("k")


def _calendar(df: DataFrame, first_day: int, days: int) -> DataFrame:
    return df.sparkSession.range(days).select((F.lit(first_day) + F.col("id")).cast("long").alias("day"))


def emotion_trend(turns: DataFrame, users: DataFrame, now: int, days: int = 7) -> DataFrame:
    """(user_id, date, emotion, n): a dense grid of ``days`` (1 to 90) UTC days up to ``now`` for every user, 0 where nothing was said.

    ``users`` (user_id) has whom to report. The calendar is of 90 rows at most and the labels are three, so the grid grows
    with the users only.
    """
    days = max(1, min(days, 90))
    first = now // DAY - days + 1
    counts = (
        turns.filter((F.col("created_at") >= first * DAY) & (F.col("created_at") < (now // DAY + 1) * DAY))
        .groupBy("user_id", F.floor(F.col("created_at") / DAY).alias("day"), "emotion").agg(F.count("*").alias("n"))
    )
    grid = users.select("user_id").distinct().select(
        "user_id", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(now // DAY).cast("long"))).alias("day")
    ).select("user_id", "day", F.explode(F.array(*map(F.lit, L.EMOTIONS))).alias("emotion"))
    dense = grid.join(counts, ["user_id", "day", "emotion"], "full").join(users.select("user_id").distinct(), "user_id", "left_semi")
    return dense.select("user_id", F.date_from_unix_date(F.col("day").cast("int")).cast("string").alias("date"), "emotion", F.coalesce("n", F.lit(0)).alias("n"))


def analytics_overview(turns: DataFrame, analysis: DataFrame, risks: DataFrame, now: int, days: int = 7) -> DataFrame:
    """(metric, value) of a rolling window of 7 or 30 days, and per UTC calendar day the number of turns."""
    if days not in (7, 30):
        raise ValueError("days is 7 or 30")
    since, today = now - days * DAY, now // DAY
    recent = turns.filter(F.col("created_at") >= since)
    total = recent.agg(F.count("*").alias("n")).select(F.lit("conversation_count").alias("metric"), F.col("n").cast("long").alias("value"))
    emotions = emotion_distribution(recent).select(F.concat(F.lit("emotion:"), "emotion").alias("metric"), F.col("n").cast("long").alias("value"))
    latency = analysis.filter(F.col("created_at") >= since).agg(rounded_mean(F.col("latency_ms")).alias("value")).select(F.lit("average_latency_ms").alias("metric"), "value")
    levels = risk_counts(risks, since).select(F.concat(F.lit("risk:"), "risk_level").alias("metric"), F.col("n").cast("long").alias("value"))
    per_day = turns.filter((F.col("created_at") >= (today - days + 1) * DAY) & (F.col("created_at") < (today + 1) * DAY)).groupBy(F.floor(F.col("created_at") / DAY).alias("day")).agg(F.count("*").alias("n"))
    daily = _calendar(turns, today - days + 1, days).join(per_day, "day", "left").select(
        F.concat(F.lit("day:"), F.date_from_unix_date(F.col("day").cast("int")).cast("string")).alias("metric"), F.coalesce("n", F.lit(0)).cast("long").alias("value")
    )
    return total.unionByName(emotions).unionByName(latency).unionByName(levels).unionByName(daily)


def risk_counts(risks: DataFrame, since: int) -> DataFrame:
    """(risk_level, n) of attention and urgent events since a time, 0 included."""
    levels = risks.sparkSession.createDataFrame([("attention",), ("urgent",)], "risk_level string")
    counts = risks.filter((F.col("created_at") >= since) & F.col("risk_level").isin("attention", "urgent")).groupBy("risk_level").agg(F.count("*").alias("n"))
    return levels.join(counts, "risk_level", "left").select("risk_level", F.coalesce("n", F.lit(0)).alias("n"))


def user_summary(turns: DataFrame, now: int, period: str, urgent: Sequence[str], attention: Sequence[str], latest: int = 50) -> DataFrame:
    """Per user: turns by emotion in the last day or week, and the highest risk of the latest inputs, with a review flag."""
    since = now - (DAY if period == "day" else 7 * DAY)
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("session_id"), F.desc("seq"))
    newest = turns.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= latest)
    risk = newest.groupBy("user_id").agg(F.max(L.risk_rank(L.risk_level(F.col("input_text"), urgent, attention))).alias("rank"))
    counts = turns.groupBy("user_id").agg(*(F.count_if((F.col("created_at") >= since) & (F.col("emotion") == e)).alias(f"n_{e}") for e in L.EMOTIONS))
    level = F.element_at(F.array(*map(F.lit, L.RISK_LEVELS)), F.col("rank") + 1)
    return counts.join(risk, "user_id").select("user_id", *(f"n_{e}" for e in L.EMOTIONS), level.alias("risk_level"), (F.col("rank") > 0).alias("needs_review"))


def dominant_emotion(turns: DataFrame) -> DataFrame:
    """(user_id, emotion, n, share): each user's most frequent label, of equals the first by name; share in percent, 4 at least."""
    counts = turns.groupBy("user_id", "emotion").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("user_id"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "emotion")
    ranked = counts.withColumns({"total": total, "r": F.row_number().over(w)}).filter("r = 1")
    return ranked.select("user_id", "emotion", "n", F.greatest(F.bround(100 * F.col("n") / F.col("total"), 0), F.lit(4.0)).alias("share"))


def search_users(users: DataFrame, text: str = "", status: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A page of users whose id or name holds ``text`` (ASCII case does not matter), with the number of all that match."""
    page, size = max(1, page), max(1, min(size, 100))
    pattern = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%" if text else "%"
    found = users.filter(F.col("user_id").cast("string").ilike(pattern) | F.col("display_name").ilike(pattern))
    if status:
        found = found.filter(F.col("status") == status)
    total = found.agg(F.count("*").alias("total"))
    rows = found.orderBy(F.desc("created_at"), "user_id").offset((page - 1) * size).limit(size)
    return rows.withColumn("k", F.lit(1)).join(total.withColumn("k", F.lit(1)), "k").drop("k")


def recent(df: DataFrame, order: Sequence[Column], limit: int = 50, key: str | None = None) -> DataFrame:
    """The first ``limit`` (1 to 200) rows in ``order``, of all or of each ``key``."""
    limit = max(1, min(limit, 200))
    if key is None:
        return df.orderBy(*order).limit(limit)
    return df.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("r") <= limit).drop("r")


def review_risk(risks: DataFrame, updates: DataFrame) -> DataFrame:
    """Risk events with the review status of ``updates`` (conversation_id, review_status); statuses that are not known change nothing."""
    known = ("unreviewed", "reviewing", "resolved", "dismissed")
    valid = updates.filter(F.col("review_status").isin(*known)).select("conversation_id", F.col("review_status").alias("new_status"))
    return risks.join(valid, "conversation_id", "left").withColumn("review_status", F.coalesce("new_status", "review_status")).drop("new_status")

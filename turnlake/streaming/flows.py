"""Streams that Spark's own operators express; each works on a batch as well."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.analytics import annotate_turns
from ..operators.devices import normalize_heartbeat
from ..operators.upsert import insert_if_absent, upsert_last


def risk_alerts(turns: DataFrame, negative: Sequence[str], positive: Sequence[str], urgent: Sequence[str], attention: Sequence[str]) -> DataFrame:
    """Turns of the two higher risk levels as they arrive; no state."""
    return annotate_turns(turns, negative, positive, urgent, attention).filter("needs_review").select("turn_id", "user_id", "risk_level", "evidence", "created_at")


def emotion_windows(turns: DataFrame, late: str = "1 day", size: str = "1 day") -> DataFrame:
    """(window_start, emotion, n) per tumbling window of event time; rows later than ``late`` are dropped. Needs ``at`` (timestamp)."""
    counts = turns.withWatermark("at", late).groupBy(F.window("at", size), "emotion").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "emotion", "n")


def idempotent_turns(turns: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first turn of each request_id; on a stream within the watermark of ``at``."""
    if turns.isStreaming:
        return turns.withWatermark("at", late).dropDuplicatesWithinWatermark(["request_id"])
    return turns.dropDuplicates(["request_id"])


def validate_envelope(events: DataFrame, types: Sequence[str], version: int = 1) -> DataFrame:
    """Events with ``reason``: what is wrong with the envelope (type, version, device_id), or null."""
    reason: Column = (
        F.when(F.col("device_id").isNull() | (F.trim("device_id") == ""), "missing_identity").when(F.col("version").isNull() | (F.col("version") != version), "unsupported_version")
        .when(F.col("type").isNull() | ~F.col("type").isin(*types), "unknown_type")
    )
    return events.withColumn("reason", reason)


def heartbeat_batch(read: Callable[[str], DataFrame], write: Callable[[str, DataFrame], None]):
    """The foreachBatch function of a heartbeat stream: clean rows, latest state per device (a late one never replaces a newer), event log, unknown users.

    ``read`` and ``write`` take a table's name (devices, device_events, users). Writing devices and users replaces the table; writing
    device_events replaces the rows of the batch_id that its rows have (``replace_partitions``), so a batch that is delivered
    again, as after a failure, leaves every table as the first time.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        clean = normalize_heartbeat(batch).persist()
        devices = read("devices")
        write("devices", upsert_last(devices.unionByName(clean.select(*devices.columns)), ["device_id"], ["created_at"]))
        write("device_events", clean.select("device_id", F.lit("heartbeat").alias("event_type"), "created_at", F.lit(batch_id).alias("batch_id")))
        users = read("users")
        new = clean.filter("user_id is not null").groupBy("user_id").agg(F.min("created_at").alias("created_at")).withColumn("display_name", F.col("user_id").cast("string"))
        write("users", insert_if_absent(users, new, "user_id"))
        clean.unpersist()

    return apply


def heartbeat_stream(stream: DataFrame, checkpoint: str, read: Callable[[str], DataFrame], write: Callable[[str, DataFrame], None]):
    """Start the heartbeat stream over what there is; returns the query."""
    return stream.writeStream.foreachBatch(heartbeat_batch(read, write)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_clocks(events: DataFrame, voice: Column, voice_gap: int = 60, link_gap: int = 300, late: str = "10 minutes") -> DataFrame:
    """(device_id, clock, started_at, ended_at, n): runs of a device's events (device_id, at), on a stream or a batch.

    Two clocks run side by side: without a ``voice`` event for ``voice_gap`` seconds a device goes to standby, without any event for
    ``link_gap`` its link is dead; ended_at is that moment. An event exactly a gap later begins a new run. On a stream a run
    is emitted once the watermark, ``late`` behind the latest event, is past its end; events behind the watermark are dropped.
    """

    def runs(rows: DataFrame, clock: str, gap: int) -> DataFrame:
        # windows that touch are merged: a microsecond less keeps an event at exactly the gap apart
        window = F.session_window("at", f"{gap * 1_000_000 - 1} microseconds")
        found = rows.groupBy("device_id", window.alias("run")).agg(F.count("*").alias("n"))
        return found.select("device_id", F.lit(clock).alias("clock"), F.col("run.start").alias("started_at"), (F.col("run.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("ended_at"), "n")

    timed = events.withWatermark("at", late)
    return runs(timed.filter(voice), "standby", voice_gap).unionByName(runs(timed, "dead", link_gap))

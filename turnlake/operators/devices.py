"""Device state: heartbeats, status, commands, firmware, sessions. Times are epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .analytics import device_status


def list_devices(devices: DataFrame, now: int, kind: str = "all", online: int = 60, stale: int = 300) -> DataFrame:
    """Devices with their status, newest first; ``kind``: all, esp (no simulators), sim, online."""
    out = devices.withColumn("status", device_status(F.col("last_seen"), now, online, stale))
    chosen = {"all": F.lit(True), "esp": ~F.col("is_simulator"), "sim": F.col("is_simulator"), "online": F.col("status") == "online"}[kind]
    return out.filter(chosen).orderBy(F.desc("last_seen"), "device_id")


def pending_devices(devices: DataFrame, transport: str | None = None, limit: int = 50) -> DataFrame:
    """Devices that nobody has bound and that are no simulators, newest first."""
    out = devices.filter(F.col("bound_user_id").isNull() & ~F.col("is_simulator"))
    if transport:
        out = out.filter(F.col("transport") == transport)
    return out.orderBy(F.desc("last_seen"), "device_id").limit(limit)


def normalize_heartbeat(events: DataFrame, longest: int = 128, most: int = 32) -> DataFrame:
    """Trimmed and clipped ids, capabilities without blanks and repeats in their order, at most ``most``."""
    short = lambda c: F.substring(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), 1, longest)
    caps = F.slice(F.array_distinct(F.filter(F.transform(F.coalesce("capabilities", F.array()), lambda x: F.substring(F.trim(x), 1, longest)), lambda x: x.isNotNull() & (x != ""))), 1, most)
    return events.withColumns({"device_id": short("device_id"), "firmware": short("firmware"), "capabilities": caps})


def capability_fault(c: Column) -> Column:
    """What is wrong with a struct (sample_rate, frame_ms, width, height), or null."""
    return (
        F.when(c["sample_rate"].isNull() | (c["sample_rate"] != 16000), "invalid_sample_rate")
        .when(c["frame_ms"].isNull() | ~c["frame_ms"].isin(20, 40), "invalid_frame_ms")
        .when(c["width"].isNull() | c["height"].isNull() | (c["width"] != 320) | (c["height"] != 240), "invalid_display")
    )


def command_status(commands: DataFrame, updates: DataFrame, now: int) -> DataFrame:
    """Commands (command_id, status, sent_at) after ``updates`` (command_id, status); the first send or delivery stamps sent_at."""
    new = updates.select("command_id", F.col("status").alias("new_status"))
    sent = F.when(F.col("new_status").isin("sent", "delivered"), F.coalesce("sent_at", F.lit(now).cast("long"))).otherwise(F.col("sent_at"))
    return commands.join(new, "command_id", "left").withColumn("sent_at", sent).withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def version_array(version: Column) -> Column:
    """The digit runs of a version as numbers."""
    return F.transform(F.regexp_extract_all(F.coalesce(version, F.lit("")), F.lit(r"(\d+)"), 1), lambda x: x.cast("long"))


def _padded(v: Column, size: Column) -> Column:
    return F.concat(v, F.array_repeat(F.lit(0).cast("long"), size - F.size(v)))


def is_newer(candidate: Column, current: Column) -> Column:
    """Whether a version is strictly newer, number by number, the shorter one padded with zeros."""
    a, b = version_array(candidate), version_array(current)
    size = F.greatest(F.size(a), F.size(b))
    return _padded(a, size) > _padded(b, size)


def firmware_eligible(devices: DataFrame, builds: DataFrame, width: int = 8) -> DataFrame:
    """(device_id, version, new_version, filename): per device the newest build of its model that is strictly newer.

    The newest build of each model is found first, so a model with most of the devices meets one row.
    """
    key = _padded(version_array(F.col("version")), F.lit(width))
    newest = builds.withColumn("key", key).withColumn("r", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("key"), F.desc("filename")))).filter("r = 1")
    newest = newest.select("model", F.col("version").alias("new_version"), "filename")
    return devices.join(newest, "model").filter(is_newer(F.col("new_version"), F.col("version"))).select("device_id", "version", "new_version", "filename")


def turn_totals(sessions: DataFrame) -> DataFrame:
    """(device_id, sessions, turns)."""
    return sessions.groupBy("device_id").agg(F.count("*").alias("sessions"), F.sum("turn_count").alias("turns"))


def playback_state(acked: Column, sent: Column) -> Column:
    """What the acknowledgement says, else whether it was sent at all."""
    return F.coalesce(acked, F.when(sent, "sent_unconfirmed").otherwise("not_sent"))


def session_log(events: DataFrame, opens: str = "signup", turn: str = "purchase", fails: str = "error") -> DataFrame:
    """Per session (session_id, created_at, event_type, ...) its start, end, duration, turns, and last error time."""
    return events.groupBy("session_id").agg(
        F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"), (F.max("created_at") - F.min("created_at")).alias("duration"),
        F.count_if(F.col("event_type") == turn).alias("turn_count"), F.max(F.when(F.col("event_type") == fails, F.col("created_at"))).alias("last_error_at"),
        F.count_if(F.col("event_type") == opens).alias("opens"),
    )


def drop_stale_frames(frames: DataFrame) -> DataFrame:
    """Frames (session_id, sequence, arrival) whose sequence is larger than every earlier one of their session."""
    w = Window.partitionBy("session_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("best", F.max("sequence").over(w)).filter("best is null or sequence > best").drop("best")


def decode_frame(packet: Column, session: Column, magic: bytes = b"ESP1") -> Column:
    """Struct (reason, session_id, sequence, payload) of a packet: magic, a byte with the session's length, the session, a
    big-endian unsigned 32-bit sequence, the payload. ``reason`` is null for a good packet of ``session``."""
    m = len(magic)
    size = F.conv(F.hex(F.substring(packet, m + 1, 1)), 16, 10).cast("int")
    name = F.decode(F.substring(packet, F.lit(m + 2), size), "UTF-8")
    number = F.conv(F.hex(F.substring(packet, F.lit(m + 2) + size, F.lit(4))), 16, 10).cast("long")
    body = F.substring(packet, F.lit(m + 6) + size, F.length(packet))
    reason = (
        F.when(packet.isNull() | (F.length(packet) < m + 6), "too_short").when(F.substring(packet, 1, m) != F.lit(magic), "bad_magic")
        .when(F.length(packet) < F.lit(m + 5) + size, "truncated").when(name != session, "wrong_session")
    )
    ok = reason.isNull()
    return F.struct(reason.alias("reason"), F.when(ok, name).alias("session_id"), F.when(ok, number).alias("sequence"), F.when(ok, body).alias("payload"))


def live_state(events: DataFrame, now: int) -> DataFrame:
    """(device_id, event_type, value, age) of each device's latest event."""
    latest = F.max_by(F.struct("event_type", "value", "created_at"), F.struct("created_at", "event_id"))
    return events.groupBy("device_id").agg(latest.alias("s")).select("device_id", "s.event_type", "s.value", F.greatest(F.lit(now) - F.col("s.created_at"), F.lit(0)).alias("age"))


def event_counts(events: DataFrame, seconds: int = 86_400) -> DataFrame:
    """(bucket, event_type, n) of tumbling windows of ``seconds``."""
    return events.groupBy((F.floor(F.col("created_at") / seconds) * seconds).alias("bucket"), "event_type").agg(F.count("*").alias("n"))


def standby_sessions(events: DataFrame, voice: Column, gap: int) -> DataFrame:
    """(device_id, started_at, ended_at, n) of runs of events, ``voice`` ones, that are less than ``gap`` seconds apart."""
    spoken = events.filter(voice)
    w = Window.partitionBy("device_id").orderBy("created_at", "event_id")
    new = F.when(F.col("created_at") - F.lag("created_at").over(w) < gap, 0).otherwise(1)
    runs = spoken.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("device_id", "run").agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"), F.count("*").alias("n")).drop("run")


def sample_quality(samples: DataFrame, rate: float, seconds: float = 3.0) -> DataFrame:
    """(session_id, clipping, rms, duration, fault) of sessions' 16-bit samples, one to a row (session_id, sample): what ``audio_quality``
    says of them as an array, by sums that combine before the shuffle. Null samples are no samples."""
    x = F.col("sample").cast("double")
    sums = samples.filter("sample is not null").groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.abs(x) >= 32760).alias("clipped"), F.sum(x * x).alias("square"))
    out = sums.select("session_id", (F.col("clipped") / F.col("n")).alias("clipping"), F.sqrt(F.col("square") / F.col("n")).alias("rms"), (F.col("n") / rate).alias("duration"))
    return out.withColumn("fault", F.when(F.col("duration") < seconds, "too_short").when(F.col("clipping") > 0.01, "clipped").when(F.col("rms") < 150, "too_quiet"))


def sample_features(samples: DataFrame, span: int = 4096) -> DataFrame:
    """(session_id, mean, rms, zero_crossing_rate) of samples (session_id, arrival, sample), as ``acoustic_features`` has them.

    Sign changes are counted within spans of ``span`` arrivals; then only the spans' ends, a row for each, meet in order. So no task holds
    a session, however long. ``arrival`` is a number that orders the samples of a session.
    """
    x, negative = F.col("sample").cast("double"), F.col("sample") < 0
    part = ["session_id", "part"]
    rows = samples.filter("sample is not null").withColumn("part", F.floor(F.col("arrival") / span))
    before = F.lag(negative).over(Window.partitionBy(*part).orderBy("arrival"))
    ends = rows.withColumn("turned", F.coalesce((before != negative).cast("int"), F.lit(0))).groupBy(*part).agg(
        F.count("*").alias("n"), F.sum(x).alias("sum"), F.sum(x * x).alias("square"), F.sum("turned").alias("turned"), F.min_by(negative, "arrival").alias("first"), F.max_by(negative, "arrival").alias("last")
    )
    across = F.coalesce((F.lag("last").over(Window.partitionBy("session_id").orderBy("part")) != F.col("first")).cast("int"), F.lit(0))
    sums = ends.withColumn("across", across).groupBy("session_id").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("square").alias("square"), F.sum(F.col("turned") + F.col("across")).alias("turned"))
    return sums.select("session_id", (F.col("sum") / F.col("n")).alias("mean"), F.sqrt(F.col("square") / F.col("n")).alias("rms"), (F.col("turned") / F.col("n")).alias("zero_crossing_rate"))

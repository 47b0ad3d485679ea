"""Queries of streaming operators as batches over the test tables; tests run the same over streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch, table
from ..sources.tables import replace_partitions
from ..streaming import flows, machines
from .analytics import ATTENTION, NEGATIVE, POSITIVE, URGENT, labelled
from .base import query
from .fixtures import NOW, duck, view


@query("t03_sequence_dedup", duck("SELECT session_id, sequence, arrival FROM (SELECT *, max(sequence) OVER (PARTITION BY session_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM frames) WHERE best IS NULL OR sequence > best", "frames"))
def sequence_dedup(spark, sf):
    return machines.run_batch(view(spark, sf, "frames"), "session_id", "arrival", machines.sequence_step, machines.SEQUENCE)


#: All sessions step to their next frame together.
_SEGMENTS = """fr AS (SELECT session_id, arrival, coalesce(rms, 0.0) AS level, row_number() OVER (PARTITION BY session_id ORDER BY arrival) AS r FROM frames),
s AS (SELECT session_id, CAST(0 AS BIGINT) AS r, CAST([] AS DOUBLE[]) AS levels, 0 AS voiced, 0 AS silent, 0 AS frames, CAST(NULL AS BIGINT) AS began, false AS spoke, CAST(NULL AS BIGINT) AS arrival, CAST(NULL AS STRUCT(started BIGINT, frames INTEGER, spoke BOOLEAN, reason VARCHAR)) AS cut FROM (SELECT DISTINCT session_id FROM frames)
  UNION ALL SELECT session_id, r, CASE WHEN reason IS NULL THEN levels ELSE [] END, CASE WHEN reason IS NULL THEN voiced ELSE 0 END, CASE WHEN reason IS NULL THEN silent ELSE 0 END, CASE WHEN reason IS NULL THEN frames ELSE 0 END, CASE WHEN reason IS NULL THEN began END, reason IS NULL AND spoke, arrival,
    CASE WHEN reason IS NOT NULL AND frames * 60 >= 400 THEN {'started': began, 'frames': frames, 'spoke': spoke, 'reason': reason} END
  FROM (SELECT *, CASE WHEN spoke AND silent >= 800 THEN 'silence' WHEN frames * 60 >= 20000 THEN 'max_length' END AS reason
    FROM (SELECT session_id, r, levels, voiced + 60 * loud AS voiced, CASE loud WHEN 1 THEN 0 ELSE silent + 60 END AS silent, frames + 1 AS frames, coalesce(began, arrival) AS began, spoke OR voiced + 60 * loud >= 240 AS spoke, arrival
      FROM (SELECT *, CASE WHEN level >= least(greatest(2.5 * list_min(levels), 100.0), 300.0) THEN 1 ELSE 0 END AS loud
        FROM (SELECT s.session_id, fr.r, (s.levels || [fr.level])[-50:] AS levels, voiced, silent, frames, began, spoke, fr.arrival, fr.level FROM s JOIN fr ON fr.session_id = s.session_id AND fr.r = s.r + 1))))),
e AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY r DESC) AS back FROM s)"""


@query("t04_endpoint_detect", duck(f"WITH RECURSIVE {_SEGMENTS} SELECT session_id, cut.started AS started, arrival AS ended, CAST(cut.frames AS BIGINT) AS frames, cut.spoke AS spoke, cut.reason AS reason FROM s WHERE cut IS NOT NULL UNION ALL SELECT session_id, began, arrival, CAST(frames AS BIGINT), true, 'flush' FROM e WHERE back = 1 AND spoke AND frames * 60 >= 400", "frames"))
def endpoint_detect(spark, sf):
    return machines.run_batch(view(spark, sf, "frames"), "session_id", "arrival", machines.endpoint_step(100.0), machines.SEGMENTS, machines.endpoint_finish())


def lifecycle(spark, sf):
    h = view(spark, sf, "heartbeats")
    kind = F.when(F.col("event_type") == "signup", "begin").when(F.col("event_type") == "error", "cancel").otherwise("complete")
    return h.filter("event_type in ('signup', 'error', 'purchase')").select(F.col("device_id").alias("session_id"), (F.col("event_id") % 3).alias("turn_id"), (F.col("created_at") * 100_000 + F.col("event_id")).alias("ts"), kind.alias("kind"))


_LIFECYCLE = """e AS (SELECT device_id AS session_id, event_id % 3 AS turn_id, created_at * 100000 + event_id AS ts, CASE event_type WHEN 'signup' THEN 'begin' WHEN 'error' THEN 'cancel' ELSE 'complete' END AS kind FROM heartbeats WHERE event_type IN ('signup', 'error', 'purchase')),
l AS (SELECT session_id, list({'open': CAST(NULL AS BIGINT), 'out': CAST([] AS STRUCT(turn_id BIGINT, ts BIGINT, outcome VARCHAR)[]), 'turn_id': turn_id, 'ts': ts, 'kind': kind} ORDER BY ts) AS l FROM e GROUP BY session_id),
r AS (SELECT session_id, list_reduce([{'open': CAST(NULL AS BIGINT), 'out': CAST([] AS STRUCT(turn_id BIGINT, ts BIGINT, outcome VARCHAR)[]), 'turn_id': CAST(0 AS BIGINT), 'ts': CAST(0 AS BIGINT), 'kind': ''}] || l, lambda a, x: {
  'open': CASE WHEN x.kind = 'begin' THEN coalesce(a.open, x.turn_id) WHEN a.open = x.turn_id THEN NULL ELSE a.open END,
  'out': a.out || [{'turn_id': x.turn_id, 'ts': x.ts, 'outcome': CASE WHEN x.kind = 'begin' THEN CASE WHEN a.open IS NULL THEN 'begun' ELSE 'rejected_busy' END WHEN a.open = x.turn_id THEN CASE x.kind WHEN 'cancel' THEN 'cancelled' ELSE 'completed' END ELSE 'ignored' END}],
  'turn_id': x.turn_id, 'ts': x.ts, 'kind': x.kind}).out AS out FROM l),
o AS (SELECT session_id, unnest(out) AS o FROM r)"""


@query("t05_turn_lifecycle", duck(f"WITH {_LIFECYCLE} SELECT session_id, o.turn_id AS turn_id, o.ts AS ts, o.outcome AS outcome FROM o", "heartbeats"))
def turn_lifecycle(spark, sf):
    return machines.run_batch(lifecycle(spark, sf), "session_id", "ts", machines.lifecycle_step, machines.LIFECYCLE)


@query("w19_turn_lifecycle", duck(f"WITH {_LIFECYCLE} SELECT o.outcome AS outcome, count(*) AS n FROM o GROUP BY 1", "heartbeats"))
def turn_outcomes(spark, sf):
    return turn_lifecycle(spark, sf).groupBy("outcome").agg(F.count("*").alias("n"))


@query("t08_sentence_stream")
def sentence_stream(spark, sf):
    t = view(spark, sf, "turns")
    parts = t.select(F.col("turn_id").alias("request_id"), F.posexplode(F.split("response_text", "(?<= )")).alias("chunk_no", "delta"), F.size(F.split("response_text", "(?<= )")).alias("n"))
    return machines.run_batch(parts.withColumn("last", F.col("chunk_no") == F.col("n") - 1), "request_id", "chunk_no", machines.sentence_step(), machines.SENTENCES)


def enrollments(spark, sf):
    h = view(spark, sf, "heartbeats")
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "cancel").otherwise("sample")
    return h.select(F.col("device_id").alias("user_id"), (F.col("event_id") % 2).alias("enrollment_id"), F.col("created_at").alias("ts"), kind.alias("kind"), (F.col("created_at") * 1_000_000 + F.col("event_id")).alias("seq"))


_ROW = "STRUCT(enrollment_id BIGINT, ts BIGINT, status VARCHAR)"
_ENROLLMENTS = f"""e AS (SELECT device_id AS user_id, event_id % 2 AS one, created_at AS t, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'cancel' ELSE 'sample' END AS kind, created_at * 1000000 + event_id AS seq FROM heartbeats),
l AS (SELECT user_id, list({{'id': CAST(NULL AS BIGINT), 'since': CAST(NULL AS BIGINT), 'out': CAST([] AS {_ROW}[]), 'one': one, 't': t, 'kind': kind}} ORDER BY seq) AS l FROM e GROUP BY user_id),
r AS (SELECT user_id, list_reduce([{{'id': CAST(NULL AS BIGINT), 'since': CAST(NULL AS BIGINT), 'out': CAST([] AS {_ROW}[]), 'one': CAST(0 AS BIGINT), 't': CAST(0 AS BIGINT), 'kind': ''}}] || l, lambda a, x: {{
  'id': CASE WHEN x.kind = 'start' THEN x.one WHEN x.t > a.since + 86400 OR (a.id = x.one AND x.kind <> 'sample') THEN NULL ELSE a.id END,
  'since': CASE WHEN x.kind = 'start' THEN x.t WHEN x.t > a.since + 86400 OR (a.id = x.one AND x.kind <> 'sample') THEN NULL ELSE a.since END,
  'out': a.out || CASE WHEN a.id IS NOT NULL AND x.t > a.since + 86400 THEN [{{'enrollment_id': a.id, 'ts': a.since + 86400, 'status': 'expired'}}] WHEN a.id IS NOT NULL AND x.kind = 'start' THEN [{{'enrollment_id': a.id, 'ts': x.t, 'status': 'cancelled'}}] ELSE [] END
    || CASE WHEN x.kind = 'start' THEN [{{'enrollment_id': x.one, 'ts': x.t, 'status': 'started'}}] WHEN a.id = x.one AND x.t <= a.since + 86400 THEN [{{'enrollment_id': x.one, 'ts': x.t, 'status': CASE x.kind WHEN 'sample' THEN 'sampled' WHEN 'complete' THEN 'completed' ELSE 'cancelled' END}}] ELSE [] END,
  'one': x.one, 't': x.t, 'kind': x.kind}}) AS r FROM l),
o AS (SELECT user_id, unnest(r.out || CASE WHEN r.id IS NOT NULL AND {NOW} > r.since + 86400 THEN [{{'enrollment_id': r.id, 'ts': r.since + 86400, 'status': 'expired'}}] ELSE [] END) AS o FROM r)"""


@query("t09_enrollment_state", duck(f"WITH {_ENROLLMENTS} SELECT user_id, o.enrollment_id AS enrollment_id, o.ts AS ts, o.status AS status FROM o", "heartbeats"))
def enrollment_state(spark, sf):
    return machines.run_batch(enrollments(spark, sf), "user_id", "seq", machines.enrollment_step(86_400), machines.ENROLLMENTS, machines.enrollment_finish(86_400, NOW))


_SAMPLES = "samples AS (SELECT vec_id AS sample_id, label AS user_id, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE vec_id % 4 + 1 END AS step, CASE label % 3 WHEN 0 THEN CAST([] AS BIGINT[]) WHEN 1 THEN [CAST(1 AS BIGINT)] ELSE [CAST(1 AS BIGINT), 3] END AS saved FROM embeddings)"
_ADMITTED = "STRUCT(sample_id BIGINT, step BIGINT, outcome VARCHAR, samples BIGINT)"


@query(
    "w18_admit_samples",
    f"""WITH {_SAMPLES}, l AS (SELECT user_id, first(saved) AS saved, list({{'saved': CAST([] AS BIGINT[]), 'out': CAST([] AS {_ADMITTED}[]), 'id': sample_id, 'step': step}} ORDER BY sample_id) AS l FROM samples GROUP BY user_id),
r AS (SELECT user_id, list_reduce([{{'saved': saved, 'out': CAST([] AS {_ADMITTED}[]), 'id': CAST(0 AS BIGINT), 'step': CAST(NULL AS BIGINT)}}] || l, lambda a, x: {{
  'saved': CASE WHEN coalesce(x.step, list_min(list_filter([1, 2, 3], lambda k: NOT list_contains(a.saved, k)))) = list_min(list_filter([1, 2, 3], lambda k: NOT list_contains(a.saved, k)))
    THEN a.saved || [CAST(list_min(list_filter([1, 2, 3], lambda k: NOT list_contains(a.saved, k))) AS BIGINT)] ELSE a.saved END,
  'out': a.out || [{{'sample_id': x.id, 'step': CAST(coalesce(x.step, list_min(list_filter([1, 2, 3], lambda k: NOT list_contains(a.saved, k)))) AS BIGINT),
    'outcome': CASE WHEN list_contains(a.saved, x.step) THEN 're_recorded' WHEN coalesce(x.step, list_min(list_filter([1, 2, 3], lambda k: NOT list_contains(a.saved, k)))) = list_min(list_filter([1, 2, 3], lambda k: NOT list_contains(a.saved, k))) THEN 'accepted' ELSE 'rejected' END,
    'samples': len(a.saved) + CASE WHEN coalesce(x.step, list_min(list_filter([1, 2, 3], lambda k: NOT list_contains(a.saved, k)))) = list_min(list_filter([1, 2, 3], lambda k: NOT list_contains(a.saved, k))) THEN 1 ELSE 0 END}}],
  'id': x.id, 'step': x.step}}).out AS out FROM l), o AS (SELECT user_id, unnest(out) AS o FROM r)
SELECT user_id, o.sample_id AS sample_id, o.step AS step, o.outcome AS outcome, o.samples AS samples FROM o""",
)
def admit_samples(spark, sf):
    v, label = F.col("vec_id"), F.col("label")
    saved = F.when(label % 3 == 0, F.array().cast("array<long>")).when(label % 3 == 1, F.array(F.lit(1).cast("long"))).otherwise(F.array(F.lit(1).cast("long"), F.lit(3).cast("long")))
    samples = table(spark, sf, "embeddings").select(label.cast("long").alias("user_id"), v.alias("sample_id"), F.when(v % 5 != 0, v % 4 + 1).alias("step"), saved.alias("saved"))
    return machines.run_batch(samples, "user_id", "sample_id", machines.admission_step(), machines.ADMISSIONS)


_RUNS = "SELECT device_id, '{clock}' AS clock, min(created_at) AS started_at, max(created_at) + {gap} AS ended_at, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY device_id ORDER BY created_at, event_id) AS run FROM (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY device_id ORDER BY created_at, event_id) < {gap} THEN 0 ELSE 1 END AS new FROM heartbeats WHERE {of})) GROUP BY device_id, run"


@query("t06_session_clocks", duck(_RUNS.format(clock="standby", gap=21_600, of="event_type IN ('click', 'purchase')") + " UNION ALL " + _RUNS.format(clock="dead", gap=86_400, of="true"), "heartbeats"))
def session_clocks(spark, sf):
    h = view(spark, sf, "heartbeats").withColumn("at", F.timestamp_seconds("created_at"))
    out = flows.session_clocks(h, F.col("event_type").isin("click", "purchase"), 21_600, 86_400)
    return out.withColumns({c: F.unix_seconds(c) for c in ("started_at", "ended_at")})


@query("t10_risk_alerts", duck("SELECT turn_id, CASE WHEN contains(lower(input_text), 'sad') OR contains(lower(input_text), 'great') THEN 'urgent' ELSE 'attention' END AS risk_level FROM turns WHERE contains(lower(input_text), 'sad') OR contains(lower(input_text), 'great') OR contains(lower(input_text), 'err')", "turns"))
def risk_alerts(spark, sf):
    return flows.risk_alerts(view(spark, sf, "turns"), NEGATIVE, POSITIVE, URGENT, ATTENTION).select("turn_id", "risk_level")


@query("t11_emotion_windows", duck("SELECT created_at // 86400 * 86400 AS window_start, CASE WHEN contains(lower(input_text), 'err') OR contains(lower(input_text), 'sad') THEN 'negative' WHEN contains(lower(input_text), 'the ') OR contains(lower(input_text), 'que') THEN 'positive' ELSE 'neutral' END AS emotion, count(*) AS n FROM turns GROUP BY ALL", "turns"))
def emotion_windows(spark, sf):
    out = flows.emotion_windows(labelled(spark, sf).withColumn("at", F.timestamp_seconds("created_at")))
    return out.withColumn("window_start", F.unix_seconds("window_start"))


@query("t12_idempotent_turns", duck("SELECT DISTINCT event_id // 3 AS request_id FROM heartbeats", "heartbeats"))
def idempotent_turns(spark, sf):
    h = view(spark, sf, "heartbeats").select(F.floor(F.col("event_id") / 3).alias("request_id"), F.timestamp_seconds("created_at").alias("at"))
    return flows.idempotent_turns(h).select("request_id")


@query("p09_validate_envelope", duck("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'missing_identity' WHEN event_id % 5 = 0 THEN 'unsupported_version' WHEN event_type = 'error' THEN 'unknown_type' END AS reason FROM heartbeats", "heartbeats"))
def validate_envelope(spark, sf):
    e = F.col("event_id")
    h = view(spark, sf, "heartbeats").select("event_id", F.col("event_type").alias("type"), F.when(e % 5 == 0, 2).otherwise(1).alias("version"), F.when(e % 7 != 0, F.col("device_id").cast("string")).alias("device_id"))
    return flows.validate_envelope(h, ("signup", "click", "view", "purchase")).select("event_id", "reason")


@query("t01_heartbeat_stream", duck("SELECT CAST(device_id AS VARCHAR) AS device_id, max(created_at) AS last_seen, count(*) AS n FROM heartbeats GROUP BY device_id", "heartbeats"))
def heartbeat_stream(spark, sf):
    """The heartbeat stream over the table's rows as they come in two files: devices as they stand then, with the number of their events."""
    root = scratch(spark, "heartbeats")
    h = view(spark, sf, "heartbeats").select("device_id", F.col("device_id").alias("user_id"), "created_at", "is_simulator")
    columns = {"firmware": "string", "ip": "string", "capabilities": "array<string>"}
    h = h.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in columns.items()))
    for part, rows in enumerate((h.filter("created_at % 2 = 0"), h.filter("created_at % 2 <> 0"))):
        rows.write.parquet(f"{root}/in/{part}")
    empty = {"devices": flows.normalize_heartbeat(h.limit(0)), "users": spark.createDataFrame([], "user_id long, display_name string, created_at long")}
    at = {}

    def read(name):
        return spark.read.parquet(at[name]) if name in at else empty[name]

    def write(name, df):
        if name == "device_events":
            replace_partitions(df, f"{root}/device_events", "batch_id")
            return
        path = f"{root}/{name}-{len(at)}-{scratch(spark, name).rsplit('-', 1)[1]}"
        df.write.parquet(path)
        at[name] = path

    stream = spark.readStream.schema(h.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    flows.heartbeat_stream(stream, f"{root}/checkpoint", read, write).awaitTermination()
    events = spark.read.parquet(f"{root}/device_events").groupBy("device_id").agg(F.count("*").alias("n"))
    return read("devices").select("device_id", F.col("created_at").alias("last_seen")).join(events, "device_id")

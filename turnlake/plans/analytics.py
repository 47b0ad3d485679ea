"""Queries of conversation analytics over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import analytics as A
from ..session import scratch
from ..sources.store import KeyedTable, insert_rows
from .base import ORACLE_SQL, query
from .fixtures import NOW, duck, view

#: Lexicons that the test texts hold.
NEGATIVE, POSITIVE = ("err", "sad"), ("the ", "que")
SELF_HARM, VIOLENCE, ATTENTION = ("sad",), ("great",), ("err",)
URGENT, NEGATIONS = SELF_HARM + VIOLENCE, ("un", "no")
#: Turns start on the first of January, one hour a conversation.
TURNS_NOW = 1_704_067_200 + 12 * 86_400

_EMOTION = "CASE WHEN contains(lower(input_text), 'err') OR contains(lower(input_text), 'sad') THEN 'negative' WHEN contains(lower(input_text), 'the ') OR contains(lower(input_text), 'que') THEN 'positive' ELSE 'neutral' END"
_RISK = "CASE WHEN contains(lower(input_text), 'sad') OR contains(lower(input_text), 'great') THEN 'urgent' WHEN contains(lower(input_text), 'err') THEN 'attention' ELSE 'none' END"
_LABELLED = f"labelled AS (SELECT *, {_EMOTION} AS emotion, {_RISK} AS risk_level FROM turns)"
_NAMES = "names(emotion) AS (VALUES ('positive'), ('neutral'), ('negative'))"
_DEVICES = "devices AS (SELECT device_id, max(created_at) AS last_seen, bool_or(is_simulator) AS is_simulator FROM heartbeats GROUP BY device_id)"


def labelled(spark, sf):
    return A.annotate_turns(view(spark, sf, "turns"), NEGATIVE, POSITIVE, URGENT, ATTENTION)


def devices(spark, sf):
    return view(spark, sf, "heartbeats").groupBy("device_id").agg(F.max("created_at").alias("last_seen"), F.bool_or("is_simulator").alias("is_simulator"))


@query("a01_emotion_distribution", duck(f"WITH {_LABELLED}, {_NAMES} SELECT emotion, count(turn_id) AS n FROM names FULL JOIN labelled USING (emotion) GROUP BY emotion", "turns"))
def emotion_distribution(spark, sf):
    return A.emotion_distribution(labelled(spark, sf))


@query("f02_emotion_of", duck(f"WITH {_LABELLED} SELECT turn_id, emotion FROM labelled", "turns"))
def emotion_of(spark, sf):
    return view(spark, sf, "turns").select("turn_id", L.emotion_of(F.col("input_text"), NEGATIVE, POSITIVE).alias("emotion"))


@query("f03_risk_of", duck(f"WITH {_LABELLED} SELECT turn_id, risk_level, array_to_string(list_filter(['sad', 'great', 'err'], lambda w: contains(lower(input_text), w)), ',') AS evidence FROM labelled", "turns"))
def risk_of(spark, sf):
    text = F.col("input_text")
    return view(spark, sf, "turns").select("turn_id", L.risk_level(text, URGENT, ATTENTION).alias("risk_level"), F.array_join(L.risk_evidence(text, URGENT, ATTENTION), ",").alias("evidence"))


_MODEL = "CASE CAST(seq % 5 AS INT) WHEN 0 THEN 'none' WHEN 1 THEN 'attention' WHEN 2 THEN 'urgent' WHEN 3 THEN NULL ELSE 'bogus' END"


@query("f04_merge_risk", duck(f"WITH {_LABELLED}, m AS (SELECT *, {_MODEL} AS model FROM (SELECT * REPLACE (turn_id AS seq) FROM labelled)), r AS (SELECT turn_id, list_position(['none','attention','urgent'], risk_level) AS a, CASE WHEN model IS NULL THEN 1 ELSE list_position(['none','attention','urgent'], model) END AS b FROM m) SELECT turn_id, CASE WHEN b IS NOT NULL THEN ['none','attention','urgent'][greatest(a, b)] END AS merged, CASE WHEN turn_id % 2 = 0 THEN 'ok' ELSE 'partial' END AS analysis_status FROM r", "turns"))
def merge_risk(spark, sf):
    t = labelled(spark, sf).withColumn("seq", F.col("turn_id"))
    return t.select("turn_id", L.merge_risk(F.col("risk_level"), F.expr(_MODEL)).alias("merged"), L.analysis_status(F.when(F.col("turn_id") % 2 == 0, "ok")).alias("analysis_status"))


@query("f05_first_disclosure", duck("""WITH p(phrase, ord) AS (VALUES ('sad', 0), ('great', 1), ('err', 2)),
spots AS (SELECT turn_id, phrase, ord, i, lower(input_text) AS t FROM turns, p, LATERAL (SELECT unnest(generate_series(1, greatest(length(input_text) - length(phrase) + 1, 1))) AS i) WHERE substr(lower(input_text), i, length(phrase)) = phrase),
free AS (SELECT * FROM spots WHERE NOT contains(substr(t, greatest(i - 2, 1), least(2, i - 1)), 'un') AND NOT contains(substr(t, greatest(i - 2, 1), least(2, i - 1)), 'no')),
f AS (SELECT turn_id, arg_min(phrase, i * 10 + ord) AS phrase FROM free GROUP BY turn_id)
SELECT turn_id, coalesce(phrase, '') AS phrase FROM turns LEFT JOIN f USING (turn_id)""", "turns"))
def first_disclosure(spark, sf):
    return view(spark, sf, "turns").select("turn_id", L.first_disclosure(F.col("input_text"), URGENT + ATTENTION, NEGATIONS).alias("phrase"))


@query("f07_canonical_label", duck("SELECT turn_id, CASE turn_id % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' WHEN 2 THEN 'neutral' END AS label FROM turns", "turns"))
def canonical_label(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, (" Sad ", "happy", "Neutral", "???"))), (F.col("turn_id") % 4 + 1).cast("int"))
    return view(spark, sf, "turns").select("turn_id", L.canonical_label(raw, {"sad": "negative", "happy": "positive", "neutral": "neutral"}).alias("label"))


@query("u03_risk_evidence_union", duck(f"WITH {_LABELLED}, e AS (SELECT turn_id, list_filter(['sad', 'great', 'err'], lambda w: contains(lower(input_text), w)) AS own FROM labelled) SELECT turn_id, array_to_string(own || list_filter(['err', 'model'], lambda w: NOT list_contains(own, w)), ',') AS evidence FROM e", "turns"))
def evidence_union(spark, sf):
    own = L.risk_evidence(F.col("input_text"), URGENT, ATTENTION)
    return view(spark, sf, "turns").select("turn_id", F.array_join(L.evidence_union(own, F.array(F.lit("err"), F.lit("model"))), ",").alias("evidence"))


@query("r11_annotate_turns", duck(f"WITH {_LABELLED} SELECT turn_id, emotion, risk_level, array_to_string(list_filter(['sad', 'great', 'err'], lambda w: contains(lower(input_text), w)), ',') AS evidence, risk_level <> 'none' AS needs_review FROM labelled", "turns"))
def annotate_turns(spark, sf):
    return labelled(spark, sf).select("turn_id", "emotion", "risk_level", F.array_join("evidence", ",").alias("evidence"), "needs_review")


@query("r12_persist_turns", duck(f"WITH {_LABELLED} SELECT 'conversations' AS target, count(*) AS n FROM labelled UNION ALL SELECT 'emotion_events', count(*) FROM labelled UNION ALL SELECT 'conversation_analysis', count(*) FROM labelled UNION ALL SELECT 'risk_events', count(*) FROM labelled WHERE risk_level <> 'none'", "turns"))
def persist_turns(spark, sf):
    out = None
    for name, df in A.persist_turns(labelled(spark, sf)).items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("target"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("r12_persist_stored", ORACLE_SQL["r12_persist_turns"])
def persist_stored(spark, sf):
    """Turns in stored tables, half of them delivered twice: a turn is kept once."""
    turns, out = labelled(spark, sf), None
    for name, rows in A.persist_turns(turns).items():
        kept = KeyedTable(scratch(spark, name), rows.schema, ["conversation_id"], 16)
        for part in (rows.filter("conversation_id % 2 = 0"), rows):
            kept.merge(part, insert_rows("conversation_id"))
        row = kept.read(spark).agg(F.count("*").alias("n")).select(F.lit(name).alias("target"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("a02_dashboard_summary", duck(f"WITH {_LABELLED}, {_DEVICES}, s AS (SELECT *, CASE WHEN greatest({NOW} - last_seen, 0) < 3600 THEN 'online' WHEN greatest({NOW} - last_seen, 0) <= 86400 THEN 'stale' ELSE 'offline' END AS status FROM devices) SELECT (SELECT count(*) FROM labelled) AS conversation_count, (SELECT count(DISTINCT user_id) FROM labelled) AS active_user_count, (SELECT count(*) FROM labelled WHERE emotion='positive') AS n_positive, (SELECT count(*) FROM labelled WHERE emotion='neutral') AS n_neutral, (SELECT count(*) FROM labelled WHERE emotion='negative') AS n_negative, (SELECT CAST(round_even(avg(latency_ms), 0) AS BIGINT) FROM analysis) AS average_latency_ms, count(*) FILTER (status='online') AS n_online, count(*) FILTER (status='stale') AS n_stale, count(*) FILTER (status='offline') AS n_offline, bool_or(is_simulator) AS simulator_mode FROM s", "turns", "analysis", "heartbeats"))
def dashboard_summary(spark, sf):
    return A.dashboard_summary(labelled(spark, sf), view(spark, sf, "analysis"), devices(spark, sf), NOW, 3600, 86400)


_GRID = f"days AS (SELECT unnest(range({TURNS_NOW // 86400 - 6}, {TURNS_NOW // 86400 + 1})) AS day)"


@query("a03_emotion_trend", duck(f"WITH {_LABELLED}, {_NAMES}, {_GRID}, u AS (SELECT DISTINCT user_id FROM turns), c AS (SELECT user_id, created_at // 86400 AS day, emotion, count(*) AS n FROM labelled GROUP BY ALL) SELECT user_id, CAST(DATE '1970-01-01' + CAST(day AS INT) AS VARCHAR) AS date, emotion, coalesce(n, 0) AS n FROM u CROSS JOIN days CROSS JOIN names LEFT JOIN c USING (user_id, day, emotion)", "turns"))
def emotion_trend(spark, sf):
    t = labelled(spark, sf)
    return A.emotion_trend(t, t, TURNS_NOW, 7)


@query("a04_analytics_overview", duck(f"""WITH {_LABELLED}, {_NAMES}, {_GRID}, w AS (SELECT * FROM labelled WHERE created_at >= {TURNS_NOW - 7 * 86400})
SELECT 'conversation_count' AS metric, count(*) AS value FROM w
UNION ALL SELECT 'emotion:' || emotion, count(turn_id) FROM names LEFT JOIN w USING (emotion) GROUP BY emotion
UNION ALL SELECT 'average_latency_ms', CAST(round_even(avg(latency_ms), 0) AS BIGINT) FROM analysis WHERE created_at >= {TURNS_NOW - 7 * 86400}
UNION ALL SELECT 'risk:' || l, count(turn_id) FROM (VALUES ('attention'), ('urgent')) v(l) LEFT JOIN w ON w.risk_level = l GROUP BY l
UNION ALL SELECT 'day:' || CAST(DATE '1970-01-01' + CAST(day AS INT) AS VARCHAR), count(turn_id) FROM days LEFT JOIN labelled ON created_at // 86400 = day GROUP BY day""", "turns", "analysis"))
def analytics_overview(spark, sf):
    t = labelled(spark, sf)
    return A.analytics_overview(t, view(spark, sf, "analysis"), A.persist_turns(t)["risk_events"], TURNS_NOW, 7)


@query("a05_user_summary", duck(f"""WITH {_LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, session_id DESC, seq DESC) AS rn FROM labelled),
k AS (SELECT user_id, max(list_position(['none','attention','urgent'], risk_level)) AS rank FROM r WHERE rn <= 50 GROUP BY user_id)
SELECT user_id, count(*) FILTER (created_at >= {TURNS_NOW - 7 * 86400} AND emotion='positive') AS n_positive, count(*) FILTER (created_at >= {TURNS_NOW - 7 * 86400} AND emotion='neutral') AS n_neutral, count(*) FILTER (created_at >= {TURNS_NOW - 7 * 86400} AND emotion='negative') AS n_negative, ['none','attention','urgent'][any_value(rank)] AS risk_level, any_value(rank) > 1 AS needs_review FROM labelled JOIN k USING (user_id) GROUP BY user_id""", "turns"))
def user_summary(spark, sf):
    return A.user_summary(labelled(spark, sf), TURNS_NOW, "week", URGENT, ATTENTION)


@query("a06_risk_counts", duck(f"WITH {_LABELLED} SELECT l AS risk_level, count(turn_id) AS n FROM (VALUES ('attention'), ('urgent')) v(l) LEFT JOIN labelled ON risk_level = l AND created_at >= {TURNS_NOW - 10 * 86400} GROUP BY l", "turns"))
def risk_counts(spark, sf):
    return A.risk_counts(A.persist_turns(labelled(spark, sf))["risk_events"], TURNS_NOW - 10 * 86400)


@query("a10_dominant_emotion", duck(f"WITH {_LABELLED}, c AS (SELECT user_id, emotion, count(*) AS n FROM labelled GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, emotion) AS rn FROM c) SELECT user_id, emotion, n, greatest(round_even(100.0 * n / total, 0), 4.0) AS share FROM r WHERE rn = 1", "turns"))
def dominant_emotion(spark, sf):
    return A.dominant_emotion(labelled(spark, sf))


@query("p04_search_users", duck("WITH f AS (SELECT * FROM users_v WHERE (CAST(user_id AS VARCHAR) ILIKE '%er#0000001%' OR display_name ILIKE '%er#0000001%') AND status = 'active') SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_at DESC, user_id LIMIT 20 OFFSET 20", "users_v"))
def search_users(spark, sf):
    return A.search_users(view(spark, sf, "users_v"), "er#0000001", "active", page=2, size=20)


@query("p05_recent", duck("SELECT device_id, event_id, event_type, created_at FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY created_at DESC, event_id DESC) AS r FROM heartbeats) WHERE r <= 5", "heartbeats"))
def recent(spark, sf):
    return A.recent(view(spark, sf, "heartbeats"), [F.desc("created_at"), F.desc("event_id")], 5, "device_id").select("device_id", "event_id", "event_type", "created_at")


@query("p12_review_risk", duck(f"WITH {_LABELLED} SELECT turn_id AS conversation_id, CASE turn_id % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'dismissed' ELSE 'unreviewed' END AS review_status FROM labelled WHERE risk_level <> 'none'", "turns"))
def review_risk(spark, sf):
    risks = A.persist_turns(labelled(spark, sf))["risk_events"]
    status = F.when(F.col("conversation_id") % 4 == 0, "resolved").when(F.col("conversation_id") % 4 == 1, "dismissed").when(F.col("conversation_id") % 4 == 2, "nonsense")
    return A.review_risk(risks, risks.select("conversation_id", status.alias("review_status"))).select("conversation_id", "review_status")

"""Queries of identity, governance and keyed merges over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import governance as G
from ..operators import identity as I
from ..operators import upsert as U
from ..session import scratch
from ..sources import store as W
from ..sources import tables as S
from ..sources.store import KeyedTable
from .base import ORACLE_SQL, query
from .fixtures import NOW, duck, view

_COS = "round(list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])), 6)"
_ACTIVE = "act AS (SELECT t.* FROM templates t JOIN users_v u ON t.user_id = u.user_id WHERE t.active AND u.status = 'active' AND t.model_version = 'v1')"
_BEST = f"{_ACTIVE}, s AS (SELECT probe_id, user_id, max({_COS}) AS score FROM probes p, act t GROUP BY ALL), b AS (SELECT probe_id, user_id, score AS best, coalesce(lead(score) OVER w, 0.0) AS second, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY probe_id ORDER BY score DESC, user_id)), best AS (SELECT probe_id, user_id, best, second, CASE WHEN best < 0.55 THEN 'unknown' WHEN round(best - second, 6) < 0.05 THEN 'ambiguous' ELSE 'accepted' END AS decision FROM b WHERE r = 1)"


def frames(spark, sf):
    return view(spark, sf, "probes"), view(spark, sf, "templates"), view(spark, sf, "users_v")


@query("j01_active_templates", duck(f"WITH {_ACTIVE} SELECT template_id, user_id FROM act", "templates", "users_v"))
def active_templates(spark, sf):
    _, t, u = frames(spark, sf)
    return I.active_templates(t, u, "v1").select("template_id", "user_id")


@query("j02_verify_claim", duck("WITH c AS (SELECT template_id, CASE WHEN template_id % 4 = 0 THEN user_id + 1 ELSE user_id END AS user_id FROM templates) SELECT c.* FROM c JOIN templates t USING (template_id) WHERE t.active AND t.user_id = c.user_id", "templates"))
def verify_claim(spark, sf):
    t = view(spark, sf, "templates")
    claims = t.select("template_id", F.when(F.col("template_id") % 4 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"), "model_version")
    return I.verify_claim(claims, t).select("template_id", "user_id")


@query("j07_identify", duck(f"WITH {_ACTIVE} SELECT probe_id, t.user_id, template_id, {_COS} AS score FROM probes p, act t", "probes", "templates", "users_v"))
def identify(spark, sf):
    p, t, u = frames(spark, sf)
    return I.identify(p, I.active_templates(t, u, "v1"))


@query("w08_best_second", duck(f"WITH {_BEST} SELECT probe_id, user_id, best, second FROM best", "probes", "templates", "users_v"))
def best_second(spark, sf):
    p, t, u = frames(spark, sf)
    return I.best_second(I.nearest_users(p, I.active_templates(t, u, "v1")))


@query("f18_classify_scores", duck(f"WITH {_BEST} SELECT probe_id, decision FROM best", "probes", "templates", "users_v"))
def classify_scores(spark, sf):
    p, t, u = frames(spark, sf)
    b = I.best_second(I.nearest_users(p, I.active_templates(t, u, "v1")))
    return b.select("probe_id", I.classify_scores(F.col("best"), F.col("second")).alias("decision"))


@query("f19_identity_gate", duck("SELECT turn_id, CASE WHEN turn_id % 2 = 0 THEN 'unknown' ELSE 'accepted' END AS decision FROM turns", "turns"))
def identity_gate(spark, sf):
    return view(spark, sf, "turns").select("turn_id", I.identity_gate(F.col("turn_id") % 2 == 0).alias("decision"))


@query("r15_identify_speakers", duck(f"WITH {_BEST} SELECT probe_id, CASE WHEN decision = 'accepted' THEN user_id END AS user_id, best, second, decision FROM best", "probes", "templates", "users_v"))
def identify_speakers(spark, sf):
    return I.identify_speakers(*frames(spark, sf), "v1")


@query("j09_resolve_user", duck("SELECT turn_id, session_id % 11 AS device_id, CASE WHEN turn_id % 3 = 0 THEN user_id WHEN session_id % 11 % 2 = 0 THEN session_id % 11 + 100 ELSE -1 END AS resolved_user, CASE WHEN turn_id % 3 = 0 THEN 'voiceprint' WHEN session_id % 11 % 2 = 0 THEN 'binding' ELSE 'default' END AS resolved_by FROM turns", "turns"))
def resolve_user(spark, sf):
    t = view(spark, sf, "turns").withColumn("device_id", F.col("session_id") % 11)
    speakers = t.select("turn_id", "user_id", F.when(F.col("turn_id") % 3 == 0, "accepted").otherwise("unknown").alias("decision"))
    bindings = t.select("device_id").distinct().select("device_id", F.when(F.col("device_id") % 2 == 0, F.col("device_id") + 100).alias("bound_user_id"))
    return I.resolve_user(t.select("turn_id", "device_id"), speakers, bindings, -1)


@query("a12_centroid", duck("WITH e AS (SELECT user_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM templates WHERE active), m AS (SELECT user_id, pos, avg(CAST(x AS DOUBLE)) AS mean, count(*) AS n FROM e GROUP BY ALL), s AS (SELECT user_id, sqrt(sum(mean * mean)) AS size FROM m GROUP BY 1) SELECT user_id, max(n) AS n, round(max(mean / size) FILTER (pos = 1), 6) AS first, round(sum(mean / size * pos), 5) AS mark FROM m JOIN s USING (user_id) GROUP BY user_id HAVING max(n) >= 3", "templates"))
def centroid(spark, sf):
    c = I.centroid(view(spark, sf, "templates").filter("active"))
    mark = F.aggregate(F.zip_with("centroid", F.sequence(F.lit(1), F.size("centroid")), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return c.select("user_id", "n", F.round(F.col("centroid")[0], 6).alias("first"), F.round(mark, 5).alias("mark"))


@query("w18_next_enrollment_step", duck("WITH s AS (SELECT user_id, 1 + template_id % (1 + user_id % 3) AS step FROM templates) SELECT user_id, (SELECT min(x) FROM (VALUES (1), (2), (3)) v(x) WHERE x NOT IN (SELECT step FROM s s2 WHERE s2.user_id = s.user_id)) AS next_step FROM s GROUP BY user_id", "templates"))
def next_enrollment_step(spark, sf):
    return I.next_enrollment_step(view(spark, sf, "templates").withColumn("step", F.expr("1 + template_id % (1 + user_id % 3)")))


@query("r16_enroll", duck("WITH s AS (SELECT * REPLACE (1 + template_id % (2 + user_id % 2) AS step) FROM templates), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, step ORDER BY template_id DESC) AS r FROM s) WHERE r = 1), ready AS (SELECT user_id FROM l GROUP BY 1 HAVING count(*) = 3) SELECT user_id, template_id, active AND user_id NOT IN (SELECT user_id FROM ready) AS active FROM templates UNION ALL SELECT user_id, -template_id, true FROM l WHERE user_id IN (SELECT user_id FROM ready)", "templates"))
def enroll(spark, sf):
    t = view(spark, sf, "templates")
    samples = t.select("user_id", F.expr("1 + template_id % (2 + user_id % 2)").alias("step"), F.col("template_id").alias("seq"), "embedding")
    return I.enroll(samples, t).select("user_id", "template_id", "active")


@query("j03_drop_tombstoned", duck("SELECT turn_id FROM turns WHERE user_id NOT IN (SELECT user_id FROM deleted_users) AND user_id NOT IN (SELECT user_id FROM users_v WHERE status <> 'active')", "turns", "users_v", "deleted_users"))
def drop_tombstoned(spark, sf):
    return G.drop_tombstoned(view(spark, sf, "turns"), view(spark, sf, "users_v"), view(spark, sf, "deleted_users")).select("turn_id")


@query("w04_latest_consent", duck("WITH l AS (SELECT user_id, arg_max(granted, [decided_at, seq]) AS granted FROM consents GROUP BY 1) SELECT user_id, coalesce(granted, false) AS granted FROM users_v LEFT JOIN l USING (user_id)", "users_v", "consents"))
def latest_consent(spark, sf):
    return G.latest_consent(view(spark, sf, "consents"), view(spark, sf, "users_v"), "memory")


@query("w05_consent_asof", duck("WITH t AS (SELECT event_id AS turn_id, device_id AS user_id, created_at FROM heartbeats), c AS (SELECT user_id, decided_at, arg_max(granted, seq) AS granted FROM consents GROUP BY ALL) SELECT turn_id, t.user_id, coalesce(granted, false) AS granted FROM t ASOF LEFT JOIN c ON t.user_id = c.user_id AND t.created_at >= c.decided_at", "heartbeats", "consents"))
def consent_asof(spark, sf):
    t = view(spark, sf, "heartbeats").select(F.col("event_id").alias("turn_id"), F.col("device_id").alias("user_id"), "created_at")
    return G.consent_asof(t, view(spark, sf, "consents"), "memory")


@query("p08_active_sessions", duck(f"SELECT event_id AS session_id FROM heartbeats WHERE event_id % 4 <> 0 AND created_at + 86400 * 3 > {NOW}", "heartbeats"))
def active_sessions(spark, sf):
    h = view(spark, sf, "heartbeats").select(F.col("event_id").alias("session_id"), (F.col("created_at") + 3 * 86400).alias("expires_at"), F.when(F.col("event_id") % 4 == 0, F.col("created_at")).alias("revoked_at"))
    return G.active_sessions(h, NOW).select("session_id")


@query("w17_failed_login_bursts", duck("WITH a AS (SELECT event_id AS attempt_id, device_id % 5 AS client, device_id % 3 AS actor_id, created_at AS ts, event_type = 'signup' AS ok FROM heartbeats), i AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY client, actor_id ORDER BY ts, attempt_id ROWS UNBOUNDED PRECEDING) AS island FROM a), f AS (SELECT *, count(*) OVER (PARTITION BY client, actor_id, island ORDER BY ts RANGE BETWEEN 14400 PRECEDING AND CURRENT ROW) AS n FROM i WHERE NOT ok) SELECT client, actor_id, attempt_id, ts, n FROM f WHERE n >= 5", "heartbeats"))
def failed_login_bursts(spark, sf):
    h = view(spark, sf, "heartbeats")
    a = h.select(F.col("event_id").alias("attempt_id"), (F.col("device_id") % 5).alias("client"), (F.col("device_id") % 3).alias("actor_id"), F.col("created_at").alias("ts"), (F.col("event_type") == "signup").alias("ok"))
    return G.failed_login_bursts(a, 5, 14_400)


def owned(spark, sf):
    return {"turns": view(spark, sf, "turns"), "memory": view(spark, sf, "memory"), "templates": view(spark, sf, "templates"), "heartbeats": view(spark, sf, "heartbeats")}, {"memory": "owner_user_id", "heartbeats": "device_id"}


@query("a18_erasure_counts", duck("SELECT 'turns' AS table_name, count(*) AS removed FROM turns WHERE user_id IN (SELECT user_id FROM deleted_users) UNION ALL SELECT 'memory', count(*) FROM memory WHERE owner_user_id IN (SELECT user_id FROM deleted_users) UNION ALL SELECT 'templates', count(*) FROM templates WHERE user_id IN (SELECT user_id FROM deleted_users) UNION ALL SELECT 'heartbeats', count(*) FROM heartbeats WHERE device_id IN (SELECT user_id FROM deleted_users)", "turns", "memory", "templates", "heartbeats", "deleted_users"))
def erasure_counts(spark, sf):
    tables, keys = owned(spark, sf)
    return G.erasure_counts(tables, view(spark, sf, "deleted_users"), keys)


@query("r17_erase_user", duck("SELECT 'memory' AS table_name, chunk_id AS id FROM memory WHERE owner_user_id IS NULL OR owner_user_id NOT IN (SELECT user_id FROM deleted_users) UNION ALL SELECT 'turns', turn_id FROM turns WHERE user_id NOT IN (SELECT user_id FROM deleted_users)", "turns", "memory", "deleted_users"))
def erase_user(spark, sf):
    tables, keys = owned(spark, sf)
    left = G.erase_user(tables, view(spark, sf, "deleted_users"), keys)
    return left["memory"].select(F.lit("memory").alias("table_name"), F.col("chunk_id").alias("id")).unionByName(left["turns"].select(F.lit("turns").alias("table_name"), F.col("turn_id").alias("id")))


@query("s12_manifest_check", duck("SELECT 'doc' || doc_id AS name, CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'mismatched' END AS fault FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0"))
def manifest_check(spark, sf):
    from ..session import table

    d = table(spark, sf, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("name"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    manifest = d.select("name", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("content", 256)).alias("sha256"))
    return G.manifest_check(d.filter("doc_id % 7 <> 0"), manifest)


@query("m01_upsert_last", duck("SELECT device_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY created_at DESC, event_id DESC) AS r FROM heartbeats) WHERE r = 1", "heartbeats"))
def upsert_last(spark, sf):
    return U.upsert_last(view(spark, sf, "heartbeats"), ["device_id"], ["created_at", "event_id"]).select("device_id", "event_id", "event_type")


_SIDES = "old AS (SELECT device_id, arg_min(event_type, [created_at, event_id]) AS board, min(created_at) AS first_seen, 'v1' AS firmware FROM heartbeats WHERE event_id % 2 = 0 GROUP BY 1), new AS (SELECT device_id, CASE WHEN device_id % 3 = 0 THEN '' ELSE 'b2' END AS board, max(created_at) AS first_seen, 'v2' AS firmware FROM heartbeats WHERE device_id % 4 = 0 OR device_id > 120 GROUP BY 1)"


def sides(spark, sf):
    h = view(spark, sf, "heartbeats")
    old = h.filter("event_id % 2 = 0").groupBy("device_id").agg(F.min_by("event_type", F.struct("created_at", "event_id")).alias("board"), F.min("created_at").alias("first_seen")).withColumn("firmware", F.lit("v1"))
    new = h.filter("device_id % 4 = 0 or device_id > 120").groupBy("device_id").agg(F.max("created_at").alias("first_seen")).select("device_id", F.when(F.col("device_id") % 3 == 0, "").otherwise("b2").alias("board"), "first_seen", F.lit("v2").alias("firmware"))
    return old, new


@query("m02_upsert_coalesce", duck(f"WITH {_SIDES} SELECT device_id, coalesce(nullif(new.board, ''), old.board) AS board, coalesce(old.first_seen, new.first_seen) AS first_seen, coalesce(new.firmware, old.firmware) AS firmware FROM old FULL JOIN new USING (device_id)", "heartbeats"))
def upsert_coalesce(spark, sf):
    return U.upsert_coalesce(*sides(spark, sf), "device_id", ["board"], ["first_seen"])


@query("m03_insert_if_absent", duck(f"WITH {_SIDES} SELECT * FROM old UNION ALL SELECT * FROM new WHERE device_id NOT IN (SELECT device_id FROM old)", "heartbeats"))
def insert_if_absent(spark, sf):
    return U.insert_if_absent(*sides(spark, sf), "device_id")


@query("m04_insert_or_replace", duck(f"WITH {_SIDES} SELECT * FROM new UNION ALL SELECT * FROM old WHERE device_id NOT IN (SELECT device_id FROM new)", "heartbeats"))
def insert_or_replace(spark, sf):
    return U.insert_or_replace(*sides(spark, sf), "device_id", ["first_seen"])


@query("m05_profile_patch", duck(f"SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'renamed' ELSE display_name END AS display_name, CASE WHEN user_id % 4 = 0 THEN 'disabled' ELSE status END AS status, CASE WHEN user_id % 5 = 0 THEN 40 ELSE 30 END AS age_at_registration, CASE WHEN user_id % 5 = 0 THEN {NOW} ELSE created_at END AS age_recorded_at FROM users_v", "users_v"))
def profile_patch(spark, sf):
    return U.profile_patch(*patched(spark, sf), NOW)


def patched(spark, sf):
    u, i = view(spark, sf, "users_v"), F.col("user_id")
    u = u.select("user_id", "display_name", "status", F.lit(30).alias("age_at_registration"), F.col("created_at").alias("age_recorded_at"))
    return u, u.select("user_id", F.when(i % 3 == 0, "renamed").alias("new_name"), F.when(i % 4 == 0, "disabled").when(i % 4 == 1, "bogus").alias("new_status"), F.when(i % 5 == 0, 40).when(i % 5 == 1, 30).alias("new_age"))


def stored(spark, old, keys, *merges):
    """What a stored table holds after it was filled with ``old`` and each of the ``merges`` (changes, combine) was made."""
    kept = KeyedTable(scratch(spark, "keyed"), old.schema, keys, 16)
    kept.merge(old, W.replace_groups(*keys))
    for changes, combine in merges:
        kept.merge(changes, combine)
    return kept.read(spark)


@query("m01_upsert_stored", ORACLE_SQL["m01_upsert_last"])
def upsert_stored(spark, sf):
    h = view(spark, sf, "heartbeats").select("device_id", "event_id", "event_type", "created_at")
    parts = [h.filter(F.col("event_id") % 3 == k) for k in range(3)]
    last = W.upsert_rows(["device_id"], ["created_at", "event_id"])
    return stored(spark, h.limit(0), ["device_id"], *((part, last) for part in parts), (parts[0], last)).select("device_id", "event_id", "event_type")


@query("m02_coalesce_stored", ORACLE_SQL["m02_upsert_coalesce"])
def coalesce_stored(spark, sf):
    old, new = sides(spark, sf)
    return stored(spark, old, ["device_id"], (new, W.coalesce_rows("device_id", ["board"], ["first_seen"])))


@query("m03_insert_stored", ORACLE_SQL["m03_insert_if_absent"])
def insert_stored(spark, sf):
    old, new = sides(spark, sf)
    return stored(spark, old, ["device_id"], (new, W.insert_rows("device_id")))


@query("m04_replace_stored", ORACLE_SQL["m04_insert_or_replace"])
def replace_stored(spark, sf):
    old, new = sides(spark, sf)
    return stored(spark, old, ["device_id"], (new, W.replace_rows("device_id", ["first_seen"])))


@query("m05_patch_stored", ORACLE_SQL["m05_profile_patch"])
def patch_stored(spark, sf):
    users, patches = patched(spark, sf)
    return stored(spark, users, ["user_id"], (patches, W.patch_rows(NOW)))


@query("s01_conform", duck("SELECT user_id, display_name, 'unset' AS gender, CAST(NULL AS INT) AS age FROM users_v", "users_v"))
def conform(spark, sf):
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("display_name", T.StringType()), T.StructField("gender", T.StringType()), T.StructField("age", T.IntegerType())])
    return S.conform(view(spark, sf, "users_v"), schema, {"gender": "unset"})


@query("s02_parse_json_cols", duck("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM heartbeats", "heartbeats"))
def parse_json_cols(spark, sf):
    raw = F.when(F.col("event_id") % 9 == 0, "{broken").otherwise(F.col("props"))
    parsed = S.parse_json(raw, "k long", F.named_struct(F.lit("k"), F.lit(-1).cast("long")))
    return view(spark, sf, "heartbeats").withColumn("p", parsed).select("event_id", F.coalesce("p.k", F.lit(-1)).alias("k"))


@query("s07_vector_codecs", duck("SELECT template_id, CAST(len(embedding) * 4 AS INTEGER) AS bytes, CAST(len(embedding) // 32 AS INTEGER) AS windows, true AS same FROM templates", "templates"))
def vector_codecs(spark, sf):
    t = view(spark, sf, "templates").select("template_id", "embedding")
    both = S.decode_vec(S.encode_vec(t, "embedding", "packed"), "packed", "again", 32)
    return both.select("template_id", F.length("packed").alias("bytes"), F.size("again").alias("windows"), F.flatten("again").eqNullSafe(F.col("embedding")).alias("same"))

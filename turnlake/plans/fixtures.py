"""Views of the test tables in the shapes that operators take, in Spark SQL and in DuckDB SQL.

A view is one SQL text; the few things that the dialects spell differently are written as ``{macros}``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import conform, table

#: 2024-01-31T00:00:00Z, just after the last event of the test data.
NOW = 1_706_659_200
DAY = 86_400

_SPARK = {
    "EPOCH_TS": "unix_timestamp(CAST(ts AS TIMESTAMP))",
    "STR": "STRING",
    "LINES": "(SELECT doc_id, p.pos, p.col AS line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) p AS pos, col) l",
    "PIECES": "(SELECT doc_id, p.pos, p.col AS piece FROM documents LATERAL VIEW posexplode(regexp_extract_all(text, '(?s).{{1,280}}', 0)) p AS pos, col) l",
}
_DUCK = {
    "EPOCH_TS": "CAST(floor(epoch(ts)) AS BIGINT)",
    "STR": "VARCHAR",
    "LINES": "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) l",
    "PIECES": "(SELECT doc_id, unnest(regexp_extract_all(text, '(?s).{1,280}')) AS piece, generate_subscripts(regexp_extract_all(text, '(?s).{1,280}'), 1) - 1 AS pos FROM documents) l",
}

VIEWS: dict[str, str] = {
    "turns": "SELECT u.conv_id*1000+u.turn AS turn_id, u.conv_id % 17 AS user_id, u.conv_id AS session_id, u.turn AS seq, 1704067200 + u.conv_id*3600 AS created_at, u.text AS input_text, a.text AS response_text FROM conversations u JOIN conversations a ON a.conv_id=u.conv_id AND a.turn=u.turn+1 AND a.role='assistant' WHERE u.role='user'",
    "users_v": "SELECT c_custkey AS user_id, c_name AS display_name, 1672531200 + c_custkey*86400 AS created_at, CASE WHEN c_custkey % 7 = 0 THEN 'disabled' ELSE 'active' END AS status, CASE WHEN c_custkey % 3 = 0 THEN 'yue-HK' WHEN c_custkey % 3 = 1 THEN 'zh-CN' ELSE 'en-US' END AS preferred_language FROM customer",
    "deleted_users": "SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 13 = 5",
    "heartbeats": "SELECT event_id, user_id AS device_id, {EPOCH_TS} AS created_at, event_type, value, props, user_id % 5 = 0 AS is_simulator FROM events",
    "analysis": "SELECT event_id AS conversation_id, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(floor(value*10) AS INT) END AS latency_ms, {EPOCH_TS} AS created_at FROM events WHERE event_type IN ('view','click')",
    # a document's whole text, in pieces of what one memory may hold, one memory each
    "memory": "SELECT chunk_id, owner_user_id, text, split_part(text, '.', 1) AS probe, CASE x % 8 WHEN 0 THEN 'name' WHEN 1 THEN 'skill' WHEN 2 THEN 'home' WHEN 3 THEN 'pet' ELSE NULL END AS slot_key, CASE x % 3 WHEN 0 THEN 'slot' WHEN 1 THEN 'hot' ELSE 'cold' END AS tier, ((x*37) % 100)/100.0E0 AS importance, x % 7 AS hits, 1704067200 - (x % 60)*86400 AS created_at, CASE WHEN x % 3 = 0 THEN NULL ELSE 1704067200 - (x % 20)*86400 END AS last_hit_at, x % 4 <> 0 AS approved, x % 9 <> 0 AS active, embedding FROM (SELECT e.vec_id*4096+l.pos AS chunk_id, e.vec_id+l.pos AS x, CASE WHEN e.label=0 THEN NULL ELSE e.label END AS owner_user_id, l.piece AS text, e.embedding FROM embeddings e JOIN {PIECES} ON l.doc_id=e.vec_id) m",
    "templates": "SELECT vec_id AS template_id, label AS user_id, vec_id % 3 + 1 AS step, vec_id % 6 <> 0 AS active, 'v1' AS model_version, embedding FROM embeddings WHERE vec_id % 10 <> 0",
    "probes": "SELECT vec_id AS probe_id, label AS true_user, embedding FROM embeddings WHERE vec_id % 10 = 0",
    "consents": "SELECT event_id AS consent_id, user_id, 'memory' AS purpose, value > 200 AS granted, {EPOCH_TS} AS decided_at, event_id AS seq FROM events WHERE event_type='signup'",
    "cases": "SELECT item_id, text AS question, text FROM benchmark",
    "case_docs": "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "md_lines": "SELECT doc_id, pos, CASE WHEN pos % 9 = 0 THEN '## ' || line WHEN pos % 9 IN (3,6) THEN '### ' || line WHEN pos % 5 = 4 THEN line || ' <sub>p' || CAST(pos AS {STR}) || '</sub>' ELSE line END AS line FROM {LINES} WHERE length(trim(line))>0",
    "ocr_lines": "SELECT doc_id, CAST(floor(pos/6) AS INT)+1 AS page, CASE WHEN pos % 6 = 0 THEN 'Running head ' || CAST(doc_id % 3 AS {STR}) ELSE line END AS text, 40 + (pos % 6)*150 AS y, CASE WHEN pos % 4 = 1 THEN 80 ELSE 60 END AS x, length(line)*12 AS width, 1000 AS page_height, 800 AS page_width FROM {LINES}",
    "frames": "SELECT user_id AS session_id, (event_id*7919) % 1000 AS sequence, event_id AS arrival, value AS rms FROM events",
}
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame."""
    conform(spark)
    text = VIEWS[name].format(**_SPARK)
    frames = {t: table(spark, sf_dir, t) for t in _TABLES if re.search(rf"\b{t}\b", text)}
    if name == "memory":  # documents beyond the vectors' ids join none of them and need not be dealt
        ids = frames["embeddings"].agg({"vec_id": "min"}).first()[0], frames["embeddings"].agg({"vec_id": "max"}).first()[0]
        frames["documents"] = frames["documents"].filter(frames["documents"]["doc_id"].between(*ids))
    for t in frames:
        text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **frames)


def duck(body: str, *views: str) -> str:
    """``body`` as DuckDB SQL with the named views before it."""
    ctes = ", ".join(f"{v} AS ({VIEWS[v].format(**_DUCK)})" for v in views)
    if not ctes:
        return body
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[14:]}"
    return f"WITH {ctes}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {ctes} {body}"

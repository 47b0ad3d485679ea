"""Streams give what their batch twins give; machines on hand-computed rows."""

import random

import pytest
from pyspark.sql import functions as F

from turnlake.streaming import flows
from turnlake.streaming import machines as S


def stream(spark, tmp_path, df, name, order):
    """The rows of ``df`` as a stream of two files, in order."""
    rows = df.orderBy(order).collect()
    for i, part in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 :])):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / str(i)))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / name))


def collected(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(map(str, df.sparkSession.table(name).collect()))


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([(s, (n * 7919) % 200, n, float((n * 37) % 900)) for s in (1, 2) for n in range(120)], "session_id long, sequence long, arrival long, rms double")


@pytest.mark.parametrize(("step", "schema"), [(S.sequence_step, S.SEQUENCE), (S.endpoint_step(100.0), S.SEGMENTS)])
def test_stream_equals_batch(spark, tmp_path, frames, step, schema):
    batch = S.run_batch(frames, "session_id", "arrival", step, schema)
    name = f"out_{len(schema)}"
    live = S.run_stream(stream(spark, tmp_path, frames, "in", "arrival"), "session_id", "arrival", step, schema)
    assert collected(live, name) == sorted(map(str, batch.collect()))


def run(step, rows):
    state, out = {}, []
    for row in rows:
        state, emitted = step(state, row)
        out += emitted
    return out


def test_endpoint_needs_voice_then_silence():
    level = lambda x, n: [x] * n
    rms = [*level(50, 10), *level(2000, 8), *level(50, 20), *level(2000, 3), *level(50, 30)]
    rows = [{"session_id": 1, "arrival": i, "rms": x} for i, x in enumerate(rms)]
    assert run(S.endpoint_step(), rows) == [(1, 0, 31, 32, True, "silence")]


def naive_segments(levels, threshold):
    """Every rule by its own words, over the levels of one session."""
    out, start = [], 0
    while start < len(levels):
        for end in range(start, len(levels)):
            seen = levels[start : end + 1]
            gates = [min(max(threshold, 2.5 * min(seen[max(0, i - 49) : i + 1])), 3 * threshold) for i in range(len(seen))]
            loud = [x >= g for x, g in zip(seen, gates, strict=True)]
            spoke = sum(loud) * 60 >= 240
            quiet = next((i for i, x in enumerate(reversed(loud)) if x), len(loud)) * 60
            reason = "silence" if spoke and quiet >= 800 else "max_length" if len(seen) * 60 >= 20_000 else "flush" if end == len(levels) - 1 and spoke and len(seen) * 60 >= 400 else None
            if reason:
                out.append((start, end, len(seen), spoke, reason))
                break
        else:
            break
        start = end + 1
    return out


def test_endpoints_against_every_prefix(spark):
    rng = random.Random(5)
    sessions = {k: [float(rng.choice((0, 40, 100, 250, 299, 300, 900)) if k % 2 else rng.random() ** 4 * 900) for _ in range(60 + 90 * k)] for k in range(6)} | {None: [300.0] * 30}
    sessions[9] = [10.0] * 700
    rows = [(k, i, x) for k, levels in sessions.items() for i, x in enumerate(levels)]
    df = spark.createDataFrame(rows, "session_id long, arrival long, rms double").repartition(5)
    got = sorted((str(r.session_id), r.started, r.ended, r.frames, r.spoke, r.reason) for r in S.run_batch(df, "session_id", "arrival", S.endpoint_step(), S.SEGMENTS, S.endpoint_finish()).collect())
    assert got == sorted((str(k), *s) for k, levels in sessions.items() for s in naive_segments(levels, 300.0))
    assert {r[5] for r in got} == {"silence", "max_length", "flush"}


def test_a_second_begin_is_rejected():
    rows = [{"session_id": 1, "turn_id": t, "ts": i, "kind": k} for i, (t, k) in enumerate([(1, "begin"), (2, "begin"), (2, "complete"), (1, "complete"), (2, "begin"), (2, "cancel")])]
    assert [r[3] for r in run(S.lifecycle_step, rows)] == ["begun", "rejected_busy", "ignored", "completed", "begun", "cancelled"]


def spoken(deltas, **options):
    rows = [{"request_id": 1, "chunk_no": i, "delta": d, "last": i == len(deltas) - 1} for i, d in enumerate(deltas)]
    out = run(S.sentence_step(**options), rows)
    assert [n for _, n, _ in out] == list(range(len(out)))
    return [p for _, _, p in out]


@pytest.mark.parametrize(("deltas", "pieces"), [
    (["Hi! How a", "re you? ok", '. ```json {"a', '": 1}``` no'], ["Hi!", "How are you?", "ok."]),
    (["🙂", "好", "。今天的天气{真}不错…"], ["好。", "今天的天气{真}不错…"]),
    (["  😎\u200d ok!", " yes"], ["ok!", "yes"]),
    (["Fine.", " v1.5 is out"], ["Fine. v1.5 is out"]),  # a full stop ends nothing
    (["A good day! {\"emo", "tion\": 1, \"x\": 2}"], ["A good day!"]),
    (["One two three! So `", "``json"], ["One two three!", "So"]),
    (["Yes! No! Really so! Short! Longer one!"], ["Yes!", "No!", "Really so!", "Short!", "Longer one!"]),
    (["Yes! ", "No! Now it is longer! x"], ["Yes!", "No! Now it is longer!", "x"]),
    (["", None, "end"], ["end"]),
    (["\"risk\": 1"], []),
])
def test_sentences_of_deltas(deltas, pieces):
    assert spoken(deltas) == pieces


def test_long_runs_are_cut_at_soft_breaks():
    text = "one two three, four five six seven eight nine ten eleven twelve"
    assert spoken([text], longest=24) == ["one two three, four", "five six seven eight", "nine ten eleven twelve"]
    assert spoken(["x" * 100], longest=30) == ["x" * 30, "x" * 30, "x" * 30, "x" * 10]
    assert spoken(["ab " + "x" * 60], longest=30)[0] == "ab " + "x" * 27  # a break too near the start is none


def test_deltas_of_one_character_say_the_same_words():
    text = "🙂Good morning, how are you? It is a fine day; let us go out and see the long river, the old bridge and the town! ok ```json"
    assert "".join(spoken(list(text))).replace(" ", "") == "".join(spoken([text])).replace(" ", "")


def test_enrolments_expire_and_replace():
    rows = [{"user_id": 1, "enrollment_id": e, "ts": t, "kind": k} for e, t, k in [(1, 0, "start"), (1, 10, "sample"), (2, 20, "start"), (1, 30, "complete"), (2, 700, "sample"), (3, 800, "start"), (3, 900, "complete")]]
    assert [(r[1], r[3]) for r in run(S.enrollment_step(), rows)] == [(1, "started"), (1, "sampled"), (1, "cancelled"), (2, "started"), (2, "expired"), (3, "started"), (3, "completed")]


def test_duplicates_within_the_watermark_go(spark, tmp_path):
    df = spark.createDataFrame([(1, 10), (1, 20), (2, 30), (2, 40)], "request_id long, t long").withColumn("at", F.timestamp_seconds("t"))
    assert len(collected(flows.idempotent_turns(stream(spark, tmp_path, df, "dup", "t")), "dup")) == 2


def test_heartbeats_reach_three_tables(spark, tmp_path):
    df = spark.createDataFrame([(" d1 ", "u1", 5, ["a", "a", " "]), ("d1", "u1", 9, ["b"]), ("d2", None, 7, [])], "device_id string, user_id string, created_at long, capabilities array<string>").withColumn("firmware", F.lit("v1"))
    held = {
        "devices": spark.createDataFrame([("d1", "old", 1)], "device_id string, firmware string, created_at long"),
        "users": spark.createDataFrame([("u0", 0, "u0")], "user_id string, created_at long, display_name string"), "device_events": None,
    }

    def write(name, frame):
        rows = frame.collect()
        if name == "device_events" and held[name] is not None:
            rows = held[name].collect() + rows
        held[name] = spark.createDataFrame(rows, frame.schema)

    flows.heartbeat_stream(stream(spark, tmp_path, df, "hb", "created_at"), str(tmp_path / "cp"), held.__getitem__, write).awaitTermination(120)
    assert sorted((r.device_id, r.created_at) for r in held["devices"].collect()) == [("d1", 9), ("d2", 7)]
    assert held["device_events"].count() == 3 and sorted(r.user_id for r in held["users"].collect()) == ["u0", "u1"]


def with_clock(spark, tmp_path, rows, schema, name, late="0 seconds"):
    """``rows`` of three micro-batches, with event time ``at`` from ts and a watermark."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / name / str(i)))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / name))
    live = live.withColumn("at", F.timestamp_seconds("ts"))
    return live.withWatermark("at", late) if late else live


def test_a_silent_user_s_enrolment_expires_by_the_watermark(spark, tmp_path):
    schema = "user_id long, enrollment_id long, ts long, kind string"
    parts = [[(1, 1, 100, "start"), (2, 7, 100, "start"), (3, 5, 650, "start")], [(2, 7, 300, "complete"), (1, 1, 200, "sample")], [(9, 9, 5000, "start")], [(3, 5, 90, "sample"), (9, 9, 5001, "sample")]]
    live = S.run_stream(with_clock(spark, tmp_path, parts, schema, "en"), "user_id", "ts", S.enrollment_step(), S.ENROLLMENTS, S.enrollment_deadline(), S.enrollment_finish())
    batch = spark.createDataFrame([r for part in parts for r in part if r != (3, 5, 90, "sample")], schema)
    # rows behind the watermark are dropped; of the rest the stream says what the batch does with the watermark as its now
    want = S.run_batch(batch, "user_id", "ts", S.enrollment_step(), S.ENROLLMENTS, S.enrollment_finish(now=5001)).collect()
    got = collected(live, "enrolments")
    assert got == sorted(map(str, want)) and sum("expired" in x for x in got) == 2


def test_an_open_segment_is_flushed_by_the_watermark(spark, tmp_path):
    schema = "session_id long, ts long, rms double"
    talk = [(1, 100 + t, 900.0) for t in range(10)] + [(2, 100 + t, 10.0) for t in range(10)]
    parts = [talk, [(3, 2000, 900.0)], [(3, 2001, 900.0)]]
    live = with_clock(spark, tmp_path, parts, schema, "seg").withColumn("arrival", F.col("ts"))
    live = S.run_stream(live, "session_id", "arrival", S.endpoint_step(), S.SEGMENTS, S.endpoint_deadline(), S.endpoint_finish())
    assert collected(live, "segments") == ["Row(session_id=1, started=100, ended=109, frames=10, spoke=True, reason='flush')"]


def test_session_clocks_of_a_stream_equal_the_batch(spark, tmp_path):
    schema, talk = "device_id long, ts long, voice boolean", F.col("voice")
    rng = random.Random(3)
    rows = [(d, t * 7, rng.random() < 0.4) for t in range(150) for d in (1, 2) if rng.random() < 0.12] + [(3, 0, True), (3, 60, True), (3, 119, True), (3, 419, False)]
    rows.sort(key=lambda r: r[1])
    parts = [rows[:20], rows[20:], [(9, 9000, True)], [(1, 5, True)], [(9, 9001, True)]]
    live = flows.session_clocks(with_clock(spark, tmp_path, parts, schema, "clk", None), talk, late="0 seconds")
    batch = flows.session_clocks(spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("ts")), talk)
    # the last events only move the watermark; the one of second 5 comes behind it and is dropped
    assert [x for x in collected(live, "clocks") if "device_id=9" not in x] == sorted(map(str, batch.collect()))
    own = sorted((r.clock, r.n, r.ended_at.timestamp() - r.started_at.timestamp()) for r in batch.filter("device_id = 3").collect())
    assert own == [("dead", 1, 300), ("dead", 3, 419), ("standby", 1, 60), ("standby", 2, 119)]


def test_a_heartbeat_batch_delivered_again_changes_nothing(spark, tmp_path):
    from turnlake.sources.tables import replace_partitions

    held = {"devices": spark.createDataFrame([("d0", "old", 1)], "device_id string, firmware string, created_at long"), "users": spark.createDataFrame([], "user_id string, created_at long, display_name string")}

    def write(name, frame):
        if name == "device_events":
            replace_partitions(frame, str(tmp_path / "events"), "batch_id")
        else:
            held[name] = spark.createDataFrame(frame.collect(), frame.schema)

    batch = lambda *rows: spark.createDataFrame(rows, "device_id string, user_id string, created_at long, capabilities array<string>").withColumn("firmware", F.lit("v1"))
    apply = flows.heartbeat_batch(held.__getitem__, write)
    first, second = batch(("d1", "u1", 5, []), ("d2", None, 6, [])), batch(("d1", "u2", 9, []))
    state = lambda: (sorted(map(str, held["devices"].collect())), sorted(map(str, held["users"].collect())), sorted((r.batch_id, r.device_id) for r in spark.read.parquet(str(tmp_path / "events")).collect()))
    apply(first, 0)
    apply(second, 1)
    once = state()
    apply(second, 1)
    assert state() == once and once[2] == [(0, "d1"), (0, "d2"), (1, "d1")]


def test_samples_are_admitted_in_order():
    rows = [(s, saved) for saved in ([],) for s in (2, 1, 1, 3, None, 3, None, 4)]
    out = run(S.admission_step(), [{"user_id": 1, "sample_id": i, "step": s, "saved": saved} for i, (s, saved) in enumerate(rows)])
    assert [(r[2], r[3], r[4]) for r in out] == [(2, "rejected", 0), (1, "accepted", 1), (1, "re_recorded", 1), (3, "rejected", 1), (2, "accepted", 2), (3, "accepted", 3), (None, "rejected", 3), (4, "rejected", 3)]
    gap = run(S.admission_step(), [{"user_id": 1, "sample_id": i, "step": s, "saved": [1, 3]} for i, s in enumerate((3, 2))])
    assert [r[3] for r in gap] == ["re_recorded", "accepted"]

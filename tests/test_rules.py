"""Hand-computed cases of rules that the test tables do not reach."""

import random

from pyspark.sql import functions as F

from turnlake.functions import commands as K
from turnlake.functions import dialogue as D
from turnlake.functions import hooks as H
from turnlake.functions import lexicon as L
from turnlake.functions import text as T
from turnlake.operators import corpus as C
from turnlake.operators import devices as V
from turnlake.operators import memory as M
from turnlake.operators import retrieval as R
from turnlake.sources import tables as S


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first().x


def test_squeeze_takes_ideographic_spaces(spark):
    assert one(spark, T.squeeze(F.col("t")), t="　a　 b\t\nc ") == "a b c"


def test_default_vocabularies(spark):
    assert one(spark, L.risk_level(F.col("t"), L.SELF_HARM + L.VIOLENCE, L.ATTENTION), t="我要跳樓") == "urgent"
    assert one(spark, L.risk_evidence(F.col("t"), L.SELF_HARM + L.VIOLENCE, L.ATTENTION), t="他打人") == ["打人", "打人"]
    assert one(spark, L.emotion_of(F.col("t")), t="I am HAPPY but sad") == "negative"


def test_first_disclosure_is_the_first_said_that_is_not_denied(spark):
    assert one(spark, L.first_disclosure(F.col("t"), ("跳樓", "不想活"), ("沒", "不會")), t="我不想活了，我想跳樓") == "不想活"
    assert one(spark, L.first_disclosure(F.col("t"), ("跳樓",), ("不會",)), t="我不會跳樓，真的跳樓") == "跳樓"
    assert one(spark, L.first_disclosure(F.col("t"), ("跳樓",), ("不會",)), t="我不會跳樓") == ""


def test_split_queries(spark):
    split = lambda t: one(spark, T.split_queries(F.col("t")), t=t)
    assert split("我叫什么？我几岁，喜欢什么") == ["我叫什么", "我几岁", "喜欢什么"]
    assert split("？！。") == [] and split(None) == []
    assert split(",".join("abcdefghij")) == [*"abcdefg", "h，i，j"]


def test_dialog_commands(spark):
    said = lambda t: one(spark, D.dialog_command(F.col("t")), t=t)
    assert said("停 止。") == "stop" and said("“再见！”") == "end" and said("停止播放") is None and said("") is None


def test_structured_block_is_the_last_valid_one(spark):
    text = 'Hi ```json {"emotion": "happy"}``` there {"risk": "none"} ```json\n{"risk": "urgent"}\n``` bye'
    got = one(spark, D.extract_structured(F.col("t")), t=text)
    assert got.block.risk == "urgent" and got.text == 'Hi ```json {"emotion": "happy"}``` there {"risk": "none"}  bye'
    assert one(spark, D.extract_structured(F.col("t")), t="no block {oops").text == "no block {oops"


def test_split_speech_cuts_long_runs(spark):
    pieces = one(spark, D.split_speech(F.col("t"), 10), t="**short!** " + "abcde fghij klmnopqrstuvwxyz")
    assert pieces == ["short!", "abcde fghi", "j klmnopqr", "stuvwxyz"]  # a break before the ninth letter is too early
    assert one(spark, D.split_speech(F.col("t"), 12), t="🙂 好…abcdefghi: jklmno") == ["好…", "abcdefghi:", "jklmno"]


def test_windows_keep_sentences_whole(spark):
    assert one(spark, C.split_windows(F.col("t"), 10, 3), t="一二三。四五六七八九十！甲乙丙丁戊己庚辛壬癸子丑？末。") == ["一二三。", "四五六七八九十！", "甲乙丙丁戊己庚辛壬癸子丑？"]


def test_exercise_reasons(spark):
    reason = lambda t: one(spark, C.is_exercise(F.col("t"), ("可以", "要"), "^(请|试|如何)", "^(为|请|根据)", "(请|如何)[^。！？]{0,40}[。？]"), t=t)
    assert reason("  ") == "empty" and reason("填（ ）和（ ）与（ ）") == "fill_in_blanks" and reason("|a| | | |") == "empty_table_to_fill"
    assert reason("如何沟通？为何如此？") == "questions_only" and reason("为老人拟定计划") == "task_instructions" and reason("你可以先倾听") is None


def test_heading_tree_invalidates_parents(spark):
    lines = ["intro", "# A", "### C", "x", "## B", "### D", "y", "# E", "### F"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, pos int, line string")
    paths = [r.section_path for r in C.heading_tree(df).orderBy("start").collect()]
    assert paths == ["A", "A › C", "A › B", "A › B › D", "E", "E › F"]
    sections = {r.section_path: r.body for r in C.sectionize(df).collect()}
    assert sections == {"前言": "intro", "A › C": "x", "A › B › D": "y"}


def test_pack_chunks_breaks_at_pages_and_length(spark):
    lines = ["# T", "aaaa", "bbbb <sub>p2</sub>", "cccc", "dd!ee!ff!gg!hh!ii!"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, pos int, line string")
    chunks = [(r.ord, r.page, r.text) for r in C.pack_chunks(C.sectionize(df), 10).orderBy("ord").collect()]
    assert chunks == [(0, None, "aaaa"), (1, 2, "bbbb cccc"), (2, 2, "dd!ee!ff!"), (3, 2, "gg!hh!ii!")]


def test_versions_compare_by_number(spark):
    newer = lambda a, b: one(spark, V.is_newer(F.col("a"), F.col("b")), a=a, b=b)
    assert newer("1.10.0", "1.9.9") and not newer("2.0", "2.0.0") and not newer("1.9", "1.10")


def test_fix_confusions(spark):
    assert one(spark, C.fix_confusions(F.col("t"), (("曰","日"),)), t="( 3 )--一个曰子") == "（3）一个日子"


def test_calibration_gate_without_negatives(spark):
    cases = spark.createDataFrame([(1, False, True, 0.9), (2, False, False, 0.1)], "query_id long, is_negative boolean, hit boolean, score double")
    row = R.calibration_gate(cases).first()
    assert (row.cases, row.hits, row.rate, row.overlap, row.margin, row.passed) == (2, 1, 0.5, False, None, False)


def test_duplicate_groups_are_greedy_newest_first(spark):
    rows = [(i, 1, "t", v, 100 + i, True) for i, v in enumerate([[1.0, 0.0], [0.95, 0.31], [0.6, 0.8], [1.0, 0.02]])]
    memory = spark.createDataFrame(rows, "chunk_id long, owner_user_id long, text string, embedding array<float>, created_at long, active boolean")
    got = sorted((r.chunk_id, r.leader) for r in M.duplicate_groups(memory, 0.9).collect())
    assert got == [(0, 3), (1, 3), (3, 3)]


def test_vector_codecs(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, None), (3, [1.0])], "id long, v array<float>")
    packed = S.encode_vec(df, "v", "b")
    assert {r.id: r.again for r in S.decode_vec(packed, "b", "again").collect()} == {1: [1.0, 2.0, 3.0, 4.0], 2: None, 3: [1.0]}
    assert {r.id: r.w for r in S.decode_vec(packed, "b", "w", 2).collect()} == {1: [[1.0, 2.0], [3.0, 4.0]], 2: None, 3: None}


def test_markdown_and_cases(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "My File!.md").write_text("---\ntitle: T\n---\n# H\nbody")
    (tmp_path / "c.jsonl").write_text('# note\n\n{"question": "q", "expect": ["a"]}\n')
    row = S.read_markdown(spark, str(tmp_path / "docs")).first()
    assert row.doc_id == "my-file" and row.front == {"title": "T"} and row.text == "# H\nbody"
    assert [r.question for r in S.read_cases(spark, str(tmp_path / "c.jsonl")).collect()] == ["q"]


def test_hooks(spark):
    texts = spark.createDataFrame([(1, "abc"), (2, None)], "id long, t string")
    got = {r.id: r.embedding for r in H.embed_texts(texts, "t", lambda: lambda xs: [[float(len(x))] for x in xs], as_query=True).collect()}
    assert got == {1: [10.0], 2: None}
    pool = spark.createDataFrame([(1, "q", 5, "xx"), (1, "q", 6, "x")], "query_id long, question string, chunk_id long, text string")
    assert [(r.status, r.place, r.chunk_id, r.rerank) for r in H.rerank(pool, lambda q, ps: [float(len(p)) for p in ps]).collect()] == [("scored", 1, 5, 2.0), ("scored", 2, 6, 1.0)]
    one = lambda scorer, picks=False: [(r.status, r.place, r.chunk_id) for r in H.rerank(pool, scorer, picks).collect()]
    assert one(lambda q, ps: None) == one(lambda q, ps: 1 / 0) == [("failed", None, None)]
    assert one(lambda q, ps: []) == one(lambda q, ps: [7], True) == [("none", None, None)]
    assert one(lambda q, ps: [1, 1, 0], True) == [("picked", 1, 6), ("picked", 2, 5)]
    assert one(lambda q, ps: [None, 3.0, 9.0]) == [("scored", 1, 6)]
    old = spark.createDataFrame([(1, "old", "t", 3, 9), (2, "old", "fail", 3, 9)], "user_id long, previous string, transcript string, covered_count long, stop long")

    def model(previous, transcript):
        if transcript == "fail":
            raise ValueError
        return "new " * 3

    assert sorted(tuple(r) for r in H.summarize(old, model).select("user_id", "summary", "covered_count").collect()) == [(1, "new new new", 9), (2, "old", 3)]


MEMORY = "chunk_id long, owner_user_id long, text string, probe string, slot_key string, importance double, approved boolean, created_at long, embedding array<float>, statement_vec array<float>, active boolean"
PROPOSALS = "prop_id long, owner_user_id long, ord long, slot_key string, text string, probe string, importance double, approved boolean, embedding array<float>, statement_vec array<float>"


def upserts(spark, proposals, memory, **options):
    got = M.upsert_memories(spark.createDataFrame(proposals, PROPOSALS), spark.createDataFrame(memory, MEMORY), 99, **options).collect()
    return {r.chunk_id: (r.slot_key, r.text, r.probe, round(r.importance, 6), r.approved, None if r.embedding is None else [round(x, 4) for x in r.embedding], r.action) for r in got}


def test_proposals_of_an_owner_see_one_another(spark):
    memory = [(1, 7, "likes tea", "tea?", "drink", 0.3, True, 10, [1.0, 0.0], None, True), (2, 7, "is Bo", "name?", "name", 0.5, True, 11, [0.0, 1.0], None, True), (3, 7, "gone", "tea?", "home", 0.5, True, 12, [1.0, 0.0], None, False)]
    rows = [
        (1, 7, 1, "drink", "likes coffee", "coffee?", 0.9, False, [1.0, 0.0], None),  # a category: another fact, though key and probe agree
        (2, 7, 2, "name", "is Al", "who?", 0.2, True, None, None),  # one current value: it replaces, and the vector goes with its probe
        (3, 7, 3, None, "likes  coffee", "coffee?", 0.5, True, [0.6, 0.8], None),  # other white space: the same words, near only by the first proposal's probe
        (4, 7, 4, None, "likes coffee", "really?", 0.95, True, None, None), (5, 8, 1, "home", "gone", None, 0.4, False, None, None), (6, None, 1, None, "nobody", "?", 0.4, False, None, None),
    ]
    assert upserts(spark, rows, memory) == {
        2: ("name", "is Al", "who?", 0.5, True, None, "updated"), -1: ("drink", "likes coffee", "really?", 0.95, True, None, "inserted"),
        -3: (None, "likes  coffee", "coffee?", 0.5, True, [0.6, 0.8], "inserted"), -5: ("home", "gone", "gone", 0.4, False, None, "inserted"),
    }


def test_what_a_change_keeps(spark):
    memory = [(1, 7, "said so", "p", None, 0.7, True, 10, [1.0, 0.0], None, True), (2, 7, "maybe", "p", "pet", 0.7, False, 10, [1.0, 0.0], None, True)]
    rows = [(1, 7, 1, "pet", "said so", "other", 0.1, False, [0.0, 1.0], None), (2, 7, 2, None, "maybe", "p", 0.8, False, None, None)]
    assert upserts(spark, rows, memory) == {1: ("pet", "said so", "p", 0.7, True, [1.0, 0.0], "updated"), 2: ("pet", "maybe", "p", 0.8, False, [1.0, 0.0], "updated")}


def plain_upserts(proposals, memory, now, newest, single, near=0.9, same=0.8):
    """The rules one after another, over all rows of an owner."""
    unit = lambda v: None if v is None else [x / (sum(y * y for y in v) ** 0.5 or 1) for x in v]
    dot = lambda a, b: sum(x * y for x, y in zip(unit(a), unit(b), strict=True))
    names = [x.split()[0] for x in MEMORY.split(", ")]
    rows = sorted((dict(zip(names, r, strict=True)) for r in memory), key=lambda r: (r["created_at"], r["chunk_id"]))
    rows, out = [r for r in rows if r["active"]], {}
    for p in sorted((dict(zip([x.split()[0] for x in PROPOSALS.split(", ")], r, strict=True)) for r in proposals), key=lambda p: (p["owner_user_id"], p["ord"], p["prop_id"])):
        own = [r for r in rows if r["owner_user_id"] == p["owner_user_id"]]
        found = [r for r in own if p["slot_key"] and r["slot_key"] == p["slot_key"]] + [r for r in own if r["text"] == p["text"]]
        if p["embedding"] is not None:
            recent = sorted((r for r in own if r["embedding"] is not None), key=lambda r: -r["created_at"])[:newest]
            found += [r for r in recent if dot(r["embedding"], p["embedding"]) >= near]
        hit, action = next((r for r in found if r["text"] == p["text"]), None), "updated"
        if hit is None and p["slot_key"] in single:
            hit = next((r for r in found if r["slot_key"] == p["slot_key"]), None)
        if hit is None:
            alike = lambda r: dot(r["statement_vec"], p["statement_vec"]) >= same if r["statement_vec"] and p["statement_vec"] else r["text"].split() == p["text"].split()
            hit, action = next((r for r in found if alike(r)), None), "merged"
        if hit is None:
            rows.append({**{k: p.get(k) for k in names}, "chunk_id": -p["prop_id"], "probe": p["probe"] or p["text"], "created_at": now})
            out[-p["prop_id"]] = rows[-1], "inserted"
            continue
        probe = p["probe"] or p["text"]
        if not (hit["approved"] and not p["approved"]):
            if not (p["embedding"] is None and probe == hit["probe"]):
                hit["embedding"] = p["embedding"]
            hit |= {"text": p["text"], "probe": probe, "statement_vec": p["statement_vec"]}
        hit |= {"slot_key": p["slot_key"] or hit["slot_key"], "importance": max(hit["importance"], p["importance"]), "approved": hit["approved"] or p["approved"]}
        out.setdefault(hit["chunk_id"], (hit, action))
    return {i: (r["slot_key"], r["text"], r["probe"], round(r["importance"], 6), r["approved"], None if r["embedding"] is None else [round(x, 4) for x in r["embedding"]], a) for i, (r, a) in out.items()}


def test_upserts_against_the_rules(spark):
    rng = random.Random(12)
    vector = lambda: None if rng.random() < 0.2 else [1.0, rng.choice((0.0, 0.1, 0.3, 0.6, 2.0))]
    fields = lambda: (rng.choice([f"fact {n}" for n in range(9)] + ["fact  1"]), rng.choice(("p", "q", None)), rng.choice(("name", "skill", "pet", None)), rng.choice((0.1, 0.5, 0.9)), rng.random() < 0.5)
    memory, proposals = [], []
    for n in range(150):
        text, probe, key, importance, approved = fields()
        memory.append((n + 1, n % 4, text, probe or text, key, importance, approved, 10 + n * 7 % 150, vector(), vector(), n % 9 > 0))
    for n in range(120):
        text, probe, key, importance, approved = fields()
        proposals.append((1000 + n, n % 5, n * 7 % 120, key, text, probe, importance, approved, vector(), vector()))
    for newest in (5, 200):
        assert upserts(spark, proposals, memory, newest=newest) == plain_upserts(proposals, memory, 99, newest, M.SINGLE_VALUED)


def test_candidates_agree_with_upserts_on_equal_texts(spark):
    memory = spark.createDataFrame([(n, 1, f"t{n % 500}", None, n, [1.0, 0.0], True) for n in range(700)], "chunk_id long, owner_user_id long, text string, slot_key string, created_at long, embedding array<float>, active boolean")
    new = spark.createDataFrame([(1, 1, None, "t3", None), (2, 1, None, "t400", [0.0, 1.0]), (3, 1, None, "no", [1.0, 0.1]), (4, 2, None, "t3", None), (5, 1, None, "no", None)], "prop_id long, owner_user_id long, slot_key string, text string, embedding array<float>")
    assert {r.prop_id: (r.chunk_id, r.how) for r in M.candidates_join(new, memory).collect()} == {1: (503, "text"), 2: (400, "text"), 3: (699, "probe")}


def test_import_refuses_skips_and_replaces(spark):
    profiles = spark.createDataFrame([(0, "a", "", ["Keep"], ["Drop"], 1, 40, "scenario"), (1, "", "x/*.md", [], [], 10, 600, "reference")], "ord int, doc string, path_glob string, keep_sections array<string>, drop_sections array<string>, min_chars int, max_chars int, default_kind string")
    docs = spark.createDataFrame([("a1", "k/a.md", "s1", "# Keep\nFirst sentence here! Second sentence there!\n# Drop\nno\n# Other\nno"), ("b1", "x/b.md", "s2", "short\n# T\nlong enough text <sub>p4</sub>"), ("c1", "c.md", "s3", "text"), ("d1", "x/d.md", "s4", "# T\nlong enough text")], "doc_id string, path string, sha256 string, text string")
    catalog = spark.createDataFrame([("d1", "s4", 1, "x/d.md", "passed"), ("b1", "old", 1, "x/b.md", "passed"), ("z", "s", 1, "z", "passed")], "doc_id string, sha256 string, cleaner_version int, path string, calibration_status string")
    chunks = spark.createDataFrame([("d1", "d1#0000", "kept", 5), ("b1", "b1#0000", "old", 5)], "doc_id string, chunk_id string, text string, hits int").withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("windows", F.lit(None).cast("array<string>"))
    embed = lambda df: H.embed_texts(df, "text", lambda: lambda texts: [[float(len(t))] for t in texts])
    new_docs, new_chunks, report = C.import_corpus(docs, profiles, catalog, chunks, 1, embed=embed)
    assert {r.doc_id: r.status for r in report.collect()} == {"a1": "imported", "b1": "imported", "c1": "refused", "d1": "skipped"}
    assert sorted((r.doc_id, r.sha256, r.calibration_status) for r in new_docs.collect()) == [("a1", "s1", "uncalibrated"), ("b1", "s2", "passed"), ("d1", "s4", "passed"), ("z", "s", "passed")]
    got = sorted((r.chunk_id, r.text, r.embedding and r.embedding[0], r.windows) for r in new_chunks.collect())
    assert got == [("a1#0000", "First sentence here!", 20.0, ["First sentence here!"]), ("a1#0001", " Second sentence there!", 23.0, ["Second sentence there!"]), ("b1#0000", "long enough text", 16.0, ["long enough text"]), ("d1#0000", "kept", None, None)]
    assert C.import_corpus(docs, profiles, catalog, chunks, 1, force=True)[2].filter("status = 'imported'").count() == 3
    assert C.import_corpus(docs, profiles.limit(0), catalog, chunks, 1)[2].filter("status = 'refused'").count() == 4


def test_numbers_and_settings(spark):
    said = ["十五", "六十", "一百二十", "两百", "", None]
    assert [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").orderBy("i").select(K.spoken_number(F.col("t")).alias("n")).collect()] == [15, 60, 120, 200, 0, None]
    want = {
        "请把音量调到60": ("volume", "set", 60, None), "音量 30": ("volume", "set", 30, None), "音量真的很好听呀，我有30本书": None, "音量好，有3本书": ("volume", "set", 3, None), "把亮度调到百分之三十": ("brightness", "set", 30, None), "聲音大一點": ("volume", "step", 1, None),
        "太亮了，屏幕": ("brightness", "step", -1, None), "静音，声音": ("volume", "set", 0, None), "切换主题": None, "深色主题": ("theme", "set", None, "dark"), "你好": None, "volume to 200": None, "": None, None: None,
    }
    df = spark.createDataFrame([(t,) for t in want], "t string").withColumn("c", K.device_command(F.col("t")))
    assert {r.t: None if r.c is None else (r.c.target, r.c.kind, r.c.level, r.c.theme) for r in df.collect()} == want


def test_levels_at_any_depth(spark):
    texts = ['{"a": [{"Volume": 55.9}]}', '{"volume": "50"}', '{"x": "\\"volume\\": 5", "speaker_level": 3}', '{"volume": 101, "b": {"level": 1e1}}', '{"volume": true}', "no json", None, '{"brightness": 4}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.v for r in df.orderBy("i").select(K.find_level(F.col("t"), "volume").alias("v")).collect()] == [55, None, 3, 10, None, None, None, None]


RECALLED = "chunk_id long, owner_user_id long, text string, probe string, slot_key string, tier string, created_at long, approved boolean, active boolean, embedding array<float>"


def recalled(spark, rows, turns, vectors=None, **options):
    t = spark.createDataFrame(turns, "turn_id long, user_id long, input_text string" + (", decision string" if len(turns[0]) > 3 else ""))
    v = spark.createDataFrame(vectors, "turn_id long, part int, embedding array<float>") if vectors else None
    scores = M.recall_scores(t, spark.createDataFrame(rows, RECALLED), M.MemorySettings(**options), v)
    rows_ = M.recall(t, spark.createDataFrame(rows, RECALLED), M.MemorySettings(**options), scores=scores).collect()
    return sorted((r.turn_id, r.source, r.chunk_id, r.pool) for r in rows_), {r.turn_id: r for r in M.recall_report(t, scores).collect()}


def test_basics_take_nothing_from_the_budget(spark):
    row = lambda i, key, tier="hot", at=0, owner=7: (i, owner, "green tea", "green tea", key, tier, at, True, True, None)
    rows = [row(i, None) for i in range(20)] + [row(100 + i, "name", "slot", i) for i in range(6)] + [row(200, "pet", "slot"), row(201, "name", "hot"), row(300, None, "cold"), row(301, "name", "slot", 99, 8)]
    found, report = recalled(spark, rows, [(1, 7, "green tea?"), (2, 9, "green tea?")])
    basic, matched = ([c for _, source, c, _ in found if source == kind] for kind in ("basic", "matched"))
    # the newest four of the basic keys; then twelve more, by id as all score alike, the two older basics among those that may match
    assert basic == [102, 103, 104, 105] and matched == list(range(12))
    assert (report[1].slot_best, report[1].hot_best, report[1].cold_best, report[1].tier_reached, report[1].revived) == (1.0, 1.0, 1.0, "slot", [300])
    assert (report[2].slot_best, report[2].tier_reached, report[2].revived) == (0.0, "cold", [])


def test_each_question_has_its_vector_and_tiers_their_floors(spark):
    rows = [(1, 7, "x", "x", None, "slot", 0, True, True, [1.0, 0.0]), (2, 7, "x", "x", None, "cold", 0, True, True, [0.71, 0.7042]), (3, None, "x", "x", None, "cold", 0, True, True, [0.0, 1.0]), (4, 7, "second one", "y", None, "hot", 0, True, True, None), (5, 7, "x", "x", None, "slot", 0, False, True, [1.0, 0.0])]
    found, report = recalled(spark, rows, [(1, 7, "first, second one"), (2, 7, "first", )], [(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0])])
    # row 2 has a cosine of 0.71, above the floor of other tiers and below that of cold ones; shared rows stand in the slot pool
    assert found == [(1, "matched", 1, "slot"), (1, "matched", 4, "hot"), (2, "matched", 3, "slot")]
    assert (report[1].tier_reached, report[2].tier_reached) == ("slot", "slot") and abs(report[1].cold_best - 0.71) < 1e-6
    found, report = recalled(spark, rows, [(1, 7, "nothing, second one", "accepted"), (2, 7, "second one", "unknown")])
    assert found == [(1, "matched", 4, "hot")] and (report[1].tier_reached, report[2].tier_reached, report[2].hot_best) == ("hot", "cold", 0.0)


def test_sample_rows_say_what_arrays_say(spark):
    rng = random.Random(8)
    sessions = {k: [rng.choice((-32768, 32760, 0, 5, -5, 200, -200)) for _ in range(n)] for k, n in ((1, 1), (2, 50), (3, 900), (4, 3))}
    rows = spark.createDataFrame([(k, i * 3, x) for k, own in sessions.items() for i, x in enumerate(own)] + [(2, 10_000, None)], "session_id long, arrival long, sample int").repartition(4)
    arrays = spark.createDataFrame(list(sessions.items()), "session_id long, pcm array<int>")
    quality = {r.session_id: (r.q.clipping, round(r.q.rms, 6), r.q.duration, r.q.fault) for r in arrays.select("session_id", D.audio_quality(F.col("pcm"), F.lit(20)).alias("q")).collect()}
    assert {r.session_id: (r.clipping, round(r.rms, 6), r.duration, r.fault) for r in V.sample_quality(rows, 20).collect()} == quality
    features = {r.session_id: tuple(round(x, 9) for x in r.q) for r in arrays.select("session_id", D.acoustic_features(F.col("pcm")).alias("q")).collect()}
    for span in (4096, 10):
        assert {r.session_id: tuple(round(x, 9) for x in (r["mean"], r["rms"], r["zero_crossing_rate"])) for r in V.sample_features(rows, span).collect()} == features

"""Queries of corpus operators and of dialogue text functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import commands as K
from ..functions import dialogue as D
from ..functions import hooks as H
from ..functions.tables import register_tables
from ..operators import corpus as C
from ..operators import devices as V
from ..operators.retrieval import export_matrix
from ..session import scratch, table
from ..sources import tables as S
from ..sources.store import KeyedTable, delete_groups, replace_groups
from .base import query
from .fixtures import duck, view

_PAGE = "CASE WHEN regexp_matches(line, '<sub>p\\d+</sub>') THEN CAST(regexp_extract(line, '<sub>p(\\d+)</sub>', 1) AS INT) END"
_LEVEL = "nullif(length(regexp_extract(line, '^(#{1,6})\\s+\\S', 1)), 0)"
_STRIP = "trim(regexp_replace(line, '<sub>p\\d+</sub>', ' ', 'g'))"
_TREE = f"h AS (SELECT doc_id, pos AS start, {_LEVEL} AS level, trim(regexp_replace(line, '^#{{1,6}}\\s+', '')) AS title FROM md_lines WHERE {_LEVEL} IS NOT NULL), tree AS (SELECT doc_id, start, lead(start) OVER w AS stop, level, title, CASE WHEN level = 3 THEN last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY start))"
_W = "OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"
_BLOCKS = f"bl AS (SELECT * FROM (SELECT doc_id, last_value(CASE WHEN {_LEVEL} IS NOT NULL THEN pos END IGNORE NULLS) {_W} AS section_start, pos, last_value({_PAGE} IGNORE NULLS) {_W} AS page, {_LEVEL} AS level, {_STRIP} AS text FROM md_lines) WHERE level IS NULL AND text <> '')"
_SECTIONS = f"{_TREE}, {_BLOCKS}, b AS (SELECT doc_id, section_start, min(page) AS page, count(*) AS n_blocks, string_agg(text, ' ' ORDER BY pos) AS body FROM bl GROUP BY ALL), sections AS (SELECT b.doc_id, coalesce(section_start, -1) AS start, coalesce(CASE WHEN parent IS NOT NULL THEN parent || ' › ' || title ELSE title END, '前言') AS section_path, coalesce(title, '前言') AS title, parent, page, n_blocks, body FROM b LEFT JOIN tree t ON b.doc_id = t.doc_id AND b.section_start = t.start)"


_SENTENCES = lambda t: f"regexp_extract_all({t}, '[^。！？；!?;]*[。！？；!?;]|[^。！？；!?;]+')"


def _folded(pieces: str, size: int, joint: str) -> str:
    """DuckDB SQL of a list of pieces joined greedily while they fit."""
    step = f"CASE WHEN a.open <> '' AND length(a.open) + length(x.open) > {size} THEN {{'done': a.done || [a.open], 'open': x.open}} WHEN a.open = '' THEN {{'done': a.done, 'open': x.open}} ELSE {{'done': a.done, 'open': a.open || '{joint}' || x.open}} END"
    one = f"list_reduce(list_transform({pieces}, lambda p: {{'done': CAST([] AS VARCHAR[]), 'open': p}}), lambda a, x: {step})"
    return f"(CASE WHEN len({pieces}) = 0 THEN [] ELSE (SELECT CASE WHEN r.open <> '' THEN r.done || [r.open] ELSE r.done END FROM (SELECT {one} AS r)) END)"


def _packed(size: int, where: str = "") -> str:
    """DuckDB SQL of the chunks of all sections, or of those ``where`` joins: doc_id, start, ord, page, text."""
    long_ = _folded(f"list_filter({_SENTENCES('text')}, lambda s: s <> '')", size, "")
    return f"pieces AS (SELECT doc_id, coalesce(section_start, -1) AS start, pos, page, CASE WHEN length(text) > {size} THEN {long_} ELSE [text] END AS p FROM bl), runs AS (SELECT doc_id, start, page, min(pos) AS first, flatten(list(p ORDER BY pos)) AS p FROM pieces {where} GROUP BY doc_id, start, page), folded AS (SELECT doc_id, start, page, first, {_folded('p', size, ' ')} AS c FROM runs), flat AS (SELECT doc_id, start, page, first, generate_subscripts(c, 1) AS m, unnest(c) AS text FROM folded), packed AS (SELECT doc_id, start, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, first, m) - 1 AS INT) AS ord, page, text FROM flat)"


def lines(spark, sf):
    return view(spark, sf, "md_lines")


@query("f35_page_marker", duck(f"SELECT doc_id, pos, {_PAGE} AS page, sha256({_STRIP}) AS text FROM md_lines", "md_lines"))
def page_marker(spark, sf):
    return lines(spark, sf).select("doc_id", "pos", C.page_marker(F.col("line")).alias("page"), F.sha2(C.strip_markers(F.col("line")), 256).alias("text"))


@query("w11_carry_page", duck(f"SELECT doc_id, pos, last_value({_PAGE} IGNORE NULLS) {_W} AS page FROM md_lines", "md_lines"))
def carry_page(spark, sf):
    return C.carry_page(lines(spark, sf)).select("doc_id", "pos", "page")


@query("w12_heading_tree", duck(f"WITH {_TREE} SELECT doc_id, start, stop, level, title, CASE WHEN parent IS NOT NULL THEN parent || ' › ' || title ELSE title END AS section_path FROM tree", "md_lines"))
def heading_tree(spark, sf):
    return C.heading_tree(lines(spark, sf)).drop("parents")


@query("r01_sectionize", duck(f"WITH {_SECTIONS} SELECT doc_id, start, section_path, page, n_blocks, sha256(body) AS body FROM sections", "md_lines"))
def sectionize(spark, sf):
    return C.sectionize(lines(spark, sf)).select("doc_id", "start", "section_path", "page", F.col("n_blocks").cast("long").alias("n_blocks"), F.sha2("body", 256).alias("body"))


@query("f30_classify_section", duck(f"WITH {_SECTIONS} SELECT doc_id, start, CASE WHEN contains(title, 'an') THEN 'drop_section' ELSE 'kept' END AS reason, CASE WHEN contains(title, 'an') THEN NULL WHEN contains(title, 'en') OR contains(coalesce(parent, ''), 'en') THEN 'scenario' ELSE 'reference' END AS kind FROM sections", "md_lines"))
def classify_section(spark, sf):
    c = C.classify_section(F.col("title"), F.col("parents"), drop=("an",), scenario=("en",))
    return C.sectionize(lines(spark, sf)).withColumn("c", c).select("doc_id", "start", "c.reason", "c.kind")


@query("f29_is_exercise", duck(f"WITH {_SECTIONS} SELECT doc_id, start, CASE WHEN NOT contains(body, 'the ') AND length(body) < 250 AND regexp_matches(body, '^(En|Th)') THEN 'task_instructions' END AS reason FROM sections", "md_lines"))
def is_exercise(spark, sf):
    return C.sectionize(lines(spark, sf)).select("doc_id", "start", C.is_exercise(F.col("body"), ("the ",), "^Wh", "^(En|Th)", r"zzz[^.]{0,40}[?]").alias("reason"))


@query("f31_citation", duck(f"WITH {_SECTIONS} SELECT doc_id, start, 'Manual' || CASE WHEN page > 0 THEN ' p' || page ELSE '' END || ' › ' || title AS citation FROM sections", "md_lines"))
def citation(spark, sf):
    return C.sectionize(lines(spark, sf)).select("doc_id", "start", C.citation(F.col("section_path"), F.col("page"), "Manual").alias("citation"))


@query("w16_pack_chunks", duck(f"WITH {_SECTIONS}, {_packed(300)} SELECT doc_id, start, ord, page, text FROM packed", "md_lines"))
def pack_chunks(spark, sf):
    return C.pack_chunks(C.sectionize(lines(spark, sf)), 300)


_JUDGED = "judged AS (SELECT *, CASE WHEN contains(title, 'an') THEN 'drop_section' WHEN length(body) < 40 THEN 'too_short' END AS reason, CASE WHEN contains(title, 'en') OR contains(coalesce(parent, ''), 'en') THEN 'scenario' ELSE 'reference' END AS kind FROM sections)"


@query("r02_chunk_corpus", duck(f"WITH {_SECTIONS}, {_JUDGED}, {_packed(600, 'JOIN (SELECT doc_id, start FROM judged WHERE reason IS NULL) USING (doc_id, start)')} SELECT doc_id, CAST(ord AS BIGINT) AS n, kind, section_path FROM packed JOIN judged USING (doc_id, start) UNION ALL SELECT doc_id, length(body), reason, section_path FROM judged WHERE reason IS NOT NULL", "md_lines"))
def chunk_corpus(spark, sf):
    chunks, dropped = C.chunk_corpus(lines(spark, sf), drop=("an",), scenario=("en",))
    return chunks.select("doc_id", F.col("ord").cast("long").alias("n"), "kind", "section_path").unionByName(dropped.select("doc_id", F.col("chars").cast("long").alias("n"), F.col("reason").alias("kind"), "section_path"))


@query("a08_corpus_counts", duck(f"WITH {_SECTIONS}, k AS (SELECT doc_id, CASE WHEN contains(title, 'en') OR contains(coalesce(parent, ''), 'en') THEN 'scenario' ELSE 'reference' END AS kind FROM sections) SELECT kind, count(*) AS chunks, count(DISTINCT doc_id) AS docs FROM k GROUP BY kind UNION ALL SELECT 'all', count(*), count(DISTINCT doc_id) FROM k", "md_lines"))
def corpus_counts(spark, sf):
    c = C.classify_section(F.col("title"), F.col("parents"), scenario=("en",))
    return C.corpus_counts(C.sectionize(lines(spark, sf)).select("doc_id", c["kind"].alias("kind")))


_PROFILE = f"""WITH {_SECTIONS}, {_JUDGED}, {_packed(600, 'JOIN (SELECT doc_id, start FROM judged WHERE reason IS NULL) USING (doc_id, start)')},
x AS (SELECT doc_id, line, regexp_replace(line, '[\\s\\p{{Z}}]', '', 'g') AS bare, {_LEVEL} AS level FROM md_lines),
t AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (bare <> '' AND level IS NULL) AS paragraphs, CAST(sum(length(bare)) AS BIGINT) AS chars, {', '.join(f'count(*) FILTER (level = {k}) AS h{k}' for k in range(1, 7))},
  CAST(sum(len(regexp_extract_all(line, '<sub>p\\d+</sub>'))) AS BIGINT) AS page_anchors, CAST(sum(len(regexp_extract_all(line, '!\\['))) AS BIGINT) AS images, count(*) FILTER (length(line) - length(replace(line, '|', '')) >= 2) AS table_rows FROM x GROUP BY doc_id),
c AS (SELECT p.doc_id, j.kind, length(p.text) AS size FROM packed p JOIN judged j USING (doc_id, start)),
m AS (SELECT doc_id, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS chunk_chars, min(size) AS chunk_min, list_sort(list(size))[count(*) // 2 + 1] AS chunk_median, max(size) AS chunk_max, count(*) FILTER (size > 600) AS chunks_over_max,
  CAST(coalesce(sum(size) FILTER (kind = 'scenario'), 0) AS BIGINT) AS scenario_chars, CAST(coalesce(sum(size) FILTER (kind = 'reference'), 0) AS BIGINT) AS reference_chars FROM c GROUP BY doc_id),
g AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS dropped_sections, CAST(sum(chars) AS BIGINT) AS dropped_chars, string_agg(reason || ':' || n, ',' ORDER BY reason) AS dropped_reasons FROM (SELECT doc_id, reason, count(*) AS n, sum(length(body)) AS chars FROM judged WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY doc_id)
SELECT t.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in 'chunks chunk_chars chunk_min chunk_median chunk_max chunks_over_max scenario_chars reference_chars dropped_sections dropped_chars'.split())}, coalesce(dropped_reasons, '') AS dropped_reasons
FROM t LEFT JOIN m ON m.doc_id = t.doc_id LEFT JOIN g ON g.doc_id = t.doc_id"""


@query("a09_corpus_profile", duck(_PROFILE, "md_lines"))
def corpus_profile(spark, sf):
    rows = lines(spark, sf)
    out = C.corpus_profile(rows, *C.chunk_corpus(rows, drop=("an",), scenario=("en",)))
    return out.withColumn("dropped_reasons", F.array_join(F.transform(F.array_sort(F.map_entries("dropped_reasons")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ","))


_ABOVE = """s AS (SELECT doc_id, start, level, title, row_number() OVER (PARTITION BY doc_id, title ORDER BY start) AS n FROM tree), toc AS (SELECT doc_id, start // 2 AS page, title, row_number() OVER (PARTITION BY doc_id, title ORDER BY start) AS n FROM tree WHERE start % 6 = 0),
o AS (SELECT s.*, toc.page AS own FROM s LEFT JOIN toc ON toc.doc_id = s.doc_id AND toc.title = s.title AND toc.n = s.n),
above AS (SELECT s.doc_id, s.start, arg_max(a.own, a.start) AS page FROM o s JOIN o a ON a.doc_id = s.doc_id AND a.start < s.start AND a.level < s.level AND a.own IS NOT NULL
  WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.doc_id = s.doc_id AND b.start > a.start AND b.start < s.start AND b.level <= a.level) GROUP BY ALL)"""


@query("j12_toc_pages", duck(f"WITH {_TREE}, {_ABOVE} SELECT o.doc_id, o.start, coalesce(o.own, above.page) AS toc_page FROM o LEFT JOIN above ON above.doc_id = o.doc_id AND above.start = o.start", "md_lines"))
def toc_pages(spark, sf):
    s = C.heading_tree(lines(spark, sf)).select("doc_id", "start", "level", "title")
    toc = s.filter("start % 6 = 0").select("doc_id", F.col("start").alias("ord"), "title", F.floor(F.col("start") / 2).alias("page"))
    return C.toc_pages(s, toc).select("doc_id", "start", "toc_page")


@query("j13_coverage_check", duck("WITH x AS (SELECT doc_id, CASE WHEN pos % 3 = 0 THEN 'a' ELSE 'b' END AS class, regexp_replace(line, '[\\s\\p{Z}]+', '', 'g') AS bare FROM md_lines), o AS (SELECT doc_id, regexp_replace(text, '[\\s\\p{Z}]+', '', 'g') AS t FROM documents) SELECT class, count(*) FILTER (contains(coalesce(t, ''), bare)) AS kept, count(*) AS total FROM x LEFT JOIN o USING (doc_id) WHERE bare <> '' GROUP BY class", "md_lines"))
def coverage_check(spark, sf):
    src = lines(spark, sf).select("doc_id", F.when(F.col("pos") % 3 == 0, "a").otherwise("b").alias("class"), "line")
    return C.coverage_check(src, table(spark, sf, "documents").select("doc_id", "text"))


@query("a14_running_heads", duck("SELECT doc_id, trim(text) AS text, count(DISTINCT page) AS n FROM ocr_lines WHERE y < 0.08 * page_height AND length(trim(text)) <= 30 AND trim(text) <> '' GROUP BY ALL HAVING count(DISTINCT page) >= 3", "ocr_lines"))
def running_heads(spark, sf):
    return C.running_heads(view(spark, sf, "ocr_lines"))


@query("a15_page_offset", duck("WITH p AS (SELECT doc_id, page - CAST(regexp_extract(text, '(\\d{1,4})', 1) AS INT) AS off, page FROM ocr_lines WHERE (y < 0.12 * page_height OR y > 0.88 * page_height) AND regexp_matches(text, '\\d')), v AS (SELECT doc_id, off, count(*) AS votes, min(page) AS first FROM p GROUP BY ALL) SELECT doc_id, off AS \"offset\", votes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, first, off) AS r FROM v) WHERE r = 1", "ocr_lines"))
def page_offset(spark, sf):
    return C.page_offset(view(spark, sf, "ocr_lines"))


_OFFSETS = "ov AS (SELECT doc_id, page - CAST(regexp_extract(text, '(\\d{1,4})', 1) AS INT) AS off, page FROM ocr_lines WHERE (y < 0.12 * page_height OR y > 0.88 * page_height) AND regexp_matches(text, '\\d')), ow AS (SELECT doc_id, off, count(*) AS votes, min(page) AS first FROM ov GROUP BY ALL), offsets AS (SELECT doc_id, off FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, first, off) AS r FROM ow) WHERE r = 1)"


def _fixed(t: str, pairs: tuple = ()) -> str:
    """DuckDB SQL of the corrections of a line."""
    for wrong, right in pairs:
        t = f"replace({t}, '{wrong}', '{right}')"
    dashed = f"regexp_replace({t}, '[-—–·]+', '一', 'g')"
    for double in ("一一个", "一一些", "一一直", "一一定", "一一般", "一一样"):
        dashed = f"replace({dashed}, '{double}', '{double[1:]}')"
    return f"regexp_replace(CASE WHEN regexp_matches({t}, '[-—–·]') THEN {dashed} ELSE {t} END, '[（(]\\s*(\\d{{1,2}})\\s*[)）]', '（\\1）', 'g')"


_ENDS = "[\\s\\p{Z}\\x0B\\x85]+"
_SHORT = "(length(b.t) <= 18 AND NOT regexp_matches(b.t, '[。！？；，、：]'))"
_SPACED = "coalesce(b.y - f.y > 1.35 * b.usual, false)"
_BREAKS = f"(f.open <> '' AND (b.x - b.lft > 0.8 * b.chr OR {_SPACED}))"
_HEADING = f"(({_BREAKS} OR f.open = '') AND {_SHORT} AND f.ended AND (abs(b.x + b.width / 2.0 - b.page_width / 2.0) < b.page_width * 0.06 OR {_SPACED}))"
_DONE = f"(CASE WHEN {_BREAKS} THEN f.done || [regexp_replace(f.open, '^{_ENDS}|{_ENDS}$', '', 'g')] ELSE f.done END)"
#: The rule line by line: all pages step to their next line together.
_PARAGRAPHS = f"""hd AS (SELECT doc_id, trim(text) AS text FROM ocr_lines WHERE y < 0.144 * page_height AND length(trim(text)) <= 30 AND trim(text) <> '' GROUP BY ALL HAVING count(DISTINCT page) >= 3),
b0 AS (SELECT *, regexp_replace(text, '^{_ENDS}|{_ENDS}$', '', 'g') AS bare FROM ocr_lines),
b1 AS (SELECT *, row_number() OVER w AS r, y - lag(y) OVER w AS step FROM b0 WHERE bare <> '' AND y BETWEEN 0.09 * page_height AND 0.91 * page_height AND NOT EXISTS (SELECT 1 FROM hd WHERE hd.doc_id = b0.doc_id AND hd.text = b0.bare) WINDOW w AS (PARTITION BY doc_id, page ORDER BY round_even(y / 6, 0), x, y, text)),
b2 AS (SELECT doc_id, page, count(*) AS n, min(x) AS lft, quantile_cont(width / greatest(length(text), 1), 0.5) AS chr, coalesce(quantile_cont(step, 0.5) FILTER (step > 0), 12.0) AS usual FROM b1 GROUP BY ALL),
b AS MATERIALIZED (SELECT b1.*, n, lft, chr, usual, {_fixed('bare')} AS t FROM b1 JOIN b2 USING (doc_id, page)),
f AS (SELECT doc_id, page, n, CAST(0 AS BIGINT) AS r, CAST([] AS VARCHAR[]) AS done, '' AS open, CAST(NULL AS DOUBLE) AS y, true AS ended FROM b2 UNION ALL
  SELECT f.doc_id, f.page, f.n, f.r + 1, CASE WHEN {_HEADING} THEN {_DONE} || ['### ' || b.t] ELSE {_DONE} END, CASE WHEN {_HEADING} THEN '' WHEN {_BREAKS} THEN b.t ELSE f.open || b.t END, CAST(b.y AS DOUBLE),
    {_HEADING} OR regexp_matches(b.t, '[。！？；.!?;：:]$') FROM f JOIN b ON b.doc_id = f.doc_id AND b.page = f.page AND b.r = f.r + 1),
pd AS (SELECT doc_id, page, list_filter(done || [regexp_replace(open, '^{_ENDS}|{_ENDS}$', '', 'g')], lambda p: p <> '') AS p FROM f WHERE r = n),
paragraphs AS (SELECT doc_id, page, CAST(generate_subscripts(p, 1) AS INTEGER) AS paragraph, unnest(p) AS text FROM pd)"""
_OPEN = "NOT starts_with({0}, '###') AND NOT regexp_matches({0}, '[。！？；.!?;”」』）]$')"
_CARRIED = f"""j AS (SELECT *, lag(page) OVER w AS before_page, lag(text) OVER w AS before, lead(page) OVER w AS after_page FROM paragraphs WINDOW w AS (PARTITION BY doc_id ORDER BY page, paragraph)),
k AS (SELECT *, CAST(sum(CASE WHEN before_page < page AND {_OPEN.format('before')} AND NOT starts_with(text, '###') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page, paragraph) AS BIGINT) AS block, CASE WHEN after_page > page AND {_OPEN.format('text')} THEN after_page ELSE page END AS ends FROM j),
carried AS (SELECT doc_id, block, max(ends) AS page, string_agg(text, '' ORDER BY page, paragraph) AS text FROM k GROUP BY doc_id, block)"""


def paragraphs(spark, sf):
    ocr = view(spark, sf, "ocr_lines")
    return C.paragraphs_from_lines(ocr, C.running_heads(ocr, C.HEADER_BAND * 1.6))


@query("w14_paragraphs_from_lines", duck(f"WITH RECURSIVE {_PARAGRAPHS} SELECT doc_id, page, paragraph, text FROM paragraphs", "ocr_lines"))
def paragraphs_from_lines(spark, sf):
    return paragraphs(spark, sf)


@query("w13_carry_paragraph", duck(f"WITH RECURSIVE {_PARAGRAPHS}, {_CARRIED} SELECT doc_id, block, page, text FROM carried", "ocr_lines"))
def carry_paragraph(spark, sf):
    return C.carry_paragraph(paragraphs(spark, sf))


@query("a16_page_report", duck(f"WITH RECURSIVE {_PARAGRAPHS}, {_CARRIED}, {_OFFSETS}, pl AS (SELECT doc_id, page, count(*) AS lines, round(avg(0.5 + (length(text) % 50) / 100.0), 3) AS mean_score FROM ocr_lines GROUP BY ALL), pp AS (SELECT doc_id, page, count(*) AS paragraphs, CAST(sum(length(text)) AS BIGINT) AS chars FROM carried GROUP BY ALL) SELECT pl.doc_id, pl.page, pl.page - coalesce(off, 0) AS printed_page, lines, coalesce(paragraphs, 0) AS paragraphs, coalesce(chars, 0) AS chars, mean_score FROM pl LEFT JOIN pp ON pp.doc_id = pl.doc_id AND pp.page = pl.page LEFT JOIN offsets ON offsets.doc_id = pl.doc_id", "ocr_lines"))
def page_report(spark, sf):
    ocr = view(spark, sf, "ocr_lines")
    scored = ocr.withColumn("score", 0.5 + (F.length("text") % 50) / 100)
    return C.page_report(scored, C.carry_paragraph(paragraphs(spark, sf)), C.page_offset(ocr))


@query("f21_split_windows", duck("WITH t AS (SELECT doc_id, list_filter(list_transform(" + _SENTENCES("regexp_replace(coalesce(text, ''), '\\.\\s*', '!', 'g')") + ", lambda s: trim(s)), lambda s: s <> '') AS s FROM documents) SELECT doc_id, " + _folded("s", 90, "") + "[1:8] AS windows FROM t"))
def split_windows(spark, sf):
    text = F.regexp_replace("text", r"\.\s*", "!")
    return table(spark, sf, "documents").select("doc_id", C.split_windows(text).alias("windows"))


@query("f27_tidy", duck("SELECT turn_id, trim(regexp_replace('字字' || input_text || '，end', '[ \\t\\x0B\\f\\r]+', ' ', 'g')) AS text FROM turns", "turns"))
def tidy(spark, sf):
    return view(spark, sf, "turns").select("turn_id", C.tidy(F.concat(F.lit("字 　字"), F.col("input_text"), F.lit("  ，end"))).alias("text"))


@query("f28_fix_confusions", duck("SELECT turn_id, " + _fixed("('( ' || turn_id % 90 || ' )—一个' || input_text)", (("the", "teh"),)) + " AS text FROM turns", "turns"))
def fix_confusions(spark, sf):
    return view(spark, sf, "turns").select("turn_id", C.fix_confusions(F.concat(F.lit("( "), F.col("turn_id") % 90, F.lit(" )—一个"), F.col("input_text")), (("the", "teh"),)).alias("text"))


_DOCS = "d AS (SELECT doc_id, 'corpus/' || lang || '/' || source || '.md' AS path FROM documents)"


def paths(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("corpus/"), "lang", F.lit("/"), "source", F.lit(".md")).alias("path"))


@query("s05_profile_for", duck(f"WITH {_DOCS} SELECT doc_id, path, CASE WHEN regexp_full_match(path, '(.*/)?fr/[^/]*\\.md') THEN 2 WHEN contains(split_part(path, '/', 3), 'src1') THEN 0 WHEN contains(split_part(path, '/', 3), 'src2') THEN 1 END AS profile, profile IS NULL AS refused FROM d"))
def profile_for(spark, sf):
    profiles = spark.createDataFrame([(0, "src1", ""), (1, "src2", ""), (2, "", "fr/*.md")], "ord int, doc string, path_glob string")
    return C.profile_for(paths(spark, sf), profiles)


_CATALOG = "c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE sha256(coalesce(text, '')) END AS sha256, 1 AS cleaner_version, 'passed' AS calibration_status FROM documents WHERE doc_id % 5 <> 0)"


def catalog(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("sha256"), F.lit(1).alias("cleaner_version"))
    return d, d.filter("doc_id % 5 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("sha256"))).withColumn("calibration_status", F.lit("passed"))


@query("s08_needs_import", duck("SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 = 0"))
def needs_import(spark, sf):
    d, c = catalog(spark, sf)
    return C.needs_import(d, c).select("doc_id")


@query("p07_documents", duck(f"WITH {_CATALOG} SELECT doc_id, sha256, cleaner_version FROM c"))
def documents(spark, sf):
    return catalog(spark, sf)[1].select("doc_id", "sha256", "cleaner_version").orderBy("doc_id")


@query("s09_replace_document", duck("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'uncalibrated' ELSE 'passed' END ELSE 'passed' END AS calibration_status, CASE WHEN doc_id % 4 = 0 THEN format('{}#0000', doc_id) ELSE 'old' END AS chunk_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 5 <> 0"))
def replace_document(spark, sf):
    d, c = catalog(spark, sf)
    chunks = c.select("doc_id", F.lit("old").alias("chunk_id"), F.lit(3).alias("hits"))
    new = d.filter("doc_id % 4 = 0")
    docs, rows = C.replace_document(c, chunks, new, new.select("doc_id", F.lit(0).alias("ord")))
    return docs.join(rows, "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), "calibration_status", "chunk_id")


@query("s09_replace_stored", duck("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE i END AS ord, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS text FROM documents, (SELECT unnest(range(3)) AS i) WHERE (doc_id % 4 = 0 AND i = 0) OR (doc_id % 4 <> 0 AND doc_id % 7 <> 1)"))
def replace_stored(spark, sf):
    """Chunks in a stored table: an import, documents imported again, others deleted; only their partitions are written."""
    ids = table(spark, sf, "documents").select("doc_id")
    old = ids.select("doc_id", F.explode(F.array(*map(F.lit, range(3)))).alias("ord"), F.lit("old").alias("text"))
    stored = KeyedTable(scratch(spark, "chunks"), old.schema, ["doc_id"], 16)
    stored.merge(old, replace_groups("doc_id"))
    stored.merge(ids.filter("doc_id % 4 = 0").select("doc_id", F.lit(0).alias("ord"), F.lit("new").alias("text")), replace_groups("doc_id"))
    stored.merge(ids.filter("doc_id % 7 = 1 and doc_id % 4 <> 0"), delete_groups("doc_id"))
    return stored.read(spark)


@query("s10_delete_document", duck(f"WITH {_CATALOG} SELECT doc_id FROM c WHERE doc_id % 7 <> 0"))
def delete_document(spark, sf):
    _, c = catalog(spark, sf)
    docs, chunks = C.delete_document(c, c.select("doc_id", F.lit("x").alias("chunk_id")), c.filter("doc_id % 7 = 0").select("doc_id"))
    return docs.select("doc_id").join(chunks.select("doc_id"), "doc_id")


_E = "CASE turn_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' END"


@query("f08_extract_structured", duck(f"SELECT turn_id, trim(input_text) || CASE WHEN turn_id % 3 = 2 THEN chr(10) || '{{\"x\": 1}}' ELSE '' END AS text, {_E} AS emotion FROM turns", "turns"))
def extract_structured(spark, sf):
    tail = F.when(F.col("turn_id") % 3 == 0, F.lit('\n```json\n{"emotion": "positive", "risk": "none"}\n```')).when(F.col("turn_id") % 3 == 1, F.lit('\n{"emotion": "negative"}')).otherwise(F.lit('\n{"x": 1}'))
    out = view(spark, sf, "turns").withColumn("s", D.extract_structured(F.concat("input_text", tail)))
    return out.select("turn_id", "s.text", F.col("s.block.emotion").alias("emotion"))


@query("f09_parse_sse", duck("SELECT turn_id, CASE turn_id % 4 WHEN 0 THEN 'w' || turn_id END AS content, CASE turn_id % 4 WHEN 0 THEN 'm1' WHEN 1 THEN 'm1' END AS model FROM turns", "turns"))
def parse_sse(spark, sf):
    t = F.col("turn_id")
    line = F.when(t % 4 == 0, F.concat(F.lit('data: {"model":"m1","choices":[{"delta":{"content":"w'), t, F.lit('"}}]}'))).when(t % 4 == 1, F.lit('data: {"model":"m1","choices":[]}')).when(t % 4 == 2, F.lit(": keep-alive")).otherwise(F.lit("data: [DONE]"))
    return view(spark, sf, "turns").withColumn("s", D.parse_sse(line)).select("turn_id", "s.content", "s.model")


@query("a17_merge_call_deltas", duck("SELECT session_id AS request_id, user_id % 2 AS \"index\", 'id' || arg_min(turn_id, seq) AS id, 'name' || arg_min(turn_id, seq) AS name, string_agg('a' || seq, '' ORDER BY seq) AS arguments FROM turns GROUP BY ALL", "turns"))
def merge_call_deltas(spark, sf):
    t = view(spark, sf, "turns")
    chunks = t.select(F.col("session_id").alias("request_id"), F.col("seq").alias("chunk_no"), (F.col("user_id") % 2).alias("index"), F.concat(F.lit("id"), "turn_id").alias("id"), F.concat(F.lit("name"), "turn_id").alias("name"), F.concat(F.lit("a"), "seq").alias("arguments"))
    return D.merge_call_deltas(chunks)


_SPOKEN = r"""t AS (SELECT turn_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(response_text, '.', '!'), '(?s)```.*?```', '', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '[*_`#~]', '', 'g'), '[\s\p{Z}\x0B\x85]+', ' ', 'g')) AS plain FROM turns),
p AS (SELECT turn_id, unnest(x) AS part, generate_subscripts(x, 1) AS i FROM (SELECT turn_id, list_transform(regexp_extract_all(plain, '[^。！？!?；;…\n]+[。！？!?；;…\n]?'), lambda s: trim(s)) AS x FROM t)),
c AS (SELECT turn_id, i, 0 AS n, CAST(NULL AS VARCHAR) AS piece, part AS rest, true AS more FROM p UNION ALL
  SELECT turn_id, i, n + 1, trim(CASE WHEN length(rest) > 48 THEN substr(rest, 1, spot) ELSE rest END), CASE WHEN length(rest) > 48 THEN substr(rest, spot + 1) ELSE '' END, length(rest) > 48
  FROM (SELECT *, CASE WHEN 48 - length(regexp_extract(substr(rest, 1, 48), '[^，,、：:）)】」》」 　]*$')) > 16 THEN 48 - length(regexp_extract(substr(rest, 1, 48), '[^，,、：:）)】」》」 　]*$')) ELSE 48 END AS spot FROM c WHERE more))"""


@query("f20_split_speech", duck(f"WITH RECURSIVE {_SPOKEN} SELECT t.turn_id, coalesce(string_agg(piece, '|' ORDER BY i, n) FILTER (piece <> ''), '') AS pieces FROM t LEFT JOIN c ON c.turn_id = t.turn_id AND c.n > 0 GROUP BY t.turn_id", "turns"))
def split_speech(spark, sf):
    return view(spark, sf, "turns").select("turn_id", F.array_join(D.split_speech(F.regexp_replace("response_text", r"\.", "!")), "|").alias("pieces"))


@query("f22_lead_emoji", duck("SELECT turn_id, CASE WHEN turn_id % 2 = 0 THEN '🙂' END AS emoji, CASE WHEN turn_id % 2 = 0 THEN 'happy' END AS face, ltrim(input_text) AS rest FROM turns", "turns"))
def lead_emoji(spark, sf):
    text = F.concat(F.when(F.col("turn_id") % 2 == 0, "🙂 ").otherwise("🛸 "), F.ltrim("input_text"))
    out = view(spark, sf, "turns").select("turn_id", text.alias("t")).withColumn("e", D.lead_emoji(F.col("t"), {"🙂": "happy", "😢": "sad"}))
    return out.select("turn_id", "e.emoji", "e.face", D.strip_lead_emoji(F.col("t")).alias("rest"))


@query("f23_dialog_command", duck("SELECT turn_id, CASE turn_id % 4 WHEN 0 THEN 'stop' WHEN 1 THEN 'end' END AS command FROM turns", "turns"))
def dialog_command(spark, sf):
    said = F.element_at(F.array(F.lit(" 停止。"), F.lit("再见！"), F.lit("停止 播放 音乐"), F.col("input_text")), (F.col("turn_id") % 4 + 1).cast("int"))
    return view(spark, sf, "turns").select("turn_id", D.dialog_command(said).alias("command"))


@query("f26_language_code", duck("SELECT turn_id, CASE turn_id % 3 WHEN 0 THEN 'zh' WHEN 1 THEN '' ELSE 'en' END AS code, trim(input_text) AS text FROM turns", "turns"))
def language_code(spark, sf):
    from ..functions.text import strip_tags

    hint = F.element_at(F.array(F.lit(" ZH "), F.lit("klingon"), F.lit("en")), (F.col("turn_id") % 3 + 1).cast("int"))
    return view(spark, sf, "turns").select("turn_id", D.language_code(hint).alias("code"), strip_tags(F.concat(F.lit("<|zh|><|NEUTRAL|>"), "input_text")).alias("text"))


@query("f36_audio_quality", duck("WITH s AS (SELECT session_id, list(CAST(round(rms * 10 * CASE WHEN arrival % 2 = 0 THEN 1 ELSE -1 END) AS INT) ORDER BY arrival) AS pcm FROM frames GROUP BY 1) SELECT session_id, round(sqrt(list_sum(list_transform(pcm, lambda x: CAST(x AS DOUBLE) * x)) / len(pcm)), 4) AS rms, CASE WHEN len(pcm) / 20.0 < 3 THEN 'too_short' END AS fault FROM s", "frames"))
def audio_quality(spark, sf):
    return V.sample_quality(samples(spark, sf, 2), 20).select("session_id", F.round("rms", 4).alias("rms"), "fault")


@query("f37_acoustic_features", duck("WITH s AS (SELECT session_id, list(CAST(round(rms * 10 * CASE WHEN arrival % 3 = 0 THEN 1 ELSE -1 END) AS INT) ORDER BY arrival) AS pcm FROM frames GROUP BY 1) SELECT session_id, round(list_sum(pcm) / len(pcm), 4) AS mean, round(len(list_filter(range(1, len(pcm)), lambda i: (pcm[i] < 0) <> (pcm[i + 1] < 0))) / len(pcm), 6) AS zero_crossing_rate FROM s", "frames"))
def acoustic_features(spark, sf):
    return V.sample_features(samples(spark, sf, 3)).select("session_id", F.round("mean", 4).alias("mean"), F.round("zero_crossing_rate", 6).alias("zero_crossing_rate"))


def samples(spark, sf, turn):
    """Frames' levels as samples, every ``turn``-th above zero."""
    sample = F.round(F.col("rms") * 10 * F.when(F.col("arrival") % turn == 0, 1).otherwise(-1)).cast("int")
    return view(spark, sf, "frames").select("session_id", "arrival", sample.alias("sample"))


_SAID = ("音量調到六十", "把亮度设为100%", "声音小一点", "屏幕调成夜间模式", "volume 35", "喇叭百分之三十到", "亮度最大", "聲音好像有問題", "音量一百二十到")
_ASKED = {0: ("volume", "set", 60, None), 1: ("brightness", "set", 100, None), 2: ("volume", "step", -1, None), 3: ("theme", "set", None, "dark"), 4: ("volume", "set", 35, None), 5: ("volume", "set", 30, None), 6: ("brightness", "set", 100, None)}


def _case(column: int) -> str:
    return "CASE turn_id % 10 " + " ".join(f"WHEN {n} THEN {repr(row[column])}" for n, row in _ASKED.items() if row[column] is not None) + " END"


@query("f24_device_command", duck(f"SELECT turn_id, {_case(0)} AS target, {_case(1)} AS kind, {_case(2)} AS level, {_case(3)} AS theme FROM turns", "turns"))
def device_command(spark, sf):
    said = F.element_at(F.array(*map(F.lit, _SAID), F.col("input_text")), (F.col("turn_id") % 10 + 1).cast("int"))
    return view(spark, sf, "turns").withColumn("c", K.device_command(said)).select("turn_id", "c.target", "c.kind", "c.level", "c.theme")


@query("f25_find_level", duck("SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(event_id % 101 AS INT) WHEN 1 THEN CAST(nullif(event_id % 101, 100) AS INT) WHEN 2 THEN 7 END AS level FROM heartbeats", "heartbeats"))
def find_level(spark, sf):
    n, e = (F.col("event_id") % 101).cast("string"), F.col("event_id") % 5
    text = (
        F.when(e == 0, F.concat(F.lit('{"audio": {"Speaker_Volume": '), n, F.lit("}}"))).when(e == 1, F.concat(F.lit('{"note": "\\"volume\\": 5", "volume": true, "list": [{"level": 400}, {"level": '), n, F.lit(".9}]}")))
        .when(e == 2, F.lit('{"volume": -3, "a": {"volume": 7, "level": 8}}')).when(e == 3, F.lit('{"volume": 5')).otherwise(F.col("props"))
    )
    return view(spark, sf, "heartbeats").select("event_id", K.find_level(text, "volume").alias("level"))


@query("h04_split_queries", duck("WITH p AS (SELECT turn_id, list_filter(list_transform(regexp_split_to_array(input_text, '[？?！!。；;，,\\n\\r]+'), lambda p: trim(regexp_replace(p, '[\\s\\p{Z}]+', ' ', 'g'))), lambda p: p <> '') AS x FROM turns), q AS (SELECT turn_id, CASE WHEN len(x) > 8 THEN x[1:7] || [array_to_string(x[8:], '，')] ELSE x END AS x FROM p) SELECT turn_id, CAST(generate_subscripts(x, 1) - 1 AS INT) AS part, unnest(x) AS question FROM q", "turns"))
def split_queries_table(spark, sf):
    register_tables(spark)
    return spark.sql("SELECT turn_id, q.part, q.question FROM {turns}, LATERAL split_queries(input_text) q", turns=view(spark, sf, "turns"))


@query("h04_bigrams", duck("WITH x AS (SELECT turn_id, regexp_replace(lower(input_text), '[^\\p{L}\\p{N}\\p{M}]+', '', 'g') AS x FROM turns) SELECT DISTINCT turn_id, substr(x, i, 2) AS bigram FROM x, LATERAL (SELECT unnest(generate_series(1, greatest(length(x) - 1, 1))) AS i) WHERE x <> ''", "turns"))
def bigrams_table(spark, sf):
    register_tables(spark)
    return spark.sql("SELECT turn_id, b.bigram FROM {turns}, LATERAL bigrams(input_text) b", turns=view(spark, sf, "turns"))


_IMPORT = "SELECT d.doc_id, CASE WHEN NOT (lang = 'fr' OR contains(source, 'src1') OR contains(source, 'src2')) THEN 'refused' WHEN d.doc_id % 5 = 0 OR d.doc_id % 3 = 0 THEN 'imported' ELSE 'skipped' END AS status FROM documents d"


def imported(spark, sf):
    d, c = catalog(spark, sf)
    docs = paths(spark, sf).join(d.select("doc_id", "sha256"), "doc_id").join(table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    rows = [(0, "src1", "", [], [], 1, 600, "reference"), (1, "src2", "", [], [], 1, 300, "reference"), (2, "", "fr/*.md", [], [], 1, 900, "scenario")]
    profiles = spark.createDataFrame(rows, "ord int, doc string, path_glob string, keep_sections array<string>, drop_sections array<string>, min_chars int, max_chars int, default_kind string")
    old = c.select("doc_id", F.format_string("%s#0000", F.col("doc_id").cast("string")).alias("chunk_id"), F.lit("old").alias("text"), F.lit("old").alias("kind"))
    return C.import_corpus(docs, profiles, c, old, 1)


@query("r03_import_corpus", duck(_IMPORT))
def import_corpus(spark, sf):
    return imported(spark, sf)[2]


@query("r03_import_counts", duck(f"WITH s AS ({_IMPORT}), k AS (SELECT s.doc_id, status, CASE WHEN status <> 'imported' THEN 1 END AS old FROM s JOIN documents USING (doc_id) WHERE status = 'imported' OR s.doc_id % 5 <> 0) SELECT doc_id, status = 'imported' AS is_new, CASE WHEN status = 'imported' THEN 'uncalibrated' END AS first_status FROM k", ))
def import_counts(spark, sf):
    docs, chunks, report = imported(spark, sf)
    fresh = chunks.groupBy("doc_id").agg((F.max("text") != "old").alias("is_new"))
    known = docs.select("doc_id", "calibration_status").join(fresh, "doc_id", "left").join(report, "doc_id")
    return known.select("doc_id", (F.col("status") == "imported").alias("is_new"), F.when(F.col("status") == "imported", F.lit("uncalibrated")).alias("first_status"))


@query("s03_read_markdown", duck("SELECT 'doc-' || doc_id AS doc_id, sha256('---' || chr(10) || 'title: T' || doc_id || chr(10) || '---' || chr(10) || coalesce(text, '')) AS sha256, sha256(coalesce(text, '')) AS body, 'T' || doc_id AS title FROM documents"))
def read_markdown(spark, sf):
    folder, i = scratch(spark, "markdown"), F.col("doc_id").cast("string")
    some = F.shiftright(F.monotonically_increasing_id(), 10).cast("string")  # a folder for each 1,024 files, of one task
    S.write_files(table(spark, sf, "documents").select(F.concat(some, F.lit("/Doc "), i, F.lit(".md")).alias("name"), F.concat(F.lit("---\ntitle: T"), i, F.lit("\n---\n"), F.coalesce("text", F.lit(""))).alias("content")), folder)
    return S.read_markdown(spark, folder).select("doc_id", "sha256", F.sha2("text", 256).alias("body"), F.col("front")["title"].alias("title"))


@query("s04_read_profiles", duck("SELECT n_name AS doc, CASE WHEN n_nationkey % 2 = 0 THEN 100 + n_nationkey ELSE 40 END AS min_chars, 600 AS max_chars, 1 AS min_heading_level, CASE WHEN n_nationkey % 3 = 0 THEN 'scenario' ELSE 'reference' END AS default_kind, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS drops FROM nation"))
def read_profiles(spark, sf):
    folder, n = scratch(spark, "profiles"), F.col("n_nationkey")
    profile = F.struct(F.col("n_name").alias("doc"), F.when(n % 2 == 0, n + 100).alias("min_chars"), F.when(n % 3 == 0, "scenario").alias("default_kind"), F.when(n % 2 == 0, F.array("n_name")).alias("drop_sections"))
    S.write_files(table(spark, sf, "nation").select(F.concat(n.cast("string"), F.lit(".json")).alias("name"), F.to_json(profile, {"pretty": "true"}).alias("content")), folder)
    return S.read_profiles(spark, folder).select("doc", "min_chars", "max_chars", "min_heading_level", "default_kind", F.array_join("drop_sections", ",").alias("drops"))


@query("s06_read_cases", duck("SELECT item_id, text AS question, CASE WHEN item_id % 2 = 0 THEN 'doc' || item_id ELSE '' END AS expect, CASE WHEN item_id % 3 = 0 THEN 'note' END AS note FROM benchmark"))
def read_cases(spark, sf):
    folder, i = scratch(spark, "cases"), F.col("item_id")
    case = F.to_json(F.struct(F.col("text").alias("question"), F.when(i % 2 == 0, F.array(F.concat(F.lit("doc"), i.cast("string")))).alias("expect"), F.array(F.array(i.cast("int"))).alias("expect_pages"), F.when(i % 3 == 0, "note").alias("note")))
    table(spark, sf, "benchmark").select(F.explode(F.array(F.lit("# a remark"), case, F.lit("   "))).alias("value")).write.text(folder)
    return S.read_cases(spark, folder).select(F.element_at(F.element_at("expect_pages", 1), 1).cast("long").alias("item_id"), "question", F.array_join(F.coalesce("expect", F.array().cast("array<string>")), ",").alias("expect"), "note")


@query("s11_append_events", duck("SELECT event_id, event_type, created_at FROM heartbeats", "heartbeats"))
def append_events(spark, sf):
    path, h = scratch(spark, "events"), view(spark, sf, "heartbeats").select("event_id", "event_type", "created_at")
    S.append_events(h.filter("event_id % 2 = 0"), path)
    S.append_events(h.filter("event_id % 2 <> 0"), path)
    return spark.read.parquet(path)


@query("s13_export_matrix", duck("SELECT chunk_id, round(embedding[1], 6) AS first, len(embedding) AS size FROM memory WHERE chunk_id % 5 <> 0", "memory"))
def exported_matrix(spark, sf):
    path = scratch(spark, "matrix")
    m = view(spark, sf, "memory").select("chunk_id", F.floor(F.col("chunk_id") / 4096).alias("doc_id"), (F.col("chunk_id") % 4096).alias("ord"), F.when(F.col("chunk_id") % 5 != 0, F.col("embedding")).alias("embedding"))
    export_matrix(m, path)
    return spark.read.parquet(path).select("chunk_id", F.round(F.col("embedding")[0], 6).alias("first"), F.size("embedding").cast("long").alias("size"))


@query("h01_embed_texts", duck("SELECT turn_id, CASE WHEN turn_id % 4 <> 0 THEN CAST(length('query: ' || input_text) AS FLOAT) END AS size FROM turns", "turns"))
def embed_texts(spark, sf):
    t = view(spark, sf, "turns").select("turn_id", F.when(F.col("turn_id") % 4 != 0, F.col("input_text")).alias("text"))
    return H.embed_texts(t, "text", lambda: lambda texts: [[float(len(x)), 1.0] for x in texts], as_query=True).select("turn_id", F.col("embedding")[0].alias("size"))


_ANSWERS = "p AS (SELECT session_id AS query_id, turn_id AS chunk_id, first_value(input_text) OVER (PARTITION BY session_id ORDER BY seq) AS question, response_text AS text, row_number() OVER (PARTITION BY session_id ORDER BY turn_id) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM turns)"


def answers(spark, sf):
    t = view(spark, sf, "turns")
    first = t.groupBy("session_id").agg(F.min_by("input_text", "seq").alias("question"))
    return t.join(first, "session_id").select(F.col("session_id").alias("query_id"), "question", F.col("turn_id").alias("chunk_id"), F.col("response_text").alias("text"))


@query("h02_rerank", duck(f"WITH {_ANSWERS}, s AS (SELECT *, length(text) % 97 + length(question) / 1000.0E0 AS rerank FROM p) SELECT query_id, 'scored' AS status, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, i) AS INTEGER) AS place, chunk_id, rerank FROM s WHERE length(question) % 5 > 1 UNION ALL SELECT DISTINCT query_id, CASE length(question) % 5 WHEN 0 THEN 'failed' ELSE 'none' END, NULL, NULL, NULL FROM p WHERE length(question) % 5 < 2", "turns"))
def rerank(spark, sf):
    """A scorer that fails for some questions and decides for none of the passages for others."""

    def scorer(question, texts):
        return (None, [])[len(question) % 5] if len(question) % 5 < 2 else [len(x) % 97 + len(question) / 1000.0 for x in texts]

    return H.rerank(answers(spark, sf), scorer)


@query("h02_rerank_picks", duck(f"WITH {_ANSWERS} SELECT query_id, 'picked' AS status, CAST(CASE WHEN n > 2 THEN CASE i WHEN 2 THEN 1 ELSE 2 END ELSE 1 END AS INTEGER) AS place, chunk_id, CAST(NULL AS DOUBLE) AS rerank FROM p WHERE length(question) % 2 = 0 AND i IN (0, 2) UNION ALL SELECT DISTINCT query_id, 'none', NULL, NULL, NULL FROM p WHERE length(question) % 2 = 1", "turns"))
def rerank_picks(spark, sf):
    return H.rerank(answers(spark, sf), lambda question, texts: [2, 99, 0, 2, -1] if len(question) % 2 == 0 else [], picks=True)


@query("h03_summarize", duck("SELECT turn_id AS user_id, CASE WHEN turn_id % 5 = 0 THEN 'before' WHEN length(s) > 400 THEN substr(s, 1, 400) || '…' ELSE s END AS summary, CASE WHEN turn_id % 5 = 0 THEN 3 ELSE seq END AS covered_count, CASE WHEN turn_id % 5 = 0 THEN 'ValueError' END AS error FROM (SELECT *, trim(regexp_replace('before ' || response_text, '[\\s\\p{Z}]+', ' ', 'g')) AS s FROM turns)", "turns"))
def summarize(spark, sf):
    t = view(spark, sf, "turns")

    def model(previous: str, transcript: str) -> str:
        if not transcript:
            raise ValueError("nothing to summarise")
        return f"{previous} {transcript}"

    text = F.when(F.col("turn_id") % 5 != 0, F.col("response_text"))
    return H.summarize(t.select(F.col("turn_id").alias("user_id"), F.lit("before").alias("previous"), text.alias("transcript"), F.lit(3).cast("long").alias("covered_count"), F.col("seq").alias("stop")), model)

"""Document collections: headings, pages, sections, chunks, imports and quality reports. Lines are (doc_id, pos, line)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let, strip

PAGE_MARK = r"<sub>p(\d+)</sub>"
# Marks that end a sentence.
SENTENCE_END = "(?<=[。！？；!?;])"
PATH_JOINT = " › "


def page_marker(line: Column) -> Column:
    """The page that an anchor of the line names, or null."""
    return F.regexp_extract(line, PAGE_MARK, 1).try_cast("int")


def strip_markers(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, PAGE_MARK, " "))


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading, else null."""
    marks = F.regexp_extract(line, r"^(#{1,6})\s+\S", 1)
    return F.when(marks != "", F.length(marks))


def heading_tree(lines: DataFrame) -> DataFrame:
    """(doc_id, start, stop, level, title, parents, section_path) of every heading, and of text before the first (level 0, no title).

    A heading of level k is a parent until the next heading of level k or less. ``stop`` is the next heading's place, null
    for the last.
    """
    heads = lines.withColumn("level", heading_level(F.col("line"))).filter("level is not null")
    heads = heads.select("doc_id", F.col("pos").alias("start"), "level", F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")).alias("title"))
    w = Window.partitionBy("doc_id").orderBy("start")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = heads.withColumn("stop", F.lead("start").over(w))
    for k in range(1, 6):
        # the last heading of level k, unless one of a smaller level has come since
        out = out.withColumn(f"at{k}", F.max(F.when(F.col("level") == k, F.col("start"))).over(before)).withColumn(f"cut{k}", F.max(F.when(F.col("level") < k, F.col("start"))).over(before))
        out = out.withColumn(f"t{k}", F.last(F.when(F.col("level") == k, F.col("title")), ignorenulls=True).over(before))
    parents = F.array(*(F.when((F.col("level") > k) & F.col(f"at{k}").isNotNull() & (F.col(f"cut{k}").isNull() | (F.col(f"cut{k}") < F.col(f"at{k}"))), F.col(f"t{k}")) for k in range(1, 6)))
    out = out.withColumn("parents", F.filter(parents, lambda p: p.isNotNull()))
    out = out.withColumn("section_path", F.array_join(F.concat("parents", F.array("title")), PATH_JOINT))
    return out.select("doc_id", "start", "stop", "level", "title", "parents", "section_path")


def carry_page(lines: DataFrame) -> DataFrame:
    """Lines with ``page``: that of the last anchor at or before them."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("page", F.last(page_marker(F.col("line")), ignorenulls=True).over(w))


def blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, section_start, pos, page, text): every line that is neither a heading nor empty, with the heading it stands under."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    paged = carry_page(lines).withColumn("level", heading_level(F.col("line")))
    placed = paged.withColumn("section_start", F.last(F.when(F.col("level").isNotNull(), F.col("pos")), ignorenulls=True).over(w))
    return placed.filter("level is null").select("doc_id", "section_start", "pos", "page", strip_markers(F.col("line")).alias("text")).filter("text <> ''")


def sectionize(lines: DataFrame, lead_title: str = "前言") -> DataFrame:
    """(doc_id, start, section_path, title, parents, level, page, n_blocks, body): headings with the text right below them."""
    body = blocks(lines).groupBy("doc_id", "section_start").agg(F.array_sort(F.collect_list(F.struct("pos", "page", "text"))).alias("b"))
    tree = heading_tree(lines)
    joined = body.join(tree, (body["doc_id"] == tree["doc_id"]) & (body["section_start"] == tree["start"]), "left")
    lead = F.lit(lead_title)
    return joined.select(
        body["doc_id"], F.coalesce("section_start", F.lit(-1)).alias("start"), F.coalesce("section_path", lead).alias("section_path"), F.coalesce("title", lead).alias("title"),
        F.coalesce("parents", F.array().cast("array<string>")).alias("parents"), F.coalesce("level", F.lit(1)).alias("level"), F.array_min(F.transform("b", lambda x: x["page"])).alias("page"),
        F.size("b").alias("n_blocks"), F.array_join(F.transform("b", lambda x: x["text"]), " ").alias("body"), "b",
    )


def _matches(title: Column, patterns: Sequence[str] | Column) -> Column:
    if isinstance(patterns, Column):
        return F.coalesce(F.exists(patterns, lambda p: F.contains(title, p)), F.lit(False))
    return reduce(lambda a, p: a | F.contains(title, F.lit(p)), patterns, F.lit(False))


def classify_section(title: Column, parents: Column, keep: Sequence[str] | Column = (), drop: Sequence[str] | Column = (), scenario: Sequence[str] = (), reference: Sequence[str] = (), default_kind: str | Column | None = "reference") -> Column:
    """Struct (keep, reason, kind): drop before keep before scenario (inherited too) before reference before the default kind.

    ``keep`` and ``drop`` may be array columns, of which an empty one keeps all or drops nothing.
    """
    up = lambda patterns: _matches(title, patterns) | F.exists(parents, lambda p: _matches(p, patterns))
    kept = (F.size(keep) <= 0) | up(keep) if isinstance(keep, Column) else up(keep) if keep else F.lit(True)
    kind = F.when(up(scenario), "scenario").when(up(reference), "reference").otherwise(default_kind if isinstance(default_kind, Column) else F.lit(default_kind))
    reason = F.when(_matches(title, drop), "drop_section").when(~kept, "not_in_keep_sections").when(kind.isNull(), "no_kind_rule").otherwise("kept")
    return F.struct((reason == "kept").alias("keep"), reason.alias("reason"), F.when(reason == "kept", kind).alias("kind"))


def is_exercise(text: Column, advice: Sequence[str], asks: str, imperative: str, tail: str) -> Column:
    """Why a text is a task for the reader, or null: blanks, empty cells, only questions, short instructions, a closing question.

    ``advice`` are words of which any makes it an answer; ``asks``, ``imperative`` and ``tail`` are patterns.
    """
    t = F.trim(text)
    no_advice = ~_matches(t, advice)
    questions = F.regexp_count(t, F.lit("[？?]"))
    sentences = F.filter(F.split(t, SENTENCE_END), lambda s: F.trim(s) != "")
    asked = F.aggregate(F.filter(sentences, lambda s: F.trim(s).rlike("[？?]$")), F.lit(0), lambda n, s: n + F.length(s))
    return (
        F.when(t == "", "empty")
        .when(F.regexp_count(t, F.lit(r"（ ）|\( \)|_{3,}")) >= 3, "fill_in_blanks")
        .when(F.regexp_count(t, F.lit(r"\|\s*(?=\|)")) >= 3, "empty_table_to_fill")
        .when(no_advice & (questions > 0) & ((questions >= 2) | t.rlike(asks)) & (F.length(t) - asked < 80), "questions_only")
        .when(no_advice & (F.length(t) < 250) & t.rlike(imperative), "task_instructions")
        .when(no_advice & F.substring(t, F.greatest(F.length(t) - 59, F.lit(1)), F.lit(60)).rlike(tail), "question_tail")
    )


def _fold(pieces: Column, size: int, joint: str) -> Column:
    """Pieces joined greedily while they fit ``size``; a longer one alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, piece: Column) -> Column:
        full = (acc["open"] != "") & (F.length(acc["open"]) + F.length(piece) > size)
        more = F.when(acc["open"] == "", piece).otherwise(F.concat(acc["open"], F.lit(joint), piece))
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(full, piece).otherwise(more).alias("open"))

    return F.aggregate(pieces, start, add, lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def split_windows(text: Column, size: int = 90, limit: int = 8) -> Column:
    """Windows of whole sentences of at most ``size`` characters, the first ``limit``; a longer sentence is a window."""
    sentences = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")
    return F.slice(_fold(sentences, size, ""), 1, limit)


def pack_chunks(sections: DataFrame, max_chars: int | Column = 600) -> DataFrame:
    """(doc_id, start, ord, page, text): the blocks of each section packed greedily; a page change starts a chunk, a chunk that
    is too long is cut after sentences. ``sections`` are rows of ``sectionize``. Each section folds alone, in its own row."""
    pages = F.transform(F.array_distinct(F.transform("b", lambda x: x["page"])), lambda p: F.struct(p.alias("page"), F.filter("b", lambda x: x["page"].eqNullSafe(p)).alias("b")))
    size = max_chars if isinstance(max_chars, Column) else F.lit(max_chars)
    runs = sections.select("doc_id", "start", size.alias("size"), F.posexplode(pages).alias("n", "run"))
    max_chars = F.col("size")
    pieces = F.flatten(F.transform(F.col("run.b"), lambda x: F.when(F.length(x["text"]) > max_chars, _fold(F.filter(F.split(x["text"], SENTENCE_END), lambda s: s != ""), max_chars, "")).otherwise(F.array(x["text"]))))
    packed = runs.select("doc_id", "start", "n", F.col("run.page").alias("page"), F.posexplode(_fold(pieces, max_chars, " ")).alias("m", "text"))
    w = Window.partitionBy("doc_id").orderBy("start", "n", "m")
    return packed.select("doc_id", "start", (F.row_number().over(w) - 1).alias("ord"), "page", "text")


def chunk_corpus(lines: DataFrame, keep: Sequence[str] | Column = (), drop: Sequence[str] | Column = (), scenario: Sequence[str] = (), reference: Sequence[str] = (), default_kind: str | Column | None = "reference", min_chars: int | Column = 40, max_chars: int | Column = 600, settings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, dropped): sections that pass the rules as chunks (doc_id, ord, page, kind, section_path, text), the others with their reason.

    Rules may be columns of ``settings`` (doc_id, ...), a row for each document, so documents of any number of profiles are one job.
    """
    sections = sectionize(lines)
    if settings is not None:
        sections = sections.join(settings, "doc_id")
    sections = sections.withColumn("c", classify_section(F.col("title"), F.col("parents"), keep, drop, scenario, reference, default_kind))
    reason = F.when(~F.col("c.keep"), F.col("c.reason")).when(F.length("body") < min_chars, "too_short")
    judged = sections.withColumn("reason", reason)
    kept = judged.filter("reason is null")
    named = kept.select("doc_id", "start", "section_path", "c.kind")
    chunks = pack_chunks(kept, max_chars).join(named, ["doc_id", "start"]).select("doc_id", "ord", "page", "kind", "section_path", "text")
    return chunks, judged.filter("reason is not null").select("doc_id", "section_path", "reason", F.length("body").alias("chars"))


def citation(section_path: Column, page: Column, label: str | Column) -> Column:
    label = label if isinstance(label, Column) else F.lit(label)
    leaf = F.element_at(F.split(section_path, PATH_JOINT), -1)
    return F.concat(label, F.when(page > 0, F.concat(F.lit(" p"), page)).otherwise(F.lit("")), F.lit(PATH_JOINT), leaf)


def needs_import(docs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Documents whose (doc_id, sha256, cleaner_version) the catalog lacks."""
    return docs.join(catalog.select("doc_id", "sha256", "cleaner_version"), ["doc_id", "sha256", "cleaner_version"], "left_anti")


def replace_document(catalog: DataFrame, chunks: DataFrame, new_docs: DataFrame, new_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog and chunks after an import: old chunks of imported documents go, ids are ``doc#0000``, the calibration status stays."""
    ids = new_docs.select("doc_id").distinct()
    status = catalog.select("doc_id", "calibration_status")
    rows = new_docs.join(status, "doc_id", "left").withColumn("calibration_status", F.coalesce("calibration_status", F.lit("uncalibrated")))
    docs = catalog.join(ids, "doc_id", "left_anti").unionByName(rows.select(*catalog.columns))
    named = new_chunks.withColumns({"chunk_id": F.format_string("%s#%04d", F.col("doc_id").cast("string"), F.col("ord")), "hits": F.lit(0)})
    return docs, chunks.join(ids, "doc_id", "left_anti").unionByName(named.select(*chunks.columns))


def import_corpus(docs: DataFrame, profiles: DataFrame, catalog: DataFrame, chunks: DataFrame, cleaner_version: int, force: bool = False, embed: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalog, chunks, report) after an import of ``docs`` (doc_id, path, sha256, text).

    ``report`` has a status for each document: refused without a profile, skipped if the catalog has it as it is (unless
    ``force``), else imported. ``profiles`` are rows of ``read_profiles`` with ``ord``; a document carries the settings of its own as
    columns, so all are read and chunked in one job. ``embed`` adds the vectors of ``text`` to new chunks. Chunks and catalog
    keep the columns that they have; new chunks offer doc_id, ord, chunk_id, page, kind, section_path, text, source_id,
    windows, hits, embedding.
    """
    placed = profile_for(docs.select("doc_id", "path"), profiles)
    stale = needs_import(docs.select("doc_id", "sha256").withColumn("cleaner_version", F.lit(cleaner_version)), catalog).select("doc_id", F.lit(True).alias("stale"))
    known = placed.select("doc_id", "profile", "refused").join(stale, "doc_id", "left")
    report = known.select("doc_id", "profile", F.when(F.col("refused"), "refused").when(F.lit(force) | F.col("stale"), "imported").otherwise("skipped").alias("status"))
    new = docs.join(report.filter("status = 'imported'").select("doc_id", "profile"), "doc_id")
    lines = new.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    profile = profiles.select(F.col("ord").alias("profile"), F.col("doc").alias("label"), "keep_sections", "drop_sections", "min_chars", "max_chars", "default_kind")
    settings = new.select("doc_id", "profile").join(profile, "profile").drop("profile")
    of = F.col
    found, _ = chunk_corpus(lines, of("keep_sections"), of("drop_sections"), default_kind=of("default_kind"), min_chars=of("min_chars"), max_chars=of("max_chars"), settings=settings)
    found = found.join(settings.select("doc_id", "label"), "doc_id").withColumn("source_id", citation(of("section_path"), of("page"), of("label"))).drop("label")
    report = report.select("doc_id", "status")
    found = found.withColumn("windows", split_windows(F.col("text")))
    if embed is not None:
        found = embed(found)
    for c in set(chunks.columns) - set(found.columns) - {"chunk_id", "hits"}:
        found = found.withColumn(c, F.lit(None).cast(chunks.schema[c].dataType))
    rows = new.withColumn("cleaner_version", F.lit(cleaner_version))
    for c in set(catalog.columns) - set(rows.columns) - {"calibration_status"}:
        rows = rows.withColumn(c, F.lit(None).cast(catalog.schema[c].dataType))
    return *replace_document(catalog, chunks, rows.select(*(c for c in catalog.columns if c != "calibration_status")), found), report


def delete_document(catalog: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return catalog.join(ids, "doc_id", "left_anti"), chunks.join(ids, "doc_id", "left_anti")


def profile_for(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Documents (doc_id, path) with the first profile that fits: a glob before a name part, then file order; others are refused.

    Profiles are a short ordered list, dealt out whole: ``profiles`` has doc, path_glob and ord.
    """
    glob = F.concat(F.lit("(^|.*/)"), F.regexp_replace(F.regexp_replace("path_glob", r"\.", r"\\."), r"\*", "[^/]*"), F.lit("$"))
    listed = profiles.withColumn("pattern", F.when(F.col("path_glob") != "", glob)).agg(F.array_sort(F.collect_list(F.struct("ord", "doc", "pattern"))).alias("profiles")).withColumn("k", F.lit(1))
    both = docs.withColumn("k", F.lit(1)).join(listed, "k").drop("k")
    by_glob = F.filter("profiles", lambda p: F.coalesce(F.rlike(F.col("path"), p["pattern"]), F.lit(False)))
    by_name = F.filter("profiles", lambda p: F.coalesce((p["doc"] != "") & F.contains(F.element_at(F.split("path", "/"), -1), p["doc"]), F.lit(False)))
    return both.withColumn("profile", F.coalesce(F.try_element_at(by_glob, F.lit(1)), F.try_element_at(by_name, F.lit(1)))).select("doc_id", "path", F.col("profile.ord").alias("profile"), F.col("profile").isNull().alias("refused"))


def corpus_counts(chunks: DataFrame) -> DataFrame:
    """(kind, chunks, docs) with a row ``all``."""
    per_kind = chunks.groupBy("kind").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("docs"))
    return per_kind.unionByName(chunks.agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("docs")).withColumn("kind", F.lit("all")))


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): of n values the one of rank n // 2 (from 0), by counts of equal values; no key's values are gathered."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(key)
    ranked = counts.withColumn("upto", F.sum("n").over(whole.orderBy(value))).withColumn("all", F.sum("n").over(whole))
    return ranked.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(key).agg(F.min(value).alias("median"))


def corpus_profile(lines: DataFrame, chunks: DataFrame, dropped: DataFrame, max_chars: int = 600) -> DataFrame:
    """Per document of ``lines`` what its text and its chunks are like; ``chunks`` and ``dropped`` as ``chunk_corpus`` gives them.

    lines, paragraphs (neither blank nor a heading), chars (no white space), h1 to h6, page_anchors, images, table_rows (two bars at
    least), chunks, chunk_chars, chunk_min, chunk_median (the upper one), chunk_max, chunks_over_max, scenario_chars,
    reference_chars, dropped_sections, dropped_chars, dropped_reasons (map). Without chunks their figures are 0.
    """
    level = heading_level(F.col("line"))
    bare = F.regexp_replace("line", r"(?U)\s", "")
    text = lines.groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.count_if((bare != "") & level.isNull()).alias("paragraphs"), F.sum(F.length(bare)).alias("chars"), *(F.count_if(level == k).alias(f"h{k}") for k in range(1, 7)),
        F.sum(F.regexp_count("line", F.lit(PAGE_MARK))).cast("long").alias("page_anchors"), F.sum(F.regexp_count("line", F.lit(r"!\["))).cast("long").alias("images"), F.count_if(F.regexp_count("line", F.lit(r"\|")) >= 2).alias("table_rows"),
    )
    sized = chunks.select("doc_id", "kind", F.length("text").alias("size"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("size"))), F.lit(0)).alias(f"{kind}_chars")
    made = sized.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.sum("size").alias("chunk_chars"), F.min("size").alias("chunk_min"), F.max("size").alias("chunk_max"), F.count_if(F.col("size") > max_chars).alias("chunks_over_max"), of("scenario"), of("reference"),
    )
    median = upper_median(sized, "doc_id", "size").withColumnRenamed("median", "chunk_median")
    reasons = dropped.groupBy("doc_id", "reason").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    gone = reasons.groupBy("doc_id").agg(F.sum("n").alias("dropped_sections"), F.sum("chars").alias("dropped_chars"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("dropped_reasons"))
    out = text.join(made, "doc_id", "left").join(median, "doc_id", "left").join(gone, "doc_id", "left")
    counted = [c for c in out.columns if c not in ("doc_id", "dropped_reasons")]
    return out.fillna(0, counted).withColumn("dropped_reasons", F.coalesce("dropped_reasons", F.create_map().cast("map<string,bigint>")))


def parse_toc(lines: DataFrame) -> DataFrame:
    """(doc_id, ord, title, page) of the entries of a table of contents: list items that end in a page anchor."""
    entry = lambda n: F.regexp_extract("line", r"(?i)^\s*[-*]\s+(.+?)\s*<sub>\s*p(\d+)\s*</sub>\s*$", n)
    return lines.filter(entry(2) != "").select("doc_id", F.col("pos").alias("ord"), strip(entry(1)).alias("title"), entry(2).cast("int").alias("page"))


def toc_pages(sections: DataFrame, toc: DataFrame) -> DataFrame:
    """Sections (doc_id, start, level, title) with ``toc_page``: the page of the same occurrence of their title in the table of contents
    (doc_id, ord, title, page), else that of the nearest heading above them in the tree that has one."""
    n = lambda order: F.row_number().over(Window.partitionBy("doc_id", "title").orderBy(order))
    own = sections.withColumn("n", n("start")).join(toc.withColumn("n", n("ord")).select("doc_id", "title", "n", F.col("page").alias("own_page")), ["doc_id", "title", "n"], "left").drop("n")
    before = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inherited = []
    for k in range(5, 0, -1):
        # the last heading of level k is above, unless one of a smaller level has come since
        at = F.max(F.when(F.col("level") == k, F.struct("start", "own_page"))).over(before)
        cut = F.max(F.when(F.col("level") < k, F.col("start"))).over(before)
        own = own.withColumn(f"above{k}", F.when((F.col("level") > k) & (cut.isNull() | (cut < at["start"])), at["own_page"]))
        inherited.append(f"above{k}")
    return own.withColumn("toc_page", F.coalesce("own_page", *inherited)).drop("own_page", *inherited)


def coverage_check(source: DataFrame, output: DataFrame, part: int = 512) -> DataFrame:
    """(class, kept, total) of source lines (doc_id, class, line) that the output (doc_id, text) holds, white space aside.

    A document's text stands once beside every ``part`` of its different lines, not beside each line.
    """
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    lines = source.select("doc_id", "class", bare("line").alias("bare")).filter("bare <> ''").groupBy("doc_id", "class", "bare").agg(F.count("*").alias("n"))
    number = F.count("*").over(Window.partitionBy("doc_id"))
    parts = lines.withColumn("part", F.pmod(F.xxhash64("class", "bare"), F.ceil(number / part)))
    parts = parts.groupBy("doc_id", "part").agg(F.collect_list(F.struct("class", "bare", "n")).alias("lines"))
    out = output.select("doc_id", bare("text").alias("text"))
    held = F.transform("lines", lambda x: F.struct(x["class"].alias("class"), x["n"].alias("n"), F.contains(F.coalesce("text", F.lit("")), x["bare"]).alias("held")))
    found = parts.join(out, "doc_id", "left").select(F.inline(held))
    return found.groupBy("class").agg(F.coalesce(F.sum(F.when(F.col("held"), F.col("n"))), F.lit(0)).alias("kept"), F.sum("n").alias("total"))


#: Shares of a page's height above and below which text is a header or footer; marks that end a sentence, on a line and
#: at the foot of a page; marks that no heading has.
HEADER_BAND, FOOTER_BAND = 0.09, 0.91
LINE_ENDS = "。！？；.!?;：:"
PARAGRAPH_ENDS = "。！？；.!?;”」』）"
PROSE_MARKS = "。！？；，、："


def running_heads(lines: DataFrame, band: float = 0.08, pages: int = 3, longest: int = 30) -> DataFrame:
    """(doc_id, text, n): short texts at the top of several pages; ``lines``: doc_id, page, text, y, page_height."""
    top = lines.filter((F.col("y") < band * F.col("page_height")) & (F.length(F.trim("text")) <= longest) & (F.trim("text") != ""))
    return top.groupBy("doc_id", F.trim("text").alias("text")).agg(F.count_distinct("page").alias("n")).filter(F.col("n") >= pages)


def page_offset(lines: DataFrame, band: float = 0.12) -> DataFrame:
    """(doc_id, offset, votes): the most frequent difference of page and printed number in the bands, of equals the first seen."""
    edge = lines.filter((F.col("y") < band * F.col("page_height")) | (F.col("y") > (1 - band) * F.col("page_height")))
    printed = edge.withColumn("printed", F.regexp_extract("text", r"(\d{1,4})", 1).try_cast("int")).filter("printed is not null")
    votes = printed.withColumn("offset", F.col("page") - F.col("printed")).groupBy("doc_id", "offset").agg(F.count("*").alias("votes"), F.min("page").alias("first"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("votes"), "first", "offset")
    return votes.withColumn("r", F.row_number().over(w)).filter("r = 1").select("doc_id", "offset", "votes")


def page_report(lines: DataFrame, paragraphs: DataFrame, offsets: DataFrame) -> DataFrame:
    """(doc_id, page, printed_page, lines, paragraphs, chars, mean_score) of every page of ``lines`` (doc_id, page, score).

    ``paragraphs`` as ``carry_paragraph`` gives them, with the page where each ends up; ``offsets`` as ``page_offset`` does, 0 where
    there is none. A page without paragraphs has 0 of them; lines without a score do not count in the mean.
    """
    read = lines.groupBy("doc_id", "page").agg(F.count("*").alias("lines"), F.round(F.avg("score"), 3).alias("mean_score"))
    made = paragraphs.groupBy("doc_id", "page").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"))
    out = read.join(made, ["doc_id", "page"], "left").join(offsets.select("doc_id", "offset"), "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("doc_id", "page", (F.col("page") - zero("offset")).alias("printed_page"), "lines", zero("paragraphs").alias("paragraphs"), zero("chars").alias("chars"), "mean_score")


def paragraphs_from_lines(lines: DataFrame, heads: DataFrame | None = None, pairs: Sequence[tuple[str, str]] = (), headings: bool = True, indent: float = 0.8, pitch: float = 1.35) -> DataFrame:
    """(doc_id, page, paragraph, text): each page's lines (doc_id, page, text, y, x, width, page_height, page_width) as paragraphs.

    Lines in the header and footer bands, blank ones and running ``heads`` (doc_id, text) are out; the others are read by rows of
    about six units, then from left to right, with ``fix_confusions`` by ``pairs``. An indent of more than ``indent`` median character
    widths, or a step of more than ``pitch`` median steps, starts a paragraph. A short line without punctuation that follows a finished
    sentence and stands in the middle or after such a step is a heading, ``### ...``, and never part of a paragraph. The fold over a
    page's lines is one expression; no row leaves the page.
    """
    at, high = F.col("y"), F.col("page_height")
    body = lines.withColumn("bare", strip(F.col("text"))).filter((F.col("bare") != "") & (at >= HEADER_BAND * high) & (at <= FOOTER_BAND * high))
    if heads is not None:
        body = body.join(heads.select("doc_id", F.col("text").alias("bare")).distinct(), ["doc_id", "bare"], "left_anti")
    order = Window.partitionBy("doc_id", "page").orderBy(F.bround(at / 6), "x", "y", "text")
    steps = body.withColumn("step", at - F.lag("y").over(order)).withColumn("r", F.row_number().over(order))
    clean = fix_confusions(F.col("bare"), pairs)
    line = F.struct("r", clean.alias("text"), F.col("x").cast("double").alias("x"), at.cast("double").alias("y"), F.col("width").cast("double").alias("width"))
    pages = steps.groupBy("doc_id", "page").agg(
        F.array_sort(F.collect_list(line)).alias("lines"), F.min("x").alias("left"), F.percentile(F.col("width") / F.greatest(F.length("text"), F.lit(1)), F.lit(0.5)).alias("char"),
        F.coalesce(F.percentile(F.when(F.col("step") > 0, F.col("step")), F.lit(0.5)), F.lit(12.0)).alias("usual"), F.max("page_width").alias("across"),
    )
    state = lambda done, open_, y, ended: F.struct(done.alias("done"), open_.alias("open"), y.alias("y"), ended.alias("ended"))
    start = state(F.array().cast("array<string>"), F.lit(""), F.lit(None).cast("double"), F.lit(True))
    push = lambda done, text: F.when(text != "", F.concat(done, F.array(text))).otherwise(done)

    def take(a: Column, x: Column) -> Column:
        spaced = F.coalesce(x["y"] - a["y"] > pitch * F.col("usual"), F.lit(False))
        breaks = (a["open"] != "") & ((x["x"] - F.col("left") > indent * F.col("char")) | spaced)
        short = (F.length(x["text"]) <= 18) & ~x["text"].rlike(f"[{PROSE_MARKS}]")
        middle = F.abs(x["x"] + x["width"] / 2 - F.col("across") / 2) < F.col("across") * 0.06
        heading = F.lit(headings) & (breaks | (a["open"] == "")) & short & a["ended"] & (middle | spaced)
        facts = F.struct(F.when(breaks, push(a["done"], strip(a["open"]))).otherwise(a["done"]).alias("done"), F.when(breaks, "").otherwise(a["open"]).alias("open"), heading.alias("heading"))
        ended = F.substring(x["text"], -1, 1).isin(*LINE_ENDS)
        return let(facts, lambda f: F.when(f["heading"], state(F.concat(f["done"], F.array(F.concat(F.lit("### "), x["text"]))), F.lit(""), x["y"], F.lit(True))).otherwise(state(f["done"], F.concat(f["open"], x["text"]), x["y"], ended)))

    made = pages.select("doc_id", "page", F.posexplode(F.aggregate("lines", start, take, lambda a: push(a["done"], strip(a["open"])))).alias("n", "text"))
    return made.select("doc_id", "page", (F.col("n") + 1).alias("paragraph"), "text")


def carry_paragraph(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, block, page, text) of ``paragraphs`` (doc_id, page, paragraph, text), in order.

    A page's last paragraph that is no heading and does not end a sentence is carried to the document's next page: it goes before that
    page's first paragraph, as one with it unless that is a heading. On the last page it stays. A paragraph has the page on which it
    ends up.
    """
    w = Window.partitionBy("doc_id").orderBy("page", "paragraph")
    heading = lambda c: F.startswith(c, F.lit("###"))
    open_ = lambda c: ~heading(c) & ~F.coalesce(F.substring(c, -1, 1).isin(*PARAGRAPH_ENDS), F.lit(False))
    before, after = F.lag(F.struct("page", "text")).over(w), F.lead(F.struct("page", "text")).over(w)
    joins = F.coalesce((before["page"] < F.col("page")) & open_(before["text"]) & ~heading(F.col("text")), F.lit(False))
    carried = F.coalesce((after["page"] > F.col("page")) & open_(F.col("text")), F.lit(False))
    runs = paragraphs.withColumns({"joins": joins, "ends": F.when(carried, after["page"]).otherwise(F.col("page"))}).withColumn("block", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(w))
    return runs.groupBy("doc_id", "block").agg(F.max("ends").alias("page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "paragraph", "text"))), lambda s: s["text"]), "").alias("text"))


def fix_confusions(text: Column, pairs: Sequence[tuple[str, str]], doubles: Sequence[str] = ("一一个", "一一些", "一一直", "一一定", "一一般", "一一样")) -> Column:
    """OCR corrections: listed pairs, runs of dashes as 一 (doubles undone), numbers in full-width brackets."""
    for wrong, right in pairs:
        text = F.replace(text, F.lit(wrong), F.lit(right))

    def undo(t: Column) -> Column:
        for double in doubles:
            t = F.replace(t, F.lit(double), F.lit(double[1:]))
        return t

    fixed = let(text, lambda t: F.when(t.rlike("[-—–·]"), undo(F.regexp_replace(t, "[-—–·]+", "一"))).otherwise(t))
    return F.regexp_replace(fixed, r"[（(]\s*(\d{1,2})\s*[)）]", "（$1）")


def tidy(text: Column) -> Column:
    """Private-use glyphs out, white space single, no space next to CJK letters or before CJK marks."""
    t = F.regexp_replace(text, r"[\x{E000}-\x{F8FF}]", "")
    t = F.regexp_replace(F.replace(t, F.lit("　"), F.lit(" ")), r"[ \t\x0B\f\r]+", " ")
    t = F.regexp_replace(t, r"(?<=[\x{4e00}-\x{9fff}]) +(?=[\x{4e00}-\x{9fff}，。、；：！？])", "")
    return F.trim(F.regexp_replace(t, r" +(?=[，。、；：！？])", ""))

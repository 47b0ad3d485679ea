"""Paragraphs of page lines, carried paragraphs, contents and profiles against plain Python folds."""

import random
import statistics

import pytest

from turnlake.operators import corpus as C

PAIRS = (("进人", "进入"),)
LINE = "doc_id long, page int, text string, y double, x double, width double, page_height double, page_width double"


def plain_paragraphs(lines, heads, headings=True):
    """One page, rule by rule; the corrections aside, which have their own test."""
    rows = [r for r in lines if r["text"].strip() and 90 <= r["y"] <= 910 and r["text"].strip() not in heads]
    rows.sort(key=lambda r: (round(r["y"] / 6), r["x"], r["y"], r["text"]))
    if not rows:
        return []
    left = min(r["x"] for r in rows)
    char = statistics.median(r["width"] / len(r["text"]) for r in rows)
    steps = [b["y"] - a["y"] for a, b in zip(rows, rows[1:], strict=False)]
    usual = statistics.median([s for s in steps if s > 0] or [12.0])
    out, held, y, finished = [], [], None, True
    for r in rows:
        text = r["text"].strip()
        gap = y is not None and r["y"] - y > 1.35 * usual
        if held and (gap or r["x"] - left > 0.8 * char):
            out.append("".join(held))
            held = []
        middle = abs(r["x"] + r["width"] / 2 - 400) < 48
        if headings and not held and finished and (gap or middle) and len(text) <= 18 and not set(text) & set("。！？；，、："):
            out.append("### " + text)
            finished = True
        else:
            held.append(text)
            finished = text[-1] in "。！？；.!?;：:"
        y = r["y"]
    return out + (["".join(held)] if held else [])


def pages(seed, n=60):
    rng = random.Random(seed)
    words = ["说到这里", "他走了。", "标题", "a b", "长长的一行文字没有标点却很长很长很长很长", "end.", "问？", " 空 ", "", "Head 1"]
    out = []
    for page in range(n):
        y = 30.0
        for _ in range(rng.randint(0, 14)):
            y += rng.choice([0, 4, 30, 30, 30, 30, 55, 140])
            text = rng.choice(words)
            out.append({"doc_id": page % 4, "page": page, "text": text, "y": y, "x": rng.choice([60.0, 60.0, 60.0, 90.0, 340.0, 380.0]), "width": float(max(1, len(text)) * rng.choice([10, 12])), "page_height": 1000.0, "page_width": 800.0})
    return out


@pytest.mark.parametrize("headings", [True, False])
def test_paragraphs_of_pages(spark, headings):
    rows = pages(1)
    lines = spark.createDataFrame([tuple(r.values()) for r in rows], LINE).repartition(3)
    heads = spark.createDataFrame([(d, "Head 1") for d in range(4)], "doc_id long, text string")
    got = {}
    for r in sorted(C.paragraphs_from_lines(lines, heads, headings=headings).collect(), key=lambda r: (r.page, r.paragraph)):
        got.setdefault(r.page, []).append(r.text)
    by_page = {}
    for r in rows:
        by_page.setdefault(r["page"], []).append(r)
    want = {p: found for p, own in by_page.items() if (found := plain_paragraphs(own, {"Head 1"}, headings))}
    assert got == want and any(t.startswith("###") for own in want.values() for t in own) == headings


def test_lines_are_corrected_and_a_page_may_have_one_line(spark):
    lines = spark.createDataFrame([(1, 1, "进人(3)——个", 500.0, 60.0, 90.0, 1000.0, 800.0)], LINE)
    assert [r.text for r in C.paragraphs_from_lines(lines, pairs=PAIRS, headings=False).collect()] == ["进入（3）一个"]
    assert C.paragraphs_from_lines(lines.filter("page = 9")).count() == 0


def plain_carry(doc):
    """Page after page with what is carried in hand; ``doc``: page to its paragraphs."""
    out, carry, numbers = {}, "", sorted(p for p in doc if doc[p])
    for i, p in enumerate(numbers):
        own = list(doc[p])
        if carry:
            own = [carry + own[0], *own[1:]] if not own[0].startswith("###") else [carry, *own]
            carry = ""
        if i + 1 < len(numbers) and not own[-1].startswith("###") and own[-1][-1] not in "。！？；.!?;”」』）":
            carry = own.pop()
        out[p] = own
    return {p: own for p, own in out.items() if own}


def test_unfinished_paragraphs_are_carried(spark):
    rng = random.Random(2)
    docs = {d: {p: [rng.choice(["### H", "open", "done.", "quote”", "more", "半句"]) for _ in range(rng.randint(0, 3))] for p in range(1, 12)} for d in range(30)}
    rows = [(d, p, i + 1, t) for d, doc in docs.items() for p, own in doc.items() for i, t in enumerate(own)]
    got = {}
    found = C.carry_paragraph(spark.createDataFrame(rows, "doc_id long, page int, paragraph int, text string").repartition(4)).collect()
    for r in sorted(found, key=lambda r: (r.doc_id, r.block)):
        got.setdefault(r.doc_id, {}).setdefault(r.page, []).append(r.text)
    assert got == {d: plain_carry(doc) for d, doc in docs.items() if any(doc.values())}


def test_sections_without_an_entry_have_the_page_above(spark):
    heads = [(1, 0, 1, "A"), (1, 1, 2, "B"), (1, 2, 3, "C"), (1, 3, 2, "B"), (1, 4, 4, "D"), (1, 5, 1, "E"), (1, 6, 3, "F"), (1, 7, 2, "B"), (2, 0, 2, "A"), (2, 1, 1, "X"), (2, 2, 2, "Y")]
    toc = C.parse_toc(spark.createDataFrame([(1, 0, "- A <sub>p3</sub>"), (1, 1, " * B  <sub> p5 </sub> "), (1, 2, "text <sub>p6</sub>"), (1, 3, "- B <SUB>P9</SUB>"), (2, 1, "- X <sub>p1</sub>")], "doc_id long, pos int, line string"))
    assert sorted((r.doc_id, r.title, r.page) for r in toc.collect()) == [(1, "A", 3), (1, "B", 5), (1, "B", 9), (2, "X", 1)]
    got = C.toc_pages(spark.createDataFrame(heads, "doc_id long, start int, level int, title string"), toc).collect()
    assert [r.toc_page for r in sorted(got, key=lambda r: (r.doc_id, r.start))] == [3, 5, 5, 9, 9, None, None, None, None, 1, 1]


def test_upper_median_by_counts(spark):
    rng = random.Random(4)
    values = {k: [rng.randint(0, 9) for _ in range(n)] for k, n in enumerate((1, 2, 3, 10, 11, 500))}
    got = C.upper_median(spark.createDataFrame([(k, v) for k, own in values.items() for v in own], "k long, v int"), "k", "v").collect()
    assert {r.k: r.median for r in got} == {k: sorted(own)[len(own) // 2] for k, own in values.items()}


def test_profile_of_a_document_without_chunks(spark):
    lines = spark.createDataFrame([(1, 0, "# T"), (1, 1, "a | b | c <sub>p1</sub> <sub>p2</sub>"), (1, 2, "![x](y) | "), (1, 3, "  ")], "doc_id long, pos int, line string")
    chunks, dropped = C.chunk_corpus(lines, min_chars=400)
    (r,) = C.corpus_profile(lines, chunks, dropped).collect()
    assert (r.lines, r.paragraphs, r.h1, r.h2, r.page_anchors, r.images, r.table_rows) == (4, 2, 1, 0, 2, 1, 1)
    assert (r.chunks, r.chunk_median, r.dropped_sections, r.dropped_reasons) == (0, 0, 1, {"too_short": 1}) and r.dropped_chars > 0

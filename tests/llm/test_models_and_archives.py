"""op3 and op7 by held-out accuracy and edge cases; op4, op5, op9, op10 against their SQL, brute force and edge cases."""

import gzip
import hashlib
import math
import random
import re
import unicodedata
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import compare
from tests.compare import check, connect
from turnlake.llm import components, license_digests, metric_search, quality_rules, registry, storage, toxicity_kernel, url_equivalence, warc_archive

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    check(spark, con, SF, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_contracted_queries_are_registered():
    assert [sum(name.startswith(f"op{n}_") for name in registry.QUERIES) for n in range(1, 14)] == [1] * 13


@pytest.mark.parametrize(("name", "label", "least"), [("op3_toxicity_kernel", "toxic", 0.9), ("op7_quality_rules", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = registry.QUERIES[name](spark, SF)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and scored.count() == 1000
    rows = scored.join(labels, "doc_id").filter("held_out").select("predicted", label, "score").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r[label] for r in rows]) >= least
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


ODD = [(1, None), (2, ""), (3, " "), (None, "worthless"), (4, "x" * 50_000), (5, "same"), (5, "same")]


@pytest.mark.parametrize("score", [lambda d, la: toxicity_kernel.score_toxicity(d, la, F.lit(False)), lambda d, la: quality_rules.score_quality(d, la, F.lit(False))])
def test_classifiers_without_labels_or_rows(spark, score):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = score(docs, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert score(docs.limit(0), labels.limit(0)).count() == 0


def test_kernel_tolerates_gaps_and_inserts(spark):
    rng = random.Random(2)
    clean = lambda n: " ".join("".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(i, f"{clean(20)}. {clean(5)} {'idiot' if i % 2 else 'moron'} {clean(5)}" if i % 4 < 2 else clean(30), int(i % 4 < 2)) for i in range(400)]
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity_kernel.fit_toxicity(train.select("toxic", "text"))
    texts = [f"{clean(15)} {w} {clean(15)}" for w in ("idiot", "i.d.i.o.t", "i d i o t", "idxiot", "IDIOT!!", "m-o-r-o-n")] + [clean(30) for _ in range(20)]
    scores = model.document_score(toxicity_kernel.document_facts(texts, model))
    assert min(scores[:6]) > max(scores[6:])


def plain_kernel(a, b):
    """Sum over equal subsequences of three symbols of both words, boundaries added; by pairs of occurrences."""
    def occurrences(word):
        s = f"^{word}$".replace("^", "\0").replace("$", "\0")
        return [(s[i] + s[j] + s[k], 0.8 ** (k - i)) for i in range(len(s)) for j in range(i + 1, len(s)) for k in range(j + 1, min(i + 6, len(s)))]

    x, y = occurrences(a), occurrences(b)
    return sum(p * q for u, p in x for v, q in y if u == v)


def test_kernel_values_are_sums_over_subsequences():
    words = ["abcd", "bc", "aabcih", "a", "hahahaha", "глупый", "ßé漢"]
    marks = ["abcd", "haha", "глуп", "bc"]
    got = toxicity_kernel._kernel([toxicity_kernel.word_bytes(w) for w in words], [toxicity_kernel.word_bytes(m) for m in marks])
    want = np.array([[plain_kernel(w, m) / np.sqrt(plain_kernel(w, w) * plain_kernel(m, m)) for m in marks] for w in words])
    assert np.allclose(got, want) and np.allclose(np.diag(toxicity_kernel._kernel([toxicity_kernel.word_bytes(m) for m in marks], [toxicity_kernel.word_bytes(m) for m in marks])), 1)


def test_a_document_scores_as_by_hand():
    marks, factors, bias, link = ["idiot", "moron"], np.array([1.5, -0.25]), -0.4, np.array([-1.0, 3.0, 0.5, 0.25, -0.125])
    model = toxicity_kernel.ToxicityModel(toxicity_kernel.Weights.of([toxicity_kernel.word_bytes(m) for m in marks], factors), bias, link)
    text = "You 1d10t! i d i o t, the moron idiot idxiot x"
    words = ["you", "idiot", "idiot", "the", "moron", "idiot", "idxiot", "x"]
    kernel = lambda w, m: plain_kernel(w, m) / np.sqrt(plain_kernel(w, w) * plain_kernel(m, m))
    scores = sorted((sum(f * kernel(w, m) for f, m in zip(factors, marks, strict=True)) + bias for w in words), reverse=True)
    facts = [scores[0], scores[1], np.log1p(sum(x > 0 for x in scores)), np.log1p(len(scores))]
    got = toxicity_kernel.document_facts([text, None, "!!"], model)
    assert np.allclose(got[0], facts) and np.allclose(got[1:], [-1, -1, 0, 0])
    assert np.allclose(model.document_score(got)[0], 1 / (1 + np.exp(-(link[0] + np.dot(link[1:], facts)))))


def kernel_model():
    marks = [toxicity_kernel.word_bytes(w) for w in ("some", "words", "q", "between")]
    return toxicity_kernel.ToxicityModel(toxicity_kernel.Weights.of(marks, np.array([1.0, -1.0, 0.5, 2.0])), -0.5, np.zeros(5))


def test_long_texts_score_as_in_one_piece(monkeypatch):
    model = kernel_model()
    texts = ["some words of a text that is cut between words " * 9, None, "", "q", "z" * 5_000, "i d i o t s o m e " * 40, "1 2 3 " * 90, "So" + "ΣΑΣ" * 70 + " me " + "b" * 90]
    whole = toxicity_kernel.document_facts(texts, model)
    for name, value in (("SLICE", 50), ("REMEMBERED", 3), ("PART", 17), ("HELD", 40)):
        monkeypatch.setattr(toxicity_kernel, name, value)
    assert np.allclose(whole, toxicity_kernel.document_facts(texts, kernel_model()))


def test_long_words_score_by_parts_as_whole(monkeypatch):
    model, rng = kernel_model(), random.Random(4)
    words = ["between" * 400, "".join(rng.choice("abc") for _ in range(3000)), "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3000)), "x" * 65]
    for part, held in ((1 << 16, 1 << 22), (64, 500)):
        monkeypatch.setattr(toxicity_kernel, "PART", part)
        monkeypatch.setattr(toxicity_kernel, "HELD", held)
        for w in words:
            codes, starts, _ = toxicity_kernel.symbols_of([w])
            whole = model.weights.values([toxicity_kernel.word_bytes(w)])[0] + model.bias
            assert np.isclose(model.scores_of(codes, starts)[-1], whole)


def test_letters_of_every_plane_are_letters():
    assert toxicity_kernel.words_of(*toxicity_kernel.symbols_of(["\U00030001\U00030002 \U0001f642 \U00031350"])[:2])[-3:] == [toxicity_kernel.word_bytes("\U00030001\U00030002"), b"", toxicity_kernel.word_bytes("\U00031350")]


def test_a_word_of_many_megabytes_stays_below_a_gigabyte():
    import subprocess
    import sys

    code = "import numpy as np, random, resource; from turnlake.llm import toxicity_kernel as K; m = K.ToxicityModel(K.Weights.of([K.word_bytes('idiot')], np.ones(1)), 0.0, np.zeros(5)); r = random.Random(1)\n"
    code += "t = ''.join(r.choices('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/', k=10_000_000)); assert K.document_facts([t], m)[0, 3] > 0; print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, check=True).stdout) < 1000


def test_rules_are_paths_and_columns(spark):
    dump = "Tree\n  If (feature 0 <= 1.5)\n   If (feature 1 > 0.25)\n    Predict: 1.0\n   Else (feature 1 <= 0.25)\n    Predict: 0.0\n  Else (feature 0 > 1.5)\n   Predict: 0.0\n"
    rules = {tuple((c.name, c.above, c.bound) for c in rule) for rule in quality_rules.tree_paths(dump)}
    assert (("length", False, 1.5), ("word_length", True, 0.25)) in rules and len(rules) == 4


def plain_statistics(text):
    t = text or ""
    size, lines = len(t), t.split("\n")
    words = re.split(r"[ \t\n\x0b\f\r]+", t.strip(" "))
    share = lambda f: sum(map(f, t)) / max(size, 1)
    of = lambda marks: share(lambda c: c in marks)
    return {
        "length": math.log1p(size), "word_length": (size - len(words) + 1) / len(words), "distinct_words": len({w.lower() for w in words}) / len(words), "upper": share(lambda c: unicodedata.category(c) == "Lu"),
        "digits": of("0123456789"), "pipes": of("|"), "symbols": of("#$%&*+=<>@^~_\\/[]{}"), "exclamations": of("!"), "stops": of("."), "commas": of(","), "lines": len(lines) / len(words), "distinct_lines": len(set(lines)) / len(lines),
    }


def test_statistics_and_rule_scores_against_plain_ones(spark):
    rng = random.Random(7)
    letters = list("abc ABÉß \n\t.,!|#_\\[]{}01 漢😀")
    texts = [None, "", " ", "\n\n", "One two  one.\nTwo\n", "x" * 30_000, *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    condition = quality_rules.Condition
    rules = (((condition("upper", True, 0.05), condition("length", False, 4.0)), 1.5), ((condition("distinct_words", False, 0.9),), -0.75), ((condition("symbols", True, 0.1), condition("digits", True, 0.02)), 0.5))
    narrow = docs.select("doc_id", *(c.cast("double").alias(n) for n, c in quality_rules.statistics(F.col("text")).items()))
    got = {r.doc_id: r for r in narrow.select("*", quality_rules.RuleEnsemble(-0.2, rules).score().alias("score")).collect()}
    for i, text in enumerate(texts):
        want = plain_statistics(text)
        assert all(abs(got[i][n] - want[n]) < 1e-9 for n in want), (text, got[i], want)
        total = -0.2 + sum(w for rule, w in rules if all(want[c.name] > c.bound if c.above else want[c.name] <= c.bound for c in rule))
        assert abs(got[i].score - 1 / (1 + math.exp(-total))) < 1e-9


def test_repeated_ids_teach_alike_in_any_order(spark):
    rows = [(n % 60, ("Good words here, and more. " if n % 60 % 2 else "BAD BAD ### !!! ") * (1 + n % 5) + ("" if n < 60 else "other text")) for n in range(120)]
    labels = spark.createDataFrame([(n, n % 2) for n in range(60)], "doc_id long, quality int")
    scores = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(1 + len(scores) * 3)
        scores.append(sorted((r.doc_id, round(r.score, 9)) for r in quality_rules.score_quality(docs, labels, F.lit(False)).collect()))
    assert scores[0] == scores[1]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))


def test_warc_round_trip_and_determinism(spark, tmp_path):
    long = "é" * 80
    rows = [(7, "http://a/", long), (3, None, long), (9, "http://b/\nx%0A", long), (9, "http://b/\nx%0A", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", long), (8, "u", "z" * 300_000)]
    files = []
    for k in range(2):
        folder = f"file://{tmp_path}/warc{k}"
        manifest = warc_archive.write_warc(pages(spark, rows).repartition(1 + 3 * k), folder, shard_bytes=400, roll_bytes=500)
        files.append({r.file: (r.sha256, r.records) for r in manifest.collect()})
        for name in files[-1]:
            assert gzip.decompress((tmp_path / f"warc{k}" / name).read_bytes()).startswith(b"WARC/1.1\r\n")
            assert hashlib.sha256((tmp_path / f"warc{k}" / name).read_bytes()).hexdigest() == files[-1][name][0]
        got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in warc_archive.read_warc(manifest, folder).collect())
        assert got == sorted([("7", "revisit", 3, 160), ("3", "response", None, 160), ("9", "revisit", 3, 160), ("9", "revisit", 3, 160), ("4", "response", None, 5), ("5", "response", None, 5), ("6", "response", None, 0), ("None", "revisit", 3, 160), ("8", "response", None, 300_000)])
        assert not [p for p in (tmp_path / f"warc{k}").iterdir() if p.name.endswith(".tmp")]
    assert files[0] == files[1] and len(files[0]) > 2
    assert warc_archive.write_warc(pages(spark, []), f"file://{tmp_path}/none").count() == 0


def test_of_repeated_rows_one_is_the_response(spark, tmp_path):
    manifest = warc_archive.write_warc(pages(spark, [(1, "u", "a" * 200)] * 3), f"file://{tmp_path}/w")
    assert sorted((r.record_type, r.refers_to) for r in warc_archive.read_warc(manifest, f"file://{tmp_path}/w").collect()) == [("response", None), ("revisit", 1), ("revisit", 1)]


def test_shards_of_an_outlier_hot_ids_and_rows_without(spark, tmp_path):
    rng = random.Random(1)
    body = lambda: "".join(rng.choice("abcdefgh ") for _ in range(200))
    same = body()
    rows = [(i, "u", body()) for i in range(300)] + [(2**62, "u", body()), (-(2**62), "u", same)] + [(None, "u", body()) for _ in range(300)] + [(7, "u", body()) for _ in range(300)] + [(None, "u", same)] * 3
    folder = f"file://{tmp_path}/w"
    manifest = warc_archive.write_warc(pages(spark, rows).repartition(7), folder, shard_bytes=5_000, roll_bytes=3_000)
    records = warc_archive.read_warc(manifest, folder).collect()
    assert Counter((str(r.page_id), r.payload_digest) for r in records) == Counter((str(i), hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows)
    assert sorted((str(r.page_id), r.refers_to) for r in records if r.record_type == "revisit") == [("None", -(2**62))] * 3
    by_shard = Counter()
    for r in manifest.collect():
        by_shard[r.shard] += r.records
    assert max(by_shard.values()) < 120 and len(by_shard) > 20
    ids = []
    for file in (tmp_path / "w").glob("*.warc.gz"):
        headers = gzip.decompress(file.read_bytes()).split(b"\r\n")
        ids += [h for h in headers if h.startswith(b"WARC-Record-ID")]
        assert headers[1] == b"WARC-Type: warcinfo" and sum(h.startswith(b"WARC-Date: ") for h in headers) == sum(h.startswith(b"WARC/1.1") for h in headers)
    assert len(ids) == len(set(ids)) == len(rows) + manifest.count()


def test_query_of_repeated_pages_equals_sql(spark, tmp_path):
    rows = [(3, "u", "a" * 150), (3, "u", "a" * 150), (5, "u", "a" * 150), (None, "u", "a" * 150), (6, "u", "short"), (6, "u", "short"), (None, "u", "b" * 150), (None, "u", "b" * 150), (8, None, None)]
    for name in compare.TABLES:
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    check(spark, connect(str(tmp_path)), str(tmp_path), warc_archive.op4_warc_archive, warc_archive.ORACLE_SQL["op4_warc_archive"])


def test_blocks_spread_over_aliases_but_not_over_allows(spark):
    canonical = lambda u: f"<html><link rel='canonical' href='{u}'></html>"
    refresh = lambda u: f'<META http-equiv="refresh" content="0; URL={u}">'
    rows = [
        (1, "http://x.com/de/a", None), (2, "http://y.net/1", canonical("http://x.com/de/a")), (3, "http://z.net/2", refresh("http://y.net/1")), (4, "http://good.org/", canonical("http://z.net/2")),
        (5, "http://other.net/", canonical("/self")), (6, None, "x"), (7, "no scheme", ""), (7, "no scheme", ""), (8, "HTTP://A.ORG?x#y", ""), (9, "http://sub.example.org/es/", ""), (10, "http://example.org/en/12", ""), (11, "http://notexample.org/es/", ""),
    ]
    docs = pages(spark, rows)
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_equivalence.judge_urls(docs, url_equivalence.alias_links(docs)).collect()}
    assert got == {
        (1, "x.com", "/de/a", "com/de/", "block"), (2, "y.net", "/1", None, "block"), (3, "z.net", "/2", None, "block"), (4, "good.org", "/", "org/", "allow"), (5, "other.net", "/", None, "allow"), (6, "", "", None, "allow"),
        (7, "", "", None, "allow"), (8, "a.org", "", None, "allow"), (9, "sub.example.org", "/es/", "example.org/es/", "block"), (10, "example.org", "/en/12", "example.org/en/1", "block"), (11, "notexample.org", "/es/", "org/", "allow"),
    }
    assert url_equivalence.judge_urls(docs.limit(0), url_equivalence.alias_links(docs.limit(0))).count() == 0


def test_components_of_chains_stars_and_noise(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}


@pytest.mark.parametrize("cut", [0, 3, 60])
def test_components_joined_by_more_edges(spark, cut):
    rng = random.Random(cut)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    rows = lambda df: {r.node: r.component for r in df.collect()}
    first = components.connected_components(frame(edges[:cut]), "a", "b")
    found, whole = rows(components.joined_components(first, frame(edges[cut:]))), rows(components.connected_components(frame(edges), "a", "b"))
    assert {n: c for n, c in found.items() if c != n} == {n: c for n, c in whole.items() if c != n}


def test_licences_in_any_case_spelling_and_with_any_holder(spark):
    mit = license_digests.KNOWN_LICENSES["MIT"][0]
    texts = [None, "", "Copyright (c) 2020 Some One\n\n" + mit.upper().replace(" ", "\n "), mit.replace("Software", "software").replace(",", ""), mit + " more", "Licenced under the mit LICENCE!", "para\nReleased under the MIT License.\nend"]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[2]])), "doc_id long, text string").withColumn("license", F.lit("clash"))
    known = license_digests.license_digests(spark)
    assert [r.license for r in license_digests.scan_licenses(docs, known).orderBy("doc_id").collect()] == [None, None, "MIT", "MIT", None, "MIT", None, "MIT"]
    wordings = license_digests.license_digests(spark, digests={})
    assert [(r.doc_id, r.line_no, r.license) for r in license_digests.scan_license_lines(docs.filter("doc_id = 6"), wordings).collect()] == [(6, 1, "MIT")]


def test_licence_lines_behind_notices_and_of_any_wording(spark):
    known = license_digests.known_licenses(spark.createDataFrame([("own", "Use it as you like!"), ("own", None), ("ünï", "Größe zählt"), ("none", " . ")], "license string, text string"))
    docs = spark.createDataFrame([(1, "(c) 2024 X Ltd. Use it AS you, like\nx"), (2, "GRÖSSE\ngröße zählt"), (3, "use it"), (None, "use it as you like"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.line_no, r.license) for r in license_digests.scan_license_lines(docs, known).collect()) == [("1", 0, "own"), ("2", 1, "ünï"), ("None", 0, "own")]
    rights = spark.createDataFrame([(1, "(c) 2024 Some One. All rights reserved.")], "doc_id long, text string")
    assert [r.license for r in license_digests.scan_license_lines(rights, license_digests.license_digests(spark, digests={})).collect()] == ["all-rights-reserved"]


def test_licence_query_of_odd_rows(spark, tmp_path):
    mit = license_digests.KNOWN_LICENSES["MIT"]
    rows = [(None, mit[0]), (None, f"x\n{mit[2]}"), (1, f"{mit[2]}\n{mit[2]}"), (1, "Licensed under CC BY 4.0."), (1, "Licensed under CC BY 4.0."), (2, None), (3, ""), (4, "licensed rights " * 60_000 + "\n" + mit[3])]
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, license string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r.doc_id), str(r.license), r.line_licenses, r.n_lines) for r in license_digests.op10_license_digests(spark, str(tmp_path)).collect())
    assert got == sorted([("None", "MIT", "MIT", 1), ("None", "None", "MIT", 1), ("1", "None", "MIT", 2), ("1", "CC-BY-4.0", "CC-BY-4.0", 1), ("1", "CC-BY-4.0", "CC-BY-4.0", 1), ("2", "None", "", 0), ("3", "None", "", 0), ("4", "None", "MIT", 1)])
    empty = tmp_path / "none"
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(empty / "documents.parquet"))
    assert license_digests.op10_license_digests(spark, str(empty)).count() == 0


@pytest.mark.parametrize(("file", "license"), [("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_whole_licence_texts(spark, file, license):
    path = Path("/usr/share/common-licenses") / file
    if not path.exists():
        pytest.skip("no such licence text on this machine")
    docs = spark.createDataFrame([(1, path.read_text().upper()), (2, path.read_text()[:-200])], "doc_id long, text string")
    assert {r.doc_id: r.license for r in license_digests.scan_licenses(docs, license_digests.license_digests(spark)).collect()} == {1: license, 2: None}


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_tree_search_is_exact(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    v = (centres[rng.integers(0, 12, 700)] + spread * rng.normal(size=(700, 16))).round(3)
    v[300:460] = v[5]
    rows = [(i, [float(x) for x in row], i) for i, row in enumerate(v)] + [(900, None, 0), (1000, [1.0, None], 0), (1100, [float("nan")] * 16, 0), (None, [1.0] * 16, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    vectors = metric_search.integer_vectors(table)
    got = {}
    for r in metric_search.top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10, tree_rows=150, block=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = np.floor(1024 * v.astype(np.float32).astype(np.float64)).astype(np.int64)
    assert sorted(got) == list(range(0, 700, 100))
    for q, found in got.items():
        order = sorted((-int(whole[i] @ whole[q]), i) for i in range(700) if i != q)[:10]
        assert sorted(found) == [(n + 1, i, -s) for n, (s, i) in enumerate(order)]
    few = vectors.filter("vec_id in (0, 1)")
    assert metric_search.top_k(few, few.filter("vec_id = 0")).count() == 1 and metric_search.top_k(few.limit(0), few).count() == 0


def test_search_of_ragged_large_and_repeated_vectors(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice((0, 2, 4, 5)) for _ in range(rng.choice((0, 1, 3, 8)))]) for i in range(260)]
    rows += [(300 + i, [2.0, 2.0]) for i in range(40)] + [(400, [2.0, 2.0, 0.0]), (400, [1.0]), (500, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("query_id", F.lit(1))
    vectors = metric_search.integer_vectors(table)
    got = {}
    for r in metric_search.top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10, tree_rows=30, block=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    for q in (0, 100, 200, 300, 400, 500):
        asked = [v for i, v in whole if i == q]
        order = sorted({(-dot(a, v), i) for a in asked for i, v in whole if i != q})[:10]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(order)], q


def test_likely_members_never_miss(spark):
    keys = spark.range(-500, 500, 7).select((F.col("id") * 123_456_789_012_345).alias("k"))
    rows = spark.range(-500, 500).select((F.col("id") * 123_456_789_012_345).alias("k"))
    likely = storage.marked_likely(rows.withColumn("likely_bucket2", F.lit(1)), "k", keys, "k").filter("likely")
    assert storage.marked_likely(rows.select(F.when(F.col("k") > 0, F.col("k")).alias("k")), "k", keys, "k").filter("k is null and likely").count() == 0
    assert keys.join(likely, "k", "left_anti").count() == 0 and likely.count() < 400

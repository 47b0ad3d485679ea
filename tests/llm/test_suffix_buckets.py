"""op6 against a brute-force version that looks up every 200-byte string."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from turnlake.llm import suffix_buckets as S


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + S.LENGTH] for b in data for i in range(len(b) - S.LENGTH + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - S.LENGTH + 1):
            if seen[b[i : i + S.LENGTH]] > 1:
                gone[i : i + S.LENGTH] = [True] * S.LENGTH
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def check(spark, tmp_path, texts, ids=None):
    rows = [(ids[i] if ids else i, t, "clash") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, doc string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = S.op6_suffix_buckets(spark, str(tmp_path)).collect()
    expected = sorted((str(r[0]), *b) for r, b in zip(rows, brute(texts), strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected


def passages():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(rng.randint(5, 300)) for _ in range(25)]
    shared = text(60)
    edge = text(80).encode()[:200].decode("utf-8", "ignore")
    out = [None, "", "short", "x" * 199, "y" * 200, "z" * 201, "w" * 900, *base, base[3], base[3], base[4]]
    for k in range(12):
        own = text(40)
        out.append(own[: 40 + 7 * k] + shared[k : 300 + k] + own[50:])
    out += [text(10) + edge + text(10), "q" + edge + "q", base[5][:150] + "#" + base[5][150:], base[6] + base[6], base[7][17:] + base[8][:-13]]
    near = base[9].split()
    for k in range(10):
        changed = list(near)
        changed[k * len(near) // 10] = "changed"
        out.append(" ".join(changed))
    return out


def test_against_brute_force(spark, tmp_path):
    check(spark, tmp_path, passages())


def test_null_and_repeated_ids(spark, tmp_path):
    texts = passages()[:20]
    check(spark, tmp_path, [*texts, *texts], ids=[None if i % 3 == 0 else i % 5 for i in range(40)])


def test_parts_of_long_texts(spark, tmp_path, monkeypatch):
    text = " ".join(passages()[7:20])
    spans = []
    for part in (1 << 19, 777):
        monkeypatch.setattr(S, "PART", part)
        found = set()
        for data, starts, owners, offsets in S._parts([text.encode(), b"a" * 500]):
            t, _, _, at, left, right = S.sampled_suffixes(data, starts)
            for i in range(len(t)):
                low = at[i] + offsets[t[i]] - left[i]
                found |= {(owners[t[i]], low + k) for k in range(left[i] + right[i] + 1)}
        spans.append(found)
    assert spans[0] == spans[1] and len(spans[0]) == len(text.encode()) - 199 + 301


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert S.op6_suffix_buckets(spark, str(tmp_path)).count() == 0


def test_kept_text_may_break_characters(spark):
    docs = spark.createDataFrame([(1, "é" * 150 + "a"), (2, "é" * 150 + "b")], "doc_id long, text string")
    _, cut = S.remove_repeated(docs)
    assert {bytes(r.kept) for r in cut.collect()} == {b"a", b"b"} and cut.filter(F.col("n_spans") != 1).count() == 0

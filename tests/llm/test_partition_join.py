"""op2 against all pairs, and its keys against all near pairs."""

import random
import re

import numpy as np

from turnlake.llm import partition_join as P


def shingle_set(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((str(doc), len(sets[i]), str(least.get(root(i)) if sets[i] else doc)) for i, (doc, _) in enumerate(rows))


def rows():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out = [None, "", "  \n ", "one", "One", "one two", "a b c d e", "a b c d e f", "A b c d e", "nul\x00 x y z w v", "nul x y z w v", "ünï ÜNÏ a b c d", "\x1cnot space a b c"]
    common = text(40)
    for n in (6, 8, 12, 20, 35, 60, 120, 300, 900):
        base = text(n)
        out.append(" ".join(base))
        out.append(" ".join(base))
        for edits in (1, 1, 2, 3, max(1, n // 40), max(1, n // 25), max(1, n // 18)):
            near = list(base)
            for _ in range(edits):
                k = rng.randrange(len(near))
                rng.choice((lambda: near.__setitem__(k, "edit"), lambda: near.insert(k, "more"), lambda: near.pop(k)))()
            out.append(" ".join(near))
        out.append(" ".join(base[: int(n * 0.76) + 1]))
        out.append(" ".join(base + text(n // 4)))
    for n in range(20):
        out.append(" ".join(text(n) + common))
    return [(i * 7 % 1000, t) for i, t in enumerate(out)]


def check(spark, data):
    docs = spark.createDataFrame([(d, t, 1) for d, t in data], "doc_id long, text string, cls int").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in P.jaccard_components(docs).collect())
    assert got == brute(data)


def test_against_all_pairs(spark):
    check(spark, rows())


def test_null_and_repeated_ids(spark):
    data = rows()[:40]
    check(spark, [(None if i % 4 == 0 else d, t) for i, (d, t) in enumerate([*data, *data[5:15]])])


def test_empty_table(spark):
    assert P.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_sets_share_a_key():
    rng = np.random.default_rng(1)
    for trial in range(3000):
        n = int(rng.integers(1, 60)) if trial % 3 else int(rng.integers(60, 700))
        base = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        size = int(rng.integers(-(-3 * n // 4), n + 1))
        a = base[:n]
        kept = rng.permutation(a)[:size]
        b = np.concatenate([kept, base[n : n + int(rng.integers(0, n // 6 + 1))]])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 4 * both < 3 * (len(a) + len(b) - both):
            continue
        cost = lambda s: (s % np.uint64(5)).astype(np.int64)
        assert set(P.segment_keys(a, cost(a)).tolist()) & set(P.segment_keys(b, cost(b)).tolist()), (len(a), len(b), both)


def test_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 3)
    check(spark, rows())


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 900))
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        other = np.unique(np.concatenate([base[: int(len(base) * rng.random()) + 1], rng.integers(0, 1 << 63, int(rng.integers(0, n)), dtype=np.uint64)]))
        values, before = np.concatenate([base, other]), np.array([0, len(base), len(base) + len(other)])
        a, b = P.odd_sketches(values, before)
        assert P.sketch_distance(a, b) <= len(np.setxor1d(base, other)) and P.sketch_distance(a, a) == 0

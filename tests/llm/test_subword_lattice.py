"""op11: marginals against all segmentations written out, base scores against plain counts, odd rows, very long words."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.llm import subword_lattice as S

NAMES = [b" a", b"ab", b"b", b"a", b" ", b"abab", b"ba", b"c", b" ab"]


def logs(seed=0):
    weight = np.random.default_rng(seed).random(len(NAMES)) + 0.05
    return np.log(weight / weight.sum() * 0.9)


def segmentations(unit):
    if not unit:
        yield []
    for i, name in enumerate(NAMES):
        if unit.startswith(name):
            for rest in segmentations(unit[len(name) :]):
                yield [i, *rest]


def test_scores_are_the_sum_over_all_segmentations():
    lattice, w = S.Lattice(NAMES), logs()
    units = [b" " + bytes(u) for n in range(5) for u in itertools.product(b"abc", repeat=n)]
    expected = [math.log(sum(math.exp(sum(w[i] for i in path)) for path in segmentations(u))) for u in units]
    assert np.allclose(lattice.scores(units, w), expected, atol=1e-12)
    assert np.allclose([lattice.score_long(u, w) for u in units], expected, atol=1e-12)


def test_expected_uses_weigh_all_segmentations():
    lattice, w, rng = S.Lattice(NAMES), logs(1), random.Random(1)
    units = [b" " + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 6))) for _ in range(60)]
    counts = np.array([rng.randint(1, 9) for _ in units], float)
    expected = np.zeros(len(NAMES))
    for unit, n in zip(units, counts, strict=True):
        paths = list(segmentations(unit))
        mass = [math.exp(sum(w[i] for i in path)) for path in paths]
        for path, m in zip(paths, mass, strict=True):
            for i in path:
                expected[i] += n * m / sum(mass)
    assert np.allclose(lattice.expected(units, counts, w), expected)


def test_batches_make_no_difference(monkeypatch):
    lattice, w, rng = S.Lattice(NAMES), logs(2), random.Random(2)
    units = [b" " + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    counts = np.ones(len(units))
    whole = lattice.scores(units, w), lattice.expected(units, counts, w)
    monkeypatch.setattr(S, "BATCH_BYTES", 40)
    assert np.allclose(lattice.scores(units, w), whole[0]) and np.allclose(lattice.expected(units, counts, w), whole[1])


def test_a_long_word_needs_only_the_next_states():
    names, prior = S.read_pieces(S.default_vocabulary())
    lattice, rng = S.Lattice(names), random.Random(3)
    unit = b" " + bytes(rng.choice(b"theando0123/+") for _ in range(5000))
    assert math.isclose(lattice.score_long(unit, np.log(prior)), float(lattice.scores([unit], np.log(prior))[0]), rel_tol=1e-9)


TEXTS = ["The cat  the\tdog", "", None, "THE the ÉÉ", "word " * 40, "x" * 700 + " the", "x" * 700, "▁   the cat", "The cat  the\tdog", " \n ", "the end"] * 2


def table(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, key string, c int, uid int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))


@pytest.mark.parametrize("frequent", [1, 4, 1 << 17])
def test_documents_against_plain_counts(spark, tmp_path, frequent):
    rows = [(None if i == 7 else i - i % 2 if i > 15 else i, t, "clash", 1, 2) for i, t in enumerate(TEXTS)]
    table(spark, tmp_path, rows)
    got = S.score_documents(spark.read.parquet(str(tmp_path / "documents.parquet")), S.hash_fold(7, 2), frequent=frequent).collect()
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    words = [(t or "").encode().lower().split() + [b"\n"] for _, t, *_ in rows]
    counts = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(r[0]), h, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for r, h, ws in zip(rows, held, words, strict=True))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    # equal texts have equal scores, a text is likelier than itself with a word more
    by = {}
    for r in got:
        by.setdefault((r.n_tokens, round(r.base_score, 6)), set()).add(round(r.score, 6))
    assert all(len(s) == 1 and max(s) < 0 for s in by.values())


def test_ways_of_the_frequent_and_the_rare_agree(spark, tmp_path):
    table(spark, tmp_path, [(i, t, "clash", 1, 2) for i, t in enumerate(TEXTS)])
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    # without rounds over the frequent words only, the model is the same whatever is sent to the tasks
    few, many = ({r.doc_id: round(r.score, 6) for r in S.score_documents(docs, F.lit(False), first_rounds=0, frequent=n).collect()} for n in (1, 1000))
    assert few == many


def test_no_rows_and_no_teaching_rows(spark, tmp_path):
    table(spark, tmp_path, [(1, "the cat", "", 0, 0)])
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert S.score_documents(docs.limit(0), F.lit(False)).count() == 0
    (row,) = S.score_documents(docs, F.lit(True)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and row.score < 0


def test_learning_makes_held_out_texts_likelier(spark):
    docs, held = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), S.hash_fold(7, 2)
    plain, learned = (S.score_documents(docs, held, first_rounds=a, rounds=b).filter("held_out").agg(F.sum("score")).first()[0] for a, b in ((0, 0), (2, 1)))
    assert learned > plain

"""op12 against plain k-means in Python's integers; the curve, the boxes' candidates, odd vectors and rows."""

import hashlib
import itertools
import math
import random

import numpy as np

from turnlake.llm import curve_clusters as C


def brute(rows, clusters=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in first[:clusters]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((i, v, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        given = assign()
        for k in range(len(centroids)):
            own = [v for _, v, c, _ in given if c == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    given, most = assign(), (1 << 63) - 1
    inertia = {k: sum(min(d, most) for *_, c, d in given if c == k) for k in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), c, min(d, most), min(inertia[c], most), min(sum(inertia.values()), most), digest[c]) for i, _, c, d in given)


def check(spark, tmp_path, rows):
    spark.createDataFrame([(i, v, 5) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = C.op12_curve_clusters(spark, str(tmp_path)).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == brute(rows)
    return got


def vectors(n, seed, spread=1.0):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, spread) for _ in range(64)] for _ in range(5)]
    return [(i, [m + rng.gauss(0, 0.2) for m in rng.choice(middles)]) for i in range(n)]


def test_clusters_equal_plain_k_means(spark, tmp_path):
    assert len({r.cluster for r in check(spark, tmp_path, vectors(700, 1))}) > 3


def test_copies_ties_repeated_and_missing_ids(spark, tmp_path):
    rows = vectors(60, 2)
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1])]
    check(spark, tmp_path, rows)


def test_vectors_that_take_no_part(spark, tmp_path):
    rows = vectors(30, 3)
    rows += [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63), (105, [math.nan] + [1.0] * 63), (106, [math.inf] + [1.0] * 63)]
    assert len(check(spark, tmp_path, rows)) == 30


def test_large_components_are_exact(spark, tmp_path):
    check(spark, tmp_path, [(i, [x * 10**6 for x in v]) for i, v in vectors(50, 4)] + [(900, [1e13] + [0.0] * 63)])


def test_fewer_vectors_than_clusters_and_none(spark, tmp_path):
    check(spark, tmp_path, vectors(5, 5))
    check(spark, tmp_path / "none", [(1, None)])


def test_the_curve_visits_each_cell_once_by_single_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = C.hilbert_keys(cells, bits)
        walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert len(set(keys)) == len(cells) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_candidates_hold_every_nearest_centroid_and_leave_some_out():
    rng, left = np.random.default_rng(6), 0
    for _ in range(200):
        centroids = rng.integers(-3000, 3000, (8, 6))
        points = rng.integers(-3000, 3000, 6) + rng.integers(-900, 900, (40, 6))
        d = ((points[:, None] - centroids[None]) ** 2).sum(2)
        won = set(np.nonzero(d == d.min(1)[:, None])[1].tolist())
        found = set(C.candidates(points.min(0).astype(float), points.max(0).astype(float), centroids.astype(float)).tolist())
        assert won <= found
        left += 8 - len(found)
    assert left > 400

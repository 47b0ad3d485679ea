"""op13 against trees built and folded in plain Python, in blocks of several depths; odd rows; what versions share."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from turnlake.llm import merkle_manifest as M

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    doc_id, source, lang, n_chars, _ = row
    return H(*map(field, (doc_id, source, lang, n_chars, text)))


def tree(nodes, arity=3):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def around(levels, i, arity=3):
    for level in levels[:-1]:
        first = i - i % arity
        yield level[first:i], level[i + 1 : first + arity]
        i //= arity


def brute(rows, arity=3):
    chosen = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
    leaves = [(r, leaf(r, r[4]), leaf(r, r[4] and r[4].replace("\n", "")) if chosen(r) else None) for r in rows]
    groups = {}
    for x in sorted(leaves, key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])):
        groups.setdefault(x[0][1], []).append(x)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in groups[s]], arity) for s in order}
    forest = tree([trees[s][-1][0] for s in order], arity)
    out = []
    for t, s in enumerate(order):
        for i, (row, own, tampered) in enumerate(groups[s]):
            path = [*around(trees[s], i, arity), *around(forest, t, arity)]
            digest = tampered or own
            for before, after in path:
                digest = H(*before, digest, *after)
            out.append((str(row[0]), own, trees[s][-1][0], forest[-1][0], H(*(x for before, after in path for x in before + after)), digest, digest == forest[-1][0]))
    return sorted(out)


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def corpus(n, seed, sources=("a", "b", "é", "Z", None, "aa", "")):
    rng = random.Random(seed)
    texts = [None, "", "line\nline\n", "no break", "\n\n", "ü\r\n", "x" * 5000 + "\n"]
    return [(i, rng.choice(sources) if i % 3 else "hot", rng.choice(["en", None, "dé"]), rng.choice([None, 3, 12]), rng.choice(texts)) for i in range(n)]


def save(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, at int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return spark.read.parquet(str(tmp_path / "documents.parquet"))


def test_every_row_against_plain_trees(spark, tmp_path):
    rows = corpus(400, 1)
    save(spark, tmp_path, rows)
    got = M.op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), *(r[c] for c in NAMES[1:])) for r in got) == brute(rows)
    assert {r.verified for r in got} == {True, False}


def test_missing_and_repeated_ids_and_repeated_rows(spark, tmp_path):
    rows = corpus(40, 2) + [(None, "a", "en", 1, "null\n")] * 3 + [(5, "b", None, None, "again\n"), (5, "b", None, None, "again\n"), (5, "b", None, None, "other")]
    save(spark, tmp_path, rows)
    got = M.op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), *(r[c] for c in NAMES[1:])) for r in got) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(3, "s", "en", 1, "one\n")], [(3, None, None, None, None)], [(i, "s", "en", 1, "t\n") for i in range(4)]])
def test_few_rows(spark, tmp_path, rows):
    save(spark, tmp_path, rows)
    got = M.op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), *(r[c] for c in NAMES[1:])) for r in got) == brute(rows)


@pytest.mark.parametrize(("arity", "deep"), [(3, 1), (2, 2), (4, 1)])
def test_many_tiers_give_the_same_trees(spark, tmp_path, arity, deep):
    rows = corpus(150, 3, sources=tuple("abcdefghijk"))
    docs = save(spark, tmp_path, rows)
    leaves = M.document_leaves(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    got = M.manifest(leaves, arity, deep).collect()
    assert sorted((str(r.doc_id), r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof_sha256, r.folded_root.hex(), r.folded_root == r.root) for r in got) == brute(rows, arity)


def test_a_version_copies_ancestors_only():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(20)]
    block = M.Block(digests, M.block_height(20, 3, 6))
    before = [list(level) for level in block.levels]
    copies = M.copied(b"x" * 32, block.siblings(13))
    whole = M.Block(digests[:13] + [b"x" * 32] + digests[14:], M.block_height(20, 3, 6))
    assert block.levels == before and copies[-1] == whole.top != block.top
    assert [[i for i, (a, b) in enumerate(zip(x, y, strict=True)) if a != b] for x, y in zip(block.levels, whole.levels, strict=True)] == [[13], [4], [1], [0]]
    assert copies == [whole.levels[1][4], whole.levels[2][1], whole.levels[3][0]]

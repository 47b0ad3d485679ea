"""A Merkle manifest of a dataset, and a version of it for each tampered row.

Rows are leaves of one tree for each source, in the order of doc_id; the trees' roots are the leaves of a last tree. The trees are
persistent: a tampered leaf makes a version that shares every node it does not change with the first and has copies of the leaf's
ancestors only. A tree is cut into aligned blocks of ARITY ** DEEP leaves, each built, and its paths copied, inside one task; the
blocks' tops are the leaves of the next tier, cut alike, until a tree has one. On the way down every block gets the siblings above
it, and a version goes on from the block's copied top through the tiers above.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import read_table, stored

#: Children of a node, and levels of a block: it has at most ARITY ** DEEP leaves.
ARITY, DEEP = 3, 6


def joined(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


class Block:
    """The levels of an aligned block, from its leaves to its top. Never changed: a version is the copies that ``copied`` makes."""

    def __init__(self, leaves: list[bytes], height: int, arity: int = ARITY):
        self.arity, self.levels = arity, [leaves]
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append([joined(below[i : i + arity]) for i in range(0, len(below), arity)])

    @property
    def top(self) -> bytes:
        return self.levels[-1][0]

    def siblings(self, leaf: int) -> list[tuple[bytes, bytes]]:
        """On each level below the top, the run's nodes before and after the one on the leaf's path, joined."""
        out = []
        for level in self.levels[:-1]:
            first = leaf - leaf % self.arity
            out.append((b"".join(level[first:leaf]), b"".join(level[leaf + 1 : first + self.arity])))
            leaf //= self.arity
        return out


def copied(digest: bytes, siblings: list[tuple[bytes, bytes]]) -> list[bytes]:
    """Copies of a changed node's ancestors: each has the copy below it and the siblings of the first version."""
    out = []
    for before, after in siblings:
        digest = hashlib.sha256((before.hex() + digest.hex() + after.hex()).encode()).digest()
        out.append(digest)
    return out


def block_height(nodes: int, arity: int, deep: int) -> int:
    """Levels of a block in a tier of ``nodes`` nodes: all where there are other blocks, else as many as leave one node."""
    height, reach = 0, 1
    while reach < nodes and height < deep:
        height, reach = height + 1, reach * arity
    return height


def leaf_digest(text: Column) -> Column:
    """SHA-256 over doc_id, source, lang, n_chars and ``text``: each byte length, a colon and the value, or ``-`` for null."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*(field(F.col(c).cast("string")) for c in ("doc_id", "source", "lang", "n_chars")), field(text)), 256))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``at``, its rows' places (from 0) in that order; written to the shared folder. Equal rows are dealt to partitions too."""
    spark = df.sparkSession
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(*order, "_row").sortWithinPartitions(*order, "_row").drop("_row").withColumn("_place", F.monotonically_increasing_id())
    ranged = stored(ranged, "ordered")
    part, sizes, at = F.shiftright("_place", 33), {}, 0
    for row in ranged.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each partition
        sizes[row["part"]], at = at, at + row["count"]
    starts = spark.createDataFrame(list(sizes.items()), "_part long, _start long")
    return ranged.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("at", F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_start", "_place")


TIER = "tree long, pos long, n long, digest binary"
PATHS = "tree long, pos long, before array<binary>, after array<binary>, root binary"


def _ordered(rows: pa.Table) -> pa.Table:
    return rows.sort_by("pos")


def _block_of(rows: pa.Table, arity: int, deep: int) -> Block:
    return Block(rows.column("digest").to_pylist(), block_height(rows.column("n")[0].as_py(), arity, deep), arity)


def _grouped(nodes: DataFrame, size: int):
    return nodes.withColumn("block", F.floor(F.col("pos") / size)).groupBy("tree", "block")


def climb(nodes: DataFrame, arity: int = ARITY, deep: int = DEEP) -> list[DataFrame]:
    """Tiers of ``nodes`` (tree, pos, n: the tree's nodes, digest): the nodes, the tops of their blocks, and so on to each tree's root.

    A tier has a row for each block of the one below, so there are a few tiers whatever the number of rows.
    """
    size = arity**deep

    def top(key: tuple, rows: pa.Table) -> pa.Table:
        n = -(-rows.column("n")[0].as_py() // size)
        return pa.table({"tree": [key[0].as_py()], "pos": [key[1].as_py()], "n": [n], "digest": pa.array([_block_of(_ordered(rows), arity, deep).top], pa.binary())})

    tiers = [nodes]
    while True:
        tiers.append(stored(_grouped(tiers[-1].select("tree", "pos", "n", "digest"), size).applyInArrow(top, TIER), "tier"))
        if (tiers[-1].agg(F.max("n")).first()[0] or 1) == 1:
            return tiers


def _upper(rows: pa.Table) -> tuple[list[tuple[bytes, bytes]], bytes]:
    return list(zip(rows.column("before")[0].as_py(), rows.column("after")[0].as_py(), strict=True)), rows.column("root")[0].as_py()


def descend(tier: DataFrame, paths: DataFrame, arity: int = ARITY, deep: int = DEEP) -> DataFrame:
    """Paths of the nodes of ``tier``: on each level to the root the siblings before and after; ``paths`` are those of its blocks."""

    def go(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = _ordered(rows)
        block, (upper, root) = _block_of(rows, arity, deep), _upper(above)
        found = [block.siblings(i) + upper for i in range(rows.num_rows)]
        sides = [pa.array([[s[side] for s in path] for path in found], pa.list_(pa.binary())) for side in (0, 1)]
        return pa.table([rows.column("tree"), rows.column("pos"), *sides, pa.array([root] * rows.num_rows, pa.binary())], ["tree", "pos", "before", "after", "root"])

    size = arity**deep
    return _grouped(tier.select("tree", "pos", "n", "digest"), size).cogroup(paths.withColumn("block", F.col("pos")).groupBy("tree", "block")).applyInArrow(go, PATHS)


LEAVES = "doc_id {id}, source string, leaf binary, subroot binary, root binary, proof_sha256 string, copied array<binary>, folded_root binary"


def manifest(leaves: DataFrame, arity: int = ARITY, deep: int = DEEP) -> DataFrame:
    """Every row of ``leaves`` (doc_id, source, leaf, tampered or null) with subroot, root, proof_sha256, copied and folded_root.

    ``copied`` are the nodes of the row's version from the leaf's parent to the root: with ``tampered`` in the leaf's place, or the
    leaf itself. Nodes of ``arity`` consecutive ones are joined, a last run may be shorter. Within a source the order is doc_id (null
    first), then the digests; sources are in bytewise order, null first. One source is the whole tree; no rows have no root.
    """
    id_type = leaves.schema["doc_id"].dataType.simpleString()
    leaves = numbered(leaves.select("doc_id", F.col("source").cast("string").alias("source"), "leaf", "tampered"), "source", "doc_id", "leaf", "tampered")
    trees = numbered(leaves.groupBy("source").agg(F.min("at").alias("first"), F.count("*").alias("n")), "source").withColumnRenamed("at", "tree").withColumnRenamed("source", "name")
    trees = stored(trees, "trees")
    placed = leaves.join(trees, F.col("source").eqNullSafe(F.col("name"))).select("tree", (F.col("at") - F.col("first")).alias("pos"), "n", F.col("leaf").alias("digest"), "doc_id", "source", "tampered")
    placed = stored(placed, "leaves")
    tiers = climb(placed, arity, deep)
    subroots = tiers[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees.count()).cast("long").alias("n"), "digest")
    forest = climb(subroots, arity, deep)
    none = F.array().cast("array<binary>")
    paths = forest[-1].select("tree", "pos", none.alias("before"), none.alias("after"), F.col("digest").alias("root"))
    for tier in forest[-2::-1]:
        paths = stored(descend(tier, paths, arity, deep), "paths")
    paths = paths.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "before", "after", "root")
    for tier in tiers[-2:0:-1]:
        paths = stored(descend(tier, paths, arity, deep), "paths")
    tops = tiers[-1].select("tree", F.col("digest").alias("subroot"))
    # a tree's root goes to each of its blocks: a row for every ARITY ** DEEP leaves
    paths = paths.join(tops, "tree").withColumn("block", F.col("pos"))
    kinds = [pa.binary()] * 3 + [pa.string(), pa.list_(pa.binary()), pa.binary()]

    def prove(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = _ordered(rows)
        block, (upper, root), subroot = _block_of(rows, arity, deep), _upper(above), above.column("subroot")[0].as_py()
        tail = "".join((a + b).hex() for a, b in upper)
        out: list[list] = [[] for _ in kinds]
        for i, (leaf, tampered) in enumerate(zip(rows.column("digest").to_pylist(), rows.column("tampered").to_pylist(), strict=True)):
            near = block.siblings(i)
            version = copied(leaf if tampered is None else tampered, near + upper)
            proof = hashlib.sha256(("".join((a + b).hex() for a, b in near) + tail).encode()).hexdigest()
            folded = version[-1] if version else (leaf if tampered is None else tampered)
            for column, x in zip(out, (leaf, subroot, root, proof, version, folded), strict=True):
                column.append(x)
        return pa.table([rows.column("doc_id"), rows.column("source"), *(pa.array(c, kind) for c, kind in zip(out, kinds, strict=True))], ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "copied", "folded_root"])

    return _grouped(placed, arity**deep).cogroup(paths.groupBy("tree", "block")).applyInArrow(prove, LEAVES.format(id=id_type))


def document_leaves(docs: DataFrame, chosen: Column, tampered_text: Column) -> DataFrame:
    """doc_id, source, leaf, tampered: the digest of each row, and of the ``chosen`` ones with another text. Other columns play no part."""
    other = F.when(chosen, leaf_digest(tampered_text))
    return stored(docs.select("doc_id", "source", leaf_digest(F.col("text")).alias("leaf"), other.alias("tampered")), "digests")


def op13_merkle_manifest(spark, sf_dir) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = manifest(document_leaves(docs, chosen, F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select("doc_id", text("leaf"), text("subroot"), text("root"), "proof_sha256", text("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}

ORACLE_SQL = {
    "op13_merkle_manifest": """
WITH RECURSIVE t AS (SELECT list(list_reduce(list_concat([n], range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY n) AS t FROM range(256) r(n)),
d AS (SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 AS chosen FROM documents, t),
e AS (SELECT doc_id, source, chosen, text, concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id) END, CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
  CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END, CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars) END) AS head FROM d),
l0 AS (SELECT doc_id, source, sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS leaf,
  CASE WHEN chosen THEN sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(replace(text, chr(10), '')), ':', replace(text, chr(10), '')) END)) END AS tampered FROM e),
l AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, tampered NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l0),
u AS (SELECT 0 AS level, tree, pos, n, leaf AS digest FROM l UNION ALL
  SELECT level + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, tree, pos // 3, n),
s AS MATERIALIZED (SELECT tree, digest AS subroot FROM u WHERE n = 1),
w AS (SELECT 0 AS level, CAST(0 AS BIGINT) AS tree, tree - 1 AS pos, (SELECT count(*) FROM s) AS n, subroot AS digest FROM s UNION ALL
  SELECT level + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM w WHERE n > 1 GROUP BY level, tree, pos // 3, n),
x AS (SELECT * FROM u UNION ALL SELECT * FROM w),
p AS MATERIALIZED (SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM x a JOIN x b ON b.tree = a.tree AND b.level = a.level AND b.pos // 3 = a.pos // 3 WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos),
g AS (SELECT row_number() OVER () AS row, *, coalesce(tampered, leaf) AS start FROM l),
f AS (SELECT row, tree, tree AS own, 0 AS level, pos, start AS digest, '' AS proof, false AS over FROM g UNION ALL
  SELECT f.row, CASE WHEN p.pos IS NULL THEN 0 ELSE f.tree END, f.own, CASE WHEN p.pos IS NULL THEN 0 ELSE f.level + 1 END, CASE WHEN p.pos IS NULL THEN f.own - 1 ELSE f.pos // 3 END,
    CASE WHEN p.pos IS NULL THEN f.digest ELSE sha256(concat(p.before, f.digest, p.after)) END, concat(f.proof, p.before, p.after), p.pos IS NULL AND f.tree = 0
  FROM f LEFT JOIN p ON p.tree = f.tree AND p.level = f.level AND p.pos = f.pos WHERE NOT f.over)
SELECT g.doc_id, g.leaf, s.subroot, r.digest AS root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root, f.digest = r.digest AS verified
FROM g JOIN f ON f.row = g.row AND f.over JOIN s ON s.tree = g.tree, (SELECT digest FROM w WHERE n = 1) r
"""
}

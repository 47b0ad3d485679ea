"""Tiered long-term memory. Rows: chunk_id, owner_user_id (null: shared), text, probe, slot_key, tier, importance, hits, created_at, last_hit_at, approved, active, embedding."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import hashed_terms, lexical_similarity, quote_is_verbatim, squeeze, term_jaccard
from ..functions.vectors import cosine
from .blocks import Vectors, best_in_rows, every_pair, made, scored_in_blocks
from .termindex import Asked, TermIndex, best_rows

DAY = 86_400.0
TIERS = ("slot", "hot", "cold")
# Slot keys whose fact has one current value, which a later statement replaces.
SINGLE_VALUED = frozenset({
    "name", "nickname", "call_me", "identity", "language", "age", "birthday", "birthdate", "gender", "sex", "home", "city", "residence",
    "address", "occupation", "job", "phone", "email",
})

# Slot keys of what a turn always gets to see.
BASIC_SLOT_KEYS = ("name", "nickname", "call_me", "identity", "language")


@dataclass(frozen=True)
class MemorySettings:
    """The defaults of the decay and of the thresholds."""

    slot_capacity: int = 32
    promote_score: float = 1.5
    demote_score: float = 0.2
    half_life_days: float = 14.0
    hit_bonus: float = 0.5
    relevance_floor: float = 0.68
    cold_floor: float = 0.73
    inject_top_n: int = 12
    slot_top_n: int = 4
    max_candidates: int = 3
    merge_similarity: float = 0.90
    statement_similarity: float = 0.80
    default_importance: float = 0.5


def effective_score(now: int, s: MemorySettings = MemorySettings()) -> Column:
    """Importance and hits, halved every half-life since the last hit, or since creation."""
    age = F.greatest(F.lit(0.0), (F.lit(float(now)) - F.coalesce("last_hit_at", "created_at")) / DAY)
    raw = F.greatest(F.lit(0.0), F.col("importance")) + F.greatest(F.lit(0), F.col("hits")) * s.hit_bonus
    return raw * F.pow(F.lit(0.5), age / s.half_life_days) if s.half_life_days > 0 else raw


def tier_for_score(score: Column, s: MemorySettings = MemorySettings()) -> Column:
    return F.when(score >= s.promote_score, "slot").when(score < s.demote_score, "cold").otherwise("hot")


def next_tier(current: Column, score: Column, s: MemorySettings = MemorySettings()) -> Column:
    """The tier that the score asks for; a cold row climbs to hot first."""
    target = tier_for_score(score, s)
    return F.when((current == "cold") & (target == "slot"), "hot").otherwise(target)


def list_memories(memory: DataFrame, now: int, user_id: int | None = None, tier: str | None = None, inactive: bool = False) -> DataFrame:
    """Memories with their present score, rounded to 4 places."""
    out = memory if inactive else memory.filter("active")
    if user_id is not None:
        out = out.filter(F.col("owner_user_id") == user_id)
    if tier:
        out = out.filter(F.col("tier") == tier)
    return out.withColumn("score", F.bround(effective_score(now), 4))


def tier_counts(memory: DataFrame) -> DataFrame:
    """(tier, n) of active rows, 0 included; no tier counts as hot."""
    names = memory.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    counts = memory.filter("active").groupBy(F.coalesce("tier", F.lit("hot")).alias("tier")).agg(F.count("*").alias("n"))
    return names.join(counts, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def memory_patch(memory: DataFrame, updates: DataFrame) -> DataFrame:
    """Memories after edits (chunk_id; new_text, new_probe, new_slot_key, new_tier, new_importance, reset; null: unchanged).

    Importance is clamped to 0..2; an unknown tier or a malformed slot key changes nothing; a reset clears hits and the last
    hit. The vector goes when the retrieval key, the probe or else the text, changes.
    """
    joined = memory.join(updates, "chunk_id", "left")
    text, probe = F.coalesce("new_text", "text"), F.coalesce("new_probe", "probe")
    key = lambda p, t: F.coalesce(F.when(p != "", p), t)
    reset = F.coalesce("reset", F.lit(False))
    return joined.withColumns({
        "importance": F.when(F.col("new_importance").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.col("new_importance")))).otherwise(F.col("importance")),
        "tier": F.coalesce(F.when(F.col("new_tier").isin(*TIERS), F.col("new_tier")), F.col("tier")),
        "slot_key": F.coalesce(F.when(F.col("new_slot_key").rlike("^[a-z][a-z0-9_]{0,39}$"), F.col("new_slot_key")), F.col("slot_key")),
        "hits": F.when(reset, F.lit(0).cast("long")).otherwise(F.col("hits")),
        "last_hit_at": F.when(reset, F.lit(None)).otherwise(F.col("last_hit_at")),
        "embedding": F.when(key(probe, text).eqNullSafe(key(F.col("probe"), F.col("text"))), F.col("embedding")),
        "text": text,
        "probe": probe,
    }).select(*memory.columns)


def visible(memory: DataFrame, identities: DataFrame) -> DataFrame:
    """Per row of ``identities`` (turn_id, user_id, decision) the memories it may see: active and approved, shared or its own.

    Shared rows go to every turn and owned rows to those of their owner, each as its own branch; nobody but an accepted speaker
    gets owned ones.
    """
    usable = memory.filter("active and approved")
    shared = every_pair(usable.filter("owner_user_id is null"), identities.select("turn_id", "user_id"), "turn_id")
    accepted = identities.filter("decision = 'accepted'").select("turn_id", "user_id")
    owned = every_pair(usable.filter("owner_user_id is not null").withColumn("user_id", F.col("owner_user_id").cast(identities.schema["user_id"].dataType)), accepted, "turn_id", "user_id")
    return shared.unionByName(owned)


def memory_pool(memory: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, pool, ...): shared rows, which every user has in the slot pool, and the user's own by tier; active and approved."""
    usable = memory.filter("active and approved")
    shared = every_pair(usable.filter("owner_user_id is null"), users.select("user_id"), "user_id").withColumn("pool", F.lit("slot"))
    owned = users.select("user_id").join(usable, F.col("owner_user_id") == F.col("user_id")).withColumn("pool", F.coalesce("tier", F.lit("hot")))
    return shared.unionByName(owned)


def newest_candidates(memory: DataFrame, limit: int = 200) -> DataFrame:
    """Each owner's newest ``limit`` rows."""
    w = Window.partitionBy("owner_user_id").orderBy(F.desc("created_at"), F.desc("chunk_id"))
    return memory.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit).drop("r")


def slot_overflow(memory: DataFrame, now: int, s: MemorySettings = MemorySettings()) -> DataFrame:
    """chunk_id of each owner's active slot rows beyond the capacity, those of least score."""
    w = Window.partitionBy("owner_user_id").orderBy(F.desc("score"), "created_at", "chunk_id")
    slots = memory.filter("active and tier = 'slot' and owner_user_id is not null").withColumn("score", effective_score(now, s))
    return slots.withColumn("r", F.row_number().over(w)).filter(F.col("r") > s.slot_capacity).select("owner_user_id", "chunk_id", "score")


def apply_hits(memory: DataFrame, used: DataFrame, now: int) -> DataFrame:
    """Memories after ``used`` (turn_id, used_ids): one hit for each turn that used a row, however often."""
    counts = used.select("turn_id", F.explode("used_ids").alias("chunk_id")).distinct().groupBy("chunk_id").agg(F.count("*").alias("new_hits"))
    joined = memory.join(counts, "chunk_id", "left")
    return joined.withColumns({"hits": F.col("hits") + F.coalesce("new_hits", F.lit(0)), "last_hit_at": F.when(F.col("new_hits").isNotNull(), F.lit(now).cast("long")).otherwise(F.col("last_hit_at"))}).drop("new_hits")


def evaluate_tiers(memory: DataFrame, now: int, s: MemorySettings = MemorySettings()) -> DataFrame:
    """Active memories with score, new_tier and transition (promoted, demoted, revived, slot_overflow, null)."""
    rows = memory.filter("active").withColumn("old", F.when(F.col("tier").isin(*TIERS), F.col("tier")).otherwise("hot")).withColumn("score", effective_score(now, s))
    rows = rows.withColumn("target", next_tier(F.col("old"), F.col("score"), s))
    w = Window.partitionBy("owner_user_id", "target").orderBy(F.desc("score"), "created_at", "chunk_id")
    rows = rows.withColumn("over", (F.col("target") == "slot") & F.col("owner_user_id").isNotNull() & (F.row_number().over(w) > s.slot_capacity))
    new = F.when(F.col("over"), "hot").otherwise(F.col("target"))
    change = (
        F.when(F.col("over"), "slot_overflow").when((F.col("old") == "cold") & (F.col("target") == "hot"), "revived").when((F.col("target") == "slot") & (F.col("old") != "slot"), "promoted")
        .when(F.col("target") != F.col("old"), "demoted")
    )
    return rows.withColumns({"new_tier": new, "transition": change}).drop("old", "target", "over")


def hybrid_score(query: Column, vector: Column | None, text: Column, probe: Column, embedding: Column, probe_weight: float = 1.0, text_weight: float = 0.25) -> Column:
    """Cosine with the probe's vector plus a little of the text's lexical similarity; without vectors the better lexical one of both."""
    lexical = F.greatest(lexical_similarity(query, probe), lexical_similarity(query, text))
    if vector is None:
        return lexical
    both = probe_weight * cosine(vector, embedding) + text_weight * lexical_similarity(query, text)
    return F.when(vector.isNotNull() & embedding.isNotNull(), both).otherwise(lexical)


def user_scores(questions: DataFrame, memory: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): ``hybrid_score`` of each question vector (query_id, user_id, vector) with each of its user's rows, by the row's own probe, to 5 places.

    What words give is a row's own and is taken once for each; cosines come in tiles.
    """
    schema = "query_id long, chunk_id long, score double"
    probe, text = F.col("probe"), F.col("text")
    rows = memory.select(F.col("owner_user_id").alias("user_id"), "chunk_id", "embedding", lexical_similarity(probe, text).alias("text"), hybrid_score(probe, None, text, probe, F.col("embedding")).alias("words"))

    def every(y: pa.Table):
        near, ids, text, words = Vectors(y["embedding"]), y["chunk_id"].to_numpy(), y["text"].to_numpy(), y["words"].to_numpy()

        def of(x: pa.Table) -> pa.Table:
            cosine, both = near.cosines(x["vector"])
            scores = np.where(both, np.round(cosine, 12) + 0.25 * text[None], words[None]).T
            scores = np.copysign(np.floor(np.abs(scores) * 1e5 + 0.5), scores) / 1e5  # halves away from 0, as SQL rounds
            row, column = (i.ravel() for i in np.indices(scores.shape))
            return made(schema, x["query_id"].to_numpy()[column], ids[row], scores.ravel())

        return of

    return scored_in_blocks(questions.select("query_id", "user_id", "vector"), rows, ("query_id", "chunk_id"), every, schema, "user_id", (256, 512))


def _near_probes(p: DataFrame, m: DataFrame, similarity: float) -> DataFrame:
    """(prop_id, chunk_id, created_at, similarity): of the owner's rows ``m`` the most similar to each proposal, the newer of equals."""
    schema = "prop_id long, chunk_id long, created_at long, similarity double"

    def nearest(y: pa.Table):
        rows, ids, created = Vectors(y["embedding"]), y["chunk_id"].to_numpy(), y["created_at"].to_numpy()

        def of(x: pa.Table) -> pa.Table:
            scores, _ = rows.cosines(x["p_vec"])
            row, column = best_in_rows(scores, 1, 1e-9)
            keep = scores[row, column] >= similarity
            row, column = row[keep], column[keep]
            return made(schema, x["prop_id"].to_numpy()[row], ids[column], created[column], scores[row, column])

        return of

    return scored_in_blocks(p.filter("p_vec is not null"), m.filter("embedding is not null"), ("prop_id", "chunk_id"), nearest, schema, "owner_user_id")


def candidates_join(new: DataFrame, memory: DataFrame, similarity: float = 0.90, newest: int = 200) -> DataFrame:
    """(prop_id, chunk_id, how): for each proposal (prop_id, owner_user_id, slot_key, text, embedding) the one memory it matches.

    Same text before same slot key before a probe of that similarity among the owner's newest; of equals the more similar,
    then the newer. Two equi-joins, and a matrix product for each owner's probes; only its best row leaves a block.
    """
    p = new.select("prop_id", "owner_user_id", F.col("slot_key").alias("p_key"), F.col("text").alias("p_text"), F.col("embedding").alias("p_vec"))
    m = memory.filter("active").select("owner_user_id", "chunk_id", "slot_key", "text", "embedding", "created_at")
    newest_of = lambda c: m.groupBy("owner_user_id", F.col(c).alias("same")).agg(F.max(F.struct("created_at", "chunk_id")).alias("b"))
    alike = lambda c, of, rank: p.withColumn("same", F.col(c)).join(newest_of(of), ["owner_user_id", "same"]).select("prop_id", F.lit(rank).alias("rank"), F.lit(1.0).alias("similarity"), "b.created_at", "b.chunk_id")
    few = newest_candidates(m, newest).select("owner_user_id", "chunk_id", "created_at", "embedding")
    near = _near_probes(p.select("prop_id", "owner_user_id", "p_vec"), few, similarity).select("prop_id", F.lit(2).alias("rank"), F.round("similarity", 9).alias("similarity"), "created_at", "chunk_id")
    found = alike("p_text", "text", 0).unionByName(alike("p_key", "slot_key", 1)).unionByName(near)
    best = found.groupBy("prop_id").agg(F.max(F.struct((-F.col("rank")).alias("first"), "similarity", "created_at", "chunk_id")).alias("b"))
    return best.select("prop_id", "b.chunk_id", F.element_at(F.array(F.lit("text"), F.lit("slot_key"), F.lit("probe")), 1 - F.col("b.first")).alias("how"))


def normalize_candidate(raw: DataFrame, s: MemorySettings = MemorySettings()) -> DataFrame:
    """Proposals (key, text, probe, quote, importance as strings; message) that can be stored, in clean form; others are left out."""
    empty = lambda c: squeeze(F.coalesce(F.col(c), F.lit("")))
    key = F.lower(empty("key"))
    importance = F.coalesce(F.try_to_number(F.col("importance"), F.lit("9.999")).cast("double"), F.expr("try_cast(importance AS DOUBLE)"), F.lit(s.default_importance))
    out = raw.withColumns({
        "approved": quote_is_verbatim(F.col("quote"), F.col("message")),
        "importance": F.least(F.lit(1.0), F.greatest(F.lit(0.05), importance)),
        "slot_key": F.when(key.rlike("^[a-z][a-z0-9_]{0,39}$"), key),
        "probe": F.coalesce(F.when(F.substring(empty("probe"), 1, 120) != "", F.substring(empty("probe"), 1, 120)), empty("text")),
        "text": empty("text"),
    })
    return out.filter("length(text) between 2 and 280")


def cap_candidates(rows: DataFrame, safety: DataFrame | None = None, limit: int = 3) -> DataFrame:
    """Proposals (turn_id, ord, slot_key, text) without repeats of a slot key or text, the first ``limit`` of each turn; safety
    rows come on top unless their key is there."""
    mark = F.coalesce("slot_key", "text")
    first = Window.partitionBy("turn_id", "mark").orderBy("ord")
    kept = rows.withColumn("mark", mark).withColumn("r", F.row_number().over(first)).filter("r = 1")
    kept = kept.withColumn("r", F.row_number().over(Window.partitionBy("turn_id").orderBy("ord"))).filter(F.col("r") <= limit).drop("r")
    if safety is not None:
        more = safety.withColumn("mark", mark).join(kept.select("turn_id", "mark"), ["turn_id", "mark"], "left_anti")
        kept = kept.unionByName(more)
    return kept.drop("mark")


def rank_chunks(scored: DataFrame, key: str = "query_id") -> DataFrame:
    """Adds ``rank`` by score, ties in insertion order (chunk_id)."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "chunk_id")))


def select_relevant(scored: DataFrame, floor: float, limit: int, key: str = "query_id") -> DataFrame:
    """The best ``limit`` rows of each query that reach ``floor``."""
    return rank_chunks(scored.filter(F.col("score") >= floor), key).filter(F.col("rank") <= max(1, limit))


def lexical_retrieve(visible_rows: DataFrame, limit: int = 4) -> DataFrame:
    """The best ``limit`` visible rows of each turn (turn_id, query, text) by lexical similarity alone."""
    scored = visible_rows.withColumn("score", lexical_similarity(F.col("query"), F.col("text")))
    return select_relevant(scored, -1.0, limit, "turn_id")


def _hashed(text: Column) -> Column:
    """A text's terms as 64-bit hashes, a fraction of the bytes to deal; of null, none."""
    return hashed_terms(F.coalesce(text, F.lit("")))


#: Below any similarity of lists that have a term in common.
LEAST = 1e-9


def _by_turn(x: pa.Table) -> Iterator[tuple[int, range]]:
    """(turn_id, its rows) of rows in that order."""
    turns, first = np.unique(x["turn_id"].to_numpy(), return_index=True)
    for turn, begin, end in zip(turns, first, [*first[1:], x.num_rows], strict=True):
        yield int(turn), range(begin, end)


def _lexical_best(questions: DataFrame, rows: DataFrame, keep: int, key: str | None = None) -> DataFrame:
    """(turn_id, chunk_id, score): each turn's ``keep`` best of all ``rows`` (chunk_id, t), of its ``key`` where there is one.

    ``questions`` (turn_id, q) are one to a turn. A block of rows is an index of their terms, which the questions are looked up in;
    rows that have nothing in common with a question come last, by id.
    """
    schema = "turn_id long, chunk_id long, score double"

    def best(y: pa.Table):
        index, ids = TermIndex(y["t"]), y["chunk_id"].to_numpy()
        first, any_, all_ = np.argsort(ids, kind="stable")[: 2 * keep], np.array([LEAST]), np.zeros(len(ids), np.int8)

        def of(x: pa.Table) -> pa.Table:
            out = []
            for turn, q in zip(x["turn_id"].to_numpy(), index.asked(x["q"]), strict=True):
                row, score = best_rows(*index.search(q, any_, all_, keep), ids, keep)
                if len(row) < keep:
                    more = first[~np.isin(first, row)][: keep - len(row)]
                    row, score = np.concatenate([row, more]), np.concatenate([score, np.zeros(len(more))])
                out.append((np.full(len(row), turn), ids[row], score))
            return made(schema, *map(np.concatenate, zip(*out, strict=True)))

        return of

    return scored_in_blocks(questions, rows, ("turn_id", "chunk_id"), best, schema, key, most=(262144, 98304), indexed=True)


def lexical_search(turns: DataFrame, memory: DataFrame, limit: int = 4) -> DataFrame:
    """``lexical_retrieve`` of what ``visible`` gives each turn (turn_id, user_id, decision, query), without making its pairs: (turn_id, chunk_id, score)."""
    usable = memory.filter("active and approved").select("owner_user_id", "chunk_id", _hashed(F.col("text")).alias("t"))
    asked = turns.select("turn_id", "user_id", "decision", _hashed(F.col("query")).alias("q"))
    shared = _lexical_best(asked.select("turn_id", "q"), usable.filter("owner_user_id is null").drop("owner_user_id"), limit)
    owned = _lexical_best(asked.filter("decision = 'accepted'").select("turn_id", "user_id", "q"), usable.withColumnRenamed("owner_user_id", "user_id"), limit, "user_id")
    return select_relevant(shared.unionByName(owned), -1.0, limit, "turn_id").select("turn_id", "chunk_id", "score")


def question_parts(turns: DataFrame, text: str = "input_text", key: str = "turn_id") -> DataFrame:
    """(key, part, question): the questions of each turn, numbered from 0; what an embedder is given, one vector each."""
    from ..functions.text import split_queries

    return turns.select(key, F.posexplode(split_queries(F.col(text))).alias("part", "question"))


SCORED = "turn_id long, chunk_id long, pool string, score double, part int"


class _Near:
    """Rows with a vector, in order of their kinds, to find those whose cosine, and a quarter of the text's similarity, is enough."""

    def __init__(self, y: pa.Table, index: TermIndex, kinds: np.ndarray, n: int):
        self.index, self.vectors, self.places, self.kinds = index, Vectors(y["embedding"]), index.place[0], kinds
        self.sizes = np.where(self.places >= 0, index.sizes[self.places] if len(index.sizes) else 0, 0)
        self.known = np.unique(self.sizes)
        self.unit = self._units(self.vectors)
        self.cuts = np.searchsorted(kinds, np.arange(n + 1))

    @staticmethod
    def _units(v: Vectors) -> np.ndarray:
        return np.divide(v.matrix, v.size[:, None], out=np.zeros_like(v.matrix), where=v.size[:, None] > 0).astype(np.float32)

    def asked(self, column: pa.ChunkedArray) -> None:
        """Take the cosines of a tile of question vectors, equal ones once, in single precision: they tell what is worth a closer look."""
        self.x = Vectors(column)
        _, first, same = np.unique(np.concatenate([self.x.lengths[:, None], self.x.matrix], axis=1), axis=0, return_index=True, return_inverse=True)
        self.same = same.reshape(-1)
        width = min(self.unit.shape[1], self.x.matrix.shape[1])
        self.about = self._units(self.x)[first][:, :width] @ self.unit[:, :width].T
        self.about[self.x.lengths[first][:, None] != self.vectors.lengths[None]] = 0
        #: The row of the largest cosine of each kind that there is.
        self.top = np.stack([begin + self.about[:, begin:end].argmax(1) for begin, end in zip(self.cuts, self.cuts[1:]) if end > begin], axis=1)

    def scores(self, i: int, q: Asked, row: np.ndarray) -> np.ndarray:
        """The score of question ``i`` with each row."""
        x, v = self.x, self.vectors
        width = min(v.matrix.shape[1], x.matrix.shape[1])
        size = v.size[row] * x.size[i]
        cosine = np.divide(v.matrix[row, :width] @ x.matrix[i, :width], size, out=np.zeros(len(row)), where=(size > 0) & (v.lengths[row] == x.lengths[i]))
        both = self.index.common(q, self.places[row])
        return cosine + 0.25 * (both / np.maximum(q.size + self.sizes[row] - both, 1))

    def search(self, i: int, q: Asked, need: np.ndarray, keep: int | None = None, each: bool = False, whole: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of all rows that reach what their kind needs; with ``keep`` at least the best ``keep``, of ``each`` kind (1 of them) or in all,
        and all that reach ``whole``."""
        about, a = self.about[self.same[i]], q.size
        at = np.searchsorted(self.known, a)
        lists = self.known[max(at - 1, 0) : at + 1]
        # by the lengths, no text's similarity is larger
        most = 0.25 * float((np.minimum(lists, a) / np.maximum(np.maximum(lists, a), 1)).max(initial=0.0)) + 1e-4
        if each:
            top = self.top[self.same[i]]
            need = need.copy()
            need[self.kinds[top]] = np.maximum(need[self.kinds[top]], np.minimum(self.scores(i, q, top), whole) - LEAST)  # a product of more rows may differ in its last bits
        row = np.concatenate([begin + np.flatnonzero(about[begin:end] >= n - most) for begin, end, n in zip(self.cuts, self.cuts[1:], need)])
        if keep is not None and not each and len(row) > 8 * keep + 64:
            high = row[np.argpartition(-about[row], keep - 1)[:keep]]
            score = self.scores(i, q, high)
            if (score >= need[self.kinds[high]]).all():
                need = np.maximum(need, score.min() - LEAST)
                row = row[about[row] >= score.min() - most]
        b, wanted = self.sizes[row], need[self.kinds[row]]
        row = row[about[row] + 0.25 * (np.minimum(a, b) / np.maximum(np.maximum(a, b), 1)) >= wanted - 1e-4]
        score = self.scores(i, q, row)
        enough = score >= need[self.kinds[row]]
        return row[enough], score[enough]


class _Recalled:
    """Rows of memory to answer questions from: by words, and where a row and a question have a vector by that. Kinds are the rows' pools."""

    def __init__(self, y: pa.Table, floors: dict[str, float]):
        pools = np.array(y["pool"].to_pylist())
        self.pools, self.kinds = np.unique(pools, return_inverse=True)
        self.floors = np.array([floors.get(pool, floors["hot"]) for pool in self.pools], float)
        self.ids, self.every = y["chunk_id"].to_numpy(), self.pools == "cold"
        there = y["embedding"].combine_chunks().is_valid().to_numpy(zero_copy_only=False) if "embedding" in y.column_names else np.zeros(y.num_rows, bool)
        self.words, self.near = [], None
        for rows in (np.flatnonzero(~there), np.flatnonzero(there)):
            if len(rows):
                rows = rows[np.argsort(self.kinds[rows], kind="stable")]
                some = y.take(pa.array(rows))
                self.words.append((rows, TermIndex(some["t"], some["p"]), self.kinds[rows]))
                if there[rows[0]]:
                    self.near = _Near(some, self.words[-1][1], self.words[-1][2], len(self.pools))

    def asked(self, x: pa.Table) -> None:
        self.questions = [index.asked(x["q"]) for _, index, _ in self.words]
        self.embedded = x["vector"].combine_chunks().is_valid().to_numpy(zero_copy_only=False) if self.near is not None else None
        if self.near is not None:
            self.near.asked(x["vector"])

    def search(self, i: int, need: np.ndarray, keep: int, each: bool = False, whole: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of rows that reach with question ``i`` what their kind needs: at least the best ``keep``, of ``each`` kind or in all, and all that reach ``whole``."""
        out = []
        for (rows, index, kinds), asked in zip(self.words, self.questions, strict=True):
            if self.near is not None and index is self.near.index and self.embedded[i]:
                row, score = self.near.search(i, asked[i], need, keep, each, whole)
            elif need.min() > 0:
                row, score = index.search(asked[i], need, kinds, keep, each, min(whole, 1.0))
            else:  # rows without a term in common may reach it, too
                row, score = best_rows(*index.search(asked[i], np.full(len(need), LEAST), kinds), rows)
                others = np.setdiff1d(np.arange(len(rows)), row)
                row, score = np.concatenate([row, others]), np.concatenate([score, np.zeros(len(others))])
                row, score = row[score >= need[kinds[row]]], score[score >= need[kinds[row]]]
            out.append((rows[row], score))
        return np.concatenate([r for r, _ in out]), np.concatenate([s for _, s in out])

    def best(self, own: range, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of the ``keep`` best rows that reach their floor with any of a turn's questions."""
        row, score = np.empty(0, np.int64), np.empty(0)
        for i in sorted(own, key=lambda i: self.questions[0][i].size):
            need = self.floors if len(row) < keep else np.maximum(self.floors, score.min() - LEAST)
            new, is_ = self.search(i, need, keep)
            row, score = best_rows(np.concatenate([row, new]), np.concatenate([score, is_]), self.ids, keep)
        return row, score

    def facts(self, own: range) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(best score or 0 of each pool, place of the first question that any of its rows answers or -1, every cold row that reaches the floor, its score)."""
        high, answer = np.zeros(len(self.pools)), np.full(len(self.pools), -1)
        rows, scores = [np.empty(0, np.int64)], [np.empty(0)]
        for n, i in enumerate(own):
            # up to the floor all rows are looked for, or one that shows an answer; else what is better than the best so far
            open_ = self.every | (answer < 0)
            need = np.where(open_, np.minimum(self.floors, np.maximum(high, LEAST)), np.maximum(high, LEAST))
            row, score = self.search(i, need, 1, True, float(self.floors[open_].min(initial=np.inf)))
            kind = self.kinds[row]
            np.maximum.at(high, kind, score)
            reached = score >= self.floors[kind]
            answer[np.intersect1d(kind[reached], np.flatnonzero(answer < 0))] = n
            reached &= self.every[kind]
            rows.append(row[reached])
            scores.append(score[reached])
        return high, answer, *best_rows(np.concatenate(rows), np.concatenate(scores), self.ids)


def recall_scores(turns: DataFrame, memory: DataFrame, s: MemorySettings = MemorySettings(), vectors: DataFrame | None = None, matched: bool = True, reported: bool = True) -> DataFrame:
    """(turn_id, chunk_id, pool, score, part): what recall (``matched``) and its report (``reported``) are made of, without the pairs of turns and rows.

    Rows with a chunk_id reach their pool's floor with the score, that of the turn's best question: of each block the best that may be
    matched, and, for the report, every cold one. Rows without say, for the report, for a pool its best score and the first question that it answers, if any.
    ``vectors`` (turn_id, part, embedding) has a vector for each of a turn's ``question_parts``; a question and a row that both have
    one score by ``hybrid_score``, all others by words.
    """
    schema, keep = SCORED, s.inject_top_n + s.slot_top_n
    floors = {"slot": s.relevance_floor, "hot": s.relevance_floor, "cold": s.cold_floor}
    columns = [c for c in ("turn_id", "user_id", "decision") if c in turns.columns]
    questions = question_parts(turns).join(turns.select(*columns), "turn_id").withColumn("q", _hashed(F.col("question"))).drop("question")
    # a probe that is the whole text says nothing more
    probe = F.when(~F.col("probe").eqNullSafe(F.col("text")), _hashed(F.col("probe")))
    rows = memory.filter("active and approved").select("owner_user_id", "chunk_id", F.when(F.col("owner_user_id").isNull(), "slot").otherwise(F.coalesce("tier", F.lit("hot"))).alias("pool"), _hashed(F.col("text")).alias("t"), probe.alias("p"), *(["embedding"] if vectors is not None else []))
    if vectors is not None:
        questions = questions.join(vectors.select("turn_id", "part", F.col("embedding").alias("vector")), ["turn_id", "part"], "left")

    def best(y: pa.Table):
        known = _Recalled(y, floors)

        def of(x: pa.Table) -> pa.Table:
            x = x.sort_by([("turn_id", "ascending"), ("part", "ascending")])
            known.asked(x)
            part, out, none = x["part"].to_numpy(), [], []
            for turn, own in _by_turn(x):
                row, score = known.best(own, keep) if matched else (np.empty(0, np.int64), np.empty(0))
                if reported:
                    high, answer, more, scores = known.facts(own)
                    row, score = best_rows(np.concatenate([row, more]), np.concatenate([score, scores]), known.ids)
                    none += ([turn, pool, top, None if n < 0 else int(part[own[n]])] for pool, top, n in zip(known.pools, high, answer, strict=True))
                out.append((np.full(len(row), turn), row, score))
            turn, row, score = map(np.concatenate, zip(*out, strict=True))
            found = made(schema, turn, known.ids[row], known.pools[known.kinds[row]], score, pa.nulls(len(row), pa.int32()))
            if not none:
                return found
            turn, pool, top, answer = zip(*none, strict=True)
            return pa.concat_tables([found, made(schema, turn, pa.nulls(len(turn), pa.int64()), pool, top, answer)])

        return of

    most = 262144, 98304 if vectors is None else 65536
    owned = questions.filter("decision = 'accepted'") if "decision" in columns else questions
    shared = scored_in_blocks(questions, rows.filter("owner_user_id is null").drop("owner_user_id"), ("turn_id", "chunk_id"), best, schema, tile=(256, 0), most=most, indexed=True)
    own = scored_in_blocks(owned, rows.withColumnRenamed("owner_user_id", "user_id"), ("turn_id", "chunk_id"), best, schema, "user_id", tile=(256, 0), most=most, indexed=True)
    both = shared.unionByName(own)
    # one aggregation, so what stands below it runs once
    whole = both.groupBy("turn_id", "chunk_id", "pool").agg(F.max("score").alias("score"), F.min("part").alias("part"))
    return whole.withColumn("score", F.when(F.col("chunk_id").isNull(), F.col("score")).otherwise(F.round("score", 9)))


def recall(turns: DataFrame, memory: DataFrame, s: MemorySettings = MemorySettings(), vectors: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """(turn_id, chunk_id, pool, score, source): what each turn (turn_id, user_id, input_text) gets to see.

    The user's newest ``slot_top_n`` slot rows of BASIC_SLOT_KEYS come always, as source basic, and take nothing from the budget. Of the
    other rows that reach the floor of their pool with any question of the turn, shared ones standing in the slot pool, the best
    ``inject_top_n`` come as matched; ties go to the smaller chunk_id. With a column ``decision``, only an accepted speaker gets owned
    rows. ``scores`` are ``recall_scores``, where they are at hand.
    """
    found = (recall_scores(turns, memory, s, vectors, reported=False) if scores is None else scores).filter("chunk_id is not null")
    newest = Window.partitionBy("owner_user_id").orderBy(F.desc("created_at"), "chunk_id")
    basics = memory.filter("active and approved and tier = 'slot' and owner_user_id is not null").filter(F.col("slot_key").isin(*BASIC_SLOT_KEYS))
    basics = basics.select("owner_user_id", "chunk_id", F.row_number().over(newest).alias("r")).filter(F.col("r") <= s.slot_top_n).drop("r")
    accepted = turns.filter("decision = 'accepted'") if "decision" in turns.columns else turns
    first = accepted.select("turn_id", F.col("user_id").alias("owner_user_id")).join(basics, "owner_user_id").select("turn_id", "chunk_id", F.lit("slot").alias("pool"), F.lit(None).cast("double").alias("score"), F.lit("basic").alias("source"))
    others = found.join(first.select("turn_id", "chunk_id"), ["turn_id", "chunk_id"], "left_anti")
    best = Window.partitionBy("turn_id").orderBy(F.desc("score"), "chunk_id")
    matched = others.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= s.inject_top_n)
    return first.unionByName(matched.select("turn_id", "chunk_id", "pool", "score", F.lit("matched").alias("source")))


def recall_report(turns: DataFrame, scores: DataFrame) -> DataFrame:
    """(turn_id, slot_best, hot_best, cold_best, tier_reached, revived) of every turn, from ``recall_scores``.

    The bests are over all rows of a pool, 0 without any; tier_reached is the first tier that answers the first question answered at all,
    cold without one; revived are the cold rows found, by chunk_id, whether or not the budget has room for them.
    """
    order = F.when(F.col("pool") == "slot", 0).when(F.col("pool") == "cold", 2).otherwise(1)
    fact, cold = F.col("chunk_id").isNull(), F.col("chunk_id").isNotNull() & (F.col("pool") == "cold")
    facts = scores.groupBy("turn_id").agg(
        *(F.max(F.when(fact & (F.col("pool") == pool), F.col("score"))).alias(f"{pool}_best") for pool in TIERS), F.min(F.when(fact & F.col("part").isNotNull(), F.struct("part", order.alias("order"), "pool")))["pool"].alias("tier_reached"),
        F.array_sort(F.collect_set(F.when(cold, F.col("chunk_id")))).alias("revived"),
    )
    out = turns.select("turn_id").distinct().join(facts, "turn_id", "left")
    return out.select("turn_id", *(F.coalesce(f"{pool}_best", F.lit(0.0)).alias(f"{pool}_best") for pool in TIERS), F.coalesce("tier_reached", F.lit("cold")).alias("tier_reached"), F.coalesce("revived", F.array().cast("array<long>")).alias("revived"))


def duplicate_groups(memory: DataFrame, similarity: float = 0.90, newest: int = 200) -> DataFrame:
    """(owner_user_id, chunk_id, leader): greedy groups of two or more, newest first, by cosine with the group's first row.

    At most ``newest`` rows of an owner are compared, so a group fits one task whoever owns most rows.
    """
    rows = newest_candidates(memory.filter("active and embedding is not null and owner_user_id is not null"), newest)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["created_at", "chunk_id"], ascending=False)
        vectors = np.stack(pdf["embedding"].to_numpy()).astype(float)
        size = np.linalg.norm(vectors, axis=1)
        vectors = vectors / np.where(size > 0, size, 1)[:, None]
        leaders: list[int] = []
        owner = []
        for i, v in enumerate(vectors):
            hit = next((j for j in leaders if float(vectors[j] @ v) >= similarity), None)
            if hit is None:
                leaders.append(i)
                hit = i
            owner.append(hit)
        ids = pdf["chunk_id"].to_numpy()
        return pd.DataFrame({"owner_user_id": pdf["owner_user_id"].to_numpy(), "chunk_id": ids, "leader": ids[owner]})

    groups = rows.select("owner_user_id", "chunk_id", "created_at", "embedding").groupBy("owner_user_id").applyInPandas(group, "owner_user_id long, chunk_id long, leader long")
    return groups.withColumn("n", F.count("*").over(Window.partitionBy("owner_user_id", "leader"))).filter("n > 1").drop("n")


def merge_duplicates(memory: DataFrame, groups: DataFrame) -> DataFrame:
    """(leader, chunk_id, hits, importance, approved): each group's survivor, approved before hits before age, with what all of it had."""
    rows = memory.join(groups.select("chunk_id", "leader"), "chunk_id")
    w = Window.partitionBy("leader").orderBy(F.desc("approved"), F.desc("hits"), "created_at", "chunk_id")
    whole = Window.partitionBy("leader")
    merged = rows.withColumns({"r": F.row_number().over(w), "all_hits": F.sum("hits").over(whole), "top": F.max("importance").over(whole), "any": F.max("approved").over(whole)})
    return merged.filter("r = 1").select("leader", "chunk_id", F.col("all_hits").alias("hits"), F.col("top").alias("importance"), F.col("any").alias("approved"))


def safety_memories(turns: DataFrame, plans: list[tuple[tuple[str, ...], str, str, str]], negations: tuple[str, ...] = (), urgent: tuple[str, ...] = (), importance: float = 0.95) -> DataFrame:
    """(turn_id, user_id, slot_key, text, probe, quote, importance, approved): what an urgent turn (turn_id, user_id, input_text) discloses.

    ``plans`` are (vocabulary, slot key, probe, what it is about); a plan gives a row if the turn states one of its phrases
    undenied, the first one said being the quote.
    """
    from ..functions.lexicon import first_disclosure, risk_level

    words = urgent or tuple(w for p in plans for w in p[0])
    message = squeeze(F.coalesce("input_text", F.lit("")))
    rows = F.array(*(
        F.struct(first_disclosure(message, vocabulary, negations).alias("quote"), F.lit(key).alias("slot_key"), F.lit(probe).alias("probe"), F.lit(about).alias("about"))
        for vocabulary, key, probe, about in plans
    ))
    found = turns.filter(risk_level(F.col("input_text"), words, ()) == "urgent").select("turn_id", "user_id", F.explode(rows).alias("r")).filter("r.quote <> ''")
    return found.select(
        "turn_id", "user_id", "r.slot_key", F.concat(F.lit("The user has said that they "), "r.about", F.lit(": “"), "r.quote", F.lit("”.")).alias("text"), "r.probe", "r.quote",
        F.lit(importance).alias("importance"), F.lit(True).alias("approved"),
    )


#: Rows that upserts read and write at once.
BATCH = 1024
UPSERTS = "owner_user_id long, chunk_id long, slot_key string, text string, probe string, importance double, approved boolean, embedding array<float>, action string"


class _Row:
    """A memory as it is now; ``there`` says that it has a vector."""

    __slots__ = ("owner_user_id", "chunk_id", "slot_key", "text", "probe", "importance", "approved", "embedding", "statement_vec", "created_at", "there")

    def __init__(self, row: dict):
        for name in self.__slots__:
            setattr(self, name, row.get(name))
        self.there = False


class _OwnMemories:
    """The rows of one owner that proposals may meet, in order of their insertion; proposals change and add rows."""

    def __init__(self, s: MemorySettings, single_valued: Collection[str], newest: int, now: int):
        self.s, self.single_valued, self.newest, self.now = s, single_valued, newest, now
        self.rows: list[_Row] = []
        #: By the 64-bit hash of a text, a slot key, a slot key and text, or a slot key and words, the place of the row that has it now, or those of several as a heap; others may be among them.
        self.places: dict[int, int | list[int]] = {}
        #: By slot key, the places of rows that have, or had, a statement's vector.
        self.stated: dict[str, list[int]] = {}
        self.changed: dict[int, str] = {}
        #: Places of rows with a vector, newest first; kept in order, so a proposal looks at the first few only.
        self.recent: list[tuple[int, int]] = []
        #: Vectors of length 1 of the rows asked for of late; those of all rows would be more bytes than the rows.
        self.units: dict[int, np.ndarray] = {}

    def add(self, row: dict) -> int:
        at = len(self.rows)
        self.rows.append(_Row(row))
        self._embed(at, row["embedding"])
        self._place(at)
        return at

    @staticmethod
    def _marks(row: _Row) -> list[int]:
        key, text = row.slot_key, row.text
        return [hash(("text", text)), *([hash(("key", key)), hash(("both", key, text)), hash(("words", key, _words(text)))] if key else [])]

    def _place(self, at: int, before: Collection[int] = ()) -> None:
        row = self.rows[at]
        marks = self._marks(row)
        for mark in before:
            if mark not in marks and self.places.get(mark) == at:
                del self.places[mark]
        for mark in marks:
            old = self.places.get(mark)
            if old is None:
                self.places[mark] = at
            elif isinstance(old, list):
                heappush(old, at)
            elif old != at:
                self.places[mark] = [min(old, at), max(old, at)]
        if row.slot_key and row.statement_vec is not None:
            heappush(self.stated.setdefault(row.slot_key, []), at)

    def _all(self, *mark) -> Collection[int]:
        found = self.places.get(hash(mark), ())
        return (found,) if isinstance(found, int) else found

    def _first(self, *mark) -> int | None:
        """The first row that has ``mark`` now; those that lost it before the first are dropped, for they come back if they get it again."""
        heap, mark = self._all(*mark), hash(mark)
        if isinstance(heap, tuple):
            return next((at for at in heap if mark in self._marks(self.rows[at])), None)
        while heap and mark not in self._marks(self.rows[heap[0]]):
            heappop(heap)
        return heap[0] if heap else None

    def _embed(self, at: int, vector) -> None:
        row, there = self.rows[at], vector is not None and len(vector) > 0
        place = (-row.created_at, at)
        if there and not row.there:
            insort(self.recent, place)
        elif row.there and not there:
            del self.recent[bisect_left(self.recent, place)]
        row.embedding, row.there = _packed(vector), there
        self.units.pop(at, None)

    def _unit_of(self, i: int) -> np.ndarray:
        """A row's vector of length 1, made when it is first asked for."""
        if i not in self.units:
            if len(self.units) > 4 * self.newest + 64:
                self.units.clear()
            self.units[i] = _unit(self.rows[i].embedding)
        return self.units[i]

    def _near(self, vector) -> list[int]:
        """Rows whose probe is about the same, among the newest that have a vector, newest first."""
        if vector is None or self.s.merge_similarity > 1:
            return []
        near = [i for _, i in self.recent[: self.newest] if len(self.rows[i].embedding) == len(vector)]
        if not near:
            return []
        scores = np.stack([self._unit_of(i) for i in near]) @ vector
        return [near[j] for j in np.flatnonzero(scores >= self.s.merge_similarity)]

    def _same_fact(self, p: dict, i: int) -> bool:
        a, b = _unit(p.get("statement_vec")), _unit(self.rows[i].statement_vec)
        if a is None or b is None:
            return _words(p["text"]) == _words(self.rows[i].text)
        return len(a) == len(b) and float(a @ b) >= self.s.statement_similarity

    def match(self, p: dict) -> tuple[int | None, str]:
        key, text = p["slot_key"], p["text"]
        if text and (at := self._first("text", text)) is not None:
            same_key = self._first("both", key, text) if key else None
            return (at if same_key is None else same_key), "updated"
        first = self._first("key", key) if key else None
        if key in self.single_valued and first is not None:
            return first, "updated"
        if first is not None:
            # of rows with the key, by the words one that lacks a vector, and by the vectors those that have one
            if p.get("statement_vec") is None:
                found = self._first("words", key, _words(text))
            else:
                own = sorted({*self._all("words", key, _words(text)), *self.stated.get(key, ())})
                found = next((i for i in own if self.rows[i].slot_key == key and self._same_fact(p, i)), None)
            if found is not None:
                return found, "merged"
        return next(((i, "merged") for i in self._near(_unit(p["embedding"])) if self._same_fact(p, i)), (None, "inserted"))

    def apply(self, p: dict) -> None:
        p = p | {"slot_key": p["slot_key"] or None, "probe": p["probe"] or p["text"]}
        at, action = self.match(p)
        if at is None:
            kept = {k: p.get(k) for k in ("owner_user_id", "slot_key", "text", "probe", "importance", "approved", "embedding", "statement_vec")}
            at = self.add(kept | {"chunk_id": -int(p["prop_id"]), "created_at": self.now})
            self.changed[at] = "inserted"
            return
        row = self.rows[at]
        before = self._marks(row)
        verified = bool(row.approved) and not p["approved"]
        if not verified:
            if p["embedding"] is not None or p["probe"] != row.probe:
                self._embed(at, p["embedding"])
            row.text, row.probe, row.statement_vec = p["text"], p["probe"], p.get("statement_vec")
        if p["slot_key"]:
            row.slot_key = p["slot_key"]
        if self._marks(row) != before or p.get("statement_vec") is not None:
            self._place(at, before)
        row.importance, row.approved = max(row.importance or 0.0, p["importance"]), bool(row.approved or p["approved"])
        self.changed.setdefault(at, action)

    def out(self) -> Iterator[tuple]:
        for at, action in sorted(self.changed.items()):
            yield *(getattr(self.rows[at], x.split()[0]) for x in UPSERTS.split(", ")[:-1]), action


def _packed(v):
    """A vector without missing components as an array, an eighth of the list's bytes."""
    return v if v is None or any(x is None for x in v) else np.asarray(v, np.float32)


def _words(text: str) -> str:
    return " ".join(text.split())


def _unit(v) -> np.ndarray | None:
    """A vector scaled to length 1; null for none or an empty one, zeros stay."""
    if v is None or not len(v):
        return None
    v = np.asarray([0.0 if x is None else x for x in v])
    size = np.linalg.norm(v)
    return v / size if size else v


def upsert_memories(proposals: DataFrame, memory: DataFrame, now: int, s: MemorySettings = MemorySettings(), newest: int = 200, single_valued: Collection[str] = SINGLE_VALUED) -> DataFrame:
    """The rows of ``memory`` that ``proposals`` change or add, with ``action`` (inserted, updated, merged: of the first that did).

    Proposals (prop_id, owner_user_id, ord, slot_key, text, probe, importance, approved, embedding) of an owner apply in order
    and see one another. One updates the owner's active memory with the same text, else, if its slot key is one of
    ``single_valued``, the memory with that key. Otherwise it merges into the first of those with the same key, then of the
    ``newest`` with a vector those whose probe reaches ``merge_similarity``, that states the same fact: by the cosine of
    ``statement_vec`` from ``statement_similarity`` on where both have that column, else by the words. What is left is a new
    memory, its id the negative of prop_id. A change keeps the larger importance, never takes approval back, takes the slot
    key if there is one, and keeps an approved text, probe and vector against a proposal that is not; a vector goes when its
    probe does. Rows without owner take no part.

    An owner's proposals are one task's work, for each sees those before; only memories that they may meet are held, those
    with a text or slot key of theirs and as many of the newest as they can reach.
    """
    vec = "statement_vec"
    with_vec = lambda df: df if vec in df.columns else df.withColumn(vec, F.lit(None).cast("array<float>"))
    fields = ["owner_user_id", "slot_key", "text", "probe", "importance", "approved", "embedding", vec]
    new = with_vec(proposals).filter("owner_user_id is not null and text is not null").select(*fields, "prop_id", "ord")
    old = with_vec(memory).filter("active and owner_user_id is not null").select(*fields, "chunk_id", "created_at")
    owners = new.groupBy("owner_user_id").agg(F.count("*").alias("asked"))
    w = Window.partitionBy("owner_user_id").orderBy(F.desc("created_at"), "chunk_id")
    recent = old.filter("embedding is not null").join(owners, "owner_user_id").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= newest + F.col("asked")).select("chunk_id")
    same = lambda c: old.join(new.select("owner_user_id", c).distinct(), ["owner_user_id", c], "left_semi").select("chunk_id")
    met = old.join(recent.union(same("text")).union(same("slot_key")).distinct(), "chunk_id", "left_semi")
    nothing = F.lit(None).cast("long")
    rows = met.select(F.lit(0).alias("phase"), F.col("created_at").alias("o1"), F.col("chunk_id").alias("o2"), *fields, "chunk_id", "created_at", nothing.alias("prop_id")).unionByName(
        new.select(F.lit(1).alias("phase"), F.col("ord").cast("long").alias("o1"), F.col("prop_id").alias("o2"), *fields, nothing.alias("chunk_id"), nothing.alias("created_at"), "prop_id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.float32()), pa.string()]
        names = [x.split()[0] for x in UPSERTS.split(", ")]
        owner, state = None, None

        def done(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            """An owner's changes in batches, for all of them may be many."""
            while some := list(islice(found, BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for row in (row for begin in range(0, batch.num_rows, BATCH) for row in batch.slice(begin, BATCH).to_pylist()):
                if row["owner_user_id"] != owner:
                    if state is not None:
                        yield from done(state.out())
                    owner, state = row["owner_user_id"], _OwnMemories(s, single_valued, newest, now)
                if row["phase"]:
                    state.apply(row)
                else:
                    state.add(row)
        if state is not None:
            yield from done(state.out())

    return rows.repartition("owner_user_id").sortWithinPartitions("owner_user_id", "phase", "o1", "o2").mapInArrow(run, UPSERTS)


def apply_turn(memory: DataFrame, used: DataFrame, proposals: DataFrame, now: int, s: MemorySettings = MemorySettings()) -> tuple[DataFrame, DataFrame]:
    """(memory after hits, then proposals; tier report of it), in that order."""
    hit = apply_hits(memory, used, now)
    changes = upsert_memories(proposals, hit, now, s)
    fields = ("slot_key", "text", "probe", "importance", "approved", "embedding")
    merged = changes.filter("action <> 'inserted'").select("chunk_id", F.struct(*fields).alias("new"))
    old = hit.join(merged, "chunk_id", "left").withColumns({c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)) for c in fields}).drop("new")
    added = changes.filter("action = 'inserted'").withColumns({"tier": F.lit("hot"), "hits": F.lit(0), "created_at": F.lit(now), "last_hit_at": F.lit(None), "active": F.lit(True)})
    whole = old.unionByName(added.select(*(F.col(c).cast(memory.schema[c].dataType) for c in memory.columns)))
    return whole, evaluate_tiers(whole, now, s)

"""Log-probabilities of texts under a unigram model of subwords: all segmentations of a word, summed over its lattice.

The pieces are those of an existing vocabulary; a piece of rank r among its scores starts with a weight of about 1 / r. A word
is spelled by every sequence of pieces that gives a space and the word's bytes; single bytes are pieces, so each word has one.
Weights follow the training documents by expectation and maximisation over their distinct words: a few rounds over the most
frequent ones, then rounds over all. Pieces never reach beyond a word, so a text's probability is the product of its words'
marginal probabilities and that of its end: a forward recursion in log space for each distinct word, whatever its number of
copies, and one for each very long word where its text is.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import hash_fold
from .storage import KEPT, in_turn, read_table, stored

#: Bytes of a word that is a key of its own, with all its spellings in memory at once. A longer word is counted under its digest,
#: taught in parts of this many bytes and scored by a recursion that holds the last few states only.
WORD_BYTES = 256
#: Words that every task holds at most; all others meet their counts in a join. Distinct words a task counts before it hands them on.
FREQUENT, COUNTED = 1 << 17, 150_000
#: Bytes of the words whose lattices are in memory at once.
BATCH_BYTES = 1 << 17
#: Rounds of learning over the frequent words, then over all.
FIRST_ROUNDS, ROUNDS = 4, 1
#: Weight of the vocabulary's own scores beside the counts, in pieces.
PRIOR_PIECES = 1000.0
#: First bytes of keys that are no words, for no word holds white space: a digest (or, alone, the end of a text), a part of a long word.
END, PART = b" ", b"\t"
LN10 = math.log(10)


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """The pieces that lower-case words can hold, as bytes with a leading space for the start of a word, and their weights by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    score: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in piece[1:] and not any(0x41 <= b <= 0x5A or 9 <= b <= 13 for b in piece):
                score[piece] = max(score.get(piece, -math.inf), model.get_score(i))
    for b in range(256):
        if not (0x41 <= b <= 0x5A or 9 <= b <= 13):
            score.setdefault(bytes([b]), -math.inf)
    names = sorted(score, key=lambda piece: (-score[piece], piece))
    weight = 1.0 / np.arange(2, len(names) + 2)
    return names, weight / weight.sum()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """The trie of the pieces, and the recursions over the lattices of many words at once."""

    def __init__(self, names: list[bytes]):
        self.symbol = np.zeros(256, np.int64)
        used = sorted({b for name in names for b in name})
        self.symbol[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for i, name in enumerate(names):
            node = 0
            for b in name:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][b]
            ends[node] = i
        self.children, self.ends = children, ends
        #: State and symbol to the next state; 0 is none, for no piece leads back to the root.
        self.next = np.zeros((len(children), len(used) + 1), np.int32)
        for node, found in enumerate(children):
            for b, to in found.items():
                self.next[node, self.symbol[b]] = to
        self.piece = np.array(ends, np.int32)

    def _edges(self, units: list[bytes]) -> tuple[np.ndarray, ...]:
        """Of all units, by end within the unit, then by unit: nodes of start and end, piece, and where the ends' groups begin."""
        flat = self.symbol[np.frombuffer(b"".join(units), np.uint8)]
        length = np.fromiter(map(len, units), np.int64, len(units))
        stop = np.cumsum(length)
        unit = np.repeat(np.arange(len(units)), length)
        limit, first = stop[unit], (stop - length)[unit]
        at, state, depth = np.arange(len(flat)), np.zeros(len(flat), np.int32), 0
        starts, depths, pieces = [], [], []
        while len(at):
            state = self.next[state, flat[at + depth]]
            live = state > 0
            at, state, depth = at[live], state[live], depth + 1
            hit = self.piece[state] >= 0
            starts.append(at[hit])
            depths.append(np.full(int(hit.sum()), depth))
            pieces.append(self.piece[state[hit]])
            room = at + depth < limit[at]
            at, state = at[room], state[room]
        start, piece = np.concatenate(starts), np.concatenate(pieces)
        end = start + np.concatenate(depths)
        key = (end - first[start]) * len(units) + unit[start]
        order = np.argsort(key)
        start, end, piece, key = start[order], end[order], piece[order], key[order]
        # a unit has a node more than bytes
        return start + unit[start], end + unit[start], piece, key, stop - length + np.arange(len(units)), stop + np.arange(len(units))

    def _forward(self, edges: tuple[np.ndarray, ...], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log of the weight of all ways to each node; and the edges' bounds by their end within the unit."""
        start, end, piece, key, first, last = edges
        n = len(first)
        group = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        rel = key[group] // n
        step = np.searchsorted(rel, np.arange(1, int(rel[-1]) + 2))  # groups of each end
        group = np.r_[group, len(key)]
        alpha = np.full(int(last[-1]) + 1, -math.inf)
        alpha[first] = 0
        for a, b in zip(step[:-1].tolist(), step[1:].tolist(), strict=True):
            low, high = group[a], group[b]
            value = alpha[start[low:high]] + logs[piece[low:high]]
            inner = group[a:b] - low
            most = np.maximum.reduceat(value, inner)
            total = np.add.reduceat(np.exp(value - np.repeat(most, np.diff(group[a : b + 1]))), inner)
            alpha[end[group[a:b]]] = most + np.log(total)
        return alpha, step, group

    def scores(self, units: list[bytes], logs: np.ndarray) -> np.ndarray:
        """Natural logarithm of the marginal probability of each unit."""
        out = [np.zeros(0)]
        for some in in_batches(units):
            edges = self._edges(some)
            out.append(self._forward(edges, logs)[0][edges[-1]])
        return np.concatenate(out)

    def expected(self, units: list[bytes], counts: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """How often each piece is used, weighted by the segmentations' probabilities and the units' counts."""
        total, at = np.zeros(len(logs)), 0
        for some in in_batches(units):
            edges = self._edges(some)
            start, end, piece, _, first, last = edges
            alpha, step, group = self._forward(edges, logs)
            flow, used = np.zeros(len(alpha)), np.zeros(len(start))
            flow[last] = counts[at : at + len(some)]
            for a, b in zip(step[-2::-1].tolist(), step[:0:-1].tolist(), strict=True):
                part = slice(group[a], group[b])
                from_, to = start[part], end[part]
                used[part] = flow[to] * np.exp(alpha[from_] + logs[piece[part]] - alpha[to])
                flow[from_] += used[part]  # edges of one end within a unit differ in their start
            total += np.bincount(piece, used, len(logs))
            at += len(some)
        return total

    def score_long(self, unit: bytes, logs: np.ndarray) -> float:
        """As ``scores``, of one unit of any length: weights of the next few nodes only, with what they are scaled by kept as a logarithm."""
        weight, children, ends = np.exp(logs).tolist(), self.children, self.ends
        deep = max(len(unit) and self.depth, 1)
        ahead, scale, n = [0.0] * (deep + 1), 0.0, len(unit)
        ahead[0] = 1.0
        for i in range(n):
            mass, node = ahead[0], 0
            for j in range(i, min(i + deep, n)):
                node = children[node].get(unit[j], -1)
                if node < 0:
                    break
                if ends[node] >= 0:
                    ahead[j + 1 - i] += mass * weight[ends[node]]
            del ahead[0]
            ahead.append(0.0)
            most = max(ahead)
            if most < 1e-100:
                ahead = [x / most for x in ahead]
                scale += math.log(most)
        return scale + math.log(ahead[0])

    @property
    def depth(self) -> int:
        """Bytes of the longest piece."""
        if not hasattr(self, "_depth"):
            level, self._depth = [0], -1
            while level:
                level, self._depth = [to for node in level for to in self.children[node].values()], self._depth + 1
        return self._depth


def in_batches(units: list[bytes]) -> Iterator[list[bytes]]:
    """Consecutive units of about BATCH_BYTES bytes."""
    a = size = 0
    for b, unit in enumerate(units):
        size += len(unit)
        if size >= BATCH_BYTES:
            yield units[a : b + 1]
            a, size = b + 1, 0
    if a < len(units):
        yield units[a:]


_LATTICE: dict[int, Lattice] = {}
KEPT["lattice"] = _LATTICE.clear


def _lattice(names: list[bytes]) -> Lattice:
    """A worker builds the trie once."""
    key = hash(tuple(names))
    if key not in _LATTICE:
        _LATTICE.clear()
        _LATTICE[key] = Lattice(names)
    return _LATTICE[key]


def words_of(text: bytes | None) -> tuple[list[bytes], list[bytes]]:
    """The words of a text with A-Z lower-cased, very long ones as the key of their digest; and those long words."""
    words = (text or b"").lower().split()  # of bytes: exactly these six kinds of white space, exactly A-Z
    if max(map(len, words), default=0) <= WORD_BYTES:
        return words, []
    long = [w for w in words if len(w) > WORD_BYTES]
    return [w if len(w) <= WORD_BYTES else END + hashlib.sha256(w).digest() for w in words], long


COUNTS = "key binary, c long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    taught, other = Counter(), Counter()

    def handed_on() -> pa.RecordBatch:
        keys = list(taught | other)
        c = pa.array([taught[k] for k in keys], pa.int64())
        n = pa.array([taught[k] + other[k] for k in keys], pa.int64())
        taught.clear()
        other.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), c, n], ["key", "c", "n"])

    for batch in batches:
        for text, held_out in zip(batch.column("text"), batch.column("held_out").to_pylist(), strict=True):
            words, long = words_of(text.as_py())
            here = other if held_out else taught
            here.update(words)
            here[END] += 1
            if long and not held_out:
                for word in long:
                    here.update(PART + word[a : a + WORD_BYTES] for a in range(0, len(word), WORD_BYTES))
            if len(taught) + len(other) > COUNTED:
                yield handed_on()
    if taught or other:
        yield handed_on()


def count_words(docs: DataFrame) -> DataFrame:
    """key, c (in documents that teach), n (in all): of every word, of END for the ends, and, under PART, of the parts of long words."""
    found = docs.mapInArrow(in_turn("counts", _count), COUNTS)
    return stored(found.groupBy("key").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "word-counts")


def _units(keys: list[bytes]) -> list[bytes]:
    return [k[1:] if k[:1] == PART else b" " + k for k in keys]


def _gather(shared):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = shared.value
        lattice, total = _lattice(names), np.zeros(len(names))
        for batch in batches:
            total += lattice.expected(_units(batch.column("key").to_pylist()), np.asarray(batch.column("c"), float), logs)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "used"])

    return gather


def learn_round(counts: DataFrame, names: list[bytes], prior: np.ndarray, logs: np.ndarray, ends: int) -> np.ndarray:
    """New log weights: expected counts of pieces over the words of ``counts``, a row for each piece at the driver, with the prior beside them.

    The ends of texts are a piece of their own, which takes its share of the weight and is not among the pieces returned.
    """
    shared = counts.sparkSession.sparkContext.broadcast((names, logs))
    rows = counts.select("key", "c").mapInArrow(in_turn("lattice", _gather(shared)), "piece int, used double").groupBy("piece").agg(F.sum("used").alias("used")).collect()
    total = PRIOR_PIECES * prior
    for row in rows:
        total[row["piece"]] += row["used"]
    return np.log(total / (total.sum() + ends + 1))


def frequent_bound(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` keys have it, from a table of powers of 2 ** (1 / 16)."""
    step = F.ceil(F.log2("n") * 16).cast("int")
    left, bound = most, None
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("keys"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():  # 16 rows for a doubling of counts at most
        left -= row["keys"]
        if left < 0:
            break
        bound = row["n"]
    return (1 << 62) if bound is None else bound


def _score_keys(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = shared.value
        lattice = _lattice(names)
        for batch in batches:
            keys = batch.column("key").to_pylist()
            log10 = lattice.scores([b" " if k[:1] == END else b" " + k for k in keys], logs) / LN10
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("c"), batch.column("n"), pa.array([None if k[:1] == END else x for k, x in zip(keys, log10.tolist(), strict=True)], pa.float64())], ["key", "c", "n", "p"])

    return score


MARKS = "uid long, doc_id {id}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<key: binary, times: long>>"


def _mark(frequent, model, schema: pa.Schema):
    """What the frequent words and the long ones add to a text's sums, and its other words."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (names, logs) = frequent.value, model.value
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text in batch.column("text"):
                words, long = words_of(text.as_py())
                n = base = score = 0
                rare = []
                for word, times in Counter(words).items():
                    if (found := known.get(word)) is None:
                        rare.append({"key": word, "times": times})
                    else:
                        n += times * found[0]
                        base += times * found[1]
                        score += times * found[2]
                for word in long:
                    score += _lattice(names).score_long(b" " + word, logs) / LN10
                end = known[END]
                for column, x in zip(out, (len(words) + 1, n + end[0], base + end[1], score + end[2], rare), strict=True):
                    column.append(x)
            arrays = [batch.column(c) for c in ("uid", "doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=False)] + [pa.array(c, f.type) for c, f in zip(out, list(schema)[3:], strict=True)], schema=schema)

    return mark


def score_documents(docs: DataFrame, held_out: Column, vocabulary: str | None = None, first_rounds: int = FIRST_ROUNDS, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of ``docs``, log10 of its whole text's probability.

    ``held_out`` rows teach nothing. A text without words, empty or null, is its end alone. Repeated rows teach and are scored each,
    other columns of ``docs`` are ignored, and an empty table gives an empty one. With no row that teaches, the base score is 0 and the
    weights are the vocabulary's own. Words of any length are scored whole.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"), held_out.alias("held_out"))
    counts = count_words(docs.select("text", "held_out"))
    names, prior = read_pieces(vocabulary or default_vocabulary())
    is_part, is_end = F.substring("key", 1, 1) == F.lit(PART), F.col("key") == F.lit(END)
    tokens = ~is_part & (F.col("c") > 0)
    total, kinds, ends = counts.agg(F.sum(F.when(tokens, F.col("c"))), F.count(F.when(tokens, 1)), F.sum(F.when(is_end, F.col("c")))).first()
    total, ends = total or 0, ends or 0
    taught = counts.filter((F.col("c") > 0) & (F.substring("key", 1, 1) != F.lit(END)))
    bound = frequent_bound(counts.filter(~is_part), frequent - 1)
    logs = np.log(prior)
    for _ in range(first_rounds):
        logs = learn_round(taught.filter(~is_part & (F.col("n") >= bound)), names, prior, logs, ends)
    for _ in range(rounds):
        logs = learn_round(taught, names, prior, logs, ends)
    # the weight that the pieces leave is the end's: at least one share of the total
    end_log10 = math.log10(max(-math.expm1(float(np.logaddexp.reduce(logs))), 1e-300)) if first_rounds + rounds else 0.0
    model = spark.sparkContext.broadcast((names, logs))
    scored = stored(counts.filter(~is_part).mapInArrow(in_turn("lattice", _score_keys(model)), COUNTS + ", p double"), "word-scores")
    # a long word's own score is found where its text is; here it adds its count only
    p = F.when(is_end, F.lit(end_log10)).otherwise(F.coalesce("p", F.lit(0.0)))
    known = scored.select("key", "n", (F.col("c") > 0).cast("long").alias("known"), F.log10((F.col("c") + 1) / F.lit(float(total + kinds + 1))).alias("base"), p.alias("p"))
    held = {bytes(r["key"]): (r["known"], r["base"], r["p"]) for r in known.filter((F.col("n") >= bound) | is_end).collect()}  # `frequent` rows at most
    schema = MARKS.format(id=docs.schema["doc_id"].dataType.simpleString())
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    marked = docs.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(in_turn("lattice", _mark(spark.sparkContext.broadcast(held), model, arrow)), schema)
    marked = stored(marked, "marked")
    rare = marked.select("uid", F.explode("rare").alias("word")).select("uid", F.col("word.key").alias("key"), F.col("word.times").alias("times"))
    rare = rare.join(known.filter(F.col("n") < bound), "key").select("uid", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"), (F.col("times") * F.col("known")).alias("n_known"), (F.col("times") * F.col("base")).alias("base_score"), (F.col("times") * F.col("p")).alias("score"))
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    both = marked.drop("rare").unionByName(rare).groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *sums)
    return both.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op11_subword_lattice(spark, sf_dir) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), hash_fold(7, 2))


QUERIES = {"op11_subword_lattice": op11_subword_lattice}
ORACLE_SQL: dict[str, str] = {}

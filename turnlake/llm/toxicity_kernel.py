"""Toxicity: a gapped subsequence string kernel, Nyström landmarks and a linear SVM, trained on labelled sentences.

The kernel of two words sums, over all subsequences of three symbols that span at most ``SPAN`` steps in both, the product of
``DECAY`` to the spans, and is scaled by the roots of both words' kernels with themselves. A boundary symbol stands before and
after a word; all other symbols are code points. What is no letter is passed over, and single letters in a row are one word,
so ``i.d.i.o.t``, ``i d i o t`` and ``idxiot`` all stay near ``idiot``. The Nyström map sends a word to its kernel values with
the landmarks, whitened; a weight vector there is one weight per subsequence of the landmarks, which is how words are scored.

A sentence is a bag of words that is as toxic as its worst, and so is a document of its sentences. Of each toxic document the
worst sentence counts as toxic, by its worst word; sentences of clean documents are clean in every word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality_rules import hash_fold
from .rolling import mix
from .storage import KEPT, in_turn, read_table, stored

SPAN, DECAY = 5, 0.8
LANDMARKS = 96
#: Labelled documents that are learnt from at most, those with the least hash of doc_id.
MAX_TOXIC, MAX_CLEAN = 4_000, 8_000
#: Landmarks are the words of the strongest association with toxic labels; a sentence's worst word is first guessed by four times as many.
GUESSES = 4 * LANDMARKS
#: Of the clean ones, those whose words, all of them, the kernel machine learns from: again those with the least hash.
WORD_ROWS = 250
THRESHOLD = 0.3
#: Characters handled at once. Scores that a worker remembers.
SLICE, REMEMBERED = 1 << 20, 200_000
#: Letters of a word beyond which it is scored part by part, and is no landmark nor learnt from; letters of a part; different
#: subsequences of such a word that are held at once.
LONG, PART, HELD = 64, 1 << 16, 1 << 22

BOUNDARY, DROPPED = 0, 0xFFFFFFFF
#: Bytes of a symbol.
WIDE = 4


def _symbol_table() -> np.ndarray:
    """Code point to symbol: letters are themselves, look-alike digits letters, white space a boundary, all else dropped."""
    every = np.arange(0x110000, dtype=np.uint32)
    letters = every.view("U1")
    codes = np.where(np.strings.isalpha(letters), every, np.where(np.strings.isspace(letters), np.uint32(BOUNDARY), np.uint32(DROPPED)))
    for digit, letter in zip("013457@", "oieasta", strict=True):
        codes[ord(digit)] = ord(letter)
    return codes


_TABLE: list[np.ndarray] = []
KEPT["words"] = _TABLE.clear


def _lower(text: str) -> str:
    """Lower case, each letter by itself: the one that has a form for the end of a word takes the other."""
    return text.lower().replace("ς", "σ")


def _codes(text: str) -> np.ndarray:
    """Symbols of a text, without what is dropped; a long one is mapped a slice at a time."""
    if not _TABLE:
        _TABLE.append(_symbol_table())
    out, at = [], 0
    while True:
        end = min(at + SLICE, len(text))
        codes = _TABLE[0][np.frombuffer(_lower(text[at:end]).encode("utf-32-le", "surrogatepass"), "<u4")]
        out.append(codes[codes != DROPPED])
        at = end
        if at >= len(text):
            return out[0] if len(out) == 1 else np.concatenate(out)


def symbols_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, starts, owner): all words of ``texts`` with a boundary before each and one at the end; a word's start is the
    boundary before it, its owner the index of its text. Empty words are left in (their owner's scores ignore them)."""
    marked = [f" \n{t}" for t in texts]
    if sum(map(len, marked)) <= 2 * SLICE:
        if not _TABLE:
            _TABLE.append(_symbol_table())
        lowered = [_lower(t) for t in marked]
        codes = _TABLE[0][np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")]
        kept = codes != DROPPED
        codes, text_of = codes[kept], np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])[kept]
    else:
        each = [_codes(t) for t in marked]
        codes, text_of = np.concatenate(each) if len(each) > 1 else each[0], np.repeat(np.arange(len(texts), dtype=np.int32), list(map(len, each)))
    at = np.flatnonzero(codes == BOUNDARY)
    single = np.diff(at, append=len(codes)) == 2
    joined = at[1:][single[1:] & single[:-1]]  # a boundary between two words of one letter
    if len(joined):
        keep = np.ones(len(codes), bool)
        keep[joined] = False
        codes, text_of = codes[keep], text_of[keep]
        at = np.flatnonzero(codes == BOUNDARY)
    owner = text_of[at]
    return np.append(codes, np.uint32(BOUNDARY)), at, owner


def words_of(codes: np.ndarray, starts: np.ndarray, which: np.ndarray | None = None) -> list[bytes]:
    """The words as the bytes of their symbols, empty ones too; or those ``which`` chooses."""
    ends = np.append(starts[1:], len(codes) - 1)
    if which is not None:
        starts, ends = starts[which], ends[which]
    if not len(starts):
        return []
    raw = codes.tobytes() if len(codes) <= 4 * SLICE else memoryview(codes).cast("B")
    return [bytes(raw[a:b]) for a, b in zip(((starts + 1) * WIDE).tolist(), (ends * WIDE).tolist(), strict=True)]


def lengths_of(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Letters of each word."""
    return np.diff(starts, append=len(codes) - 1) - 1


def word_bytes(word: str) -> bytes:
    return word.encode("utf-32-le", "surrogatepass")


def subsequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, value) of every occurrence of three symbols of a word, boundaries added, that span at most SPAN steps: DECAY**span."""
    nothing = bytes(WIDE)
    c = np.frombuffer(nothing + nothing.join(words) + nothing, "<u4").astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(w) // WIDE + 1 for w in words])])
    owner = np.repeat(np.arange(len(words)), np.diff(starts))
    first, second, third = (c * np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    boundary, blocked = c == BOUNDARY, np.zeros(len(c), bool)
    found = ([], [], [])
    for span in range(2, SPAN + 1):
        m = len(c) - span
        if m <= 0:
            break
        blocked[: len(c) - span + 1] |= boundary[span - 1 :]
        at = np.flatnonzero(~blocked[:m])
        for middle in range(1, span):
            key = (first[at] + second[at + middle]) ^ third[at + span]
            found[0].append(owner[at])
            found[1].append(mix(key + second[at + span]))
            found[2].append(np.full(len(at), DECAY**span))
    return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(found, (np.int64, np.uint64, float), strict=True))


def triples(c: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(subsequence, value) as ``subsequences`` gives them, of those that begin in the first ``stop`` symbols of one part of a word."""
    c = c.astype(np.uint64)
    first, second, third = (c * np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    found = ([], [])
    for span in range(2, SPAN + 1):
        m = min(stop, len(c) - span)
        for middle in range(1, span) if m > 0 else ():
            found[0].append(mix(((first[:m] + second[middle : middle + m]) ^ third[span : span + m]) + second[span : span + m]))
            found[1].append(np.full(m, DECAY**span))
    return (np.concatenate(found[0]), np.concatenate(found[1])) if found[0] else (np.zeros(0, np.uint64), np.zeros(0))


def _parts(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``triples`` of a word with its boundaries, PART symbols at a time; a part reaches as far beyond as a subsequence does."""
    for a in range(0, len(c), PART):
        yield triples(c[a : a + PART + SPAN], PART)


def long_norm(c: np.ndarray) -> float:
    """``norms`` of one word of any length. Its subsequences' values are summed by shares of a hash if they are too many to hold."""
    shares = 1
    while True:
        square = 0.0
        for share in range(shares):
            known, sums = np.zeros(0, np.uint64), np.zeros(0)
            for key, value in _parts(c):
                if shares > 1:
                    own = key % np.uint64(shares) == share
                    key, value = key[own], value[own]
                known, place = np.unique(np.concatenate([known, key]), return_inverse=True)
                sums = np.bincount(place, np.concatenate([sums, value]), len(known))
                if len(known) > HELD:
                    break
            if len(known) > HELD:
                break
            square += float(sums @ sums)
        else:
            return math.sqrt(square) if square > 0 else 1.0
        shares *= 4


def norms(n: int, word: np.ndarray, key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The root of the kernel of each of ``n`` words with itself."""
    square = np.bincount(word, value * value, n)
    own = mix(key + word.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))  # a word and a subsequence of it
    slot = (own >> np.uint64(44)).astype(np.int64)
    at = np.flatnonzero((np.bincount(slot, minlength=1 << 20) > 1)[slot])  # all that a word has more than once, and a few others
    if len(at):  # their values add up before the square
        order = np.argsort(own[at])
        at, edge = at[order], np.flatnonzero(np.diff(own[at[order]], prepend=own[at[order[0]]] + np.uint64(1)))
        square += np.bincount(word[at[edge]], np.add.reduceat(value[at], edge) ** 2, n) - np.bincount(word[at], value[at] ** 2, n)
    return np.sqrt(np.where(square > 0, square, 1.0))


@dataclass(frozen=True)
class Weights:
    """A weight for each of some subsequences (sorted), 0 for all others."""

    key: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(words: list[bytes], factors: np.ndarray) -> Weights:
        """Those of the sum of normalised kernels with ``words``, each times its factor."""
        word, key, value = subsequences(words)
        value = value * (factors / norms(len(words), word, key, value))[word]
        known, place = np.unique(key, return_inverse=True)
        return Weights(known, np.bincount(place, value, len(known)))

    @cached_property
    def likely(self) -> np.ndarray:
        out = np.zeros(1 << 18, bool)
        out[(self.key & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        return out

    def values(self, words: list[bytes]) -> np.ndarray:
        """The weighted sum of each word's subsequences, by the root of its kernel with itself."""
        word, key, value = subsequences(words)
        return self.sums(len(words), word, key, value) / norms(len(words), word, key, value)

    def sums(self, n: int, word: np.ndarray, key: np.ndarray, value: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.likely[(key & np.uint64((1 << 18) - 1)).astype(np.int64)]) if len(self.key) else np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.key, key[at]), max(len(self.key) - 1, 0))
        at, place = (x[self.key[place] == key[at]] for x in (at, place)) if len(at) else (at, place)
        return np.bincount(word[at], value[at] * self.weight[place], n)


@dataclass(frozen=True)
class ToxicityModel:
    """``weights`` and ``bias`` score words; ``link`` maps a document's (best, second best, log words above 0, log words) to a score."""

    weights: Weights
    bias: float
    link: np.ndarray

    @cached_property
    def known(self) -> dict[bytes, float]:
        return {}

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Scores of words of up to LONG letters, each different one computed once and remembered for a while."""
        known = self.known
        new = [w for w in set(words) if w not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(set(words))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            known.update(zip(part, (self.weights.values(part) + self.bias).tolist(), strict=True))
        return np.array([known[w] for w in words]) if words else np.zeros(0)

    def long_score(self, c: np.ndarray) -> float:
        """The same of one word of any length, given as symbols with a boundary at either end, in bounded memory."""
        total = sum(float(self.weights.sums(1, np.zeros(len(key), np.int64), key, value)[0]) for key, value in _parts(c))
        return total / long_norm(c) + self.bias

    def scores_of(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of all words of ``symbols_of``; 0 for empty ones."""
        size, out = lengths_of(codes, starts), np.zeros(len(starts))
        short = (size > 0) & (size <= LONG)
        out[short] = self.word_scores(words_of(codes, starts, short))
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = self.long_score(codes[starts[i] : starts[i] + size[i] + 2])
        return out

    def document_score(self, facts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(facts @ self.link[1:] + self.link[0], -30, 30)))


#: White space between two words of several letters.
BETWEEN = re.compile(r"(?<=[^\W\d_]{2})\s(?=[^\W\d_]{2})")


def _slices(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in groups of about SLICE characters; parts of a long one keep its index. It is cut between words that stand apart however
    the rest is cut; a part without such a place, as one long word, stays whole."""
    owners, parts, size = [], [], 0
    for i, text in enumerate(texts):
        at, text = 0, text or ""
        while True:
            space = BETWEEN.search(text, at + SLICE) if len(text) - at > SLICE else None
            end = space.start() if space else len(text)
            owners.append(i)
            parts.append(text[at:end])
            size += end - at
            at = end
            if size >= SLICE:
                yield owners, parts
                owners, parts, size = [], [], 0
            if at >= len(text):
                break
    if parts:
        yield owners, parts


def document_facts(texts: list[str | None], model: ToxicityModel) -> np.ndarray:
    """Per text: the best and second best word score (-1 where there is none), log of words above 0, log of words."""
    best, second = np.full(len(texts), -1.0), np.full(len(texts), -1.0)
    above, words = np.zeros(len(texts)), np.zeros(len(texts))
    for owners, parts in _slices(texts):
        codes, starts, owner = symbols_of(parts)
        full = lengths_of(codes, starts) > 0
        scores, owner = model.scores_of(codes, starts)[full], np.asarray(owners)[owner[full]]
        if not len(scores):
            continue
        np.add.at(above, owner[scores > 0], 1)
        words += np.bincount(owner, minlength=len(texts))
        edge = np.flatnonzero(np.diff(owner, prepend=-1))
        top, who = np.maximum.reduceat(scores, edge), owner[edge]
        at_top = np.repeat(top, np.diff(edge, append=len(owner))) == scores
        again = np.add.reduceat(at_top.astype(np.int32), edge) > 1
        next_top = np.where(again, top, np.maximum.reduceat(np.where(at_top, -1.0, scores), edge))
        second[who] = np.maximum(np.maximum(second[who], next_top), np.minimum(best[who], top))
        best[who] = np.maximum(best[who], top)
    return np.stack([best, second, np.log1p(above), np.log1p(words)], axis=1).astype(np.float64)


def _short_words(text: str | None) -> set[bytes]:
    codes, starts, _ = symbols_of([text or ""])
    size = lengths_of(codes, starts)
    return set(words_of(codes, starts, (size > 0) & (size <= LONG)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, documents with it), summed over each batch."""
    for batch in batches:
        found: Counter = Counter()
        for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text"), strict=True):
            for word in _short_words(text.as_py()):
                found[word, label] += 1
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(found.values()), pa.int64())], ["word", "toxic", "n"])


SENTENCE_END = re.compile(r"[.!?\n]+\s")


def _worst_words(scores: dict[bytes, float] | None, model: ToxicityModel | None):
    """(word) of the worst sentence of each document: by ``scores``, else by ``model``."""

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sentences, owner = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                parts = SENTENCE_END.split(text or "")
                sentences += parts
                owner += [i] * len(parts)
            codes, starts, whose = symbols_of(sentences)
            size = lengths_of(codes, starts)
            short = (size > 0) & (size <= LONG)
            words = [(owner[k], w) for k, w in zip(whose[short].tolist(), words_of(codes, starts, short), strict=True)]
            values = [scores.get(w, 0.0) for _, w in words] if scores is not None else model.word_scores([w for _, w in words]).tolist()
            best: dict[int, tuple[float, bytes]] = {}
            for (i, w), value in zip(words, values, strict=True):
                if value > best.get(i, (0.0,))[0]:
                    best[i] = value, w
            yield pa.RecordBatch.from_arrays([pa.array([w for _, w in best.values()], pa.binary())], ["word"])

    return worst


def _document_facts(model: ToxicityModel):
    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = document_facts(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), *(pa.array(x) for x in found.T)], ["toxic", "a", "b", "c", "d"])

    return facts


def _hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30, cost: float = 1.0) -> np.ndarray:
    """Linear SVM by dual coordinate descent; the last column of ``x`` is the bias."""
    rng, alpha, w = np.random.default_rng(11), np.zeros(len(y)), np.zeros(x.shape[1])
    square, bound = (x * x).sum(1) + 1e-9, cost * weight
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), bound[i])
            if new != alpha[i]:
                moved = max(moved, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method; the intercept comes first."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _kernel(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Normalised kernel of every word with every landmark."""
    found = subsequences(words)
    size = norms(len(words), *found)
    return np.stack([Weights.of([mark], np.ones(1)).sums(len(words), *found) / size for mark in landmarks], axis=1)


def _fit_words(landmarks: list[bytes], positive: Counter, negative: list[bytes]) -> tuple[Weights, float]:
    """Weights per subsequence and bias of the SVM in the landmarks' Nyström space."""
    words = [*positive, *negative]
    values, vectors = np.linalg.eigh(_kernel(landmarks, landmarks))
    whitening = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    x = np.column_stack([_kernel(words, landmarks) @ whitening, np.ones(len(words))])
    y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
    weight = np.concatenate([np.minimum(np.array(list(positive.values()), float), 20.0), np.ones(len(negative))])
    w = _hinge(x, y, weight)
    return Weights.of(landmarks, whitening @ w[:-1]), float(w[-1])


def fit_toxicity(train: DataFrame, word_rows: int = WORD_ROWS, landmarks: int = LANDMARKS, guesses: int = GUESSES) -> ToxicityModel:
    """Fit on ``train`` (toxic 0/1, text), which the caller has bounded.

    Word counts by label choose ``landmarks`` landmarks. Worst sentences of toxic documents are chosen first by the ``guesses``
    words of the strongest association, then once more by the SVM itself; clean words are all those of the ``word_rows`` clean rows of the least hash. Only words of up to
    LONG letters are landmarks or learnt from. A logistic link over a document's worst words gives the score.
    """
    classes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = classes.get(1, 0), classes.get(0, 0)
    nothing = Weights(np.zeros(0, np.uint64), np.zeros(0))
    share = (n_toxic + 1) / (n_toxic + n_clean + 2)
    constant = ToxicityModel(nothing, 0.0, np.array([math.log(share / (1 - share)), 0, 0, 0, 0]))
    if not n_toxic or not n_clean:
        return constant
    counts = train.mapInArrow(in_turn("words", _count_words), "word binary, toxic int, n long").groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("neg"))
    counts = stored(counts, "toxic-words")
    expected = (F.col("pos") + F.col("neg")) * (n_toxic / (n_toxic + n_clean))
    strength = (F.col("pos") - expected) / F.sqrt(expected + 1)
    least = min(3, n_toxic)
    top = counts.filter((F.col("pos") >= least) & (F.col("pos") * n_clean > 2 * F.col("neg") * n_toxic)).select("word", strength.alias("s")).orderBy(F.desc("s"), "word").limit(guesses).collect()
    if not top:
        return constant
    association = {bytes(r["word"]): float(r["s"]) for r in top}
    marks = [bytes(r["word"]) for r in top[:landmarks]]
    taught = train.filter("toxic = 0").orderBy(F.xxhash64("text", F.lit(5)), "text").limit(word_rows)
    negative = {bytes(r["word"]) for r in taught.mapInArrow(in_turn("words", _count_words), "word binary, toxic int, n long").select("word").distinct().collect()}
    toxic = train.filter("toxic = 1")
    model, scores = None, association
    for _ in range(2):
        found = toxic.select("text").mapInArrow(in_turn("words", _worst_words(scores, model)), "word binary").groupBy("word").count().collect()
        positive = Counter({bytes(r["word"]): r["count"] for r in found})
        if not positive:
            break
        weights, bias = _fit_words(marks, Counter(dict(sorted(positive.items()))), sorted(negative - set(positive)))
        model, scores = ToxicityModel(weights, bias, np.zeros(5)), None
    if model is None:
        return constant
    facts = train.mapInArrow(in_turn("words", _document_facts(model)), "toxic int, a double, b double, c double, d double").toPandas().to_numpy(np.float64)
    facts = facts[np.lexsort(facts.T)]  # one order on any cluster
    return ToxicityModel(model.weights, model.bias, _logistic(facts[:, 1:], facts[:, 0]))


def _scorer(model: ToxicityModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.document_score(document_facts(batch.column("scored_text").to_pylist(), model))
            kept = [i for i, name in enumerate(batch.schema.names) if name != "scored_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(scores)], [*(batch.schema.names[i] for i in kept), "score"])

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, word_rows: int = WORD_ROWS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) by what ``labels`` (doc_id, toxic) of rows not ``held_out`` teach.

    ``held_out`` is a condition on doc_id. Rows with a null label or doc_id teach nothing. Returns the columns ``keep``,
    held_out, score (0 to 1), predicted (score >= 0.3). A null text scores as an empty one; without labels of both classes
    every score is the smoothed share of toxic labels. The model learns from at most ``max_toxic`` toxic and ``max_clean`` clean
    labelled documents, those of the least hash of doc_id, its kernel machine from all words of ``word_rows`` of the clean ones;
    they are joined by broadcast, their number being the bound. Of rows that repeat a doc_id the least text by hash is learnt from.
    """
    known = labels.filter(~held_out & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = (F.xxhash64("doc_id", F.lit(3)), F.col("doc_id"))
    taught = known.filter("toxic = 1").orderBy(*order).limit(max_toxic).union(known.filter("toxic = 0").orderBy(*order).limit(max_clean))
    once = docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    model = fit_toxicity(stored(once.select("toxic", "text"), "toxic-train"), word_rows)
    rows = docs.select(*keep, held_out.alias("held_out"), F.col("text").alias("scored_text"))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "scored_text"), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(in_turn("words", _scorer(model)), schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op3_toxicity_kernel(spark, sf_dir) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), hash_fold(4, 2))


QUERIES = {"op3_toxicity_kernel": op3_toxicity_kernel}
ORACLE_SQL: dict[str, str] = {}

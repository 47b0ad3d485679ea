"""op8 against every window of every text."""

import random
import re
from collections import Counter

import numpy as np

from turnlake.llm import simhash_windows as S


def words_of(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())


def grams(words):
    return Counter([tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else [])


def brute(docs, items):
    out = []
    for doc, text in docs:
        words = words_of(text)
        for item, passage in set(items):
            target = words_of(passage)
            if item is None or not target:
                continue
            best = (0.0, 0)
            for i in range(len(words) - len(target) + 1):
                a, b = grams(words[i : i + len(target)]), grams(target)
                both = sum((a & b).values())
                best = max(best, (both / sum((a | b).values()), -i))
            if best[0] >= 0.75:
                out.append((str(doc), item, round(best[0], 9), -best[1], len(target)))
    return sorted(out)


def data():
    rng = random.Random(3)
    text = lambda n: [rng.choice("the of and wörd alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate((14, 20, 36, 36, 59, 5, 6))] + [(7, "two words"), (8, ""), (9, None), (None, "null id words here now"), (10, "la la la la la la la la la la")]
    items.append(items[2])
    docs = [(0, None), (1, ""), (2, "two words"), (3, "some Two, Words here"), (4, " ".join(text(200)))]
    for k in range(30):
        item = items[k % 7][1].split()
        for _ in range(k // 7):
            at = rng.randrange(len(item))
            rng.choice((lambda: item.__setitem__(at, "changed"), lambda: item.insert(at, "more"), lambda: len(item) > 1 and item.pop(at)))()
        docs.append((10 + k, " ".join(text(rng.randrange(60)) + item + text(rng.randrange(60))).upper().replace(" ", ", ", k)))
    docs += [(50, "la " * 40), (50, "la " * 40), (None, items[0][1])]
    return docs, items


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((str(r.doc_id), r.item_id, round(r.similarity, 9), r.first_word, r.n_words) for r in S.contaminated(d, b).collect())


def test_against_every_window(spark):
    docs, items = data()
    assert run(spark, docs, items) == brute(docs, items)


def test_passes_of_items(spark, monkeypatch):
    docs, items = data()
    monkeypatch.setattr(S, "PASS_WORDS", 60)
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = data()
    assert run(spark, docs, []) == [] and run(spark, [], items) == []


def test_texts_shorter_than_an_item_are_one_window(spark):
    items = data()[1]
    words = items[2][1].split()
    docs = [(1, " ".join(words[1:])), (2, " ".join(words[:-2])), (3, " ".join(words[3:-1])), (4, " ".join(words[:27])), (5, " ".join(words[:20])), (6, " ".join(words[:4])), (7, "two"), (8, "la la la la la la la la la")]
    want = []
    for doc, text in docs:
        a = grams(words_of(text))
        for item, passage in set(items):
            b = grams(words_of(passage))
            if item is not None and b and len(words_of(text)) < len(words_of(passage)):
                similarity = sum((a & b).values()) / sum((a | b).values())
                if similarity >= 0.75:
                    want.append((str(doc), item, round(similarity, 9), 0, len(words_of(text))))
    short = [r for r in run(spark, docs, items) if r[4] < len(words_of(next(t for i, t in items if i == r[1])))]
    assert short == sorted(want) and {r[0] for r in short} >= {"1", "2", "3", "8"}


def of_words(*texts):
    words, counts = S.word_hashes([t.encode() for t in texts], S.BY_PUNCTUATION)
    values, before = S.shingles(words, counts, S.WORDS)
    return [(words[a:b], values[c:d]) for a, b, c, d in zip(counts[:-1], counts[1:], before[:-1], before[1:], strict=True)]


def items_of(texts):
    found = of_words(*texts)
    pairs = [np.unique(v, return_counts=True) for _, v in found]
    return S.Items(np.arange(len(texts)), np.array([len(w) for w, _ in found]), np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]).astype(np.int32), np.cumsum([0, *(len(p[0]) for p in pairs)]))


def test_sliding_windows_are_windows():
    rng = np.random.default_rng(4)
    for n, width, kinds in ((1, 1, 5), (9, 9, 2), (60, 7, 3), (300, 40, 9), (5000, 30, 4000)):
        values = rng.integers(1, 1 << 60, kinds, dtype=np.uint64)[rng.integers(0, kinds, n)]
        item = values[: width // 2 + 1]
        shingle, count = np.unique(item, return_counts=True)
        window = S.Window(values, width)
        prints, shared = window.prints(), window.shared(shingle, count)
        for i in {0, (n - width) // 3, (n - width) // 2, n - width}:
            alone = values[i : i + width]
            assert (S.Window(np.sort(alone), width).prints()[0] == prints[i]).all()  # order does not count
            assert shared[i] == sum((Counter(alone.tolist()) & Counter(item.tolist())).values())


def marginal(rng, kind):
    """An item and a text of as many words, of a similarity of 0.75 or little more."""
    words = [f"w{rng.randrange(1 << 40)}" for _ in range(rng.choice((40, 90, 200)))]
    n = len(words)
    if kind == "repeats":
        k = (n - 4) // 7 + 1
        return words + ["la"] * k, words + ["mu"] * k
    if kind == "tail":
        k = n // 7 - 1
        return words, words[: n - k] + [f"x{rng.randrange(1 << 40)}" for _ in range(k)]
    item, text = words, list(words)
    while True:  # words changed here and there
        near = list(text)
        near[rng.randrange(n)] = f"y{rng.randrange(1 << 40)}"
        both = sum((grams(near) & grams(item)).values())
        if both < 0.75 * (2 * (n - 4) - both):
            return item, text
        text = near


def test_recall_at_the_margin_and_share_of_candidates():
    rng = random.Random(6)
    for kind in ("repeats", "tail", "changes"):
        pairs = [marginal(rng, kind) for _ in range(120)]
        items = items_of([" ".join(i) for i, _ in pairs])
        found = 0
        for n, (item, text) in enumerate(pairs):
            similarity = sum((grams(item) & grams(text)).values()) / sum((grams(item) | grams(text)).values())
            assert similarity >= 0.75 or kind != "changes"
            (words, values), = of_words(" ".join(text))
            found += n in {m[0] for m in S.matches_of(words, values, items)} or similarity < 0.75
        assert found >= 0.98 * len(pairs), (kind, found)
        assert sum(i.near for i in items.by_size.values()) < 0.4 * sum(i.seen for i in items.by_size.values())


def test_long_items_and_texts():
    rng = np.random.default_rng(8)
    words = rng.integers(0, 1 << 30, 60_000)
    near = words.copy()
    near[::50] = 7
    items = items_of([" ".join(map(str, words[:50_000]))])
    (w, v), = of_words(" ".join(map(str, np.concatenate([rng.integers(0, 1 << 30, 500), near]))))
    (item, similarity, first, n, _), = S.matches_of(w, v, items)
    assert (item, first, n) == (0, 500, 50_000) and 0.8 < similarity < 0.85

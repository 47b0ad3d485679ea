"""Quality classifier: tree paths become conjunctive rules, lasso logistic regression weighs them, and Spark columns apply them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import read_table, stored

#: Labelled rows that the rules are fitted on at most, those with the least hash of doc_id.
MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Numeric statistics of a whole text; a null text counts as empty. All are shares or lengths, so copies score alike."""
    t = F.coalesce(text, F.lit(""))
    size = F.length(t)
    share = lambda c: c / F.greatest(size, F.lit(1))
    words = F.size(F.split(F.trim(t), r"\s+"))
    kept = lambda pattern: size - F.length(F.regexp_replace(t, pattern, ""))
    distinct = F.size(F.array_distinct(F.split(F.lower(F.trim(t)), r"\s+")))
    lines = F.split(t, "\n")
    return {
        "length": F.log1p(size),
        "word_length": (size - words + 1) / F.greatest(words, F.lit(1)),
        "distinct_words": distinct / F.greatest(words, F.lit(1)),
        "upper": share(kept(r"\p{Lu}+")),
        "digits": share(kept(r"[0-9]+")),
        "pipes": share(kept(r"\|+")),
        "symbols": share(kept(r"[#$%&*+=<>@^~_\\/\[\]{}]+")),
        "exclamations": share(kept("!+")),
        "stops": share(kept("[.]+")),
        "commas": share(kept(",+")),
        "lines": F.size(lines) / F.greatest(words, F.lit(1)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


STATISTICS = (
    "length", "word_length", "distinct_words", "upper", "digits", "pipes", "symbols", "exclamations", "stops", "commas", "lines", "distinct_lines",
)


@dataclass(frozen=True)
class Condition:
    """``name <= bound``, or ``name > bound``."""

    name: str
    above: bool
    bound: float

    def column(self) -> Column:
        return F.col(self.name) > self.bound if self.above else F.col(self.name) <= self.bound


@dataclass(frozen=True)
class RuleEnsemble:
    """score = 1 / (1 + exp(-(intercept + sum of the weights of the rules that hold)))."""

    intercept: float
    weights: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(_all_hold(rule), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _all_hold(rule: tuple[Condition, ...]) -> Column:
    held = rule[0].column()
    for condition in rule[1:]:
        held = held & condition.column()
    return held


def tree_paths(dump: str) -> set[tuple[Condition, ...]]:
    """Every path from a root, to inner nodes too, as a rule; ``dump`` is a tree's or forest's printed form."""
    rules, path = set(), []
    for line in dump.splitlines():
        depth = len(line) - len(line.lstrip())
        if m := re.match(r"\s*(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            path = [(d, c) for d, c in path if d < depth]
            path.append((depth, Condition(STATISTICS[int(m[2])], m[3] == ">", float(m[4]))))
            rules.add(_simplified([c for _, c in path]))
    return rules


def _simplified(conditions: list[Condition]) -> tuple[Condition, ...]:
    """The tightest bound of each statistic and direction, in one order."""
    tight: dict[tuple[str, bool], float] = {}
    for c in conditions:
        known = tight.get((c.name, c.above), c.bound)
        tight[c.name, c.above] = max(known, c.bound) if c.above else min(known, c.bound)
    return tuple(Condition(name, above, bound) for (name, above), bound in sorted(tight.items()))


def fit_rules(train: DataFrame, label: str, trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleEnsemble:
    """Fit on ``train`` (the statistics and a 0/1 label), which the caller has bounded.

    With one class or no rows the ensemble has no rules and scores that class's smoothed share (0.5 without rows).
    """
    import math

    n, positive = train.agg(F.count("*"), F.sum(label)).first()
    if not n or positive in (0, n):
        share = ((positive or 0) + 1) / (n + 2)
        return RuleEnsemble(math.log(share / (1 - share)), ())
    rows = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(train).select("features", F.col(label).cast("double").alias("label"), *STATISTICS).cache()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=seed).fit(rows)
    rules = sorted(tree_paths(forest.toDebugString), key=str)
    if not rules:
        share = positive / n
        return RuleEnsemble(math.log(share / (1 - share)), ())
    names = [f"rule_{i}" for i in range(len(rules))]
    held = rows.select("label", *(_all_hold(rule).cast("double").alias(name) for name, rule in zip(names, rules, strict=True)))
    held = VectorAssembler(inputCols=names, outputCol="features").transform(held)
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(held)
    rows.unpersist()
    weights = tuple((rule, float(w)) for rule, w in zip(rules, model.coefficients, strict=True) if abs(w) > 1e-9)
    return RuleEnsemble(float(model.intercept), weights)


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) by rules learnt from ``labels`` (doc_id, quality) of rows not ``held_out``.

    ``held_out`` is a condition on doc_id. Rows with a null label or doc_id teach nothing; a document with several labels
    takes the largest, and of rows that repeat a doc_id those of the least statistics teach. Returns doc_id, held_out, score,
    predicted; a null text scores as an empty one, and repeated rows each get a row. The statistics are computed once, in one scan, and stored as narrow rows; training rows are bounded by
    ``max_train_rows``.
    """
    narrow = stored(docs.select("doc_id", *(c.cast("double").alias(name) for name, c in statistics(F.col("text")).items())), "statistics")
    taught = (
        labels.filter(~held_out & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(max_train_rows)
    )
    once = narrow.join(taught, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*STATISTICS, "quality")).alias("s")).select("doc_id", "s.*")
    train = stored(once.coalesce(4).sortWithinPartitions("doc_id"), "quality-train")
    ensemble = fit_rules(train, "quality")
    scored = narrow.select("doc_id", held_out.alias("held_out"), ensemble.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def hash_fold(folds: int, fold: int) -> Column:
    """crc32 of doc_id as text, mod ``folds``, is ``fold``; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def op7_quality_rules(spark, sf_dir) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), hash_fold(5, 0))


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE_SQL: dict[str, str] = {}

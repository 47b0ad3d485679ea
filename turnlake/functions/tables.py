"""Table functions for SQL: the rows that a text expands to."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .text import MAX_QUERIES, QUERY_JOINT, QUERY_MARKS


@F.udtf(returnType="part int, question string")
class SplitQueries:
    """The questions of a turn, in order, as ``split_queries`` gives them."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        parts = [" ".join(p.split()) for p in re.split(QUERY_MARKS, text or "")]
        parts = [p for p in parts if p]
        if len(parts) > MAX_QUERIES:
            parts[MAX_QUERIES - 1 :] = [QUERY_JOINT.join(parts[MAX_QUERIES - 1 :])]
        yield from enumerate(parts)


@F.udtf(returnType="bigram string")
class Bigrams:
    """Distinct pairs of neighbouring letters or digits, as ``bigrams`` gives them."""

    def eval(self, text: str) -> Iterator[tuple[str]]:
        compact = re.sub(r"[\W_]+", "", (text or "").lower())
        yield from ((x,) for x in dict.fromkeys(compact[i : i + 2] for i in range(max(len(compact) - 1, min(len(compact), 1)))))


def register_tables(spark: SparkSession) -> None:
    """Make ``split_queries(text)`` and ``bigrams(text)`` known to SQL, for use after FROM or LATERAL."""
    spark.udtf.register("split_queries", SplitQueries)
    spark.udtf.register("bigrams", Bigrams)

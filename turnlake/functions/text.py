"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks that end a question or a clause in a spoken turn.
QUERY_MARKS = "[？?！!。；;，,\\n\\r]+"
# Fixed value: what joins the questions beyond the limit.
QUERY_JOINT = "，"
MAX_QUERIES = 8


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def squeeze(text: Column) -> Column:
    """Each run of Unicode white space as one space, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def word_tokens(text: Column) -> Column:
    """Distinct runs of letters, digits and underscores, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring letters or digits, in lower case; a single one alone."""
    def pairs(compact: Column) -> Column:
        size = F.length(compact)
        every = F.regexp_extract_all(compact, F.lit(r"(?s)(?=(..))."), 1)  # one pass over the text
        return F.when(size >= 2, F.array_distinct(every)).when(size == 1, F.array(compact)).otherwise(F.array().cast("array<string>"))

    return let(F.regexp_replace(F.lower(text), r"(?U)[\s\W_]+", ""), pairs)


def lexical_terms(text: Column) -> Column:
    """What lexical similarity compares: bigrams and words."""
    return F.array_union(bigrams(text), word_tokens(text))


def hashed_terms(text: Column) -> Column:
    """``lexical_terms`` as 64-bit hashes. They are hashed before they are told apart, for arrays of numbers are by hash, those of texts by comparing all."""
    def pairs(compact: Column) -> Column:
        return F.when(F.length(compact) == 1, F.array(compact)).otherwise(F.regexp_extract_all(compact, F.lit(r"(?s)(?=(..))."), 1))

    both = F.concat(let(F.regexp_replace(F.lower(text), r"(?U)[\s\W_]+", ""), pairs), F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1))
    return F.array_distinct(F.transform(both, lambda t: F.xxhash64(t)))


def term_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct terms; 0 if one is empty."""
    def jaccard(x: Column) -> Column:
        both = F.size(F.array_intersect(x["a"], x["b"]))
        return F.when((F.size(x["a"]) > 0) & (F.size(x["b"]) > 0), both / (F.size(x["a"]) + F.size(x["b"]) - both)).otherwise(F.lit(0.0))

    return let(F.struct(a.alias("a"), b.alias("b")), jaccard)


def lexical_similarity(a: Column, b: Column) -> Column:
    return term_jaccard(lexical_terms(F.coalesce(a, F.lit(""))), lexical_terms(F.coalesce(b, F.lit(""))))


def split_queries(text: Column, limit: int = MAX_QUERIES) -> Column:
    """The questions of a turn, in order; beyond ``limit`` the rest are joined as one, so none is lost.

    A text of marks alone has none; a null text has none.
    """
    return let(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), QUERY_MARKS), squeeze), lambda p: p != ""), lambda parts: _joined_tail(parts, limit))


def _joined_tail(parts: Column, limit: int) -> Column:
    joined = F.concat(F.slice(parts, 1, limit - 1), F.array(F.array_join(F.slice(parts, F.lit(limit), F.greatest(F.size(parts), F.lit(1))), QUERY_JOINT)))
    return F.when(F.size(parts) > limit, joined).otherwise(parts)


def quote_is_verbatim(quote: Column, message: Column, longest: int = 200) -> Column:
    """Whether the squeezed quote, not empty nor longer than ``longest``, is in the squeezed message."""
    q = squeeze(F.coalesce(quote, F.lit("")))
    return (q != "") & (F.length(q) <= longest) & F.contains(squeeze(F.coalesce(message, F.lit(""))), q)


def clip(text: Column, size: int) -> Column:
    """The first ``size`` characters, with an ellipsis if there are more."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def strip_tags(text: Column) -> Column:
    """Without ``<|...|>`` markers, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|[^|]*\|>", ""))

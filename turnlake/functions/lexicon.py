"""Emotion and risk labels from lexicons; every word list is a parameter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default vocabularies, matched in lower case.
SELF_HARM = (
    "自殺", "自杀", "自傷", "自伤", "自殘", "自残", "不想活", "活不下去", "想死", "尋死", "寻死", "一了百了", "傷害自己", "伤害自己", "結束生命", "结束生命", "輕生", "轻生",
    "跳樓", "跳楼", "跳海", "上吊", "割腕", "割脈", "服毒", "吞藥", "吞药", "suicide", "kill myself", "kill herself", "kill himself", "end my life", "want to die",
    "jump off a building", "jump off the roof", "throw myself off", "hang myself", "cut myself", "self-harm", "self harm",
)
VIOLENCE = (
    "殺人", "杀人", "殺了他", "杀了他", "殺死他", "杀死他", "捅死", "砍死", "傷人", "伤人", "傷害別人", "伤害别人", "打人", "揍人", "hurt someone", "hurt people", "kill him", "kill her",
    "kill them",
)
ATTENTION = ("很痛苦", "崩潰", "崩溃", "絕望", "绝望", "撐不下去", "撑不下去", "打人", "揍", "傷人", "伤人", "傷害別人", "伤害别人")
NEGATIVE = ("難過", "难过", "傷心", "伤心", "心情不好", "心情不太好", "焦慮", "焦虑", "壓力", "压力", "生氣", "生气", "憤怒", "愤怒", "討厭", "讨厌", "火大", "打人", "想打", "揍", "mad", "sad", "angry")
POSITIVE = ("開心", "开心", "高興", "高兴", "謝謝", "谢谢", "棒", "喜歡", "喜欢", "happy", "great")
# The three labels and the three levels, and their order.
EMOTIONS = ("positive", "neutral", "negative")
RISK_LEVELS = ("none", "attention", "urgent")


def _any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words), F.lit(False))


def emotion_of(text: Column, negative: Sequence[str] = NEGATIVE, positive: Sequence[str] = POSITIVE) -> Column:
    """negative if any negative word is in the lower-case text, else positive if any positive one is, else neutral; null is neutral."""
    lowered = F.lower(text)
    return F.when(_any(lowered, negative), "negative").when(_any(lowered, positive), "positive").otherwise("neutral")


def risk_evidence(text: Column, urgent: Sequence[str], attention: Sequence[str]) -> Column:
    """The words of both lists that the lower-case text has, in list order; a word of both lists counts twice."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    words = F.array(*map(F.lit, [*urgent, *attention])) if urgent or attention else F.array().cast("array<string>")
    return F.filter(words, lambda w: F.contains(lowered, w))


def risk_level(text: Column, urgent: Sequence[str], attention: Sequence[str]) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.when(_any(lowered, urgent), "urgent").when(_any(lowered, attention), "attention").otherwise("none")


def risk_rank(level: Column) -> Column:
    """Place of a level in RISK_LEVELS; null for others."""
    return F.when(level == "none", 0).when(level == "attention", 1).when(level == "urgent", 2)


def merge_risk(local: Column, model: Column) -> Column:
    """The higher level; a null one from the model counts as none, an unknown one makes the result null."""
    other = F.when(model.isNull(), 0).otherwise(risk_rank(model))
    rank = F.when(risk_rank(local).isNotNull() & other.isNotNull(), F.greatest(risk_rank(local), other))
    return F.when(rank == 0, "none").when(rank == 1, "attention").when(rank == 2, "urgent")


def analysis_status(model_status: Column) -> Column:
    return F.when(model_status == "ok", "ok").otherwise("partial")


def canonical_label(label: Column, aliases: Mapping[str, str]) -> Column:
    """The canonical name of an alias, matched trimmed and in lower case; null for others."""
    key = F.lower(F.trim(label))
    if not aliases:
        return F.lit(None).cast("string")
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.try_element_at(table, F.coalesce(key, F.lit("")))


def first_disclosure(text: Column, vocabulary: Sequence[str], negations: Sequence[str], reach: int = 2) -> Column:
    """The phrase that the text states first, in lower case; empty if none.

    A phrase counts where no negation is within the ``reach`` characters before it. At one place, the phrase listed first
    wins.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    marks = F.array(*map(F.lit, negations)) if negations else F.array().cast("array<string>")

    def places(order: int, phrase: str) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(lowered) - len(phrase) + 1, F.lit(1))), lambda i: F.substring(lowered, i, F.lit(len(phrase))) == phrase)
        free = F.filter(at, lambda i: ~F.exists(marks, lambda m: F.contains(F.substring(lowered, F.greatest(i - reach, F.lit(1)), F.least(F.lit(reach), i - 1)), m)))
        return F.when(F.contains(lowered, F.lit(phrase)) & (F.size(free) > 0), F.struct(F.array_min(free).alias("at"), F.lit(order).alias("ord"), F.lit(phrase).alias("phrase")))

    if not vocabulary:
        return F.lit("")
    first = F.array_min(F.filter(F.array(*(places(i, p) for i, p in enumerate(vocabulary))), lambda x: x.isNotNull()))
    return F.coalesce(first["phrase"], F.lit(""))


def evidence_union(local: Column, model: Column) -> Column:
    """Local evidence as it is, then the model's that it lacks."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(local, none), F.array_except(F.coalesce(model, none), F.coalesce(local, none)))

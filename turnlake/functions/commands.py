"""Device settings that an utterance asks for, and levels that a device reports, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Words that only look like a number, what a setting is called, what asks for a level, for more, less, all or nothing, and themes.
FILLERS = ("一點", "一点", "一些", "一下", "一會兒", "一会儿", "一点儿")
TARGETS = {
    "volume": ("音量", "聲音", "声音", "喇叭", "volume", "聲量", "声量"),
    "theme": ("主題", "主题", "夜間模式", "夜间模式", "深色", "淺色", "浅色", "theme"),
    "brightness": ("亮度", "屏幕亮", "螢幕亮", "屏幕暗", "螢幕暗", "brightness", "屏幕", "螢幕"),
}
SET_WORDS = ("調到", "调到", "設成", "设成", "設為", "设为", "改成", "改為", "改为", "變成", "变成", "調成", "调成", "到")
UP_WORDS = (
    "大一點", "大一点", "大聲", "大声", "調大", "调大", "增大", "調高", "调高", "放大", "大聲點", "大声点", "太吵", "太響", "太响", "太小聲", "太小声", "太小",
    "太暗", "調亮", "调亮", "亮一點", "亮一点", "高一點", "高一点",
)
DOWN_WORDS = (
    "小一點", "小一点", "小聲", "小声", "調小", "调小", "減小", "减小", "調低", "调低", "小聲點", "小声点", "太輕", "太轻", "太低", "太大聲", "太大声", "太大", "太亮",
    "暗一點", "暗一点", "調暗", "调暗", "低一點", "低一点",
)
MAX_WORDS = ("最大", "最響", "最响", "最大聲", "最大声", "調滿", "调满", "全開", "全开", "滿格", "满格")
MIN_WORDS = ("最小", "最輕", "最轻", "最小聲", "最小声", "靜音", "静音", "關掉聲音", "关掉声音", "別出聲", "别出声")
THEMES = {
    "dark": ("夜間", "夜间", "深色", "黑色", "暗色", "夜晚", "dark", "night"),
    "light": ("白天", "日間", "日间", "淺色", "浅色", "亮色", "白色", "light", "day"),
}
DIGITS = {"零": 0, "〇": 0, "一": 1, "壹": 1, "二": 2, "兩": 2, "两": 2, "貳": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
# Parts of the names that a device gives a level.
LEVEL_NAMES = {"volume": ("volume", "音量", "speaker", "level"), "brightness": ("bright", "亮度", "level")}


def _has(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))


def spoken_number(digits: Column) -> Column:
    """The value of a run of number words: tens and hundreds multiply what stands before them, or one."""
    values = F.create_map(*(F.lit(x) for pair in DIGITS.items() for x in pair))
    start = F.struct(F.lit(0).alias("whole"), F.lit(0).alias("last"))

    def read(acc: Column, ch: Column) -> Column:
        unit = F.when(ch == "十", 10).when(ch == "百", 100)
        many = F.when(acc["last"] == 0, 1).otherwise(acc["last"])
        return F.struct(F.when(unit.isNotNull(), acc["whole"] + many * unit).otherwise(acc["whole"]).alias("whole"), F.when(unit.isNotNull(), 0).otherwise(F.coalesce(F.try_element_at(values, ch), F.lit(0))).alias("last"))

    return F.aggregate(F.filter(F.split(digits, ""), lambda c: c != ""), start, read, lambda acc: acc["whole"] + acc["last"])


def level_in(text: Column) -> Column:
    """The first level of 0 to 100, in figures, else in words; null without one."""
    figures = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{1,3})(?![0-9])"), 1), lambda x: x.cast("int"))
    plain = F.replace(F.replace(text, F.lit("百分之"), F.lit("")), F.lit("百分"), F.lit(""))
    words = F.transform(F.regexp_extract_all(plain, F.lit("([" + "".join(DIGITS) + "十百]+)"), 1), spoken_number)
    first = lambda xs: F.try_element_at(F.filter(xs, lambda x: x.between(0, 100)), F.lit(1))
    return F.coalesce(first(figures), first(words))


def device_command(text: Column) -> Column:
    """Struct (target, kind, level, theme) of an utterance that sets a device's volume, brightness or theme, or steps it; else null.

    ``kind`` is set or step; a step's level is 1 or -1. Only a named target with an explicit value or direction counts.
    """
    def parsed(said: Column) -> Column:
        plain = reduce(lambda t, w: F.replace(t, F.lit(w), F.lit("")), FILLERS, said)
        target = reduce(lambda c, item: c.when(_has(F.lower(plain), item[1]), item[0]), list(TARGETS.items())[1:], F.when(_has(F.lower(plain), TARGETS["volume"]), "volume"))
        theme = F.when(_has(F.lower(said), THEMES["dark"]), "dark").when(_has(F.lower(said), THEMES["light"]), "light")

        def follows(name: str) -> Column:
            right_after = [(F.instr(plain, w) > 0) & level_in(F.substring(plain, F.instr(plain, w) + len(w), F.lit(6))).isNotNull() for w in TARGETS[name]]
            return reduce(lambda a, b: a | b, right_after)

        def chosen(x: Column) -> Column:
            target, level = x["target"], x["level"]
            near = F.when(target == "volume", follows("volume")).otherwise(follows("brightness"))
            answer = lambda kind, value: F.struct(target.alias("target"), F.lit(kind).alias("kind"), value.cast("int").alias("level"), F.lit(None).cast("string").alias("theme"))
            dark = F.struct(target.alias("target"), F.lit("set").alias("kind"), F.lit(None).cast("int").alias("level"), theme.alias("theme"))
            return (
                F.when(target.isNull(), None).when(target == "theme", F.when(theme.isNotNull(), dark))
                .when(level.isNotNull() & (_has(plain, SET_WORDS) | near), answer("set", level))
                .when(_has(said, MAX_WORDS), answer("set", F.lit(100))).when(_has(said, MIN_WORDS), answer("set", F.lit(0)))
                .when(_has(said, UP_WORDS), answer("step", F.lit(1))).when(_has(said, DOWN_WORDS), answer("step", F.lit(-1)))
            )

        return let(F.struct(target.alias("target"), level_in(plain).alias("level")), chosen)

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""), parsed)


def find_level(status: Column, target: str) -> Column:
    """The first number of 0 to 100, as a whole one, that a JSON text has at any depth under a name of ``target``; null without one."""
    names = LEVEL_NAMES.get(target, ())
    token = r'("(?:[^"\\]|\\.)*"(?:\s*:\s*-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)?)'
    tokens = F.regexp_extract_all(status, F.lit(token), 1)
    number = lambda t: F.regexp_extract(t, r'"\s*:\s*(-?[0-9.]+(?:[eE][+-]?[0-9]+)?)$', 1).try_cast("double")
    name = lambda t: F.lower(F.regexp_extract(t, r'^"((?:[^"\\]|\\.)*)"', 1))
    fits = F.filter(tokens, lambda t: number(t).between(0, 100) & _has(name(t), names))
    return F.when(F.try_parse_json(status).isNotNull(), F.floor(number(F.try_element_at(fits, F.lit(1)))).cast("int"))

"""Model output, speech and utterance parsing as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

TRAILER = "emotion string, risk string, risk_level string, risk_evidence array<string>, remember array<map<string,string>>"
DELTA = "model string, choices array<struct<delta:struct<content:string,tool_calls:array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>>>>"
# What ends a spoken sentence, and where a long one may break.
TERMINATORS, SOFT_BREAKS = "。！？!?；;…\n", "，,、：:）)】」》」 　"
# Whole utterances that stop speech or end a conversation, and what is trimmed around them.
STOP_WORDS = ("停", "停止", "停一下", "停下", "停停", "别说了", "別說了", "不要说了", "不用说了", "别讲了", "別講了", "安静", "安靜", "闭嘴", "閉嘴", "打断", "打斷", "别念了", "stop", "shutup")
END_WORDS = (
    "退下", "退下吧", "结束", "結束", "结束对话", "結束對話", "结束聊天", "結束聊天", "退出对话", "退出對話", "不聊了", "不聊啦", "就这样", "就這樣", "就这样吧", "拜拜", "拜拜啦", "再见", "再見", "不用了",
    "没事了", "沒事了", "先这样", "byebye", "goodbye", "good bye",
)
TRIMMED = "。！？!?.,，、；;：: 　\t~～…\"'“”‘’()（）[]【】"
LANGUAGE_CODES = ("zh", "en", "yue", "ja", "ko", "auto", "nospeech")


def extract_structured(content: Column) -> Column:
    """Struct (text, block): the last fenced, else the last bare, JSON object that has an emotion, a risk or memories, and the
    text without it. Braces are matched to the first closing one, so nested objects are no block."""
    body = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?U)^\s+|\s+$", "")

    def found(pattern: str) -> Column:
        blocks = F.transform(F.regexp_extract_all(body, F.lit(f"({pattern})"), 1), lambda b: F.struct(b.alias("raw"), F.from_json(F.regexp_extract(b, r"(?s)(\{.*?\})", 1), TRAILER).alias("v")))
        return F.filter(blocks, lambda b: b["v"].isNotNull() & (b["v"]["emotion"].isNotNull() | b["v"]["risk"].isNotNull() | b["v"]["risk_level"].isNotNull() | (F.size(F.coalesce(b["v"]["remember"], F.array())) > 0)))

    last = lambda p: F.try_element_at(found(p), F.lit(-1))
    chosen = F.coalesce(last(r"(?s)```(?:json)?\s*\{.*?\}\s*```"), last(r"(?s)\{.*?\}"))

    def cut(c: Column) -> Column:
        back = F.length(body) - F.instr(F.reverse(body), F.reverse(c["raw"])) - F.length(c["raw"]) + 2
        rest = F.concat(F.substring(body, F.lit(1), back - 1), F.substring(body, back + F.length(c["raw"]), F.length(body)))
        return F.struct(F.when(c.isNull(), body).otherwise(F.regexp_replace(rest, r"(?U)^\s+|\s+$", "")).alias("text"), c["v"].alias("block"))

    return let(chosen, cut)


def parse_sse(line: Column) -> Column:
    """Struct (content, calls, model) of one stream line; all null for comments, [DONE] and what is no JSON."""
    data = F.trim(F.regexp_replace(F.trim(line), "^data:", ""))
    body = F.when(~F.trim(line).startswith(":") & (data != "") & (data != "[DONE]"), F.from_json(data, DELTA))
    first = F.try_element_at(body["choices"], F.lit(1))
    return F.struct(F.nullif(first["delta"]["content"], F.lit("")).alias("content"), first["delta"]["tool_calls"].alias("calls"), F.nullif(body["model"], F.lit("")).alias("model"))


def merge_call_deltas(chunks: DataFrame) -> DataFrame:
    """(request_id, index, id, name, arguments) of streamed call fragments (request_id, chunk_no, index, id, name, arguments):
    the first id and name, arguments joined in order; calls without a name are left out."""
    order = F.col("chunk_no")
    first = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", F.coalesce("arguments", F.lit("")).alias("a")))), lambda x: x["a"]), "")
    return chunks.groupBy("request_id", "index").agg(F.coalesce(first("id"), F.lit("")).alias("id"), first("name").alias("name"), joined.alias("arguments")).filter("name is not null")


def strip_markup(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?```", "")
    return F.regexp_replace(F.regexp_replace(t, r"\[([^\]]+)\]\([^)]*\)", "$1"), "[*_`#~]", "")


def split_speech(text: Column, longest: int = 48) -> Column:
    """Speakable pieces: sentences, those that are too long cut at the last soft break that is not too early, else hard; no emoji at the start."""
    plain = strip_lead_emoji(F.trim(F.regexp_replace(strip_markup(text), r"(?U)\s+", " ")))
    parts = F.transform(F.regexp_extract_all(plain, F.lit(f"([^{TERMINATORS}]+[{TERMINATORS}]?)"), 1), lambda s: F.trim(s))
    floor = max(8, longest // 3)

    def cut(part: Column) -> Column:
        steps = F.sequence(F.lit(1), F.greatest(F.ceil(F.length(part) / floor).cast("int"), F.lit(1)))
        start = F.struct(F.array().cast("array<string>").alias("done"), part.alias("rest"))

        def step(acc: Column, _: Column) -> Column:
            window = F.substring(acc["rest"], 1, longest)
            last = F.length(window) - F.length(F.regexp_extract(window, f"([^{SOFT_BREAKS}]*)$", 1))
            at = F.when(last > floor, last).otherwise(longest)
            long = F.length(acc["rest"]) > longest
            return F.struct(
                F.when(long, F.concat(acc["done"], F.array(F.trim(F.substring(acc["rest"], F.lit(1), at))))).otherwise(acc["done"]).alias("done"),
                F.when(long, F.substring(acc["rest"], at + 1, F.length(acc["rest"]))).otherwise(acc["rest"]).alias("rest"),
            )

        return F.aggregate(steps, start, step, lambda acc: F.filter(F.concat(acc["done"], F.array(F.trim(acc["rest"]))), lambda p: p != ""))

    return F.flatten(F.transform(parts, cut))


def dialog_command(text: Column, stop: Sequence[str] = STOP_WORDS, end: Sequence[str] = END_WORDS, longest: int = 12) -> Column:
    """stop or end where the utterance, white space and marks around it aside, is one of the words; else null."""
    marks = "[" + "".join("\\" + c if c in "[]\\^-\"'()." else c for c in TRIMMED) + "]+"
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""), "^" + marks, ""), marks + "$", "")
    short = F.length(t) <= longest
    return F.when(short & t.isin(*stop), "stop").when(short & t.isin(*end), "end")


def language_code(hint: Column) -> Column:
    """A known code of the hint, else empty."""
    code = F.lower(F.trim(F.coalesce(hint, F.lit(""))))
    return F.when(code.isin(*LANGUAGE_CODES), code).otherwise("")


def lead_emoji(text: Column, faces: Mapping[str, str]) -> Column:
    """Struct (emoji, face) of the first known emoji in the text; null if there is none."""
    table = F.create_map(*(F.lit(x) for pair in faces.items() for x in pair))
    known = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: F.map_contains_key(table, c))
    first = F.try_element_at(known, F.lit(1))
    return F.when(first.isNotNull(), F.struct(first.alias("emoji"), F.try_element_at(table, F.coalesce(first, F.lit(""))).alias("face")))


def strip_lead_emoji(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*(?:[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2190}-\x{21FF}\x{2B00}-\x{2BFF}\x{FE0F}])(?:[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2190}-\x{21FF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}])*\s*", "")


def audio_quality(pcm: Column, rate: Column, seconds: float = 3.0) -> Column:
    """Struct (clipping, rms, duration, fault) of 16-bit samples; fault is too_short, clipped, too_quiet or null."""
    n = F.greatest(F.size(pcm), F.lit(1))
    clipping = F.size(F.filter(pcm, lambda x: F.abs(x.cast("int")) >= 32760)) / n
    rms = F.sqrt(F.aggregate(pcm, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / n)
    duration = F.size(pcm) / rate
    fault = F.when(duration < seconds, "too_short").when(clipping > 0.01, "clipped").when(rms < 150, "too_quiet")
    return F.struct(clipping.alias("clipping"), rms.alias("rms"), duration.alias("duration"), fault.alias("fault"))


def acoustic_features(pcm: Column) -> Column:
    """Struct (mean, rms, zero_crossing_rate)."""
    n = F.greatest(F.size(pcm), F.lit(1))
    mean = F.aggregate(pcm, F.lit(0.0), lambda a, x: a + x.cast("double")) / n
    rms = F.sqrt(F.aggregate(pcm, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / n)
    signs = F.zip_with(F.slice(pcm, F.lit(1), F.size(pcm) - 1), F.slice(pcm, F.lit(2), F.size(pcm)), lambda a, b: ((a < 0) != (b < 0)).cast("int"))
    return F.struct(mean.alias("mean"), rms.alias("rms"), (F.aggregate(F.coalesce(signs, F.array()), F.lit(0), lambda a, x: a + x) / n).alias("zero_crossing_rate"))

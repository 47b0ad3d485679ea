"""Keyed state machines: one step function each, run over a stream with state or over a sorted batch.

A step takes (state, row) and gives (state, rows to emit). State is a JSON value, so it survives in any state store. Rows of a key
have to come in order: a micro-batch is sorted before its steps; what is late beyond that meets the state as it is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.dialogue import SOFT_BREAKS, TERMINATORS

Step = Callable[[dict, dict], tuple[dict, list[tuple]]]
ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def run_batch(df: DataFrame, key: str, order: str, step: Step, schema: str, finish: Step | None = None) -> DataFrame:
    """All rows of each key in order through ``step``, in one pass over sorted partitions; no key is held in memory.

    Rows without a key are a key of their own. ``finish`` takes the state and the last row of a key once it has ended.
    """
    fields = [x.split() for x in schema.split(", ")]
    table = pa.schema([(name, ARROW[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = {}, None
        for batch in batches:
            out: list[tuple] = []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(batch.schema.names, values, strict=True))
                if last is None or not _same(row[key], last[key]):
                    out += finish(state, last)[1] if finish and last is not None else []
                    state = {}
                last = row
                state, emitted = step(state, row)
                out += emitted
            yield _rows(out, table)
        if finish and last is not None:
            yield _rows(finish(state, last)[1], table)

    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


def _rows(out: list[tuple], table: pa.Schema) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [()] * len(table)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, table, strict=True)], schema=table)


def run_stream(df: DataFrame, key: str, order: str, step: Step, schema: str, deadline: Callable[[dict], float | None] | None = None, finish: Step | None = None) -> DataFrame:
    """The same over a stream; emits in append mode.

    With ``deadline``, the second of event time at which a state is over (null: never), and ``finish``, what is over is emitted when
    the watermark passes it, whether or not another row of the key comes. ``df`` then has a watermark; rows behind it are dropped.
    ``finish`` gets a row of the key alone.
    """
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(keys, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {}
        if held.hasTimedOut:
            held.remove()
            yield pd.DataFrame(finish(state, {key: keys[0]})[1] if state else [], columns=columns)
            return
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for row in (dict(zip(rows.columns, values, strict=True)) for values in zip(*(rows[c] for c in rows.columns), strict=True)):
            state, emitted = step(state, row)
            out += emitted
        held.update((json.dumps(state),))
        if deadline is not None and (at := deadline(state) if state else None) is not None:
            held.setTimeoutTimestamp(max(int(at * 1000), held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=columns)

    clock = GroupStateTimeout.NoTimeout if deadline is None else GroupStateTimeout.EventTimeTimeout
    return df.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", clock)


def sequence_step(state: dict, row: dict) -> tuple[dict, list[tuple]]:
    """Keeps a frame whose sequence is larger than all before it. Rows: session_id, sequence, arrival."""
    if row["sequence"] <= state.get("last", -1):
        return state, []
    return {"last": int(row["sequence"])}, [(row["session_id"], row["sequence"], row["arrival"])]


SEQUENCE = "session_id long, sequence long, arrival long"


def endpoint_step(threshold: float = 300.0, frame_ms: int = 60, trigger_ms: int = 240, silence_ms: int = 800, longest_ms: int = 20_000, shortest_ms: int = 400, floor_ms: int = 3_000) -> Step:
    """Segments of a level series. Rows: session_id, arrival, rms; emits session_id, started, ended, frames, spoke, reason.

    A frame is voice from a gate on, 2.5 times the least level of the last ``floor_ms`` but between once and three times
    the threshold. ``trigger_ms`` of voice, short silences aside, make a segment one that is spoken; then ``silence_ms``
    without voice end it. ``longest_ms`` end any, spoken or not. A segment begins with the first frame after the last one's
    end, and nothing is remembered across an end. Segments shorter than ``shortest_ms`` are dropped. A null level is silence.
    """

    def step(s: dict, row: dict) -> tuple[dict, list[tuple]]:
        level = float(row["rms"] or 0.0)
        levels = [*s.get("levels", []), level][-max(1, floor_ms // frame_ms):]
        gate = min(max(2.5 * min(levels), threshold), 3 * threshold)
        voice = level >= gate
        voiced, silent = s.get("voiced", 0) + voice * frame_ms, 0 if voice else s.get("silent", 0) + frame_ms
        frames, began = s.get("frames", 0) + 1, s.get("began", int(row["arrival"]))
        spoke = s.get("spoke", False) or voiced >= trigger_ms
        reason = "silence" if spoke and silent >= silence_ms else "max_length" if frames * frame_ms >= longest_ms else None
        if reason is None:
            return {"levels": levels, "voiced": voiced, "silent": silent, "frames": frames, "began": began, "spoke": spoke, "last": int(row["arrival"])}, []
        return {}, [(row["session_id"], began, int(row["arrival"]), frames, spoke, reason)] if frames * frame_ms >= shortest_ms else []

    return step


def endpoint_finish(frame_ms: int = 60, shortest_ms: int = 400) -> Step:
    """What is open when the frames of a session end is a segment if it is spoken."""

    def finish(s: dict, row: dict) -> tuple[dict, list[tuple]]:
        long_enough = s.get("spoke", False) and s["frames"] * frame_ms >= shortest_ms
        return {}, [(row["session_id"], s["began"], s["last"], s["frames"], True, "flush")] if long_enough else []

    return finish


def endpoint_deadline(idle: float = 300.0, per_second: float = 1.0) -> Callable[[dict], float | None]:
    """A session without a frame for ``idle`` seconds has ended; ``arrival`` counts ``per_second`` to a second of event time."""
    return lambda s: s["last"] / per_second + idle if "last" in s else None


SEGMENTS = "session_id long, started long, ended long, frames long, spoke boolean, reason string"


def lifecycle_step(state: dict, row: dict) -> tuple[dict, list[tuple]]:
    """Turns of a session: a second begin while one is open is rejected; cancel and complete close the open turn only.

    Rows: session_id, turn_id, ts, kind; emits session_id, turn_id, ts, outcome.
    """
    open_, turn = state.get("open"), int(row["turn_id"])
    out = lambda outcome: [(row["session_id"], turn, row["ts"], outcome)]
    if row["kind"] == "begin":
        return (state, out("rejected_busy")) if open_ is not None else ({"open": turn}, out("begun"))
    if open_ != turn:
        return state, out("ignored")
    return {}, out({"cancel": "cancelled", "complete": "completed"}.get(row["kind"], "ignored"))


LIFECYCLE = "session_id long, turn_id long, ts long, outcome string"


#: What begins the trailer that is never spoken; characters of such a trailer; the least place of a soft cut.
TRAILERS = ("```", '"emotion"', '"risk_evidence"', '"remember"', '"risk"')
TRAILER_MARKS = '{}":,'
SOFT_FLOOR = 8
#: The same characters as ``strip_lead_emoji`` has.
LEAD_EMOJI = re.compile("^\\s*[\U0001F300-\U0001FAFF\u2600-\u27BF\u2190-\u21FF\u2B00-\u2BFF\uFE0F][\U0001F300-\U0001FAFF\u2600-\u27BF\u2190-\u21FF\u2B00-\u2BFF\uFE0F\u200D]*\\s*")


def _soft_cut(text: str, longest: int) -> int:
    """Where to cut a run of more than ``longest`` characters: after its last soft break, unless that is near the start."""
    at = max(text.rfind(mark, 0, longest) for mark in SOFT_BREAKS)
    return at + 1 if at >= max(SOFT_FLOOR, longest // 3) else longest


def sentence_step(least: int = 6, longest: int = 48, ends: str = TERMINATORS) -> Step:
    """Speakable sentences of streamed text. Rows: request_id, chunk_no, delta, last; emits request_id, piece_no, piece.

    A sentence ends at one of ``ends`` once it has ``least`` characters, two while nothing was spoken in an earlier delta; a run of
    ``longest`` is cut at a soft break; what is left comes with the last delta. An emoji at the very start is not spoken. From
    a trailer on, found across deltas too, nothing is spoken, nor an unfinished sentence before it that looks like one.
    """

    def cut(text: str, floor: int) -> int:
        at = next((i + 1 for i, ch in enumerate(text) if ch in ends and i + 1 >= floor), 0)
        return at or (_soft_cut(text, longest) if len(text) >= longest else 0)

    def step(s: dict, row: dict) -> tuple[dict, list[tuple]]:
        text, n, muted, begun = s.get("text", ""), s.get("n", 0), s.get("muted", False), s.get("begun", False)
        final, pieces = bool(row["last"]), []
        if not muted and row["delta"]:
            text += row["delta"]
            if found := [i for i in (text.find(mark) for mark in TRAILERS) if i >= 0]:
                text, muted, final = text[: min(found)], True, True
                tail = max(text.rfind(ch) for ch in ends) + 1
                if any(ch in TRAILER_MARKS for ch in text[tail:]):
                    text = text[:tail]
        elif muted:
            final = False
        if text and not begun:
            text, begun = LEAD_EMOJI.sub("", text), True
        while at := cut(text, least if n else 2):
            pieces.append(text[:at].strip())
            text = text[at:]
        if final:
            text = text.strip()
            while len(text) > longest:
                at = _soft_cut(text, longest)
                pieces.append(text[:at].strip())
                text = text[at:]
            pieces.append(text.strip())
            text = ""
        spoken = [p for p in pieces if p]
        return {"text": text, "n": n + len(spoken), "muted": muted, "begun": begun}, [(row["request_id"], n + i, p) for i, p in enumerate(spoken)]

    return step


SENTENCES = "request_id long, piece_no long, piece string"


def enrollment_step(expires: int = 600) -> Step:
    """Enrolments of a user: one at a time, over after ``expires`` seconds. Rows: user_id, enrollment_id, ts, kind {start, sample,
    complete, cancel}; emits user_id, enrollment_id, ts, status. What has ended stays as it is."""

    def step(s: dict, row: dict) -> tuple[dict, list[tuple]]:
        out, ts, one = [], int(row["ts"]), int(row["enrollment_id"])
        if s and ts > s["ts"] + expires:
            out.append((row["user_id"], s["id"], s["ts"] + expires, "expired"))
            s = {}
        if row["kind"] == "start":
            if s:
                out.append((row["user_id"], s["id"], ts, "cancelled"))
            return {"id": one, "ts": ts}, [*out, (row["user_id"], one, ts, "started")]
        if not s or s["id"] != one:
            return s, out
        if row["kind"] == "sample":
            return s, [*out, (row["user_id"], one, ts, "sampled")]
        return {}, [*out, (row["user_id"], one, ts, {"complete": "completed"}.get(row["kind"], "cancelled"))]

    return step


def enrollment_finish(expires: int = 600, now: float | None = None) -> Step:
    """An open enrolment expires: on a stream when the watermark passes its time, in a batch if ``now`` is past it."""

    def finish(s: dict, row: dict) -> tuple[dict, list[tuple]]:
        over = s and (now is None or now > s["ts"] + expires)
        return {}, [(row["user_id"], s["id"], s["ts"] + expires, "expired")] if over else []

    return finish


def enrollment_deadline(expires: int = 600) -> Callable[[dict], float | None]:
    return lambda s: s["ts"] + expires if s else None


ENROLLMENTS = "user_id long, enrollment_id long, ts long, status string"


def admission_step(steps: int = 3) -> Step:
    """Samples of a user in order of arrival. Rows: user_id, sample_id, step, saved (steps on record before the first row); emits
    user_id, sample_id, step, outcome, samples.

    A step not yet on record is accepted only if it is the first that is missing; one on record is recorded again; a sample without a
    step takes the first that is missing. Anything else is rejected and changes nothing. ``samples`` counts the steps then on record.
    """

    def step(s: dict, row: dict) -> tuple[dict, list[tuple]]:
        saved = s["saved"] if s else sorted({int(x) for x in (row["saved"] if row["saved"] is not None else ()) if x is not None})
        following = next((x for x in range(1, steps + 1) if x not in saved), None)
        asked = following if row["step"] is None or row["step"] != row["step"] else int(row["step"])
        if asked is not None and asked in saved:
            outcome = "re_recorded"
        elif asked is not None and asked == following:
            outcome, saved = "accepted", sorted([*saved, asked])
        else:
            outcome = "rejected"
        return {"saved": saved}, [(row["user_id"], row["sample_id"], asked, outcome, len(saved))]

    return step


ADMISSIONS = "user_id long, sample_id long, step long, outcome string, samples long"

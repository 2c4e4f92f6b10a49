"""Structured Streaming: windows, vote logs, note and token streams. Each has a batch counterpart with equal results."""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from partita.functions.tokens import clean_start, clean_step, decode, decode_start, decode_step

CHUNK = 16


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", gap: str | None = None) -> DataFrame:
    """Count and sum of value by event_type and tumbling, sliding or (with gap) session window on ts."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    w = F.session_window("ts", gap) if gap else F.window("ts", size, slide) if slide else F.window("ts", size)
    g = e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "event_type", "n", "total")


class _State(StatefulProcessor):
    """One JSON value of state for each key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("state", StructType([StructField("json", StringType())]))

    def load(self, default: dict) -> dict:
        return json.loads(self.value.get()[0]) if self.value.exists() else default

    def save(self, state: dict) -> None:
        self.value.update((json.dumps(state),))

    def close(self) -> None:
        pass


def _order(event: tuple) -> tuple:
    t, kind, target, value = event
    return t, kind, str(target), str(value)


def _apply(standing: dict, times: list, events: list[tuple]) -> None:
    """Applies events in the order of their time to the standing votes and their sorted times."""
    for t, kind, target, value in events:
        if kind == 0:
            if t not in standing:
                bisect.insort(times, t)
            standing[t] = value
            continue
        at = target if target is not None else times[-1] if times else None
        if at in standing:
            if kind == 1:
                standing[at] = value
            else:
                del standing[at]
                del times[bisect.bisect_left(times, at)]


class VoteLog(StatefulProcessor):
    """Newest standing vote of each pair under casts, sets and undos arriving in any order.

    Events newer than all before them are applied to the standing votes. A late one makes the pair's events, which are
    kept as a list, be applied anew in the order of their own time; repeated ones are passed over. So late rows
    correct what was emitted before: take the last row of each pair. With keep_ms, state that hasn't changed for so
    long is dropped (needs a time mode).
    """

    EVENT = StructType([StructField("t", LongType()), StructField("kind", IntegerType()), StructField("target", LongType()), StructField("value", StringType())])

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = () if self.keep_ms is None else (self.keep_ms,)
        self.events = handle.getListState("events", self.EVENT, *ttl)
        self.summary = handle.getValueState("summary", StructType([StructField("json", StringType())]), *ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        s = json.loads(self.summary.get()[0]) if self.summary.exists() else {"standing": [], "top": None, "version": 0}
        new = {(int(t), int(kind), None if pd.isna(target) else int(target), None if pd.isna(value) else value) for pdf in rows for t, kind, target, value in zip(pdf["t"], pdf["kind"], pdf["target_t"], pdf["value"])}
        late = s["top"] is not None and min(map(_order, new)) <= tuple(s["top"])
        old = {tuple(e) for e in self.events.get()} if late else set()
        new -= old
        standing = {} if late and new else dict(map(tuple, s["standing"]))
        times = sorted(standing)
        _apply(standing, times, sorted(old | new if late and new else new, key=_order))
        if new:
            self.events.appendList([tuple(e) for e in new])
            s["top"] = max([_order(e) for e in new] + ([tuple(s["top"])] if s["top"] else []))
        s["standing"], s["version"] = list(standing.items()), s["version"] + 1
        self.summary.update((json.dumps(s),))
        yield pd.DataFrame({"pair_id": [key[0]], "choice": [standing[times[-1]] if times else None], "standing": [len(standing)], "version": [s["version"]]})

    def close(self) -> None:
        pass


def vote_log(events: DataFrame) -> DataFrame:
    """events: pair_id, t, kind (0 cast, 1 set, 2 undo), target_t, value."""
    return events.groupBy("pair_id").transformWithStateInPandas(VoteLog(), "pair_id string, choice string, standing int, version int", "Update", "None")


class NoteStream(_State):
    """Notes of a growing token stream, each once, as soon as their last token is there.

    Kept are the decoder's state and the notes of the current bar, so a stream of any length costs the same for each
    token. With strict_compat the whole stream is kept and decoded anew every CHUNK tokens, only the count of emitted
    notes is remembered and the last partial chunk waits for more tokens, as the reference does it: a note that sorts
    before emitted ones then shifts the rest, and the tail is never emitted.
    """

    def __init__(self, strict_compat: bool = False):
        self.strict = strict_compat

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        new = [t for _, t in sorted((int(p), int(t)) for pdf in rows for p, t in zip(pdf["pos"], pdf["token"]))]
        out = self._strict(new) if self.strict else self._each(new)
        yield pd.DataFrame([(key[0], *n) for n in out], columns=["stream", "program", "start", "duration", "pitch", "velocity"])

    def _each(self, new: list[int]) -> list[tuple]:
        s = self.load({"decoder": decode_start(), "bar": 0, "known": []})
        out, known = [], {tuple(k) for k in s["known"]}
        for t in new:
            note = decode_step(s["decoder"], t)
            if s["decoder"]["bar"] != s["bar"]:
                s["bar"], known = s["decoder"]["bar"], set()
            if note and note not in known:
                known.add(note)
                out.append(note)
        s["known"] = sorted(known)
        self.save(s)
        return out

    def _strict(self, new: list[int]) -> list[tuple]:
        s = self.load({"ids": [], "waiting": 0, "emitted": 0})
        out: list[tuple] = []
        for t in new:
            s["ids"].append(t)
            s["waiting"] += 1
            if s["waiting"] == CHUNK:
                s["waiting"] = 0
                notes = sorted(decode(s["ids"]), key=lambda n: (n[1], n[3]))
                out += notes[s["emitted"] :]
                s["emitted"] = len(notes)
        self.save(s)
        return out


def note_stream(tokens: DataFrame, strict_compat: bool = False) -> DataFrame:
    """tokens: stream, pos, token."""
    return tokens.groupBy("stream").transformWithStateInPandas(NoteStream(strict_compat), "stream string, program int, start int, duration int, pitch int, velocity int", "Append", "None")


class CleanStream(_State):
    """Token clean-up (functions.tokens.clean_step) kept between arrivals."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        s = self.load(clean_start(False, 8))
        new = sorted((int(p), int(t)) for pdf in rows for p, t in zip(pdf["pos"], pdf["token"]))
        out = [(key[0], pos, x) for pos, t in new for x in clean_step(s, t)]
        self.save(s)
        yield pd.DataFrame(out, columns=["stream", "pos", "token"])


def clean_stream(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("stream").transformWithStateInPandas(CleanStream(), "stream string, pos int, token int", "Append", "None")


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to be labelled: each key once, without those done."""
    return todo.dropDuplicates([key]).join(done.select(key), key, "left_anti")


def advanced(before: dict | None, after: dict | None) -> bool:
    """Whether a query moved between two reads of its progress."""
    return bool(before and after) and (after["batchId"] > before["batchId"] or after["numInputRows"] > 0)

"""Token layer: vocabulary, bar-relative encoding and decoding, document layouts, stream clean-up, augmentation.

Array functions are Column builders; encoding and decoding run in Arrow batches, one file a row.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.functions.notes import DRUMS, FAMILIES

# Header names, in vocabulary order: fixed values of the format.
SPECIALS = ["PAD_None", "BOS_None", "EOS_None", "SEP_None", "MASK_None"]
SOURCES = ["lakh", "lamd", "aria", "gigamidi", "maestro", "pop909", "giantmidi", "user", "fma"]
GENRES = ["rock", "pop", "jazz", "classical", "electronic", "hiphop", "rnb", "country", "folk", "latin", "blues", "metal", "reggae", "soul", "world", "other"]
HEADER_FAMILIES = ["Task_", "Inst_", "Density_", "Poly_", "Range_", "Tempo_", "Source_", "Genre_", "Quality_"]
METERS = [(n, d) for d, ns in ((2, (2, 3, 4)), (4, (1, 2, 3, 4, 5, 6, 7)), (8, (3, 5, 6, 7, 9, 12))) for n in ns]
POSITIONS, MOST_BEATS, DRUM_PITCHES = 8, 12, (27, 88)


def header_vocab() -> list[str]:
    groups = [("Task", ["accomp", "infill"]), ("Inst", [*FAMILIES, DRUMS]), ("Density", range(4)), ("Poly", range(3)), ("Range", range(3)), ("Tempo", range(7)), ("Source", SOURCES), ("Genre", GENRES), ("Quality", range(4))]
    return [f"{g}_{x}" for g, xs in groups for x in xs]


@functools.cache
def durations() -> tuple[tuple[int, int, int], ...]:
    """(beats, parts, parts in a beat): eighths of a beat below 4 beats, quarters below 12, and 12 beats."""
    short = [(b, p, 8) for b in range(4) for p in range(8)][1:]
    return (*short, *((b, p, 4) for b in range(4, 12) for p in range(4)), (12, 0, 4))


VELOCITIES = [(i + 1) * 127 // 32 for i in range(32)]


@functools.cache
def vocabulary() -> dict[str, int]:
    """Token to id; 598 tokens."""
    names = [*SPECIALS, *header_vocab(), "Bar_None", *(f"Pitch_{p}" for p in range(128)), *(f"Velocity_{v}" for v in VELOCITIES), *(f"Duration_{b}.{p}.{r}" for b, p, r in durations())]
    names += [*(f"Position_{i}" for i in range(POSITIONS * MOST_BEATS)), *(f"PitchDrum_{p}" for p in range(DRUM_PITCHES[0], DRUM_PITCHES[1] + 1)), *(f"Program_{p}" for p in range(-1, 128)), *(f"TimeSig_{n}/{d}" for n, d in METERS)]
    return {t: i for i, t in enumerate(names)}


def ids_of(prefix: str) -> list[int]:
    return [i for t, i in vocabulary().items() if t.startswith(prefix)]


def vocab_table(spark) -> DataFrame:
    return spark.createDataFrame([(t, i, t.split("_")[0]) for t, i in vocabulary().items()], "token string, id int, family string")


# ---- encoding ----


def _nearest(grid: list[int], x: int) -> int:
    """Index of the nearest grid value; the later one of two equally near."""
    k = bisect.bisect_left(grid, x)
    if k == len(grid) or (k and x - grid[k - 1] < grid[k] - x):
        k -= 1
    return k


def bars_of(meters: list[tuple[int, int, int]], end: int, tpq: int) -> list[tuple[int, int, int]]:
    """(start, num, den) of each bar up to `end`. A meter change inside a bar waits for the next bar line; of changes at one line the last holds."""
    meters = sorted(meters, key=lambda m: m[0])
    out, at, k, cur = [], 0, 0, (4, 4)
    while at <= end:
        while k < len(meters) and meters[k][0] <= at:
            cur = meters[k][1:]
            k += 1
        out.append((at, *cur))
        at += max(1, tpq * 4 // cur[1] * cur[0])
    return out


def encode(notes: list[tuple[int, int, int, int, int]], meters: list[tuple[int, int, int]], tpq: int) -> list[int]:
    """Ids of notes (program or -1 for drums, start, duration, pitch, velocity), given in track order.

    Times go to a grid of eight positions a beat, durations and velocities to the nearest of the vocabulary; notes
    outside the pitch ranges and meters outside the vocabulary are left out. Tracks of one program are merged.
    """
    v = vocabulary()
    ms = [m for m in meters if m[1:] in METERS] or [(0, 4, 4)]
    if min(m[0] for m in ms) > 0:
        ms = [(0, 4, 4), *ms]
    grid = POSITIONS * max(m[2] for m in ms) // 4
    scale = lambda t: int(t * grid / tpq + 0.5)
    ms = [(t * grid // tpq, n, d) for t, n, d in ms]
    order: dict[int, int] = {}
    for x in notes:
        order.setdefault(x[0], len(order))
    kept = []
    for i, (program, start, duration, pitch, velocity) in enumerate(notes):
        lo, hi = DRUM_PITCHES if program == -1 else (0, 127)
        if lo <= pitch <= hi:
            kept.append([scale(start), order[program], i, program, max(1, scale(duration)), pitch, velocity])
    if not kept:
        return []
    bars = bars_of(ms, max(k[0] for k in kept), grid)
    starts = [b[0] for b in bars]
    placed = []
    for t, o, i, program, duration, pitch, velocity in kept:
        b = bisect.bisect_right(starts, t) - 1
        step = max(1, grid * 4 // bars[b][2] // POSITIONS)
        t = starts[b] + round((t - starts[b]) / step) * step
        b = bisect.bisect_right(starts, t) - 1 if t < starts[-1] + max(1, grid * 4 // bars[-1][2] * bars[-1][1]) else len(bars)
        placed.append((t, o, i, program, duration, pitch, velocity, b))
    if max(p[-1] for p in placed) == len(bars):
        bars = bars_of(ms, max(p[0] for p in placed), grid)
        starts = [b[0] for b in bars]
        placed = [(*p[:-1], bisect.bisect_right(starts, p[0]) - 1) for p in placed]
    placed.sort()
    out, bar, tick, program = [], -1, None, None
    for t, _, _, prog, duration, pitch, velocity, b in placed:
        while bar < b:
            bar += 1
            out += [v["Bar_None"], v[f"TimeSig_{bars[bar][1]}/{bars[bar][2]}"]]
            tick = None
        beat = grid * 4 // bars[bar][2]
        if t != tick:
            out.append(v[f"Position_{(t - starts[bar]) // max(1, beat // POSITIONS)}"])
            tick = t
        if prog != program:
            out.append(v[f"Program_{prog}"])
            program = prog
        ticks = [(n * r + p) * beat // r for n, p, r in durations()]
        n, p, r = durations()[_nearest(ticks, duration)]
        out += [v[f"{'PitchDrum' if prog == -1 else 'Pitch'}_{pitch}"], v[f"Velocity_{VELOCITIES[_nearest(VELOCITIES, velocity)]}"], v[f"Duration_{n}.{p}.{r}"]]
    return out


GRID = 16  # ticks of a quarter in decoded scores


@functools.cache
def _parts() -> list[tuple[str, str]]:
    """Family and value of each id."""
    return [(k, v) for k, _, v in (t.partition("_") for t in vocabulary())]


def decode_start() -> dict:
    """The state of a stream of which no token has come: plain values only, so that it can be stored."""
    return {"bar": 0, "length": 4 * GRID, "at": 0, "program": 0, "beat": GRID, "first": True, "open": []}


def decode_step(s: dict, token: int) -> tuple[int, int, int, int, int] | None:
    """The note (program, start, duration, pitch, velocity) that a token completes, if any; moves the state on."""
    kind, value = _parts()[token]
    if (kind, len(s["open"])) == ("Velocity", 1):
        s["open"].append(int(value))
        return None
    begun, s["open"] = s["open"], []
    if (kind, len(begun)) == ("Duration", 2):
        n, p, r = map(int, value.split("."))
        return s["program"], s["at"], (n * r + p) * s["beat"] // r, begun[0], begun[1]
    if kind == "Bar":
        s["bar"] = 0 if s["first"] else s["bar"] + s["length"]
        s["at"], s["first"] = s["bar"], False
    elif kind == "TimeSig":
        n, d = map(int, value.split("/"))
        s["beat"] = GRID * 4 // d
        s["length"] = s["beat"] * n
    elif kind == "Position":
        s["at"] = s["bar"] + int(value) * (s["beat"] // POSITIONS or 1)
    elif kind == "Program":
        s["program"] = int(value)
    elif kind in ("Pitch", "PitchDrum"):
        s["open"] = [int(value)]
    return None


def decode(ids: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Notes (program, start, duration, pitch, velocity) on GRID ticks a quarter; header and special tokens, and notes without velocity and duration behind them, are passed over."""
    s = decode_start()
    return [n for t in ids if (n := decode_step(s, t))]


def encode_files(scores: DataFrame) -> DataFrame:
    """(file_id, ids) of scores: file_id, tpq, meters array<struct<time,num,den>>, notes array<struct<program,start,duration,pitch,velocity>>."""
    kind = scores.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [encode([tuple(n[c] for c in ("program", "start", "duration", "pitch", "velocity")) for n in notes], [(m["time"], m["num"], m["den"]) for m in meters], int(tpq)) for tpq, meters, notes in zip(b["tpq"], b["meters"], b["notes"])]
            yield pd.DataFrame({"file_id": b["file_id"], "ids": ids})

    return scores.select("file_id", "tpq", "meters", "notes").mapInPandas(run, f"file_id {kind}, ids array<int>")


def decode_files(docs: DataFrame) -> DataFrame:
    """One row for each decoded note of (file_id, ids)."""
    kind = docs.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(f, i, *n) for f, ids in zip(b["file_id"], b["ids"]) for i, n in enumerate(decode(list(ids)))], columns=["file_id", "note_idx", "program", "start", "duration", "pitch", "velocity"])

    return docs.select("file_id", "ids").mapInPandas(run, f"file_id {kind}, note_idx int, program int, start int, duration int, pitch int, velocity int")


# ---- layouts and array functions ----


def _id(name: str) -> Column:
    return F.lit(vocabulary()[name])


def _arr(*cols: Column) -> Column:
    return F.array(*cols)


def continuation(header: Column, body: Column, end: bool = True) -> Column:
    return F.concat(_arr(_id("BOS_None")), header, body, *([_arr(_id("EOS_None"))] if end else []))


def accompaniment(header: Column, cond: Column, target: Column | None = None, end: bool = False) -> Column:
    parts = [_arr(_id("BOS_None"), _id("Task_accomp")), header, cond, _arr(_id("SEP_None"))] + ([target] if target is not None else [])
    return F.concat(*parts, *([_arr(_id("EOS_None"))] if end else []))


def infill(header: Column, prefix: Column, suffix: Column, middle: Column | None = None, end: bool = False) -> Column:
    parts = [_arr(_id("BOS_None"), _id("Task_infill")), header, prefix, _arr(_id("MASK_None")), suffix, _arr(_id("SEP_None"))] + ([middle] if middle is not None else [])
    return F.concat(*parts, *([_arr(_id("EOS_None"))] if end else []))


def _in(x: Column, ids: list[int]) -> Column:
    return x.between(min(ids), max(ids)) if len(ids) == max(ids) - min(ids) + 1 else x.isin(*ids)


def _header_ids() -> list[int]:
    return [vocabulary()[n] for n in header_vocab()]


def split_header(ids: Column) -> tuple[Column, Column]:
    """(header, rest) of ids that begin right after BOS."""
    stop = F.array_position(F.transform(ids, lambda x: _in(x, _header_ids()).cast("int")), 0)
    n = F.when(stop == 0, F.size(ids)).otherwise(stop - 1).cast("int")
    return F.slice(ids, F.lit(1), n), F.slice(ids, n + 1, F.size(ids))


def count_bars(ids: Column) -> Column:
    return F.size(F.filter(ids, lambda x: x == _id("Bar_None")))


def ends_on_bar_line(ids: Column) -> Column:
    """Whether the last token that is neither header nor BOS is a Bar, with or without its TimeSig."""
    tail = F.filter(ids, lambda x: ~_in(x, _header_ids()) & (x != _id("BOS_None")))
    last = F.try_element_at(tail, F.lit(-1))
    sig = _in(last, ids_of("TimeSig_"))
    return F.coalesce(F.when(sig, F.try_element_at(tail, F.lit(-2)) == _id("Bar_None")).otherwise(last == _id("Bar_None")), F.lit(False))


def pad_to_bars(ids: Column, n: Column, meter: Column | None = None) -> Column:
    """Empty bars appended until there are n, in the first meter of ids (without one: `meter`, else 4/4); more than n is an error."""
    have = count_bars(ids)
    own = F.try_element_at(F.filter(ids, lambda x: _in(x, ids_of("TimeSig_"))), F.lit(1))
    sig = F.coalesce(own, *([meter] if meter is not None else []), _id("TimeSig_4/4"))
    more = F.when(have > n, F.raise_error(F.concat(F.lit("prompt spans "), have.cast("string"), F.lit(" bars > "), n.cast("string"))).cast("int")).otherwise(n - have).cast("int")
    return F.concat(ids, F.flatten(F.array_repeat(F.array(_id("Bar_None"), sig), more)))


def close_bar(ids: Column) -> Column:
    return F.when(ends_on_bar_line(ids), ids).otherwise(pad_to_bars(ids, count_bars(ids) + 1))


def fit_to_context(ids: Column, new: Column, most: int, least: int = 256) -> tuple[Column, Column]:
    """(prompt, new tokens) that fit the context together; the prompt's head is kept."""
    keep = F.least(F.lit(least), F.size(ids), F.lit(most // 2))
    n = F.greatest(F.lit(0), F.least(new, F.lit(most) - keep)).cast("int")
    return F.slice(ids, F.lit(1), F.least(F.size(ids), F.lit(most) - n).cast("int")), n


def token_budget(cond: Column, bars: Column) -> Column:
    """Room for an accompaniment: twice the condition's tokens a bar, at least 160, and 64 more."""
    return (F.greatest(F.lit(160.0), 2 * cond / F.greatest(F.lit(1), bars)) * bars).cast("int") + 64


def infill_budget(tokens: Column, ctx_bars: Column, bars: Column) -> Column:
    return (F.greatest(F.lit(64.0), 2 * (tokens / F.greatest(F.lit(1), ctx_bars))) * bars).cast("int") + 64


def bar_positions(ids: Column) -> Column:
    """0-based places of the Bar tokens."""
    return F.filter(F.transform(ids, lambda x, i: F.when(x == _id("Bar_None"), i)), lambda i: i.isNotNull())


def split_bars(ids: Column, at: Column, n: Column) -> tuple[Column, Column]:
    """(prefix, suffix) around bars at .. at + n - 1, without header and BOS; too few bars is an error."""
    body = F.filter(ids, lambda x: ~_in(x, _header_ids()) & (x != _id("BOS_None")))
    edges = bar_positions(body)
    ok = at + n <= F.size(edges)
    lo = F.when(ok, F.try_element_at(edges, (at + 1).cast("int"))).otherwise(F.raise_error(F.concat(F.lit("segment has "), F.size(edges).cast("string"), F.lit(" bars"))).cast("int"))
    hi = F.coalesce(F.try_element_at(edges, (at + n + 1).cast("int")), F.size(body))
    return F.slice(body, F.lit(1), lo.cast("int")), F.slice(body, (hi + 1).cast("int"), F.size(body))


def bar_groups(ids: Column) -> Column:
    """The tokens of each bar, without the Bar tokens; what stands before the first Bar is a group of its own. Empty bars are left out."""
    joined = F.array_join(F.transform(ids, lambda x: F.when(x == _id("Bar_None"), F.lit("|")).otherwise(x.cast("string"))), " ")
    return F.filter(F.transform(F.split(joined, r"\|"), lambda s: F.trim(s)), lambda s: s != "")


def loop_metrics(ids: Column) -> Column:
    """struct(adjacent_identical, distinct_fraction, n_bars), null below three bars."""
    g = bar_groups(ids)
    n = F.size(g)
    same = F.size(F.filter(F.arrays_zip(F.slice(g, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(g, F.lit(2), n).alias("b")), lambda s: s["a"] == s["b"]))
    return F.when(n >= 3, F.struct((same / (n - 1)).alias("adjacent_identical"), (F.size(F.array_distinct(g)) / n).alias("distinct_fraction"), n.alias("n_bars")))


def filled_program(ids: Column) -> Column:
    """The program in force at each token (0 before the first)."""
    progs = ids_of("Program_")
    lo = min(progs)
    step = lambda acc, x: F.concat(acc, F.array(F.when(_in(x, progs), x - lo - 1).otherwise(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))))
    return F.aggregate(ids, F.array().cast("array<int>"), step)


@functools.cache
def _token_classes() -> dict[str, np.ndarray]:
    """For each id of the vocabulary: whether it is a pitch, velocity or program, and for pitches the room to the ends of their range."""
    n = len(vocabulary())
    of = lambda p: np.array(ids_of(p))
    out = {k: np.zeros(n, bool) for k in ("pitch", "velocity", "program")} | {k: np.zeros(n, np.int64) for k in ("down", "up")}
    out["velocity"][of("Velocity_")] = out["program"][of("Program_")] = True
    for p in ("Pitch_", "PitchDrum_"):
        x = of(p)
        out["pitch"][x], out["down"][x], out["up"][x] = True, x - x.min(), x.max() - x
    return out


def augment_batch(ids: np.ndarray, sizes: np.ndarray, shift: np.ndarray, jitter: np.ndarray) -> np.ndarray:
    """The ids of many streams, laid end to end, augmented by each stream's own shift and jitter.

    Pitches outside drum stretches move by the shift as far as the stream's lowest and highest of them leave room,
    velocities by the jitter within their range. A stretch goes from one Program (or the stream's start) to the next.
    """
    if not len(ids):
        return ids
    c, stream = _token_classes(), np.repeat(np.arange(len(sizes)), sizes)
    begins = np.flatnonzero(c["program"][ids] | np.concatenate([[True], stream[1:] != stream[:-1]]))
    drums = np.repeat(ids[begins] == vocabulary()["Program_-1"], np.diff(np.append(begins, len(ids))))
    moves = c["pitch"][ids] & ~drums
    room = np.iinfo(np.int64).max
    down, up = np.full(len(sizes), room), np.full(len(sizes), room)
    np.minimum.at(down, stream[moves], c["down"][ids[moves]])
    np.minimum.at(up, stream[moves], c["up"][ids[moves]])
    by = np.clip(shift, -down, up)
    velocity = c["velocity"][ids]
    lo, hi = min(ids_of("Velocity_")), max(ids_of("Velocity_"))
    return ids + np.where(moves, by[stream], 0) + np.where(velocity, np.clip(ids + jitter[stream], lo, hi) - ids, 0)


def shift_and_jitter(ids: np.ndarray, shift: int, jitter: int) -> np.ndarray:
    """augment_batch of one stream."""
    x = np.asarray(ids, dtype=np.int64)
    return augment_batch(x, np.array([len(x)]), np.array([shift]), np.array([jitter]))


def augmented(docs: DataFrame, most_shift: int = 6, most_jitter: int = 1, seed: int = 0) -> DataFrame:
    """(file_id, ids) augmented by a draw that depends on file and seed only; null ids stay null."""
    kind = docs.schema["file_id"].dataType.simpleString()
    draw = lambda most, salt: (F.pmod(F.xxhash64("file_id", F.lit(seed), F.lit(salt)), F.lit(2 * most + 1)) - most).alias(salt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("ids")
            sizes = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            out = augment_batch(col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes, b.column("shift").to_numpy(), b.column("jitter").to_numpy())
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(out.astype(np.int32)), mask=col.is_null())
            yield pa.RecordBatch.from_arrays([b.column("file_id"), ids], names=["file_id", "ids"])

    return docs.select("file_id", "ids", draw(most_shift, "shift"), draw(most_jitter, "jitter")).mapInArrow(run, f"file_id {kind}, ids array<int>")


# What becomes of a sampled token, by the state of the stream and the token's class. States: `line` (nothing given out
# yet, the prompt ends on a bar line), `open` (nothing yet, the prompt's last bar is open), `bar` and `sig` (a Bar, and
# a Bar with its TimeSig, wait for a first note), `body`. Actions: pass over, keep back, give out, give out all kept.
CLEAN = {
    ("line", "bar"): ("line", "pass"), ("line", "sig"): ("line", "pass"), ("line", "other"): ("body", "give"),
    ("open", "bar"): ("bar", "keep"), ("open", "sig"): ("open", "pass"), ("open", "other"): ("body", "give"),
    ("bar", "bar"): ("bar", "pass"), ("bar", "sig"): ("sig", "keep"), ("bar", "other"): ("body", "release"),
    ("sig", "bar"): ("sig", "pass"), ("sig", "sig"): ("sig", "pass"), ("sig", "other"): ("body", "release"),
    ("body", "bar"): ("body", "count"), ("body", "sig"): ("body", "give"), ("body", "other"): ("body", "give"),
}


@functools.cache
def _clean_class() -> dict[int, str]:
    v = vocabulary()
    ends = {v["EOS_None"]: "eos", v["Bar_None"]: "bar"} | {v[f"{x}_None"]: "stop" for x in ("SEP", "MASK", "BOS")}
    return dict.fromkeys(ids_of("TimeSig_"), "sig") | ends


def clean_start(on_bar_line: bool, stop_after: int | None = None, trim: bool = True) -> dict:
    """The state of a stream of which no token has come. Plain values only, so that it can be stored."""
    return {"at": ("line" if on_bar_line else "open") if trim else "body", "kept": [], "bars": int(bool(stop_after) and on_bar_line), "most": stop_after or 0}


def clean_step(s: dict, token: int) -> list[int]:
    """What is given out for a token; moves the state on."""
    kind = _clean_class().get(token, "other")
    if s["at"] == "done":
        return []
    if kind in ("eos", "stop"):
        s["at"] = "done"
        return [token] if kind == "eos" else []
    s["at"], action = CLEAN[s["at"], kind]
    if action == "keep":
        s["kept"].append(token)
    if action == "count" or (action == "release" and s["kept"]):
        s["bars"] += 1
        if action == "count" and 0 < s["most"] < s["bars"]:
            s["at"] = "done"
            return []
    if action == "release":
        kept, s["kept"] = s["kept"], []
        return [*kept, token]
    return [token] if action in ("give", "count") else []


def clean_stream(on_bar_line: bool, raw: list[int], stop_after: int | None = None, trim: bool = True) -> list[int]:
    """What a caller gets of sampled ids: EOS ends it and is kept, SEP, MASK and BOS end it; leading empty bars are swallowed, but for the one that closes an open prompt bar; the bar after `stop_after` ends it."""
    s = clean_start(on_bar_line, stop_after, trim)
    return [x for t in raw for x in clean_step(s, t)]


def drop_families(header: Column, key: Column, p_family: float, p_all: float) -> Column:
    """Header without dropped families: all at once with p_all, each with p_family; Task_ always stays. Draws are hashes of key."""
    u = lambda salt: F.pmod(F.xxhash64(key, salt), F.lit(1_000_000)) / F.lit(1e6)
    names = header_vocab()
    fam = {v: HEADER_FAMILIES.index(n.split("_")[0] + "_") for n, v in ((n, vocabulary()[n]) for n in names)}
    lookup = F.array(*(F.lit(fam[i]) for i in sorted(fam)))
    base = min(fam)
    f = lambda x: F.element_at(lookup, (x - base + 1).cast("int"))
    return F.filter(header, lambda x: (f(x) == 0) | ((u(F.lit(-1)) >= p_all) & (u(f(x)) >= p_family)))


def sort_header(names: Column) -> Column:
    """Header names in family order, stable within a family; a name of no family is an error."""
    fams = F.array(*map(F.lit, HEADER_FAMILIES))
    rank = lambda n: F.array_position(fams, F.concat(F.substring_index(n, "_", 1), F.lit("_")))
    s = F.array_sort(F.transform(names, lambda n, i: F.struct(F.when(rank(n) == 0, F.raise_error(F.concat(F.lit("not a header token: "), n)).cast("bigint")).otherwise(rank(n)).alias("r"), i.alias("i"), n.alias("n"))))
    return F.transform(s, lambda x: x["n"])


# ---- names ----

# Instrument names in use and their families: fixed values.
ALIASES = {
    "acoustic piano": "Piano", "electric piano": "Piano", "keys": "Piano", "keyboard": "Piano", "rhodes": "Piano", "chromatic percussion": "ChromPerc", "vibraphone": "ChromPerc", "electric guitar": "Guitar", "acoustic guitar": "Guitar",
    "electric bass": "Bass", "bassline": "Bass", "sub": "Bass", "808": "Bass", "string section": "Strings", "violin": "Strings", "cello": "Strings", "choir": "Ensemble", "horns": "Brass", "trumpet": "Brass", "sax": "Reed", "saxophone": "Reed", "clarinet": "Reed",
    "flute": "Pipe", "lead": "SynthLead", "synth": "SynthLead", "pad": "SynthPad", "synth bass": "Bass", "fx": "SynthFX", "sound effects": "SoundFX", "percussion": "Percussive", "drum": "Drums", "drum kit": "Drums", "beat": "Drums",
}
AUTO = ("", "auto", "any", "none", "original", "model")


def resolve_family(name: Column) -> Column:
    """Family of an instrument name whatever its case and separators; null if unknown."""
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum())
    m = {plain(f): f for f in [*FAMILIES, DRUMS]} | {plain(k): v for k, v in ALIASES.items()}
    return F.create_map(*(F.lit(x) for kv in m.items() for x in kv))[F.regexp_replace(F.lower(name), "[^0-9a-z]", "")]


def pitch_name(pitch: Column) -> Column:
    """C4 for 60."""
    names = F.array(*map(F.lit, ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]))
    return F.concat(F.element_at(names, (F.pmod(pitch, F.lit(12)) + 1).cast("int")), (F.floor(pitch / 12) - 1).cast("string"))


#: Percussion voices of General MIDI that have a name; any other is Perc with its key number.
GM_DRUMS = {35: "Kick", 36: "Kick", 37: "Rim", 38: "Snare", 39: "Clap", 40: "Snare", 41: "TomLo", 42: "HatClosed", 43: "TomLo", 44: "HatPedal", 45: "TomMid", 46: "HatOpen", 47: "TomMid", 48: "TomHi", 49: "Crash", 50: "TomHi", 51: "Ride", 53: "Bell", 55: "Splash", 57: "Crash", 59: "Ride"}


def drum_name(pitch: Column) -> Column:
    """Kick for 35."""
    names = F.create_map(*(F.lit(x) for kv in GM_DRUMS.items() for x in kv))
    return F.coalesce(F.try_element_at(names, pitch.cast("int")), F.concat(F.lit("Perc"), pitch.cast("string")))


def with_instruments(names: Column, families: Column) -> Column:
    """The header with its Inst_ names replaced by the families, once each, in canonical order, at most six; an unknown family is an error."""
    order = F.array(*map(F.lit, [*FAMILIES, DRUMS]))
    rank = lambda f: F.array_position(order, f)
    ranked = F.array_sort(F.transform(F.array_distinct(families), lambda f: F.struct(F.when(rank(f) == 0, F.raise_error(F.concat(F.lit("not an instrument family: "), f)).cast("bigint")).otherwise(rank(f)).alias("r"), f.alias("f"))))
    inst = F.slice(F.transform(ranked, lambda x: F.concat(F.lit("Inst_"), x["f"])), 1, 6)
    return sort_header(F.concat(inst, F.filter(names, lambda n: ~n.startswith("Inst_"))))


def shift_clipped(ids: np.ndarray, shift: int, jitter: int) -> np.ndarray:
    """The older augmentation: every pitched note moves by itself and stays within 0..127, drums keep their pitches."""
    pitch, vel = np.array(ids_of("Pitch_")), np.array(ids_of("Velocity_"))
    a = np.asarray(ids)
    out = np.where(np.isin(a, pitch), np.clip(a + shift, pitch[0], pitch[-1]), a)
    return np.where(np.isin(a, vel), np.clip(out + jitter, vel[0], vel[-1]), out)


def load_scheme(text: str) -> str:
    """The scheme a tokenizer file names: bars (with SEP and MASK specials) or events. The bar scheme's vocabulary must be this module's."""
    import json

    d = json.loads(text)
    c = d.get("config") or {}
    names = {str(s).split("_")[0] for s in c.get("special_tokens") or []}
    if not {"SEP", "MASK"} <= names:
        return "events"
    if list(c["special_tokens"]) != [*SPECIALS, *header_vocab()] or c.get("num_velocities", 32) != 32:
        raise ValueError("a bar vocabulary other than this one")
    return "bars"

"""Small rules about files, spans, names and prompts, as Column builders and one-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.functions import notes as N
from partita.functions import tokens as T
from partita.operators.corpus import sha1_mod
from partita.tables import with_totals

MOST_SPAN, CONTEXT, MOST_NOTES = 4, 16, 600
# Data-issue flags a rater may set: fixed values.
FLAGS = ("junk", "wrong_instruments", "drums_as_piano", "timing", "truncated", "empty", "clipped", "bad_prompt")


def degeneracy(notes: DataFrame) -> DataFrame:
    """file_id, n_notes, top_pitch_share, repetition, degenerate, badness of continuations; repetition counts pitched notes, from 8 notes on."""
    p = notes.groupBy("file_id", "pitch").agg(F.count(F.lit(1)).alias("c")).groupBy("file_id").agg(F.sum("c").alias("n"), (F.max("c") / F.sum("c")).alias("top"))
    x = p.join(N.repetition(notes), "file_id", "left").withColumn("rep", F.when(F.col("n") >= 8, F.coalesce("repetition_rate", F.lit(0.0))).otherwise(0.0))
    n, top, rep = F.col("n"), F.col("top"), F.col("rep")
    bad = F.when(n < 8, (8 - n) / F.lit(8.0)).otherwise(0.0) + F.greatest(F.lit(0.0), top - 0.3) + F.greatest(F.lit(0.0), rep - 0.3) + F.when(n > MOST_NOTES, 1.0).otherwise(0.0)
    return x.select("file_id", n.alias("n_notes"), top.alias("top_pitch_share"), rep.alias("repetition"), ((n < 8) | (top > 0.5) | (rep > 0.6) | (n > MOST_NOTES)).alias("degenerate"), bad.alias("badness"))


def velocity_scale(peak: Column, target: int = 118) -> Column:
    """One gain for a pair, from its prompt's loudest note: 1 to 3."""
    return F.when(peak.isNull(), 1.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(3.0), F.lit(float(target)) / F.greatest(peak, F.lit(1)))))


def scaled_velocity(velocity: Column, scale: Column) -> Column:
    return F.when(scale <= 1, velocity).otherwise(F.greatest(F.lit(1), F.least(F.lit(127), F.bround(velocity * scale).cast("int"))))


def context_window(bars: Column, start: Column, span: Column, most: int = CONTEXT) -> tuple[Column, Column]:
    """[b0, b1): at most `most` bars with the span as near the middle as the file allows."""
    ctx = F.least(F.lit(most), bars)
    b0 = F.greatest(F.lit(0), F.least(start - F.floor((ctx - span) / 2), bars - ctx))
    return b0, b0 + ctx


def span_problem(bars: Column, start: Column, span: Column) -> Column:
    """Why a span can't be filled anew, or null: 1 to 4 bars, with a kept bar on each side."""
    valid = F.when(bars - span - 1 >= 1, F.concat(F.lit("start=1.."), (bars - span - 1).cast("string"))).otherwise("none: the upload is too short")
    return F.when(~span.between(1, MOST_SPAN), F.concat(F.lit("bars="), span.cast("string"))).when((start < 1) | (start + span > bars - 1), valid)


def track_spec(raw: Column) -> Column:
    """struct(kind, tracks, error) of "2", "0,2", "all" and "auto"; blank is auto."""
    s = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    parts = F.filter(F.split(s, ","), lambda x: F.trim(x) != "")
    ok = (F.size(parts) > 0) & F.forall(parts, lambda x: F.trim(x).rlike(r"^[+-]?\d{1,9}$"))
    kind = F.when(s.isin("", "auto"), "auto").when(s == "all", "all").when(ok, "list").otherwise("error")
    return F.struct(kind.alias("kind"), F.when(kind == "list", F.transform(parts, lambda x: F.try_to_number(F.regexp_replace(F.trim(x), r"^\+", ""), F.lit("S999999999")).cast("int"))).alias("tracks"), F.when(kind == "error", F.concat(F.lit("not a track: "), raw)).alias("error"))


def portable_path(path: Column, home: str) -> Column:
    """The path with the home folder written as ~."""
    return F.when(path.startswith(home.rstrip("/") + "/"), F.concat(F.lit("~"), F.substring(path, len(home.rstrip("/")) + 1, 1 << 20))).otherwise(path)


def safe_name(name: Column, most: int = 40) -> Column:
    """Letters, digits, _ and - of a file's stem, other runs as one _; seed if nothing is left."""
    stem = F.regexp_extract(F.regexp_extract(name, r"([^/]*)$", 1), r"^(.*?)(\.[^.]*)?$", 1)
    s = F.substring(F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", ""), 1, most)
    return F.when(s == "", "seed").otherwise(s)


def weight_spec(spec: Column) -> Column:
    """map of "k:v,k:v"."""
    return F.transform_values(F.str_to_map(F.regexp_replace(spec, r"\s+", ""), F.lit(","), F.lit(":")), lambda k, v: F.try_to_number(v, F.lit("S99999.99999")).cast("double"))


def log_partition(ts: Column) -> tuple[Column, Column]:
    """(YYYY-MM-DD, HHMMSS) of a log folder."""
    return F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "HHmmss")


def score_text(abc: Column) -> Column:
    """The lines of an ABC text that carry music, key and meter; null if none is left."""
    keep = F.filter(F.split(abc, "\n"), lambda x: ~(x.startswith("T:") | x.startswith("X:") | x.startswith("%%")) & (F.trim(x) != ""))
    return F.nullif(F.trim(F.array_join(keep, "\n")), F.lit(""))


def judge_prompt(mode: Column, context: Column, first: Column, second: Column) -> Column:
    """The request to a judge by mode; unknown modes are asked as continuations."""
    ask = F.when(mode == "accompany", "Which accompaniment fits the given part better?").when(mode == "infill", "Which filling fits the bars around it better?").otherwise("Which continuation is better?")
    return F.format_string("%s\n\nGIVEN:\n%s\n\n1:\n%s\n\n2:\n%s\n\nAnswer with JSON: {\"winner\": \"1\", \"2\" or \"tie\", \"reason\": \"...\"}", ask, F.coalesce(context, F.lit("")), F.coalesce(first, F.lit("")), F.coalesce(second, F.lit("")))


def without_end(ids: Column, seconds: Column, under: float, kind: Column) -> Column:
    """Continuations of files shorter than `under` are fragments: they lose their EOS."""
    return F.when((kind == "continuation") & (seconds < under) & (F.try_element_at(ids, F.lit(-1)) == T._id("EOS_None")), F.slice(ids, F.lit(1), F.size(ids) - 1)).otherwise(ids)


def cut_prompt(ids: Column, n: int) -> Column:
    """The first n ids at most, ending before the last Position or Bar after the eighth; without one, n ids."""
    stops = [T.vocabulary()["Bar_None"], *T.ids_of("Position_")]
    at = F.array_max(F.filter(F.transform(F.slice(ids, 1, n), lambda x, i: F.when(x.isin(*stops) & (i > 8), i)), lambda i: i.isNotNull()))
    return F.slice(ids, F.lit(1), F.coalesce(at, F.lit(n)).cast("int"))


def fit_for_scoring(prompt: Column, cont: Column, most: int, least: int = 8) -> Column:
    """The continuation cut to what the context leaves beside the whole prompt; null below `least`."""
    room = F.least(F.size(cont), F.lit(most) - F.size(prompt))
    return F.when(room >= least, F.slice(cont, F.lit(1), F.greatest(room, F.lit(0)).cast("int")))


def reheaded(header: Column, body: Column, before: Column, need: int) -> Column:
    """BOS, header and body of exactly `need` ids; what is missing at a shard's end comes from the ids before the body."""
    x = F.concat(F.array(T._id("BOS_None")), header, body)
    short = F.greatest(F.lit(0), F.lit(need) - F.size(x))
    pad = F.slice(before, F.greatest(F.lit(1), F.size(before) - short + 1).cast("int"), F.least(short, F.size(before)).cast("int"))
    return F.slice(F.concat(x, pad), 1, need)


def window_start(anchors: Column, n: Column, window: int, anchored: float, key: Column) -> Column:
    """Where a training window of a shard of n tokens begins: with probability `anchored` at one of the anchors (document starts), if there are any, else at any place that leaves a window and its successor. Draws are hashes of key."""
    u = lambda salt: sha1_mod(F.concat(F.lit(salt), key))
    there = F.try_element_at(anchors, (u("a:") % F.greatest(F.size(anchors), F.lit(1)) + 1).cast("int"))
    return F.when((u("c:") / F.lit(1e6) < anchored) & (F.size(anchors) > 0), there).otherwise(u("p:") % (n - window))


def shard_weights(shards: DataFrame, mixture: dict[str, float], block: int) -> DataFrame:
    """name, prob: sampling weight by usable length, times the weight of the first key found in the name."""
    w = F.greatest(F.col("tokens") - block - 1, F.lit(0)).cast("double")
    f = F.lit(1.0)
    for key, v in reversed(list(mixture.items())):
        f = F.when(F.contains(F.col("name"), F.lit(key)), F.lit(float(v))).otherwise(f)
    x = shards.withColumn("w", w * f)
    return with_totals(x, t=F.sum("w")).select("name", (F.col("w") / F.col("t")).alias("prob"))


def densest_track(notes: DataFrame) -> DataFrame:
    """file_id, track_name: the track with the most notes, the first of equals."""
    c = notes.groupBy("file_id", "track_name").agg(F.count(F.lit(1)).alias("n"), F.min("note_idx").alias("i"))
    return c.groupBy("file_id").agg(F.max_by("track_name", F.struct("n", -F.col("i"))).alias("track_name"), F.max("n").alias("n"))


def piece_analysis(notes: DataFrame, tpq: int, bpm: float, skip: int = 8, least: float = 60.0) -> DataFrame:
    """file_id, secs, bars, notes, head, tail, empty, ok: density of the first and last quarter after the first `skip` bars, and bars without notes."""
    b = notes.withColumn("bar", F.floor(F.col("start") / (4 * tpq))).groupBy("file_id", "bar").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("start") + F.col("duration")).alias("e"))
    g = b.groupBy("file_id").agg((F.max("bar") + 1).alias("bars"), F.sum("c").alias("notes"), (F.max("e") / F.lit(float(tpq)) * F.lit(60.0 / bpm)).alias("secs"))
    x = b.join(g, "file_id").withColumn("q", F.greatest(F.lit(4), F.floor(F.col("bars") / 4)))
    top, lo = F.least("bars", F.lit(skip) + F.col("q")), F.greatest(F.lit(skip), F.col("bars") - F.col("q"))
    y = x.groupBy("file_id", "secs", "bars", "notes", "q").agg(
        F.sum(F.when((F.col("bar") >= skip) & (F.col("bar") < top), F.col("c")).otherwise(0)).alias("h"), F.sum(F.when(F.col("bar") >= lo, F.col("c")).otherwise(0)).alias("t"), F.count_if(F.col("bar") >= skip).alias("some"))
    long = F.col("bars") > 12
    head, tail = F.when(long, F.col("h") / (top - skip)).otherwise(0.0), F.when(long, F.col("t") / (F.col("bars") - lo)).otherwise(0.0)
    empty = F.greatest(F.lit(0), F.col("bars") - skip) - F.col("some")
    return y.select("file_id", "secs", "bars", "notes", head.alias("head"), tail.alias("tail"), empty.alias("empty"), ((F.col("secs") >= least) & (empty <= 1) & (tail >= 0.5 * head)).alias("ok"))


def note_roll(notes: DataFrame, seconds_per_tick: float, prompt_end: float) -> DataFrame:
    """file_id, t, d, pitch, drum, prompt: notes in seconds to the millisecond, with whether they belong to the prompt."""
    s = lambda c: F.floor(F.col(c) * F.lit(seconds_per_tick) * 1000 + 0.5) / F.lit(1000.0)
    return notes.select("file_id", "note_idx", s("start").alias("t"), s("duration").alias("d"), "pitch", F.col("is_drum").alias("drum"), (F.col("start") * F.lit(seconds_per_tick) < prompt_end).alias("prompt"))


def repair_counts(meta: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, stored, actual of rows whose stored count differs from the recomputed one."""
    return meta.join(actual, key).filter(~F.col("stored").eqNullSafe(F.col("actual"))).select(key, "stored", "actual")


def listed_order(sources: DataFrame) -> DataFrame:
    """Adds rank: those with work left first, by configured place, then the newest."""
    w = Window.orderBy(F.col("todo") == 0, F.coalesce("place", F.lit(1 << 30)), F.col("newest").desc(), "id")
    return sources.withColumn("rank", F.row_number().over(w))


def bars_spanned(notes: DataFrame, tpq: int) -> DataFrame:
    """file_id, bars: from the first onset to the last end, in bars of four beats."""
    return notes.groupBy("file_id").agg(((F.max(F.col("start") + F.col("duration")) - F.min("start")) / F.lit(4.0 * tpq)).alias("bars"))


def sampled_span(bars: Column, key: Column, most: int = MOST_SPAN) -> tuple[Column, Column]:
    """(start, length) of a gap by hash of key: 1 to `most` bars with a kept bar on each side; nulls for files under three bars."""
    u = lambda salt: F.pmod(F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(1_000_000_007))
    n = 1 + F.pmod(u("n"), F.greatest(F.lit(1), F.least(F.lit(most), bars - 2)))
    return F.when(bars >= 3, 1 + F.pmod(u("s"), F.greatest(F.lit(1), bars - n - 1))), F.when(bars >= 3, n)


def infill_report(sides: DataFrame) -> DataFrame:
    """empty_rate, short_rate, density_ratio, pc_fit: means over model sides, of the values that are numbers."""
    mean = lambda c: F.avg(F.when(~F.isnan(c), F.col(c)))
    return sides.agg(F.avg(F.col("empty").cast("double")).alias("empty_rate"), F.avg((~F.col("bars_ok")).cast("double")).alias("short_rate"), mean("density_ratio").alias("density_ratio"), mean("pc_fit").alias("pc_fit"))

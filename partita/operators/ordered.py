"""As-of and range joins, change-point maps, bar grids and window cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.operators.positions import at_share



def asof_join(left: DataFrame, right: DataFrame, keys: list[str], t: str, cols: list[str], bucket: int | None = None) -> DataFrame:
    """Each left row with the columns of the newest right row of its keys at or before t; nulls where there is none.

    Both sides have the time column t. Of right rows at one time the one with the greatest columns counts. The
    sides are unioned and filled forward in one window by keys. With `bucket`, the window is by keys and time
    bucket, and the last right row of earlier buckets comes from one row for each bucket, so that a hot key is
    spread over many tasks.
    """
    right = right.groupBy(*keys, t).agg(F.max(F.struct(*cols)).alias("_r"))
    both = left.select(*keys, t, F.struct(*(c for c in left.columns)).alias("_l"), F.lit(None).cast(right.schema["_r"].dataType).alias("_r"))
    both = both.unionByName(right.select(*keys, t, F.lit(None).cast(both.schema["_l"].dataType).alias("_l"), "_r"))
    order = [F.col(t), F.col("_l").isNotNull()]
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w))
    else:
        both = both.withColumn("_b", F.floor(F.col(t) / bucket))
        w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        last = both.groupBy(*keys, "_b").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col(t))).alias("_c"))
        before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        last = last.withColumn("_c", F.last("_c", ignorenulls=True).over(before))
        out = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).join(last, [*keys, "_b"]).withColumn("_r", F.coalesce("_r", "_c"))
    return out.filter("_l is not null").select("_l.*", *(F.col("_r")[c].alias(c) for c in cols))


def range_join(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, lo: str, hi: str, width: int) -> DataFrame:
    """Points with the intervals of their keys that hold lo <= t < hi.

    An equi-join on keys and time bucket of `width`; an interval is copied to each bucket it touches, so width
    should be about the usual length of an interval.
    """
    p = points.withColumn("_b", F.floor(F.col(t) / width))
    i = intervals.filter(F.col(hi) > F.col(lo)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    return p.join(i, [*keys, "_b"]).filter((F.col(t) >= F.col(lo)) & (F.col(t) < F.col(hi))).drop("_b")


def tempo_segments(tempos: DataFrame, tpq: int) -> DataFrame:
    """file_id, time, qpm, spt, base: tempo segments with the seconds before them. The first tempo also holds before its time; of tempos at one time the greatest counts."""
    w = Window.partitionBy("file_id").orderBy("time")
    t = tempos.filter("qpm > 0").groupBy("file_id", "time").agg(F.max("qpm").alias("qpm"))
    first = t.groupBy("file_id").agg(F.min("time").alias("m"), F.min_by("qpm", "time").alias("qpm")).filter("m > 0").select("file_id", F.lit(0).cast("long").alias("time"), "qpm")
    t = t.unionByName(first).withColumn("spt", F.lit(60.0) / (F.col("qpm") * tpq))
    t = t.withColumn("_s", (F.lead("time").over(w) - F.col("time")) * F.col("spt"))
    return t.withColumn("base", F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_s")


def seconds_of(points: DataFrame, tempos: DataFrame, tpq: int, t: str = "start") -> DataFrame:
    """Adds seconds: t through the piecewise-linear tempo map; 120 without any tempo."""
    seg = tempo_segments(tempos, tpq).withColumn("at", F.col("time")).withColumnRenamed("time", t)
    x = asof_join(points, seg, ["file_id"], t, ["at", "spt", "base"])
    return x.withColumn("seconds", F.when(F.col("at").isNull(), F.col(t) * F.lit(60.0 / (120.0 * tpq))).otherwise(F.col("base") + (F.col(t) - F.col("at")) * F.col("spt"))).drop("at", "spt", "base")


def ticks_of(points: DataFrame, tempos: DataFrame, tpq: int, seconds: str = "seconds") -> DataFrame:
    """Adds tick: the inverse of the tempo map, rounded down."""
    seg = tempo_segments(tempos, tpq).withColumn("sec0", F.col("base")).withColumnRenamed("base", seconds)
    x = asof_join(points, seg, ["file_id"], seconds, ["time", "spt", "sec0"])
    tick = F.when(F.col("time").isNull(), F.col(seconds) * F.lit(2.0 * tpq)).otherwise(F.col("time") + (F.col(seconds) - F.col("sec0")) / F.col("spt"))
    return x.withColumn("tick", F.floor(F.round(tick, 6))).drop("time", "spt", "sec0")


def bar_edges(ends: DataFrame, bar: int, end: str = "end") -> DataFrame:
    """file_id, bar, edge: bar lines of a constant meter from 0 until past the end."""
    return ends.select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col(end) / bar) + 1)).alias("bar")).withColumn("edge", F.col("bar") * bar)


def rebase(notes: DataFrame, lo: Column, hi: Column, tpq: int) -> DataFrame:
    """The notes that lie within [lo, hi - tpq/16), counted from lo; notes that ring past the end are dropped."""
    guard = max(1, tpq // 16)
    inside = (F.col("start") >= lo) & (F.col("start") + F.col("duration") <= hi - guard) & (F.col("start") < hi - guard)
    return notes.filter(inside).withColumn("start", F.col("start") - lo)


def cut_tail(notes: DataFrame, cut: Column) -> DataFrame:
    """Drops notes from `cut` on and shortens those that ring past it."""
    return notes.filter(F.col("start") < cut).withColumn("duration", F.least(F.col("duration"), cut - F.col("start")))


def trim_leading(notes: DataFrame) -> DataFrame:
    """Moves each file so that its first onset is at 0."""
    first = F.min("start").over(Window.partitionBy("file_id"))
    return notes.withColumn("start", F.col("start") - F.greatest(first, F.lit(0)))


def resample(notes: DataFrame, tpq: int, to: int) -> DataFrame:
    """Times on another tick rate, halves away from zero."""
    r = lambda c: (F.signum(F.col(c)) * F.floor(F.abs(F.col(c)) * to / F.lit(float(tpq)) + 0.5)).cast("long")
    return notes.withColumn("start", r("start")).withColumn("duration", F.greatest(r("duration"), F.lit(1)))


def overlay(a: DataFrame, b: DataFrame, tpq_a: int, tpq_b: int) -> DataFrame:
    """The tracks of b, on a's tick rate, beside those of a."""
    return a.unionByName(resample(b, tpq_b, tpq_a), allowMissingColumns=True)


def splice(score: DataFrame, fill: DataFrame, lo: Column, hi: Column, shift: Column) -> DataFrame:
    """The score with the stretch [lo, hi) replaced by fill's notes, moved by shift. Notes ringing into the stretch are cut at lo; fill's tracks go to the score's first track of the same instrument."""
    first = score.groupBy("file_id", "is_drum", "program").agg(F.min("track_name").alias("_t"))
    keep = score.filter((F.col("start") < lo) | (F.col("start") >= hi))
    keep = keep.withColumn("duration", F.when(F.col("start") < lo, F.least(F.col("duration"), lo - F.col("start"))).otherwise(F.col("duration")))
    new = fill.withColumn("start", F.col("start") + shift).filter((F.col("start") >= lo) & (F.col("start") < hi))
    new = new.withColumn("duration", F.least(F.col("duration"), hi - F.col("start"))).join(first, ["file_id", "is_drum", "program"], "left").withColumn("track_name", F.coalesce("_t", "track_name")).drop("_t")
    return keep.unionByName(new)


# Words that name drums anywhere, and those that need to stand alone: fixed values.
DRUM_WORDS = ("drum", "perc", "kick", "snare", "cymbal", "hihat", "hi-hat", "clap", "batter", "schlag")
DRUM_ALONE = ("drm", "kit", "hat", "tom", "beat", "808", "909")


def name_says_drums(name: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    return n.rlike("|".join(DRUM_WORDS)) | n.rlike(f"(?<![0-9a-z])({'|'.join(DRUM_ALONE)})(?![0-9a-z])")


def looks_like_drums(notes: DataFrame, least: int = 16) -> DataFrame:
    """file_id, track_name, drums: enough notes, few pitches, nearly all in the percussion range, with kick, snare and hat."""
    has = lambda *p: F.bool_or(F.col("pitch").isin(*p))
    ok = (F.count(F.lit(1)) >= least) & (F.count_distinct("pitch") <= 8) & (F.avg(F.col("pitch").between(35, 59).cast("double")) >= 0.85) & has(35, 36) & has(38, 40) & has(42, 44, 46)
    return notes.groupBy("file_id", "track_name").agg(ok.alias("drums"))


def normalize_drums(notes: DataFrame, file_name: Column) -> DataFrame:
    """Sets is_drum on tracks whose name says drums, whose file's name does if it is their only track, or that look like drums."""
    of = Window.partitionBy("file_id")
    t = looks_like_drums(notes).withColumn("_alone", F.count(F.lit(1)).over(of) == 1)
    x = notes.join(t, ["file_id", "track_name"])
    return x.withColumn("is_drum", F.col("is_drum") | name_says_drums(F.col("track_name")) | (name_says_drums(file_name) & F.col("_alone")) | F.col("drums")).drop("drums", "_alone")


PRESETS = {"strict": (0.60, 0.45, 0.90, 3, 3), "loose": (0.75, 0.60, 0.95, 2, 2)}
NOISE_DENSITY, NOISE_ENTROPY, WINDOW_SECONDS = 40.0, 3.2, 5.0


def degenerate_windows(notes: DataFrame, seconds: Column, preset: str = "strict", width: float = WINDOW_SECONDS) -> DataFrame:
    """file_id, win, n, degenerate: tumbling windows in which one pitch dominates, one onset gap repeats over few pitches, or dense noise plays. Windows under 8 notes never are."""
    top, top_rep, same, least, _ = PRESETS[preset]
    x = notes.withColumn("win", F.floor(seconds / F.lit(width)))
    by = ["file_id", "win"]
    pitch = x.groupBy(*by, "pitch").agg(F.count(F.lit(1)).alias("c"))
    tot = F.sum("c")
    pitch = pitch.groupBy(*by).agg(tot.alias("n"), (F.max("c") / tot).alias("top"), F.count(F.lit(1)).alias("pitches"), F.collect_list(F.col("c").cast("double")).alias("cs"))
    ons = x.select(*by, "start").distinct().withColumn("gap", F.col("start") - F.lag("start").over(Window.partitionBy(*by).orderBy("start")))
    gaps = ons.filter("gap is not null").groupBy(*by, "gap").agg(F.count(F.lit(1)).alias("c")).groupBy(*by).agg((F.max("c") / F.sum("c")).alias("same"))
    w = pitch.join(gaps, by, "left").fillna(1.0, ["same"])
    n = F.col("n")
    total = F.aggregate("cs", F.lit(0.0), lambda a, v: a + v)
    ent = F.aggregate(F.array_sort("cs"), F.lit(0.0), lambda a, v: a - v / total * F.log2(v / total))
    noise = (n / F.lit(width) > NOISE_DENSITY) & (ent < NOISE_ENTROPY)
    bad = (n >= 8) & (noise | (F.col("top") > top) | ((F.col("top") > top_rep) & (F.col("same") > same)) | (F.col("pitches") < least))
    return w.select(*by, "n", bad.alias("degenerate"))


def clean_score(windows: DataFrame, preset: str = "strict", width: float = WINDOW_SECONDS) -> DataFrame:
    """file_id, verdict, cut_seconds. The first bad window counts among the windows that have notes, as the cut is placed by that count."""
    keep = PRESETS[preset][4]
    r = windows.withColumn("r", F.row_number().over(Window.partitionBy("file_id").orderBy("win")) - 1)
    g = r.groupBy("file_id").agg(F.min(F.when(F.col("degenerate"), F.col("r"))).alias("first"))
    v = F.when(F.col("first").isNull(), "clean").when(F.col("first") < keep, "degenerate").otherwise(F.concat(F.lit("trimmed at "), (F.col("first") * width).cast("int").cast("string"), F.lit("s")))
    return g.select("file_id", v.alias("verdict"), F.when(F.col("first") >= keep, F.col("first") * F.lit(width)).alias("cut_seconds"))


LOOK_BACK = 24


def held_under(low: DataFrame, high: DataFrame, margin: int) -> DataFrame:
    """file_id, held: the share of high's onsets over a low note begun at least `margin` before and still sounding; of the low notes begun by then only the last 24 count.

    The ends of the last 24 low notes (by start and end) are carried as an array beside each low note, and each onset
    takes the array of the newest low note at or before onset - margin.
    """
    w = Window.partitionBy("file_id").orderBy("start", "end").rowsBetween(-LOOK_BACK + 1, 0)
    lo = low.select("file_id", "start", (F.col("start") + F.greatest("duration", F.lit(1))).alias("end"))
    lo = lo.withColumn("ends", F.collect_list("end").over(w)).withColumn("o", F.row_number().over(Window.partitionBy("file_id").orderBy("start", "end")))
    lo = lo.select("file_id", F.col("start").alias("t"), "o", "ends")
    hi = high.select("file_id", (F.col("start") - margin).alias("t"), F.col("start").alias("onset"), F.col("note_idx"))
    x = asof_join(hi, lo, ["file_id"], "t", ["o", "ends"])
    hit = F.coalesce(F.exists("ends", lambda e: e > F.col("onset")), F.lit(False))
    return x.groupBy("file_id").agg(F.avg(hit.cast("double")).alias("held"))


def split_hands(notes: DataFrame, tpq: int) -> DataFrame:
    """file_id, split, n_low, n_high, held, accepted: pitched notes split at the median pitch, kept within 50..67."""
    p = notes.filter(~F.col("is_drum"))
    mid = at_share(p, ["file_id"], "pitch", 0.5).select("file_id", F.greatest(F.lit(50), F.least(F.lit(67), F.col("pitch"))).alias("split"))
    x = p.join(mid, "file_id")
    low, high = x.filter("pitch < split"), x.filter("pitch >= split")
    n = x.groupBy("file_id", "split").agg(F.count_if(F.col("pitch") < F.col("split")).alias("n_low"), F.count_if(F.col("pitch") >= F.col("split")).alias("n_high"))
    a, b = held_under(low, high, tpq), held_under(high, low, tpq)
    y = n.join(a.withColumnRenamed("held", "ha"), "file_id", "left").join(b.withColumnRenamed("held", "hb"), "file_id", "left").fillna(0.0, ["ha", "hb"])
    held = F.greatest("ha", "hb")
    return y.select("file_id", "split", "n_low", "n_high", held.alias("held"), ((F.col("n_low") >= 4) & (F.col("n_high") >= 4) & (held >= 0.35)).alias("accepted"))


def excerpt_window(edges: DataFrame, target: float, seed: str = "0") -> DataFrame:
    """file_id, lo, hi: a start among the bars with at least `target` seconds left (by hash), and the edge nearest to start + target; the whole file up to target + 2 seconds. edges: file_id, bar, edge, seconds."""
    of = Window.partitionBy("file_id")
    e = edges.withColumn("total", F.max("seconds").over(of))
    can = e.filter((F.col("total") - F.col("seconds") >= target)).groupBy("file_id").agg(F.min_by(F.struct("bar", "edge", "seconds"), F.sha1(F.concat_ws(":", F.lit(seed), "file_id", "bar"))).alias("s"))
    x = e.join(can, "file_id").filter(F.col("bar") > F.col("s.bar"))
    pick = x.groupBy("file_id").agg(F.min_by(F.struct(F.col("s.edge").alias("lo"), F.col("edge").alias("hi")), F.struct(F.round(F.abs(F.col("seconds") - F.col("s.seconds") - target), 9), F.col("bar"))).alias("p"))
    whole = e.groupBy("file_id").agg(F.max("total").alias("total"), F.min("edge").alias("lo0"), F.max("edge").alias("hi0"))
    j = whole.join(pick, "file_id", "left")
    short = (F.col("total") <= target + 2.0) | F.col("p").isNull()
    return j.select("file_id", F.when(short, F.col("lo0")).otherwise(F.col("p.lo")).alias("lo"), F.when(short, F.col("hi0")).otherwise(F.col("p.hi")).alias("hi"))

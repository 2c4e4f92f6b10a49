"""Note-level metrics. Notes: file_id, track_name, program, is_drum, note_idx, start, duration, pitch, velocity.

Each function takes notes and gives one row for each file (or window); all are Catalyst expressions over one
grouping or one window by file. Order-sensitive metrics sort by (start, note_idx).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Krumhansl-Kessler key profiles and scale degrees: fixed values.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
SCALES = {"major": [0, 2, 4, 5, 7, 9, 11], "minor": [0, 2, 3, 5, 7, 8, 10]}
# General MIDI program families, eight programs each: fixed values.
FAMILIES = ["Piano", "ChromPerc", "Organ", "Guitar", "Bass", "Strings", "Ensemble", "Brass", "Reed", "Pipe", "SynthLead", "SynthPad", "SynthFX", "Ethnic", "Percussive", "SoundFX"]
DRUMS = "Drums"
MOST_FAMILIES = 6
# Bucket edges of the header tokens: fixed values.
DENSITY_EDGES, POLY_EDGES, RANGE_EDGES = (8, 24, 64), (1.5, 3.0), (24, 48)
TEMPO_EDGES = (70, 90, 110, 130, 150, 175)

def by_file():
    return Window.partitionBy("file_id").orderBy("start", "note_idx")



def events_as_notes(events: DataFrame) -> DataFrame:
    """The driver's events as notes: a user is a file, an event type a track, a second a tick."""
    program = F.create_map(*(F.lit(x) for kv in {"click": 0, "view": 33, "purchase": 48, "signup": 73, "error": 0}.items() for x in kv))[F.col("event_type")]
    return events.select(
        F.col("user_id").alias("file_id"), F.col("event_type").alias("track_name"), program.alias("program"), (F.col("event_type") == "error").alias("is_drum"), F.col("event_id").alias("note_idx"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").alias("start"), (1800 * (1 + F.col("event_id") % 8)).alias("duration"),
        (21 + F.floor("value").cast("long") % 88).alias("pitch"), (1 + F.get_json_object("props", "$.k").cast("long")).alias("velocity"),
    )


def bucketize(x: Column, edges: tuple) -> Column:
    """How many leading edges x has reached: the first bucket whose upper edge exceeds x."""
    return sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int")


def entropy_bits(counts: Column) -> Column:
    """Entropy of an array of counts, in bits; zeros add nothing."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.aggregate(counts, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0))).otherwise(0.0)


def file_stats(notes: DataFrame, seconds_per_tick: float) -> DataFrame:
    """Counts, length, distinct pitched pitches and the longest gap between onsets of each file."""
    gap = F.col("start") - F.lag("start").over(by_file())
    g = notes.withColumn("gap", gap).groupBy("file_id")
    return g.agg(
        F.count(F.lit(1)).alias("n_notes"), F.count_distinct("track_name").alias("n_tracks"), (F.max(F.col("start") + F.col("duration")) * F.lit(seconds_per_tick)).alias("duration_seconds"),
        F.count_distinct(F.when(~F.col("is_drum"), F.col("pitch"))).alias("pitched"), F.bool_or("is_drum").alias("has_drums"), (F.coalesce(F.max("gap"), F.lit(0)) * F.lit(seconds_per_tick)).alias("max_gap_seconds"),
    )


def clean_verdict(n_notes: Column, duration: Column, has_drums: Column | None = None, pitched: Column | None = None, max_gap: Column | None = None) -> Column:
    """The first test a file fails, or ok. Tests without their column are passed over; a duration of 0 is too dense."""
    rate = F.when(duration > 0, n_notes / duration).otherwise(F.lit(float("inf")))
    v = F.when(n_notes.isNull() | duration.isNull() | F.isnan(duration.cast("double")) | (duration < 0), "unparseable").when(n_notes < 32, "too_few_notes").when(duration > 1800, "too_long")
    if pitched is not None:
        v = v.when(~has_drums & (pitched < 2), "single_pitch_spam")
    v = v.when(rate < 0.3, "too_sparse").when(rate > 80, "too_dense")
    if max_gap is not None:
        v = v.when(max_gap > 30, "long_silence")
    return v.otherwise("ok")


def pitch_classes(notes: DataFrame) -> DataFrame:
    """file_id, hist: how many pitched notes each of the 12 pitch classes has; files with drums only have zeros."""
    pc = F.pmod("pitch", F.lit(12))
    return notes.groupBy("file_id").agg(F.array(*(F.sum(F.when(~F.col("is_drum") & (pc == k), 1).otherwise(0)).cast("double") for k in range(12))).alias("hist"))


def detect_key(hists: DataFrame) -> DataFrame:
    """Adds tonic and mode: the best correlated of 24 rotated profiles, the earliest of equals (tonics upward, major first). No notes: 0, major."""
    rows = [(2 * t + k, t, mode, [p[(i - t) % 12] for i in range(12)]) for t in range(12) for k, (mode, p) in enumerate((("major", MAJOR), ("minor", MINOR)))]
    profiles = F.array(*(F.struct(F.lit(o).alias("ord"), F.lit(t).alias("tonic"), F.lit(m).alias("mode"), F.array(*map(F.lit, p)).alias("profile")) for o, t, m, p in rows))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / 12
    total = F.aggregate("hist", F.lit(0.0), lambda s, x: s + x)
    share = F.when(total > 0, F.transform("hist", lambda x: x / total)).otherwise(F.col("hist"))
    x = hists.withColumn("_s", share).withColumn("_s", F.transform("_s", lambda v: v - mean(F.col("_s")))).withColumn("_k", F.explode(profiles)).select("*", "_k.*")
    x = x.withColumn("_p", F.transform("profile", lambda v: v - mean(F.col("profile"))))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot("_s", "_s")) * F.sqrt(dot("_p", "_p"))
    r = F.round(F.when(norm > 0, dot("_s", "_p") / norm).otherwise(0.0), 12)
    return x.groupBy("file_id").agg(F.first("hist").alias("hist"), F.max_by(F.struct("tonic", "mode"), F.struct(r, -F.col("ord"))).alias("k")).select("file_id", "hist", "k.tonic", "k.mode")


def scale_consistency(keys: DataFrame) -> DataFrame:
    """Adds scale_consistency: the share of pitched notes in the detected scale."""
    total = F.aggregate("hist", F.lit(0.0), lambda s, x: s + x)
    inside = lambda scale: F.aggregate(F.transform(F.array(*map(F.lit, scale)), lambda d: F.element_at("hist", (F.pmod(F.col("tonic") + d, F.lit(12)) + 1).cast("int"))), F.lit(0.0), lambda s, x: s + x)
    hit = F.when(F.col("mode") == "major", inside(SCALES["major"])).otherwise(inside(SCALES["minor"]))
    return keys.withColumn("scale_consistency", F.when(total > 0, hit / total).otherwise(0.0))


def polyphony(notes: DataFrame) -> DataFrame:
    """file_id, polyphony_prior, polyphony_counts: notes sounding at each onset, on average over pitched notes.

    prior: the note itself and the earlier notes (by start, note_idx) that end later than its start. counts: notes
    started at or before it less those ended at or before it, at least 1. Both come from running counts over the
    onsets and ends in time order, without a self-join.
    """
    p = notes.filter(~F.col("is_drum"))
    end = F.col("start") + F.col("duration")
    ons = p.select("file_id", F.col("start").alias("t"), F.lit(1).alias("k"), F.col("note_idx").alias("o"), F.lit(0).alias("z"))
    ends = p.select("file_id", end.alias("t"), F.when(F.col("duration") > 0, 0).otherwise(1).alias("k"), F.when(F.col("duration") > 0, 0).otherwise(F.col("note_idx")).alias("o"), F.lit(1).alias("z"))
    ev = ons.unionAll(ends)
    upto = Window.partitionBy("file_id").orderBy("t", "k", "o", "z").rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("file_id").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("prior", F.sum(F.when(F.col("z") == 0, 1).otherwise(-1)).over(upto)).withColumn("counts", F.sum(F.when(F.col("z") == 0, 1).otherwise(-1)).over(same))
    return ev.filter("z = 0").groupBy("file_id").agg(F.avg("prior").alias("polyphony_prior"), F.avg(F.greatest(F.col("counts"), F.lit(1))).alias("polyphony_counts"))


def repetition(notes: DataFrame, n: int = 4) -> DataFrame:
    """file_id, repetition_rate: the share of pitch n-grams that occur more than once; 0 below n notes."""
    w = by_file()
    p = notes.filter(~F.col("is_drum")).select("file_id", F.array(*(F.lead("pitch", i).over(w) for i in range(n))).alias("gram"))
    c = p.groupBy("file_id", "gram").agg(F.count(F.lit(1)).alias("c"))
    whole = F.element_at("gram", -1).isNotNull()
    return c.groupBy("file_id").agg(F.coalesce(F.sum(F.when(whole & (F.col("c") > 1), F.col("c"))) / F.sum(F.when(whole, F.col("c"))), F.lit(0.0)).alias("repetition_rate"))


def ioi_entropy(notes: DataFrame, tpq: int) -> DataFrame:
    """file_id, ioi_entropy: entropy of positive onset gaps in sixteenths, rounded half to even."""
    p = notes.filter(~F.col("is_drum")).select("file_id", (F.col("start") - F.lag("start").over(by_file())).alias("d"))
    b = F.when(F.col("d") > 0, F.bround(F.col("d") / F.lit(tpq / 4)))
    c = p.groupBy("file_id", b.alias("b")).agg(F.count(F.lit(1)).alias("c")).withColumn("c", F.when(F.col("b").isNotNull(), F.col("c")))
    return c.groupBy("file_id").agg(entropy_bits(F.array_sort(F.collect_list(F.col("c").cast("double")))).alias("ioi_entropy"))


def onset_alignment(notes: DataFrame, tpq: int, beats: int = 4) -> DataFrame:
    """file_id, downbeat_alignment (share of onsets within an eighth of a beat of beats 1 or 3), phrase_offset (beats from the first onset to the nearest bar line)."""
    bar = tpq * beats
    pos = F.pmod("start", F.lit(bar))
    strong = F.least(pos, bar - pos, F.abs(pos - 2 * tpq)) <= tpq / 8
    first = F.pmod(F.min("start"), F.lit(bar))
    return notes.groupBy("file_id").agg(F.avg(strong.cast("double")).alias("downbeat_alignment"), (F.least(first, bar - first) / F.lit(float(tpq))).alias("phrase_offset"))


def density_and_range(notes: DataFrame, seconds_per_tick: float) -> DataFrame:
    """file_id, note_density_hz, pitch_range, over pitched notes; 0 for files without any."""
    p = ~F.col("is_drum")
    n = F.count_if(p)
    end = F.max(F.when(p, F.col("start") + F.col("duration"))) * F.lit(seconds_per_tick)
    return notes.groupBy("file_id").agg(
        F.when(n > 0, n / F.greatest(end, F.lit(1e-6))).otherwise(0.0).alias("note_density_hz"),
        F.coalesce(F.max(F.when(p, F.col("pitch"))) - F.min(F.when(p, F.col("pitch"))), F.lit(0)).alias("pitch_range"),
    )


def bar_overlap(a: DataFrame, b: DataFrame, pair: list[str], tpq_a: int, tpq_b: int, beats: float = 4.0) -> DataFrame:
    """Mean Jaccard overlap of the pitch-class sets of common bars, each side on its own ticks; a, b: notes with the columns of pair."""
    bars = lambda n, tpq, s: n.filter(~F.col("is_drum")).groupBy(*pair, F.floor(F.col("start") / F.lit(tpq * beats)).alias("bar")).agg(F.collect_set(F.pmod("pitch", F.lit(12))).alias(s))
    both = bars(a, tpq_a, "x").join(bars(b, tpq_b, "y"), [*pair, "bar"])
    return both.groupBy(*pair).agg(F.avg(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("overlap"), F.count(F.lit(1)).alias("bars"))


def family(program: Column, is_drum: Column) -> Column:
    at = F.floor(F.greatest(F.lit(0), F.least(F.lit(127), program)) / 8).cast("int") + 1
    return F.when(is_drum, DRUMS).otherwise(F.element_at(F.array(*map(F.lit, FAMILIES)), at))


def instrument_families(notes: DataFrame) -> DataFrame:
    """file_id, families: the most used families (ties: the one whose first note comes first), in canonical order."""
    order = F.array(*map(F.lit, [*FAMILIES, DRUMS]))
    c = notes.groupBy("file_id", family(F.col("program"), F.col("is_drum")).alias("fam")).agg(F.count(F.lit(1)).alias("n"), F.min("note_idx").alias("first"))
    top = c.withColumn("r", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("n"), "first"))).filter(F.col("r") <= MOST_FAMILIES)
    return top.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.array_position(order, F.col("fam")).alias("p"), F.col("fam").alias("fam")))), lambda s: F.concat(F.lit("Inst_"), s["fam"])).alias("families"))


def content_tokens(notes: DataFrame, ticks_per_bar: int) -> DataFrame:
    """file_id, tokens: Density, Poly and Range tokens."""
    n, bars = F.count(F.lit(1)), F.greatest(F.lit(1.0), (F.max(F.col("start") + F.col("duration")) - F.min("start")) / F.lit(float(ticks_per_bar)))
    span = F.coalesce(F.max(F.when(~F.col("is_drum"), F.col("pitch"))) - F.min(F.when(~F.col("is_drum"), F.col("pitch"))), F.lit(0))
    g = notes.groupBy("file_id").agg((n / bars).alias("d"), (n / F.count_distinct("start")).alias("p"), span.alias("r"))
    token = lambda name, x, e: F.concat(F.lit(name), bucketize(x, e).cast("string"))
    return g.select("file_id", F.array(token("Density_", F.col("d"), DENSITY_EDGES), token("Poly_", F.col("p"), POLY_EDGES), token("Range_", F.col("r"), RANGE_EDGES)).alias("tokens"))


def dominant_tempo(tempos: DataFrame, ends: DataFrame) -> DataFrame:
    """file_id, tempo: the tempo in force for the most ticks up to the file's end (ties: the earliest seen). tempos: file_id, time, qpm; ends: file_id, end."""
    nxt = F.lead("time").over(Window.partitionBy("file_id").orderBy("time", "qpm"))
    t = tempos.join(ends, "file_id").withColumn("stop", F.least(F.coalesce(nxt, F.col("end")), F.col("end")))
    g = t.groupBy("file_id", "qpm").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest(F.lit(0), F.col("time")))).alias("ticks"), F.min("time").alias("first"))
    g = g.groupBy("file_id").agg(F.max_by("qpm", F.struct("ticks", -F.col("first"))).alias("best"), F.max("ticks").alias("m"), F.min_by("qpm", "first").alias("early"))
    return g.select("file_id", F.when(F.col("m") > 0, F.col("best")).otherwise(F.col("early")).alias("tempo"))


def tempo_token(tempo: Column, first: Column, source: Column) -> Column:
    """Tempo token, or null for sources whose tempo is a placeholder (for fma, where the first tempo is exactly 120)."""
    ok = ~F.coalesce(source.isin("aria", "maestro", "giantmidi"), F.lit(False)) & ~F.coalesce((source == "fma") & (F.abs(first - 120.0) < 1e-6), F.lit(False)) & (tempo > 0)
    return F.when(ok, F.concat(F.lit("Tempo_"), bucketize(tempo, TEMPO_EDGES).cast("string")))


def excerpt_features(notes: DataFrame, tpq: int, seconds_per_tick: float, tempo: float) -> DataFrame:
    """The feature vector of each file: tonal, rhythmic and density metrics with counts and spreads (population std)."""
    p = ~F.col("is_drum")
    secs = F.greatest(F.max(F.col("start") + F.col("duration")) * F.lit(seconds_per_tick), F.lit(1e-6))
    base = notes.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_notes"), F.count_if(p).alias("n_pitched_notes"), F.count_distinct("track_name").alias("n_tracks"), F.count_distinct(F.when(p, F.col("program"))).alias("n_programs"),
        F.max((~p).cast("double")).alias("has_drums"), F.avg((~p).cast("double")).alias("drum_fraction"), (F.count(F.lit(1)) / secs).alias("notes_per_second"), F.lit(float(tempo)).alias("tempo_bpm"), secs.alias("duration_seconds"),
        F.avg("velocity").alias("velocity_mean"), F.stddev_pop("velocity").alias("velocity_std"), F.coalesce(F.avg(F.when(p, F.col("duration") / F.lit(float(tpq)))), F.lit(0.0)).alias("mean_note_beats"),
    )
    keys = scale_consistency(detect_key(pitch_classes(notes))).select("file_id", entropy_bits(F.col("hist")).alias("pitch_class_entropy"), "scale_consistency")
    out = base.join(keys, "file_id").join(density_and_range(notes, seconds_per_tick), "file_id")
    for part in (polyphony(notes).select("file_id", F.col("polyphony_counts").alias("polyphony_rate")), repetition(notes), ioi_entropy(notes, tpq)):
        out = out.join(part, "file_id", "left")
    return out.fillna(0.0, ["polyphony_rate", "repetition_rate", "ioi_entropy"])


def metric_registry() -> dict:
    """Metric name to (function, keyword arguments it needs). An unknown name is an error."""
    return {"density_and_range": (density_and_range, ("seconds_per_tick",)), "polyphony": (polyphony, ()), "repetition": (repetition, ()), "ioi_entropy": (ioi_entropy, ("tpq",)), "onset_alignment": (onset_alignment, ("tpq",))}


def compute(notes: DataFrame, names: list[str], **settings) -> DataFrame:
    """The named metrics of each file side by side."""
    known, out = metric_registry(), notes.select("file_id").distinct()
    for name in names:
        if name not in known:
            raise KeyError(f"unknown metric {name}; known: {sorted(known)}")
        fn, needs = known[name]
        out = out.join(fn(notes, **{k: settings[k] for k in needs}), "file_id", "left")
    return out

"""Queries over as-of joins, range joins, windows and score edits, on events seen as notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from partita.functions import notes as N
from partita.operators import ordered as O
from partita.plans.notes import NOTES, SPT, TPQ, _n, _tempos
from partita.tables import table

BAR = 4 * TPQ


def _r(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def tempo_asof(s, d):
    left = _n(s, d).filter("track_name = 'click'").select("file_id", "note_idx", "start")
    right = _tempos(s, d).withColumnRenamed("time", "start")
    return O.asof_join(left, right, ["file_id"], "start", ["qpm"], bucket=500_000).withColumn("qpm", F.coalesce("qpm", F.lit(120.0)))


def meter_asof(s, d):
    """Meter in force at each click: every signup sets one; 4/4 before the first."""
    n = _n(s, d)
    right = n.filter("track_name = 'signup'").select("file_id", "start", (2 + F.col("pitch") % 5).alias("num"), F.when(F.col("pitch") % 2 == 0, 4).otherwise(8).alias("den"))
    x = O.asof_join(n.filter("track_name = 'click'").select("file_id", "note_idx", "start"), right, ["file_id"], "start", ["num", "den"])
    return x.withColumn("num", F.coalesce("num", F.lit(4).cast("long"))).withColumn("den", F.coalesce("den", F.lit(4)))


def tick_to_seconds(s, d):
    return _r(O.seconds_of(_n(s, d).select("file_id", "note_idx", "start"), _tempos(s, d), TPQ))


def seconds_to_tick(s, d):
    """There and back again: the tick of each note's second."""
    x = O.seconds_of(_n(s, d).select("file_id", "note_idx", "start"), _tempos(s, d), TPQ)
    return O.ticks_of(x, _tempos(s, d), TPQ).select("file_id", "note_idx", "tick")


def _spans(s, d):
    return _n(s, d).filter("track_name = 'purchase'").select("file_id", F.col("note_idx").alias("win"), F.col("start").alias("lo"), (F.col("start") + 20 * F.col("duration")).alias("hi"))


def notes_in_window(s, d):
    x = O.range_join(_n(s, d), _spans(s, d), ["file_id"], "start", "lo", "hi", 200_000)
    return x.groupBy("file_id", "win").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("track_name").alias("tracks"))


def gap_split(s, d):
    """Kept and fill notes, kept bars and density ratio about each file's middle gap of 40 beats."""
    n = _n(s, d)
    g = n.groupBy("file_id").agg(F.expr("floor(avg(start))").alias("lo")).withColumn("hi", F.col("lo") + 40 * TPQ)
    inside = (F.col("start") >= F.col("lo")) & (F.col("start") < F.col("hi"))
    x = n.join(g, "file_id").groupBy("file_id", "lo", "hi").agg(F.count_if(inside).alias("fill"), F.count_if(~inside).alias("kept"), F.max(F.col("start") + F.col("duration")).alias("e"))
    bars = F.greatest(F.lit(1e-9), (F.greatest("e", "hi") - (F.col("hi") - F.col("lo"))) / F.lit(4.0 * TPQ))
    x = x.withColumn("kept_bars", bars).withColumn("density_ratio", F.when(F.col("kept") > 0, (F.col("fill") / F.lit(10.0)) / (F.col("kept") / F.col("kept_bars"))))
    return _r(x.select("file_id", "fill", "kept", "kept_bars", "density_ratio"))


def _rhythm(s, d):
    """Notes squeezed so that windows of five seconds hold many: one tick is a second of 600 at 120 beats, pitches over a small alphabet for some files."""
    return _n(s, d).withColumn("start", F.floor(F.col("start") / 90)).withColumn("pitch", F.when(F.col("file_id") % 3 == 0, 40 + F.col("pitch") % 2).otherwise(F.col("pitch")))


def tumbling_degenerate(s, d):
    return O.degenerate_windows(_rhythm(s, d), F.col("start") * F.lit(0.001), "strict")


def clean_score_trim(s, d):
    x = _n(s, d).withColumn("start", F.floor(F.col("start") / 90)).withColumn("pitch", F.when((F.col("file_id") % 3 == 0) & (F.col("start") > 14000), 40).otherwise(F.col("pitch")))
    return O.clean_score(O.degenerate_windows(x, F.col("start") * F.lit(0.001), "loose"), "loose").withColumn("cut_seconds", F.col("cut_seconds").cast("double"))


def held_under(s, d):
    n = _n(s, d)
    return _r(O.held_under(n.filter("track_name = 'view'"), n.filter("track_name = 'click'"), TPQ))


def _edges(s, d):
    ends = _n(s, d).groupBy("file_id").agg(F.max(F.col("start") + F.col("duration")).alias("end"))
    return O.bar_edges(ends, BAR).withColumn("seconds", F.col("edge") * F.lit(SPT))


def drum_names(s, d):
    m = table(s, d, "manifest").select("path").distinct()
    return m.select("path", O.name_says_drums(F.regexp_extract("path", r"([^/]*)$", 1)).alias("drums"))


def normalize_drums(s, d):
    n = _n(s, d).withColumn("is_drum", F.lit(False)).withColumn("pitch", F.when((F.col("track_name") == "view") & (F.col("file_id") % 2 == 0), 35 + F.col("pitch") % 4 * 3 + F.when(F.col("pitch") % 4 == 3, 2).otherwise(0)).otherwise(F.col("pitch")))
    n = n.unionByName(n.withColumn("note_idx", F.col("note_idx") + 1_000_000_000))
    x = O.normalize_drums(n, F.when(F.col("file_id") % 7 == 0, "beat 4.mid").otherwise("song.mid"))
    return x.groupBy("file_id", "track_name").agg(F.bool_or("is_drum").alias("is_drum"), F.count(F.lit(1)).alias("n"))


def score_edits(s, d):
    """Checks of trim, rebase, tail cut, resample, overlay and splice as sums over each file."""
    n = _n(s, d)
    total = lambda x, name: x.groupBy("file_id").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.sum("start").alias(f"s_{name}"), F.sum("duration").alias(f"d_{name}"))
    lo, hi = F.lit(500_000), F.lit(1_500_000)
    parts = {
        "trim": O.trim_leading(n), "rebase": O.rebase(n, lo, hi, TPQ), "tail": O.cut_tail(n, hi), "resample": O.resample(n, TPQ, 480),
        "overlay": O.overlay(n.filter("track_name = 'click'"), n.filter("track_name = 'view'"), TPQ, 480),
        "splice": O.splice(n.filter("track_name <> 'view'"), n.filter("track_name = 'view'"), lo, hi, F.lit(1000)),
    }
    out = n.select("file_id").distinct()
    for name, x in parts.items():
        out = out.join(total(x, name), "file_id", "left")
    return out


QUERIES = {
    "tempo_asof": tempo_asof, "meter_asof": meter_asof, "tick_to_seconds": tick_to_seconds, "seconds_to_tick": seconds_to_tick, "notes_in_window": notes_in_window, "gap_split": gap_split,
    "tumbling_5s_degenerate": tumbling_degenerate, "clean_score_trim": clean_score_trim, "held_under_24": held_under, "split_hands": lambda s, d: _r(O.split_hands(_n(s, d), TPQ)),
    "bar_edges": lambda s, d: _edges(s, d).groupBy("file_id").agg(F.count(F.lit(1)).alias("edges"), F.max("edge").alias("last")),
    "excerpt_window_choice": lambda s, d: O.excerpt_window(_edges(s, d), 30.0), "drum_name_predicate": drum_names, "normalize_drums": normalize_drums, "score_edits": score_edits,
}

_TE = "te AS (SELECT file_id, start AS time, max((60 + 10 * (pitch % 13))::DOUBLE) AS qpm FROM notes WHERE is_drum GROUP BY ALL)"
_SEG = f"""{_TE}, t0 AS (SELECT * FROM te UNION ALL SELECT file_id, 0, arg_min(qpm, time) FROM te GROUP BY file_id HAVING min(time) > 0),
 sg AS (SELECT *, 60.0::DOUBLE / (qpm * 3600) AS spt, (lead(time) OVER w - time) * (60.0::DOUBLE / (qpm * 3600)) AS s FROM t0 WINDOW w AS (PARTITION BY file_id ORDER BY time)),
 seg AS (SELECT file_id, time, spt, coalesce(sum(s) OVER (PARTITION BY file_id ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM sg)"""


def _held(low, high, name="hu"):
    return f"""{name}_lo AS (SELECT file_id, start, start + greatest(duration, 1) AS e, row_number() OVER (PARTITION BY file_id ORDER BY start, start + greatest(duration, 1)) AS i FROM {low}),
 {name}_k AS (SELECT h.file_id, h.note_idx, h.start, max(l.i) AS k FROM {high} h LEFT JOIN {name}_lo l ON l.file_id = h.file_id AND l.start <= h.start - 3600 GROUP BY ALL),
 {name}_x AS (SELECT k.file_id, k.note_idx, coalesce(bool_or(l.e > k.start), false) AS hit FROM {name}_k k LEFT JOIN {name}_lo l ON l.file_id = k.file_id AND l.i <= k.k AND l.i > k.k - 24 GROUP BY ALL),
 {name} AS (SELECT file_id, avg(hit::INT) AS held FROM {name}_x GROUP BY 1)"""


def _degenerate(src, top, rep, same, least):
    return f"""x AS ({src}), w AS (SELECT *, floor(start * 0.001::DOUBLE / 5.0)::BIGINT AS win FROM x),
 p1 AS (SELECT file_id, win, pitch, count(*) AS c FROM w GROUP BY ALL), pt AS (SELECT *, sum(c) OVER (PARTITION BY file_id, win) AS t FROM p1),
 p2 AS (SELECT file_id, win, sum(c)::BIGINT AS n, max(c) / sum(c) AS top, count(*) AS pitches, -sum(c / t * log2(c / t)) AS ent FROM pt GROUP BY ALL),
 o AS (SELECT DISTINCT file_id, win, start FROM w), og AS (SELECT *, start - lag(start) OVER (PARTITION BY file_id, win ORDER BY start) AS gap FROM o),
 gc AS (SELECT file_id, win, gap, count(*) AS c FROM og WHERE gap IS NOT NULL GROUP BY ALL), gs AS (SELECT file_id, win, max(c) / sum(c) AS same FROM gc GROUP BY ALL),
 dg AS (SELECT file_id, win, n, n >= 8 AND ((n / 5.0 > 40 AND ent < 3.2) OR top > {top} OR (top > {rep} AND coalesce(same, 1) > {same}) OR pitches < {least}) AS degenerate FROM p2 LEFT JOIN gs USING (file_id, win))"""


def _tot(name, src, extra=""):
    return f"{name} AS (SELECT file_id, count(*) AS n_{name}, sum(start)::BIGINT AS s_{name}, sum(duration)::BIGINT AS d_{name} FROM ({src}) GROUP BY 1)"


ORACLE = {
    "tempo_asof": f"WITH {NOTES}, {_TE} SELECT n.file_id, n.note_idx, n.start, coalesce(qpm, 120) AS qpm FROM (SELECT * FROM notes WHERE track_name = 'click') n ASOF LEFT JOIN te ON te.file_id = n.file_id AND te.time <= n.start",
    "meter_asof": f"""WITH {NOTES}, m0 AS (SELECT file_id, start AS time, max(struct_pack(num := 2 + pitch % 5, den := CASE WHEN pitch % 2 = 0 THEN 4 ELSE 8 END)) AS v FROM notes WHERE track_name = 'signup' GROUP BY file_id, start), m AS (SELECT file_id, time, v.num AS num, v.den AS den FROM m0)
      SELECT n.file_id, n.note_idx, n.start, coalesce(num, 4) AS num, coalesce(den, 4) AS den FROM (SELECT * FROM notes WHERE track_name = 'click') n ASOF LEFT JOIN m ON m.file_id = n.file_id AND m.time <= n.start""",
    "tick_to_seconds": f"WITH {NOTES}, {_SEG} SELECT n.file_id, n.note_idx, n.start, round(coalesce(base + (n.start - time) * spt, n.start * (60.0 / (120.0 * 3600))::DOUBLE), 6) AS seconds FROM notes n ASOF LEFT JOIN seg ON seg.file_id = n.file_id AND seg.time <= n.start",
    "seconds_to_tick": f"WITH {NOTES} SELECT file_id, note_idx, start AS tick FROM notes",
    "notes_in_window": f"""WITH {NOTES}, w AS (SELECT file_id, note_idx AS win, start AS lo, start + 20 * duration AS hi FROM notes WHERE track_name = 'purchase')
      SELECT w.file_id, win, count(*) AS n, count(DISTINCT track_name) AS tracks FROM w JOIN notes n ON n.file_id = w.file_id AND n.start >= lo AND n.start < hi GROUP BY ALL""",
    "gap_split": f"""WITH {NOTES}, g AS (SELECT file_id, floor(avg(start))::BIGINT AS lo, floor(avg(start))::BIGINT + 144000 AS hi FROM notes GROUP BY 1),
      x AS (SELECT file_id, lo, hi, count(*) FILTER (start >= lo AND start < hi) AS fill, count(*) FILTER (NOT (start >= lo AND start < hi)) AS kept, max(start + duration) AS e FROM notes JOIN g USING (file_id) GROUP BY ALL),
      y AS (SELECT *, greatest(1e-9, (greatest(e, hi) - (hi - lo)) / 14400.0::DOUBLE) AS kb FROM x)
      SELECT file_id, fill, kept, round(kb, 6) AS kept_bars, round(CASE WHEN kept > 0 THEN (fill / 10.0::DOUBLE) / (kept / kb) END, 6) AS density_ratio FROM y""",
    "tumbling_5s_degenerate": f"WITH {NOTES}, {_degenerate('SELECT file_id, note_idx, start // 90 AS start, CASE WHEN file_id % 3 = 0 THEN 40 + pitch % 2 ELSE pitch END AS pitch FROM notes', 0.60, 0.45, 0.90, 3)} SELECT * FROM dg",
    "clean_score_trim": f"""WITH {NOTES}, {_degenerate('SELECT file_id, note_idx, start // 90 AS start, CASE WHEN file_id % 3 = 0 AND start // 90 > 14000 THEN 40 ELSE pitch END AS pitch FROM notes', 0.75, 0.60, 0.95, 2)},
      r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY win) - 1 AS r FROM dg), f AS (SELECT file_id, min(r) FILTER (degenerate) AS f FROM r GROUP BY 1)
      SELECT file_id, CASE WHEN f IS NULL THEN 'clean' WHEN f < 2 THEN 'degenerate' ELSE 'trimmed at ' || (f * 5) || 's' END AS verdict, CASE WHEN f >= 2 THEN (f * 5)::DOUBLE END AS cut_seconds FROM f""",
    "held_under_24": f"WITH {NOTES}, {_held('(SELECT * FROM notes WHERE track_name = $$view$$)', '(SELECT * FROM notes WHERE track_name = $$click$$)')} SELECT file_id, round(held, 6) AS held FROM hu",
    "split_hands": f"""WITH {NOTES}, p AS (SELECT * FROM notes WHERE NOT is_drum), md AS (SELECT file_id, greatest(50, least(67, list_sort(list(pitch))[count(*) // 2 + 1])) AS split FROM p GROUP BY 1),
      px AS (SELECT p.*, split FROM p JOIN md USING (file_id)), {_held('(SELECT * FROM px WHERE pitch < split)', '(SELECT * FROM px WHERE pitch >= split)', 'ha')}, {_held('(SELECT * FROM px WHERE pitch >= split)', '(SELECT * FROM px WHERE pitch < split)', 'hb')},
      n AS (SELECT file_id, split, count(*) FILTER (pitch < split) AS n_low, count(*) FILTER (pitch >= split) AS n_high FROM px GROUP BY ALL)
      SELECT file_id, split, n_low, n_high, round(greatest(coalesce(ha.held, 0), coalesce(hb.held, 0)), 6) AS held, n_low >= 4 AND n_high >= 4 AND greatest(coalesce(ha.held, 0), coalesce(hb.held, 0)) >= 0.35 AS accepted
      FROM n LEFT JOIN ha USING (file_id) LEFT JOIN hb USING (file_id)""",
    "bar_edges": f"WITH {NOTES} SELECT file_id, max(start + duration) // 14400 + 2 AS edges, (max(start + duration) // 14400 + 1) * 14400 AS last FROM notes GROUP BY 1",
    "excerpt_window_choice": f"""WITH {NOTES}, en AS (SELECT file_id, max(start + duration) // 14400 + 1 AS nb FROM notes GROUP BY 1), e AS (SELECT file_id, nb, unnest(range(nb + 1)) AS bar FROM en),
      es AS (SELECT *, bar * 14400 AS edge, bar * 14400 * (60.0 / (120.0 * 3600))::DOUBLE AS seconds, nb * 14400 * (60.0 / (120.0 * 3600))::DOUBLE AS total FROM e),
      c AS (SELECT file_id, arg_min(bar, sha1('0:' || file_id || ':' || bar)) AS b FROM es WHERE total - seconds >= 30 GROUP BY 1),
      h AS (SELECT es.file_id, b, arg_min(bar, (round(abs(seconds - b * 14400 * (60.0 / (120.0 * 3600))::DOUBLE - 30), 9), bar)) AS j FROM es JOIN c USING (file_id) WHERE bar > b GROUP BY ALL)
      SELECT en.file_id, CASE WHEN nb * 14400 * (60.0 / (120.0 * 3600))::DOUBLE <= 32 OR j IS NULL THEN 0 ELSE b * 14400 END AS lo, CASE WHEN nb * 14400 * (60.0 / (120.0 * 3600))::DOUBLE <= 32 OR j IS NULL THEN nb * 14400 ELSE j * 14400 END AS hi
      FROM en LEFT JOIN h USING (file_id)""",
    "drum_name_predicate": f"""SELECT DISTINCT path, regexp_matches(lower(regexp_extract(path, '([^/]*)$', 1)), '{"|".join(O.DRUM_WORDS)}') OR regexp_matches(lower(regexp_extract(path, '([^/]*)$', 1)), '(^|[^0-9a-z])({"|".join(O.DRUM_ALONE)})([^0-9a-z]|$)') AS drums FROM manifest""",
    "normalize_drums": f"""WITH {NOTES}, x AS (SELECT file_id, track_name, CASE WHEN track_name = 'view' AND file_id % 2 = 0 THEN 35 + pitch % 4 * 3 + (CASE WHEN pitch % 4 = 3 THEN 2 ELSE 0 END) ELSE pitch END AS pitch FROM notes, range(2))
      SELECT file_id, track_name, count(*) >= 16 AND count(DISTINCT pitch) <= 8 AND avg((pitch BETWEEN 35 AND 59)::INT) >= 0.85 AND bool_or(pitch IN (35, 36)) AND bool_or(pitch IN (38, 40)) AND bool_or(pitch IN (42, 44, 46))
        OR (file_id % 7 = 0 AND count(*) OVER (PARTITION BY file_id) = 1) AS is_drum, count(*) AS n FROM x GROUP BY file_id, track_name""",
    "score_edits": f"""WITH {NOTES}, {_tot('trim', 'SELECT file_id, start - greatest(0, min(start) OVER (PARTITION BY file_id)) AS start, duration FROM notes')},
      {_tot('rebase', 'SELECT file_id, start - 500000 AS start, duration FROM notes WHERE start >= 500000 AND start + duration <= 1500000 - 225 AND start < 1500000 - 225')},
      {_tot('tail', 'SELECT file_id, start, least(duration, 1500000 - start) AS duration FROM notes WHERE start < 1500000')},
      {_tot('resample', 'SELECT file_id, floor(start * 480 / 3600.0::DOUBLE + 0.5)::BIGINT AS start, greatest(1, floor(duration * 480 / 3600.0::DOUBLE + 0.5)::BIGINT) AS duration FROM notes')},
      {_tot('overlay', 'SELECT file_id, start, duration FROM notes WHERE track_name = $$click$$ UNION ALL SELECT file_id, floor(start * 3600 / 480.0::DOUBLE + 0.5)::BIGINT, greatest(1, floor(duration * 3600 / 480.0::DOUBLE + 0.5)::BIGINT) FROM notes WHERE track_name = $$view$$')},
      {_tot('splice', '''SELECT file_id, start, CASE WHEN start < 500000 THEN least(duration, 500000 - start) ELSE duration END AS duration FROM notes WHERE track_name <> $$view$$ AND (start < 500000 OR start >= 1500000)
         UNION ALL SELECT file_id, start + 1000, least(duration, 1500000 - start - 1000) FROM notes WHERE track_name = $$view$$ AND start + 1000 >= 500000 AND start + 1000 < 1500000''')}
      SELECT * FROM (SELECT DISTINCT file_id FROM notes) LEFT JOIN trim USING (file_id) LEFT JOIN rebase USING (file_id) LEFT JOIN tail USING (file_id) LEFT JOIN resample USING (file_id) LEFT JOIN overlay USING (file_id) LEFT JOIN splice USING (file_id)""",
}

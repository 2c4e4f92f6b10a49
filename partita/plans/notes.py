"""Note metrics over the events table seen as notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from partita.functions import notes as N
from partita.tables import table

TPQ = 3600
SPT = 60.0 / (120.0 * TPQ)


def _n(spark, d):
    return N.events_as_notes(table(spark, d, "events"))


def clean_verdict(spark, d):
    s = N.file_stats(_n(spark, d), SPT)
    return s.select("file_id", N.clean_verdict(F.col("n_notes"), F.col("duration_seconds"), F.col("has_drums"), F.col("pitched"), F.col("max_gap_seconds")).alias("verdict"))


def pitch_class_hist(spark, d):
    return N.pitch_classes(_n(spark, d)).select("file_id", F.posexplode("hist").alias("pitch_class", "n")).withColumn("n", F.col("n").cast("long"))


def pitch_class_entropy(spark, d):
    return N.pitch_classes(_n(spark, d)).select("file_id", F.round(N.entropy_bits(F.col("hist")), 9).alias("entropy"))


def detect_key(spark, d):
    return N.detect_key(N.pitch_classes(_n(spark, d))).select("file_id", "tonic", "mode")


def scale_consistency(spark, d):
    return N.scale_consistency(N.detect_key(N.pitch_classes(_n(spark, d)))).select("file_id", F.round("scale_consistency", 9).alias("scale_consistency"))


def pc_overlap_per_bar(spark, d):
    n = _n(spark, d).filter(F.col("track_name").isin("click", "view"))
    return N.bar_overlap(n.filter("track_name = 'click'"), n.filter("track_name = 'view'"), ["file_id"], TPQ, TPQ, 16.0).select("file_id", F.round("overlap", 9).alias("overlap"), "bars")


def pc_cosine(spark, d):
    h = lambda t, s: N.pitch_classes(_n(spark, d).filter(F.col("track_name") == t)).withColumnRenamed("hist", s)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x = h("click", "a").join(h("view", "b"), "file_id")
    return x.select("file_id", F.round(dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b")), 9).alias("cosine"))


def excerpt_features(spark, d):
    x = N.excerpt_features(_n(spark, d), TPQ, SPT, 120.0)
    return x.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c).cast("long").alias(c) for c, t in x.dtypes))


def _tempos(spark, d):
    """Tempo events: every error event sets one."""
    return _n(spark, d).filter("is_drum").select("file_id", F.col("start").alias("time"), (60 + 10 * (F.col("pitch") % 13)).cast("double").alias("qpm"))


def dominant_tempo(spark, d):
    ends = _n(spark, d).groupBy("file_id").agg(F.max(F.col("start") + F.col("duration")).alias("end"))
    return N.dominant_tempo(_tempos(spark, d), ends)


def header_tokens(spark, d):
    n = _n(spark, d)
    first = _tempos(spark, d).groupBy("file_id").agg(F.min_by("qpm", "time").alias("first"))
    x = N.instrument_families(n).join(N.content_tokens(n, 4 * TPQ), "file_id").join(dominant_tempo(spark, d), "file_id", "left").join(first, "file_id", "left")
    source = F.element_at(F.array(*map(F.lit, ("lakh", "aria", "fma", "user"))), (F.col("file_id") % 4 + 1).cast("int"))
    return x.select("file_id", F.array_join(F.array_compact(F.concat("families", "tokens", F.array(N.tempo_token(F.col("tempo"), F.col("first"), source)), F.array(F.concat(F.lit("Source_"), source)))), " ").alias("header"))


QUERIES = {
    "file_stats": lambda s, d: N.file_stats(_n(s, d), SPT).select("file_id", "n_notes", "n_tracks", F.round("duration_seconds", 6).alias("duration_seconds"), "pitched", "has_drums", F.round("max_gap_seconds", 6).alias("max_gap_seconds")),
    "clean_verdict": clean_verdict,
    "clean_verdict_counts": lambda s, d: clean_verdict(s, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n")),
    "pitch_class_hist": pitch_class_hist, "pitch_class_entropy": pitch_class_entropy, "detect_key": detect_key, "scale_consistency": scale_consistency,
    "density_and_range": lambda s, d: N.density_and_range(_n(s, d), SPT).select("file_id", F.round("note_density_hz", 9).alias("note_density_hz"), F.col("pitch_range").cast("long").alias("pitch_range")),
    "polyphony": lambda s, d: N.polyphony(_n(s, d)).select("file_id", F.round("polyphony_prior", 9).alias("polyphony_prior"), F.round("polyphony_counts", 9).alias("polyphony_counts")),
    "repetition_rate_4gram": lambda s, d: N.repetition(_n(s, d).withColumn("pitch", F.col("pitch") % 4)).select("file_id", F.round("repetition_rate", 9).alias("repetition_rate")),
    "ioi_entropy": lambda s, d: N.ioi_entropy(_n(s, d), TPQ).select("file_id", F.round("ioi_entropy", 9).alias("ioi_entropy")),
    "onset_alignment": lambda s, d: N.onset_alignment(_n(s, d), TPQ).select("file_id", F.round("downbeat_alignment", 9).alias("downbeat_alignment"), F.round("phrase_offset", 9).alias("phrase_offset")),
    "pc_overlap_per_bar": pc_overlap_per_bar, "pc_cosine": pc_cosine, "excerpt_features": excerpt_features, "dominant_tempo": dominant_tempo,
    "instrument_families": lambda s, d: N.instrument_families(_n(s, d)).select("file_id", F.array_join("families", " ").alias("families")),
    "header_tokens": header_tokens,
}

NOTES = """notes AS (SELECT user_id AS file_id, event_type AS track_name, CASE event_type WHEN 'view' THEN 33 WHEN 'purchase' THEN 48 WHEN 'signup' THEN 73 ELSE 0 END AS program,
  event_type = 'error' AS is_drum, event_id AS note_idx, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS start, 1800 * (1 + event_id % 8) AS duration,
  21 + CAST(floor(value) AS BIGINT) % 88 AS pitch, 1 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS velocity FROM events)"""
_S = "(60.0 / (120.0 * 3600))::DOUBLE"
_STATS = f"""g AS (SELECT *, start - lag(start) OVER (PARTITION BY file_id ORDER BY start, note_idx) AS gap FROM notes),
 st AS (SELECT file_id, count(*) AS n_notes, count(DISTINCT track_name) AS n_tracks, max(start + duration) * {_S} AS duration_seconds, count(DISTINCT CASE WHEN NOT is_drum THEN pitch END) AS pitched,
  bool_or(is_drum) AS has_drums, coalesce(max(gap), 0) * {_S} AS max_gap_seconds FROM g GROUP BY file_id)"""
_VERDICT = f"""WITH {NOTES}, {_STATS}, v AS (SELECT file_id, CASE WHEN n_notes < 32 THEN 'too_few_notes' WHEN duration_seconds > 1800 THEN 'too_long' WHEN NOT has_drums AND pitched < 2 THEN 'single_pitch_spam'
  WHEN duration_seconds > 0 AND n_notes / duration_seconds < 0.3 THEN 'too_sparse' WHEN duration_seconds <= 0 OR n_notes / duration_seconds > 80 THEN 'too_dense' WHEN max_gap_seconds > 30 THEN 'long_silence' ELSE 'ok' END AS verdict FROM st)"""
_HIST = """pcs AS (SELECT unnest(range(12)) AS pc), fs AS (SELECT DISTINCT file_id FROM notes),
 h AS (SELECT fs.file_id, pcs.pc, count(n.pitch) AS n FROM fs CROSS JOIN pcs LEFT JOIN notes n ON n.file_id = fs.file_id AND NOT n.is_drum AND n.pitch % 12 = pcs.pc GROUP BY ALL)"""
_MAJ, _MIN = (f"[{', '.join(map(str, p))}]" for p in (N.MAJOR, N.MINOR))
_KEY = f"""prof AS (SELECT t AS tonic, m AS mode, 2 * t + (m = 'minor')::INT AS ord, pc, (CASE WHEN m = 'major' THEN {_MAJ} ELSE {_MIN} END)[((pc - t + 12) % 12) + 1]::DOUBLE AS w
   FROM (SELECT unnest(range(12)) AS t), (SELECT unnest(['major', 'minor']) AS m), pcs),
 c AS (SELECT file_id, tonic, mode, ord, round(coalesce(CASE WHEN var_pop(n) > 0 THEN corr(n, w) END, 0), 12) AS r FROM h JOIN prof USING (pc) GROUP BY ALL),
 k AS (SELECT file_id, tonic, mode FROM c QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY r DESC, ord) = 1)"""
_SCALE = f"""sc AS (SELECT h.file_id, coalesce(sum(CASE WHEN list_contains(CASE WHEN mode = 'major' THEN {N.SCALES['major']} ELSE {N.SCALES['minor']} END, (pc - tonic + 12) % 12) THEN n END) / nullif(sum(n), 0), 0)::DOUBLE AS scale_consistency
   FROM h JOIN k USING (file_id) GROUP BY 1)"""
_ENT = "en AS (SELECT file_id, coalesce(-sum(CASE WHEN n > 0 THEN (n / t) * log2(n / t) END), 0)::DOUBLE AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY file_id) AS t FROM h) GROUP BY 1)"
_DENS = f"""de AS (SELECT file_id, CASE WHEN count(*) FILTER (NOT is_drum) > 0 THEN count(*) FILTER (NOT is_drum) / greatest(max(start + duration) FILTER (NOT is_drum) * {_S}, 1e-6) ELSE 0 END::DOUBLE AS note_density_hz,
   coalesce(max(pitch) FILTER (NOT is_drum) - min(pitch) FILTER (NOT is_drum), 0)::BIGINT AS pitch_range FROM notes GROUP BY 1)"""
_POLY = """pn AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start, note_idx) AS i FROM notes WHERE NOT is_drum),
 pp AS (SELECT a.file_id, a.i, 1 + count(b.i) FILTER (b.i < a.i AND b.start + b.duration > a.start) AS prior, greatest(count(*) FILTER (b.start <= a.start) - count(*) FILTER (b.start + b.duration <= a.start), 1) AS counts
   FROM pn a JOIN pn b USING (file_id) GROUP BY ALL),
 po AS (SELECT file_id, avg(prior) AS polyphony_prior, avg(counts) AS polyphony_counts FROM pp GROUP BY 1)"""


def _rep(p):
    return f"""rg AS (SELECT file_id, [{', '.join(f'lead({p}, {i}) OVER w' for i in range(4))}] AS gram FROM notes WHERE NOT is_drum WINDOW w AS (PARTITION BY file_id ORDER BY start, note_idx)),
 rc AS (SELECT file_id, gram, count(*) AS c FROM rg GROUP BY ALL),
 re AS (SELECT file_id, coalesce(sum(c) FILTER (gram[4] IS NOT NULL AND c > 1) / sum(c) FILTER (gram[4] IS NOT NULL), 0)::DOUBLE AS repetition_rate FROM rc GROUP BY 1)"""


_IOI = """io AS (SELECT file_id, round_even((start - lag(start) OVER (PARTITION BY file_id ORDER BY start, note_idx)) / 900.0::DOUBLE, 0) AS b, start - lag(start) OVER (PARTITION BY file_id ORDER BY start, note_idx) AS dd FROM notes WHERE NOT is_drum),
 ic AS (SELECT file_id, b, count(*) AS c FROM io WHERE dd > 0 GROUP BY ALL), it AS (SELECT *, sum(c) OVER (PARTITION BY file_id) AS t FROM ic),
 ie AS (SELECT f.file_id, coalesce(-sum((c / t) * log2(c / t)), 0)::DOUBLE AS ioi_entropy FROM (SELECT DISTINCT file_id FROM notes WHERE NOT is_drum) f LEFT JOIN it USING (file_id) GROUP BY 1)"""
_FAM = f"""fm AS (SELECT file_id, CASE WHEN is_drum THEN 'Drums' ELSE {N.FAMILIES}[program // 8 + 1] END AS fam, count(*) AS n, min(note_idx) AS f FROM notes GROUP BY ALL),
 ft AS (SELECT * FROM fm QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY n DESC, f) <= 6),
 fl AS (SELECT file_id, string_agg('Inst_' || fam, ' ' ORDER BY list_position({[*N.FAMILIES, N.DRUMS]}, fam)) AS families FROM ft GROUP BY 1)"""
_TEMPO = """te AS (SELECT file_id, start AS time, (60 + 10 * (pitch % 13))::DOUBLE AS qpm FROM notes WHERE is_drum), en2 AS (SELECT file_id, max(start + duration) AS e FROM notes GROUP BY 1),
 tt AS (SELECT file_id, time, qpm, least(coalesce(lead(time) OVER (PARTITION BY file_id ORDER BY time, qpm), e), e) AS stop FROM te JOIN en2 USING (file_id)),
 tg AS (SELECT file_id, qpm, sum(greatest(0, stop - greatest(0, time))) AS ticks, min(time) AS f FROM tt GROUP BY ALL),
 td AS (SELECT file_id, qpm AS tempo FROM tg QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ticks DESC, f) = 1)"""


def _bucket(x, edges):
    return "(" + " + ".join(f"({x} >= {e})::INT" for e in edges) + ")"


_CONTENT = f"""ct AS (SELECT file_id, count(*) / greatest(1, (max(start + duration) - min(start)) / 14400) AS d, count(*) / count(DISTINCT start) AS p, coalesce(max(pitch) FILTER (NOT is_drum) - min(pitch) FILTER (NOT is_drum), 0) AS r FROM notes GROUP BY 1)"""

ORACLE = {
    "file_stats": f"WITH {NOTES}, {_STATS} SELECT file_id, n_notes, n_tracks, round(duration_seconds, 6) AS duration_seconds, pitched, has_drums, round(max_gap_seconds, 6) AS max_gap_seconds FROM st",
    "clean_verdict": f"{_VERDICT} SELECT * FROM v",
    "clean_verdict_counts": f"{_VERDICT} SELECT verdict, count(*) AS n FROM v GROUP BY 1",
    "pitch_class_hist": f"WITH {NOTES}, {_HIST} SELECT file_id, pc::INT AS pitch_class, n FROM h",
    "pitch_class_entropy": f"WITH {NOTES}, {_HIST}, {_ENT} SELECT file_id, round(entropy, 9) AS entropy FROM en",
    "detect_key": f"WITH {NOTES}, {_HIST}, {_KEY} SELECT file_id, tonic::INT AS tonic, mode FROM k",
    "scale_consistency": f"WITH {NOTES}, {_HIST}, {_KEY}, {_SCALE} SELECT file_id, round(scale_consistency, 9) AS scale_consistency FROM sc",
    "density_and_range": f"WITH {NOTES}, {_DENS} SELECT file_id, round(note_density_hz, 9) AS note_density_hz, pitch_range FROM de",
    "polyphony": f"WITH {NOTES}, {_POLY} SELECT file_id, round(polyphony_prior, 9) AS polyphony_prior, round(polyphony_counts, 9) AS polyphony_counts FROM po",
    "repetition_rate_4gram": f"WITH {NOTES}, {_rep('pitch % 4')} SELECT file_id, round(repetition_rate, 9) AS repetition_rate FROM re",
    "ioi_entropy": f"WITH {NOTES}, {_IOI} SELECT file_id, round(ioi_entropy, 9) AS ioi_entropy FROM ie",
    "onset_alignment": f"""WITH {NOTES} SELECT file_id, round(avg((least(start % 14400, 14400 - start % 14400, abs(start % 14400 - 7200)) <= 450)::INT), 9) AS downbeat_alignment,
      round(least(min(start) % 14400, 14400 - min(start) % 14400) / 3600.0::DOUBLE, 9) AS phrase_offset FROM notes GROUP BY 1""",
    "pc_overlap_per_bar": f"""WITH {NOTES}, b AS (SELECT file_id, track_name, start // 57600 AS bar, list(DISTINCT pitch % 12) AS s FROM notes WHERE track_name IN ('click', 'view') GROUP BY ALL)
      SELECT a.file_id, round(avg(len(list_intersect(a.s, c.s)) / len(list_distinct(a.s || c.s))), 9) AS overlap, count(*) AS bars FROM b a JOIN b c ON a.file_id = c.file_id AND a.bar = c.bar AND a.track_name = 'click' AND c.track_name = 'view' GROUP BY 1""",
    "pc_cosine": f"""WITH {NOTES}, pcs AS (SELECT unnest(range(12)) AS pc), h AS (SELECT file_id, pc, count(*) FILTER (track_name = 'click' AND pitch % 12 = pc) AS a, count(*) FILTER (track_name = 'view' AND pitch % 12 = pc) AS b FROM notes, pcs GROUP BY ALL)
      SELECT file_id, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 9) AS cosine FROM h GROUP BY 1 HAVING sum(a) > 0 AND sum(b) > 0""",
    "excerpt_features": f"""WITH {NOTES}, {_HIST}, {_KEY}, {_SCALE}, {_ENT}, {_DENS}, {_POLY}, {_rep('pitch')}, {_IOI},
      ba AS (SELECT file_id, count(*) AS n_notes, count(*) FILTER (NOT is_drum) AS n_pitched_notes, count(DISTINCT track_name) AS n_tracks, count(DISTINCT program) FILTER (NOT is_drum) AS n_programs, max(is_drum::INT)::DOUBLE AS has_drums,
        avg(is_drum::INT) AS drum_fraction, count(*) / greatest(max(start + duration) * {_S}, 1e-6) AS notes_per_second, 120.0::DOUBLE AS tempo_bpm, greatest(max(start + duration) * {_S}, 1e-6) AS duration_seconds,
        avg(velocity) AS velocity_mean, stddev_pop(velocity) AS velocity_std, coalesce(avg(duration / 3600) FILTER (NOT is_drum), 0) AS mean_note_beats FROM notes GROUP BY 1)
      SELECT file_id, n_notes, n_pitched_notes, n_tracks, n_programs, has_drums, round(drum_fraction, 9) AS drum_fraction, round(notes_per_second, 9) AS notes_per_second, tempo_bpm, round(duration_seconds, 9) AS duration_seconds,
        round(velocity_mean, 9) AS velocity_mean, round(velocity_std, 9) AS velocity_std, round(mean_note_beats, 9) AS mean_note_beats, round(entropy, 9) AS pitch_class_entropy, round(scale_consistency, 9) AS scale_consistency,
        round(note_density_hz, 9) AS note_density_hz, pitch_range, round(coalesce(polyphony_counts, 0), 9) AS polyphony_rate, round(coalesce(repetition_rate, 0), 9) AS repetition_rate, round(coalesce(ioi_entropy, 0), 9) AS ioi_entropy
      FROM ba JOIN sc USING (file_id) JOIN en USING (file_id) JOIN de USING (file_id) LEFT JOIN po USING (file_id) LEFT JOIN re USING (file_id) LEFT JOIN ie USING (file_id)""",
    "dominant_tempo": f"WITH {NOTES}, {_TEMPO} SELECT * FROM td",
    "instrument_families": f"WITH {NOTES}, {_FAM} SELECT * FROM fl",
    "header_tokens": f"""WITH {NOTES}, {_FAM}, {_TEMPO}, {_CONTENT}, s AS (SELECT DISTINCT file_id, ['lakh', 'aria', 'fma', 'user'][file_id % 4 + 1] AS source FROM notes), t1 AS (SELECT file_id, arg_min(qpm, time) AS f FROM te GROUP BY 1)
      SELECT file_id, concat_ws(' ', families, 'Density_' || {_bucket('d', N.DENSITY_EDGES)}, 'Poly_' || {_bucket('p', N.POLY_EDGES)}, 'Range_' || {_bucket('r', N.RANGE_EDGES)},
        CASE WHEN source <> 'aria' AND NOT (source = 'fma' AND abs(f - 120) < 1e-6) THEN 'Tempo_' || {_bucket('tempo', N.TEMPO_EDGES)} END, 'Source_' || source) AS header
      FROM fl JOIN ct USING (file_id) JOIN s USING (file_id) LEFT JOIN td USING (file_id) LEFT JOIN t1 USING (file_id)""",
}

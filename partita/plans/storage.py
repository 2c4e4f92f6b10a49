"""Queries that write the tables as files of the corpus tools, in the shared folder, and read them back."""

from __future__ import annotations

import gzip
import uuid

from pyspark.sql import functions as F

from partita.functions import tokens as T
from partita.plans.notes import NOTES
from partita.plans.tokens import _T, _text, _toks
from partita.sources import logs, projects, sinks
from partita.streaming import streams as S
from partita.tables import shared_dir, table


def _at(s, name):
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex[:8]}"


def _listing(s, d):
    """The manifest's rows as the tools list them, each once; sizes that are no numbers are nulls."""
    m = table(s, d, "manifest").filter("path is not null").withColumn("duration_seconds", F.nanvl("duration_seconds", F.lit(None).cast("double")))
    return m.select("path", "n_notes", "n_tracks", "duration_seconds", "content_hash").distinct()


def manifest_lines(s, d):
    """The manifest as lines of JSON, read strictly: a malformed line would fail the query."""
    p = _at(s, "manifest")
    sinks.write_manifest(_listing(s, d), p)
    return logs.strict(s, p, logs.MANIFEST)


def source_folders(s, d):
    """The manifest in a folder for each source, read back with the folder as a column."""
    p = _at(s, "sources")
    sinks.write_by_source(_listing(s, d), p)
    x = s.read.schema(logs.MANIFEST + ", source string").json(p)
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_notes").alias("notes"))


def score_lines(s, d):
    """Scores to four digits."""
    p = _at(s, "scores")
    q = table(s, d, "quality_scores").filter("path is not null and quality is not null and not isnan(quality)").groupBy("path").agg((F.max("quality") / 3).alias("quality"))
    sinks.write_scores(q, p)
    return s.read.schema("path string, quality double").json(p)


def metric_series(s, d):
    """A series appended in two writes; blanks stay nulls."""
    p = _at(s, "series")
    x = table(s, d, "pair_meta").filter("pair_id <> ''").groupBy("mode").agg(F.count(F.lit(1)).alias("step"), F.round(F.avg("tempo_bpm"), 3).alias("tempo"), F.max("part_path").alias("part"))
    for even in (True, False):
        sinks.append_metrics(x.filter((F.col("step") % 2 == 0) == even), p)
    return s.read.schema("mode string, step long, tempo double, part string").option("header", True).csv(p)


def pick_pools(s, d):
    """Picks of each source with how many it had: every file of 1,000 notes or more."""
    p = _at(s, "pool")
    m = table(s, d, "manifest").filter("path is not null").groupBy("path").agg(F.max("n_notes").alias("n"))
    sinks.write_pool(m.select(F.coalesce(F.nullif(F.regexp_extract(F.lower("path"), "/raw/([^/]+)/", 1), F.lit("")), F.lit("unknown")).alias("source"), "path", F.coalesce(F.col("n") >= 1000, F.lit(False)).alias("picked")), p)
    return s.read.schema("source string, picked long, available long").json(f"{p}/pool")


def vote_lines(s, d):
    """The vote log as lines of JSON between lines that are none, read leniently."""
    p = _at(s, "votes")
    x = table(s, d, "labels").filter("pair_id <> ''")
    x.select(F.to_json(F.struct("session_id", "pair_id", "idx", "choice", "flags")).alias("value")).write.text(p)
    x.filter("choice is null").select(F.concat(F.lit("not JSON: "), "pair_id").alias("value")).write.mode("append").text(p)
    v = logs.lenient(s, p, logs.VOTES)
    return v.groupBy("choice").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pair_id").alias("pairs"), F.sum(F.coalesce(F.size("flags"), F.lit(0))).alias("flags"))


def preference_file(s, d):
    """Decided votes as the historical preference file."""
    p = _at(s, "preferences")
    x = table(s, d, "labels").filter("pair_id <> '' and preferred is not null and ts is not null").select(F.expr("md5(concat_ws('|', pair_id, session_id, ts))").alias("response_id"), "pair_id", "preferred", "left_is", "right_is", "left_model", F.lit("a,b.csv").alias("source_csv")).distinct()
    x.write.option("header", True).csv(p)
    return logs.preferences(s, p).groupBy("pair_id").agg(F.count(F.lit(1)).alias("votes"), F.count_if(F.col("preferred") == "a").alias("a"), F.max("source_csv").alias("csv"))


def album_file(s, d):
    """Nations under two header rows, and those whose name has a word of the wanted."""
    p = _at(s, "albums")
    n = table(s, d, "nation")
    rows = n.select(F.concat_ws(",", "n_nationkey", "n_name", F.concat(F.lit('"'), F.substring("n_name", 1, 3), F.lit(', x"'))).alias("value"))
    head = s.createDataFrame([(",track,,album", 0), (",title,genre top,title", 1)], "value string, o int")
    head.unionByName(rows.withColumn("o", F.lit(2))).coalesce(1).sortWithinPartitions("o", "value").select("value").write.text(p)
    t = logs.two_headers(s, p)
    return logs.genre_filter(t.withColumnRenamed("track_title", "name"), "name", ["on_1", "ION_22"]).select("id", "name", F.col("track_genre_top").alias("genre"))


def event_log(s, d):
    """Votes added to a log in two appends."""
    p = _at(s, "events")
    x = table(s, d, "labels").filter("pair_id <> ''").select("pair_id", "choice")
    logs.append_events(x.filter("choice is not null"), p)
    logs.append_events(x.filter("choice is null"), p)
    return logs.lenient(s, p, "pair_id string, choice string").groupBy("choice").agg(F.count(F.lit(1)).alias("n"))


def resumed(s, d):
    """Pairs that still lack a vote for a side."""
    todo = table(s, d, "pair_meta").filter("pair_id <> ''").select("pair_id", "mode").groupBy("pair_id").agg(F.min("mode").alias("mode"))
    return S.resume(todo, table(s, d, "labels").filter("pair_id <> '' and choice in ('left', 'right')"), "pair_id")


def older_augmentation(s, d):
    """Streams augmented the older way: every pitch by itself, clipped at the ends."""
    import numpy as np

    def run(batches):
        for b in batches:
            yield b[["file_id"]].assign(ids=[T.shift_clipped(np.array(list(x), dtype=np.int64), int(f) % 13 - 6, int(f) % 3 - 1).tolist() for f, x in zip(b["file_id"], b["ids"])])

    return _toks(s, d).mapInPandas(run, "file_id long, ids array<int>").select("file_id", _text(F.col("ids")).alias("ids"))


PROJECT = """<Live><Tracks><MidiTrack><Name><EffectiveName Value="{name}"/></Name><ArrangerAutomation><MidiClip><Name Value="{user}"/><CurrentStart Value="{begin}"/><CurrentEnd Value="{end}"/><Loop><LoopStart Value="0"/><LoopEnd Value="2"/><LoopOn Value="true"/></Loop>
<KeyTrack><MidiKey Value="{key}"/><MidiNoteEvent Time="0" Duration="0.5" Velocity="90"/><MidiNoteEvent Time="1.5" Duration="1" Velocity="200"/><MidiNoteEvent Time="3" Duration="1"/></KeyTrack></MidiClip></ArrangerAutomation></MidiTrack></Tracks><MasterTrack><Tempo><Manual Value="{tempo}"/></Tempo></MasterTrack></Live>"""


def _projects(s, d):
    """A project file for each nation: one looped clip whose length, key and tempo come from its number."""
    from partita.sources.files import at

    root = _at(s, "projects")
    n = table(s, d, "nation").select("n_nationkey", "n_name")

    def write(batches):
        system, folder = at(root)
        for b in batches:
            system.create_dir(folder, recursive=True)
            for k, name in zip(b["n_nationkey"], b["n_name"]):
                text = PROJECT.format(name=f"{name} kit" if k % 4 == 0 else name, user=f"take {k}", begin=k, end=k + 1 + k % 5, key=30 + k, tempo=60 + k)
                with system.open_output_stream(f"{folder}/{k}.als") as f:
                    f.write(gzip.compress(text.encode()) if k % 2 else text.encode())
            yield b[["n_nationkey"]]

    n.mapInPandas(write, "n_nationkey int").count()
    return root


def arrangements(s, d):
    x = projects.scan(s, _projects(s, d))
    return x.select(F.regexp_extract("path", r"(\d+)\.als$", 1).cast("int").alias("file"), "start", "duration", "pitch", "velocity", "is_drum", "tempo")


def clip_notes(s, d):
    x = projects.scan(s, _projects(s, d), by_clip=True, exclude="take 1")
    return x.select(F.regexp_extract("path", r"(\d+)\.als$", 1).cast("int").alias("file"), "unit", "name", "start", "duration", "pitch", "is_drum", "excluded")


QUERIES = {
    "manifest_lines": manifest_lines, "source_folders": source_folders, "score_lines": score_lines, "metric_series": metric_series, "pick_pools": pick_pools, "vote_lines": vote_lines, "preference_file": preference_file,
    "album_file": album_file, "event_log": event_log, "resumed_pairs": resumed, "older_augmentation": older_augmentation, "project_arrangements": arrangements, "project_clips": clip_notes,
}

_P0, _P1, _V0, _V1 = min(T.ids_of("Pitch_")), max(T.ids_of("Pitch_")), min(T.ids_of("Velocity_")), max(T.ids_of("Velocity_"))
_PR = "pr AS (SELECT n_nationkey::INT AS file, n_name, n_nationkey::INT AS b, n_nationkey::INT + 1 + n_nationkey::INT % 5 AS e FROM nation)"
ORACLE = {
    "manifest_lines": "SELECT DISTINCT path, n_notes, n_tracks, CASE WHEN NOT isnan(duration_seconds) THEN duration_seconds END AS duration_seconds, content_hash FROM manifest WHERE path IS NOT NULL",
    "source_folders": """WITH m AS (SELECT DISTINCT path, n_notes, n_tracks, CASE WHEN NOT isnan(duration_seconds) THEN duration_seconds END AS t, content_hash FROM manifest WHERE path IS NOT NULL)
      SELECT coalesce(nullif(regexp_extract(lower(path), '/raw/([^/]+)/', 1), ''), 'unknown') AS source, count(*) AS files, sum(n_notes)::BIGINT AS notes FROM m GROUP BY 1""",
    "score_lines": "SELECT path, round(max(quality) / 3, 4) AS quality FROM quality_scores WHERE path IS NOT NULL AND quality IS NOT NULL AND NOT isnan(quality) GROUP BY 1",
    "metric_series": "SELECT mode, count(*) AS step, round(avg(tempo_bpm), 3) AS tempo, max(part_path) AS part FROM pair_meta WHERE pair_id <> '' GROUP BY 1",
    "pick_pools": "WITH m AS (SELECT path, max(n_notes) AS n FROM manifest WHERE path IS NOT NULL GROUP BY 1) SELECT coalesce(nullif(regexp_extract(lower(path), '/raw/([^/]+)/', 1), ''), 'unknown') AS source, count(*) FILTER (n >= 1000) AS picked, count(*) AS available FROM m GROUP BY 1",
    "vote_lines": "SELECT choice, count(*) AS n, count(DISTINCT pair_id) AS pairs, sum(coalesce(cardinality(flags), 0))::BIGINT AS flags FROM labels WHERE pair_id <> '' GROUP BY 1",
    "preference_file": """WITH x AS (SELECT DISTINCT pair_id, session_id, ts, preferred, left_is, right_is, left_model FROM labels WHERE pair_id <> '' AND preferred IS NOT NULL AND ts IS NOT NULL)
      SELECT pair_id, count(*) AS votes, count(*) FILTER (preferred = 'a') AS a, 'a,b.csv' AS csv FROM x GROUP BY 1""",
    "album_file": "SELECT n_nationkey::VARCHAR AS id, n_name AS name, substr(n_name, 1, 3) || ', x' AS genre FROM nation WHERE contains(lower(n_name), 'on_1') OR contains(lower(n_name), 'ion_22')",
    "event_log": "SELECT choice, count(*) AS n FROM labels WHERE pair_id <> '' GROUP BY 1",
    "resumed_pairs": "SELECT pair_id, min(mode) AS mode FROM pair_meta WHERE pair_id <> '' AND pair_id NOT IN (SELECT pair_id FROM labels WHERE pair_id <> '' AND choice IN ('left', 'right')) GROUP BY 1",
    "older_augmentation": f"""WITH {NOTES}, {_T} SELECT file_id, array_to_string(list_transform(ids, lambda t: CASE WHEN t BETWEEN {_P0} AND {_P1} THEN greatest({_P0}, least({_P1}, t + file_id % 13 - 6)) WHEN t BETWEEN {_V0} AND {_V1} THEN greatest({_V0}, least({_V1}, t + file_id % 3 - 1)) ELSE t END), ' ') AS ids FROM ts""",
    "project_arrangements": f"""WITH {_PR}, n AS (SELECT *, unnest([0.0, 1.5]) AS t, unnest([0.5, 1.0]) AS len, unnest([90, 127]) AS v FROM pr), k AS (SELECT *, unnest(range(0, (e - b) // 2 + 1)) AS k FROM n), x AS (SELECT *, b + t + 2 * k AS s FROM k)
      SELECT file, (s * 480)::BIGINT AS start, (least(len, e - s) * 480)::BIGINT AS duration, (30 + file)::INT AS pitch, v::INT AS velocity, file % 4 = 0 OR regexp_matches(lower(n_name), 'kick|snare|clap|hat|tom|perc|crash|ride|rim|shaker|cymbal|808|909|kit|drum') AS is_drum, (60 + file)::DOUBLE AS tempo FROM x WHERE s < e""",
    "project_clips": f"""WITH {_PR} SELECT file, 'clip-0-0' AS unit, 'take ' || file AS name, unnest([0, 720, 1440])::BIGINT AS start, unnest([240, 480, 480])::BIGINT AS duration, (30 + file)::INT AS pitch, true AS is_drum, CASE WHEN file = 1 OR file BETWEEN 10 AND 19 THEN 'clip' END AS excluded FROM pr""",
}

"""Queries over the streams' batch counterparts and over files written and read again."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from partita.plans.notes import NOTES, TPQ, _n
from partita.sources import midi, shards
from partita.streaming import streams as S
from partita.tables import shared_dir, table


def _w(df):
    return df.select(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', start)").alias("start"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', end)").alias("end"), "event_type", "n", "total")


def _e(s, d):
    return table(s, d, "events").select("ts", "event_type", "value")


def streamed(s, d):
    """Hourly counts by a stream that reads the events file once and ends."""
    schema = table(s, d, "events").schema
    src = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select("ts", "event_type", "value")
    name = f"partita_{uuid.uuid4().hex[:10]}"
    q = S.windowed(src, "1 hour", late="60 days").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_dir(s)}/{name}").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return _w(s.table(name))


def midi_roundtrip(s, d):
    """Every user's events written as MIDI bytes and parsed again."""
    def run(batches):
        for b in batches:
            rows = []
            for f, notes in zip(b["file_id"], b["notes"]):
                ns = [{k: (bool(n[k]) if k == "is_drum" else n[k] if k == "track_name" else int(n[k])) for k in n} for n in (x if isinstance(x, dict) else x.asDict() for x in notes)]
                p = midi.parse_row(str(f), midi.dump(TPQ, ns, [{"time": 0, "qpm": 120.0}], [{"time": 0, "num": 4, "den": 4}]))
                rows.append((f, len(p["notes"]), sum(n["start"] for n in p["notes"]), sum(n["pitch"] for n in p["notes"]), p["n_tracks"], p["parse_error"]))
            yield pd.DataFrame(rows, columns=["file_id", "n", "starts", "pitches", "tracks", "error"])

    track = F.dense_rank().over(Window.partitionBy("file_id").orderBy("track_name")).alias("track")
    n = _n(s, d).select("file_id", "track_name", "program", "is_drum", "start", "duration", "pitch", "velocity", track)
    g = n.groupBy("file_id").agg(F.collect_list(F.struct(F.col("track"), "track_name", "program", "is_drum", "start", "duration", "pitch", "velocity")).alias("notes"))
    return g.mapInPandas(run, "file_id long, n long, starts long, pitches long, tracks long, error string")


def npy_roundtrip(s, d):
    """Velocities of each track as a shard file, read back."""
    path = f"{shared_dir(s)}/npy-{uuid.uuid4().hex[:8]}"
    for source in (shards.NpyDataSource, midi.MidiDataSource):
        s.dataSource.register(source)
    parts = _n(s, d).select(F.concat(F.lit("train_"), "track_name").alias("name"), F.col("note_idx").alias("offset"), F.array(F.col("velocity").cast("int")).alias("ids"))
    shards.shard_rows(parts, F.col("name")).write.format("npy").mode("append").save(path)
    x = s.read.format("npy").option("rows", 500).load(path)
    return x.groupBy("shard").agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda a, v: a + v)).alias("total"))


QUERIES = {
    "window_tumbling": lambda s, d: _w(S.windowed(_e(s, d), "1 hour")), "window_sliding": lambda s, d: _w(S.windowed(_e(s, d), "6 hours", "2 hours")), "window_session": lambda s, d: _w(S.windowed(_e(s, d), "", gap="20 minutes")),
    "stream_tumbling": streamed, "midi_roundtrip": midi_roundtrip, "npy_roundtrip": npy_roundtrip,
}

_TUMBLE = "SELECT floor(epoch(ts) / 3600)::BIGINT * 3600 AS start, floor(epoch(ts) / 3600)::BIGINT * 3600 + 3600 AS \"end\", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"
ORACLE = {
    "window_tumbling": _TUMBLE, "stream_tumbling": _TUMBLE,
    "window_sliding": """SELECT (floor(epoch(ts) / 7200)::BIGINT - k) * 7200 AS start, (floor(epoch(ts) / 7200)::BIGINT - k) * 7200 + 21600 AS "end", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events, range(3) r(k) GROUP BY ALL""",
    "window_session": """WITH g AS (SELECT *, (ts >= lag(ts) OVER w + INTERVAL 20 MINUTE OR lag(ts) OVER w IS NULL)::INT AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
      s AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS sid FROM g)
      SELECT floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts) + INTERVAL 20 MINUTE))::BIGINT AS "end", event_type, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY event_type, sid""",
    "midi_roundtrip": f"WITH {NOTES} SELECT file_id, count(*) AS n, sum(start)::BIGINT AS starts, sum(pitch)::BIGINT AS pitches, count(DISTINCT track_name) AS tracks, NULL::VARCHAR AS error FROM notes GROUP BY 1",
    "npy_roundtrip": f"WITH {NOTES} SELECT 'train_' || track_name AS shard, count(*) AS n, sum(velocity)::BIGINT AS total FROM notes GROUP BY 1",
}

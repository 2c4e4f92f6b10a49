import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.sources import logs, midi, projects, shards
from partita.streaming import streams


def header(tracks, tpq=480, fmt=1):
    return b"MThd" + (6).to_bytes(4, "big") + fmt.to_bytes(2, "big") + tracks.to_bytes(2, "big") + tpq.to_bytes(2, "big")


def chunk(body):
    return b"MTrk" + len(body).to_bytes(4, "big") + body


END = b"\x00\xff\x2f\x00"


def test_running_status_fifo_and_unclosed():
    body = b"\x00\x90\x3c\x40" + b"\x0a\x3c\x50" + b"\x0a\x3c\x00" + b"\x0a\x3c\x00" + b"\x00\x40\x40" + END
    got = midi.parse(header(1) + chunk(body))
    assert [(n["start"], n["duration"], n["pitch"], n["velocity"]) for n in got["notes"]] == [(0, 20, 60, 64), (10, 20, 60, 80)]


def test_program_at_note_on_splits_tracks_and_channel_10_is_drums():
    body = b"\x00\xc0\x05" + b"\x00\x90\x3c\x40" + b"\x00\xc0\x07" + b"\x00\x90\x3e\x40" + b"\x10\x80\x3c\x00" + b"\x00\x80\x3e\x00" + b"\x00\x99\x24\x40" + b"\x04\x89\x24\x00" + END
    got = midi.parse(header(1) + chunk(body))
    assert [(n["track"], n["program"], n["is_drum"], n["pitch"]) for n in got["notes"]] == [(0, 5, False, 60), (1, 7, False, 62), (2, 0, True, 36)]


@pytest.mark.parametrize("data", [b"", b"RIFF" + bytes(20), header(1)[:-1] + b"", header(1) + chunk(b"\x00\x3c\x40"), header(1) + chunk(b"\x00\x90\x3c\xff" + END), header(1) + chunk(b"\x00\x90\x3c"), header(1) + chunk(b"\x00\xf4" + END)])
def test_broken_files_are_rows(data):
    assert midi.parse_row("x", data)["parse_error"]


def test_dump_and_parse_agree():
    rnd = random.Random(1)
    notes, free = [], {}
    for _ in range(300):
        t, p = rnd.randrange(3), rnd.randrange(20, 100)
        s = free.get((t, p), 0) + rnd.randrange(50)
        d = rnd.randrange(1, 90)
        free[t, p] = s + d
        notes.append({"track": t, "track_name": f"t{t}", "program": 10 * t, "is_drum": t == 2, "start": s, "duration": d, "pitch": p, "velocity": rnd.randrange(1, 128)})
    got = midi.parse(midi.dump(96, notes, [{"time": 0, "qpm": 100.0}, {"time": 50, "qpm": 140.0}], [{"time": 0, "num": 6, "den": 8}]))
    key = lambda n: (n["is_drum"], n["program"] * (not n["is_drum"]), n["start"], n["duration"], n["pitch"], n["velocity"])
    assert sorted(map(key, got["notes"])) == sorted(map(key, notes)) and got["tpq"] == 96
    assert [round(t["qpm"]) for t in got["tempos"]] == [100, 140] and got["meters"] == [{"time": 0, "num": 6, "den": 8}]


def test_fuzz_never_raises():
    rnd = random.Random(2)
    for _ in range(500):
        body = bytes(rnd.randrange(256) for _ in range(rnd.randrange(60)))
        midi.parse_row("f", header(1) + chunk(body))


def test_scan_and_data_source(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.MID").write_bytes(midi.dump(480, [{"track": 0, "program": 0, "is_drum": False, "start": 0, "duration": 5, "pitch": 60, "velocity": 9}]))
    (tmp_path / "bad.midi").write_bytes(b"nothing")
    (tmp_path / "note.txt").write_bytes(b"")
    rows = {r.path.rsplit("/", 1)[1]: r for r in midi.scan(spark, str(tmp_path)).collect()}
    assert rows["x.MID"].notes[0].pitch == 60 and rows["bad.midi"].parse_error and len(rows) == 2
    spark.dataSource.register(midi.MidiDataSource)
    again = spark.read.format("midi").load(str(tmp_path))
    assert midi.explode_notes(again).select("pitch", "duration").collect() == [(60, 5)]


def test_npy(spark, tmp_path):
    spark.dataSource.register(shards.NpyDataSource)
    parts = spark.createDataFrame([("s0", 3, [4, 5]), ("s0", 0, [1, 2, 3]), ("s1", 0, [65535])], "n string, offset int, ids array<int>")
    shards.shard_rows(parts, F.col("n")).write.format("npy").mode("append").save(str(tmp_path))
    a = np.load(tmp_path / "s0.npy")
    assert a.dtype == np.uint16 and a.tolist() == [1, 2, 3, 4, 5]
    with gzip.open(tmp_path / "s2.npy.gz", "wb") as f:
        np.save(f, np.array([7], dtype=np.uint16))
    got = spark.read.format("npy").option("rows", 2).load(str(tmp_path)).orderBy("shard", "first").collect()
    assert [(r.shard, r.first, r.ids) for r in got] == [("s0", 0, [1, 2]), ("s0", 2, [3, 4]), ("s0", 4, [5]), ("s1", 0, [65535]), ("s2", 0, [7])]


def test_logs(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"excerpt_id": "a", "rating": 3}\nnot json\n\n{"excerpt_id": "b", "rating": null}\n')
    assert sorted(r.excerpt_id for r in logs.lenient(spark, str(p), logs.RATINGS).collect()) == ["a", "b"]
    assert logs.lenient(spark, str(tmp_path / "none.jsonl"), logs.RATINGS).count() == 0
    with pytest.raises(Exception):
        logs.strict(spark, str(p), logs.RATINGS).collect()
    (tmp_path / "pairs").mkdir()
    (tmp_path / "pairs" / "p1.json").write_text('{"pair_id": "p1",\n "mode": "infill", "gap_beats": [4, 8]}')
    (tmp_path / "pairs" / "p2.json").write_text("{")
    assert [(r.file, r.gap_beats) for r in logs.pair_files(spark, str(tmp_path / "pairs")).collect()] == [("p1", [4.0, 8.0])]
    c = tmp_path / "t.csv"
    c.write_text(",track,,album\n,title,genre top,title\n1,One,Rock,X\n2,Two,,Y\n")
    t = logs.two_headers(spark, str(c))
    assert t.columns == ["id", "track_title", "track_genre_top", "album_title"]
    assert [r.id for r in logs.genre_filter(t, "track_genre_top", ["ROCK"]).collect()] == ["1"]


PROJECT = """<Ableton><LiveSet><Tracks><MidiTrack><Name><EffectiveName Value="909 kit"/></Name><DeviceChain><MainSequencer><ClipTimeable><ArrangerAutomation><Events>
<MidiClip Time="0"><Name Value="loop"/><CurrentStart Value="4"/><CurrentEnd Value="7"/><Loop><LoopStart Value="0"/><LoopEnd Value="2"/><LoopOn Value="true"/></Loop><Notes><KeyTracks><KeyTrack><MidiKey Value="36"/><Notes>
<MidiNoteEvent Time="0" Duration="0.5" Velocity="100"/><MidiNoteEvent Time="1.5" Duration="1" Velocity="90"/><MidiNoteEvent Time="2.5" Duration="1" Velocity="90"/><MidiNoteEvent Time="0" Duration="1" IsEnabled="false"/></Notes></KeyTrack></KeyTracks></Notes></MidiClip>
</Events></ArrangerAutomation></ClipTimeable></MainSequencer></DeviceChain></MidiTrack></Tracks><MasterTrack><Mixer><Tempo><Manual Value="174"/></Tempo></Mixer></MasterTrack></LiveSet></Ableton>"""


def test_projects(spark, tmp_path):
    (tmp_path / "p.als").write_bytes(gzip.compress(PROJECT.encode()))
    (tmp_path / "pilot.als").write_bytes(PROJECT.encode())
    (tmp_path / "bad.als").write_bytes(b"\x1f\x8bno")
    rows = projects.scan(spark, str(tmp_path)).filter("path like '%/p.als'").orderBy("start").collect()
    assert [(r.start / 480, r.duration / 480) for r in rows] == [(4, 0.5), (5.5, 1), (6, 0.5)] and rows[0].is_drum and rows[0].tempo == 174
    clips = projects.scan(spark, str(tmp_path), by_clip=True)
    assert clips.filter("error is not null").count() == 1
    assert {(r.path.rsplit("/", 1)[1], r.excluded) for r in clips.filter("error is null").collect()} == {("p.als", None), ("pilot.als", "project")}
    assert clips.filter("path like '%/p.als'").count() == 3


def test_silent_tracks_and_clips_and_bad_values(spark, tmp_path):
    """Muted tracks, disabled clips, empty regions and unreadable keys give no notes of the arrangement; clips by themselves don't mind."""
    muted = PROJECT.replace("<DeviceChain>", '<DeviceChain><Mixer><Speaker><Manual Value="false"/></Speaker></Mixer>', 1)
    kinds = {"muted": muted, "off": PROJECT.replace('<CurrentStart', '<Disabled Value="true"/><CurrentStart'), "empty": PROJECT.replace('LoopEnd Value="2"', 'LoopEnd Value="0"'), "key": PROJECT.replace('MidiKey Value="36"', 'MidiKey Value="x"'),
             "rack": PROJECT.replace("909 kit", "lead").replace("<DeviceChain>", "<DeviceChain><DeviceChain><Devices><DrumGroupDevice/></Devices></DeviceChain>", 1), "slow": PROJECT.replace('Value="174"', 'Value="?"')}
    for k, text in kinds.items():
        (tmp_path / f"{k}.als").write_bytes(text.encode())
    name = F.regexp_extract("path", r"([a-z]+)\.als", 1)
    got = projects.scan(spark, str(tmp_path)).groupBy(name.alias("f")).agg(F.count(F.lit(1)).alias("n"), F.bool_or("is_drum").alias("drum"), F.max("tempo").alias("tempo")).collect()
    assert {tuple(r) for r in got} == {("rack", 3, True, 174.0), ("slow", 3, True, 120.0)}
    clips = {r.f: r.n for r in projects.scan(spark, str(tmp_path), by_clip=True).groupBy(name.alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert clips == dict.fromkeys(("muted", "off", "empty", "rack", "slow"), 3)


def test_bad_bytes_matter_only_where_they_are_used():
    body = bytes([0x00, 0x90, 60, 64, 0x00, 0xA0, 60, 200, 0x10, 0x80, 60, 0, 0x00, 0xFF, 0x2F, 0x00])
    head = b"MThd" + bytes([0, 0, 0, 6, 0, 0, 0, 1, 1, 0xE0])
    assert [n["pitch"] for n in midi.parse(head + b"MTrk" + len(body).to_bytes(4, "big") + body)["notes"]] == [60]
    with pytest.raises(midi.MidiError, match="over 127"):
        midi.parse(head + b"MTrk" + len(body).to_bytes(4, "big") + body.replace(bytes([0xA0]), bytes([0xB0])))


def _drain(spark, df, name, tmp_path, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_vote_log_stream(spark, tmp_path, rocks):
    schema = "pair_id string, t long, kind int, target_t long, value string"
    files = [[("p", 5, 1, None, "tie"), ("p", 1, 0, None, "left")], [("p", 3, 0, None, "right"), ("q", 1, 0, None, "left"), ("q", 2, 2, 1, None)], [("p", 9, 2, None, None), ("p", 9, 2, None, None)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = {}
    for r in _drain(spark, streams.vote_log(src), "votes_out", tmp_path, "update"):
        if r.version >= last.get(r.pair_id, r).version:
            last[r.pair_id] = r
    assert (last["p"].choice, last["p"].standing) == ("left", 1) and (last["q"].choice, last["q"].standing) == (None, 0)


def test_vote_log_stream_in_any_order_equals_one_pass(spark, tmp_path, rocks):
    rnd = random.Random(6)
    events = [("r", 10 * i, 0, None, rnd.choice(["left", "right"])) for i in range(25)] + [("r", rnd.randrange(300), rnd.choice([1, 2]), 10 * rnd.randrange(25) if rnd.random() < 0.5 else None, f"v{i}") for i in range(25)]
    events = [e if e[2] != 2 else (*e[:4], None) for e in events]
    standing = {}
    for _, t, kind, target, value in sorted(set(events), key=lambda e: (e[1], e[2], str(e[3]), str(e[4]))):
        at = t if kind == 0 else target if target is not None else max(standing, default=None)
        if kind == 0 or (kind == 1 and at in standing):
            standing[at] = value
        elif kind == 2:
            standing.pop(at, None)
    rows = events + rnd.sample(events, 20)
    rnd.shuffle(rows)
    schema = "pair_id string, t long, kind int, target_t long, value string"
    for i in range(0, len(rows), 14):
        spark.createDataFrame(rows[i : i + 14], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "any"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "any"))
    last = max(_drain(spark, streams.vote_log(src), "any_out", tmp_path, "update"), key=lambda r: r.version)
    assert (last.choice, last.standing) == (standing[max(standing)], len(standing)) and last.version == 5


def test_note_and_token_streams(spark, tmp_path, rocks):
    from partita.functions.tokens import clean_stream, decode, encode

    ids = encode([(0, 480 * i, 200, 60 + i % 12, 80) for i in range(20)], [(0, 4, 4)], 480)
    for i, lo in enumerate(range(0, len(ids), 23)):
        spark.createDataFrame([("s", p, ids[p]) for p in range(lo, min(len(ids), lo + 23))], "stream string, pos int, token int").coalesce(1).write.parquet(str(tmp_path / "tok" / f"{i:02d}"))
    src = lambda: spark.readStream.schema("stream string, pos int, token int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "tok"))
    got = sorted(tuple(r)[1:] for r in _drain(spark, streams.note_stream(src()), "notes_out", tmp_path, "append"))
    assert got == sorted(decode(ids))
    strict = [tuple(r)[1:] for r in _drain(spark, streams.note_stream(src(), True), "strict_out", tmp_path, "append")]
    assert 0 < len(strict) < len(got) and set(strict) <= set(got)
    clean = [r.token for r in sorted(_drain(spark, streams.clean_stream(src()), "clean_out", tmp_path, "append"), key=lambda r: r.pos)]
    assert clean == clean_stream(False, ids, 8, True)[-len(clean):] and len(clean) >= len(ids) - 4


def test_resume(spark):
    todo = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert streams.resume(todo, spark.createDataFrame([("b",)], "k string"), "k").collect() == [("a",)]


def test_archive_samples(spark, tmp_path):
    import io
    import tarfile

    from partita.sources import archives

    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for i in range(30):
            info = tarfile.TarInfo(f"d/{i}.{'mid' if i % 2 else 'txt'}")
            info.size = 3
            t.addfile(info, io.BytesIO(b"abc"))
    spark.dataSource.register(archives.TarDataSource)
    got = spark.read.format("tarsample").option("n", 4).option("skip", 3).load(str(tmp_path)).collect()
    assert len(got) == 4 and all(r.member.endswith(".mid") and bytes(r.content) == b"abc" for r in got)
    spark.createDataFrame([(i, bytes([i])) for i in range(50)], "i int, midi binary").write.parquet(str(tmp_path / "p"))
    a, b = (sorted(bytes(r.content) for r in archives.parquet_sample(spark, str(tmp_path / "p"), 7, 1).collect()) for _ in range(2))
    assert a == b and len(set(a)) == 7


def test_sinks(spark, tmp_path):
    import datetime as dt

    from partita.sources import sinks

    m = spark.createDataFrame([("/x/raw/lakh/a.mid", 5, 1, 2.0, "h"), ("/y/raw/aria/b.mid", None, 1, 2.0, "h"), ("odd", 1, 1, 1.0, None)], logs.MANIFEST)
    sinks.write_manifest(m, str(tmp_path / "m"))
    assert logs.strict(spark, str(tmp_path / "m"), logs.MANIFEST).exceptAll(m).count() == 0
    sinks.write_by_source(m, str(tmp_path / "s"))
    assert {p.name for p in (tmp_path / "s").glob("source=*")} == {"source=lakh", "source=aria", "source=unknown"}
    sinks.append_metrics(spark.createDataFrame([(1, 0.5, None)], "step int, lr double, val double"), str(tmp_path / "csv"))
    sinks.append_metrics(spark.createDataFrame([(2, 0.5, 1.0)], "step int, lr double, val double"), str(tmp_path / "csv"))
    assert sorted(map(tuple, spark.read.schema("step int, lr double, val double").option("header", True).csv(str(tmp_path / "csv")).collect())) == [(1, 0.5, None), (2, 0.5, 1.0)]
    sinks.write_scores(spark.createDataFrame([("a", 1.23456)], "path string, quality double"), str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q")).first().quality == 1.2346
    sinks.write_pool(spark.createDataFrame([("s", "a", True), ("s", "b", False)], "source string, path string, picked boolean"), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p" / "pool")).select("picked", "available").first() == (1, 2)
    spark.createDataFrame([(dt.datetime(2026, 1, 2, 3), "r")], "time timestamp, id string").write.parquet(str(tmp_path / "req"))
    src = spark.readStream.schema("time timestamp, id string").parquet(str(tmp_path / "req"))
    sinks.request_log(src, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    assert (tmp_path / "log" / "date=2026-01-02").exists()
    (tmp_path / "blocked").write_text("a file where the folder should be")
    q = sinks.request_log(src, str(tmp_path / "blocked" / "x"), str(tmp_path / "ck2"))
    q.awaitTermination()
    assert q.exception() is None

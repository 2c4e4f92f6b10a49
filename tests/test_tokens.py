import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.functions import documents as D
from partita.functions import tokens as T


def test_vocabulary_is_derived():
    v = T.vocabulary()
    assert len(v) == 598 and v["PAD_None"] == 0 and v["Bar_None"] == 70 and len(T.durations()) == 64 and T.VELOCITIES[:3] == [3, 7, 11] and T.VELOCITIES[-1] == 127
    assert len(T.header_vocab()) == 65 and len(T.ids_of("PitchDrum_")) == 62 and len(T.ids_of("Position_")) == 96


def names(ids):
    inv = [*T.vocabulary()]
    return [inv[i] for i in ids]


def test_encode_by_hand():
    got = names(T.encode([(0, 0, 480, 60, 64), (-1, 240, 10, 36, 100), (0, 1920, 960, 62, 64)], [(0, 4, 4)], 480))
    assert got == ["Bar_None", "TimeSig_4/4", "Position_0", "Program_0", "Pitch_60", "Velocity_63", "Duration_1.0.8", "Position_4", "Program_-1", "PitchDrum_36", "Velocity_99", "Duration_0.1.8",
                   "Bar_None", "TimeSig_4/4", "Position_0", "Program_0", "Pitch_62", "Velocity_63", "Duration_2.0.8"]


def test_encode_changes_meter_at_the_bar_line_and_rounds_up_into_the_next_bar():
    got = names(T.encode([(0, 0, 120, 60, 64), (0, 1910, 120, 61, 64), (0, 3 * 480 * 4, 120, 62, 64)], [(0, 4, 4), (1900, 3, 4)], 480))
    assert [t for t in got if t.startswith("TimeSig")] == ["TimeSig_4/4", "TimeSig_3/4", "TimeSig_3/4", "TimeSig_3/4"][: got.count("Bar_None")]
    assert got[got.index("Pitch_61") - 1] == "Position_0"
    assert T.encode([], [], 480) == [] and T.encode([(0, 0, 1, 200, 1)], [], 480) == []


@pytest.mark.parametrize("seed", range(5))
def test_round_trip(seed):
    rnd = random.Random(seed)
    meters = [(0, *rnd.choice(T.METERS)), (5000, *rnd.choice(T.METERS))]
    notes = [(rnd.choice([-1, 0, 33]), rnd.randrange(20000), rnd.randrange(1, 6000), rnd.randrange(30, 80), rnd.randrange(1, 128)) for _ in range(120)]
    ids = T.encode(notes, meters, 480)
    assert len(T.decode(ids)) == 120
    inv, at, ms = [*T.vocabulary()], 0, []
    for i in ids:
        if inv[i].startswith("TimeSig_"):
            n, d = map(int, inv[i][8:].split("/"))
            ms.append((at, n, d))
            at += T.GRID * 4 // d * n
    again = T.encode(T.decode(ids), ms, T.GRID)
    assert sorted(T.decode(again)) == sorted(T.decode(ids))


V = T.vocabulary()
BAR, TS, TS3, EOS, SEP, POS = V["Bar_None"], V["TimeSig_4/4"], V["TimeSig_3/4"], V["EOS_None"], V["SEP_None"], V["Position_0"]


@pytest.mark.parametrize("on_line, raw, stop, trim, want", [
    (True, [BAR, TS, BAR, TS, POS, BAR, POS], None, True, [POS, BAR, POS]),
    (False, [BAR, TS3, BAR, TS, POS], None, True, [BAR, TS3, POS]),
    (False, [POS, EOS, POS], None, True, [POS, EOS]),
    (False, [POS, SEP, POS], None, True, [POS]),
    (True, [POS, BAR, POS, BAR, POS], 2, False, [POS, BAR, POS]),
    (False, [BAR, POS, BAR, POS], 1, True, [BAR, POS]),
])
def test_clean_stream(on_line, raw, stop, trim, want):
    assert T.clean_stream(on_line, raw, stop, trim) == want


def test_streams_of_a_batch_are_augmented_by_themselves(spark):
    rnd = random.Random(1)
    streams = [[rnd.choice([V["Program_-1"], V["Program_5"], *T.ids_of("Pitch_"), *T.ids_of("PitchDrum_"), *T.ids_of("Velocity_"), BAR]) for _ in range(rnd.randrange(0, 60))] for _ in range(40)] + [[], [V["Pitch_127"], V["Pitch_0"]]]
    shift, jitter = np.array([rnd.randrange(-6, 7) for _ in streams]), np.array([rnd.randrange(-1, 2) for _ in streams])
    flat, sizes = np.array([i for x in streams for i in x], dtype=np.int64), np.array([len(x) for x in streams])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = T.augment_batch(flat, sizes, shift, jitter)
    assert all((out[a:b] == T.shift_and_jitter(np.array(x, dtype=np.int64), int(k), int(j))).all() for x, k, j, a, b in zip(streams, shift, jitter, ends, ends[1:]))
    family = [n.split("_")[0] for n in V]
    assert all(family[a] == family[b] for a, b in zip(flat, out)) and out[-2:].tolist() == streams[-1]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(streams)] + [(99, None)], "file_id int, ids array<int>")
    got = {r.file_id: r.ids for r in T.augmented(df).collect()}
    assert got[99] is None and got[40] == [] and all(len(got[i]) == len(x) for i, x in enumerate(streams))


def test_augment_shrinks_until_nothing_clips_and_leaves_drums():
    ids = np.array([V["Program_-1"], V["PitchDrum_36"], V["Program_0"], V["Pitch_125"], V["Velocity_3"]])
    out = names(T.shift_and_jitter(ids, 6, -1))
    assert out == ["Program_-1", "PitchDrum_36", "Program_0", "Pitch_127", "Velocity_3"]
    assert names(T.shift_and_jitter(ids, 0, 1))[-1] == "Velocity_7" and len(T.shift_and_jitter(np.array([], dtype=np.int64), 3, 1)) == 0


def test_columns(spark):
    h = [V["Inst_Bass"], V["Tempo_2"], V["Task_infill"]]
    df = spark.createDataFrame([(h + [BAR, TS, POS],), ([],), ([BAR, TS],)], "ids array<int>")
    a, b = T.split_header(F.col("ids"))
    assert [(list(r.a), list(r.b)) for r in df.select(a.alias("a"), b.alias("b")).collect()] == [(h, [BAR, TS, POS]), ([], []), ([], [BAR, TS])]
    assert [r[0] for r in df.select(T.ends_on_bar_line(F.col("ids"))).collect()] == [False, False, True]
    assert [len(r[0]) for r in df.select(T.close_bar(F.col("ids"))).collect()] == [8, 2, 2]
    with pytest.raises(Exception, match="spans"):
        df.select(T.pad_to_bars(F.col("ids"), F.lit(0))).collect()
    with pytest.raises(Exception, match="has 1 bars"):
        df.filter("size(ids) = 2").select(*T.split_bars(F.col("ids"), F.lit(0), F.lit(2))).collect()
    kept = df.limit(1).select(T.drop_families(F.array(*map(F.lit, h)), F.lit("k"), 0.0, 1.0)).first()[0]
    assert kept == [V["Task_infill"]] and df.limit(1).select(T.drop_families(F.array(*map(F.lit, h)), F.lit("k"), 0.0, 0.0)).first()[0] == h
    with pytest.raises(Exception, match="not a header token"):
        df.select(T.sort_header(F.array(F.lit("Foo_1")))).collect()


NOTE_ROW = "file_id string, track_name string, program int, is_drum boolean, note_idx int, start long, duration long, pitch int, velocity int"


def build(spark, files, meters=((0, 4, 4),), **more):
    """Documents of {path: [(track, program, notes)]}, all under the same meters."""
    rows = [(path, t, max(p, 0), p == -1, i, *n) for path, tracks in files.items() for t, p, ns in tracks for i, n in enumerate(ns)]
    heads = spark.createDataFrame([(path, 480, [tuple(m) for m in meters]) for path in files], "path string, tpq int, meters array<struct<time:long,num:int,den:int>>").withColumns({k: F.lit(v) for k, v in more.items()})
    return D.build(D.scores_of(spark.createDataFrame(rows, NOTE_ROW), heads))


def test_documents_are_reproducible_and_well_formed(spark):
    rnd = random.Random(3)
    line = lambda lo, hi, n, step, d: [(i * step, d, rnd.randrange(lo, hi), 80) for i in range(n)]
    band = [("lead", 0, line(60, 80, 400, 240, 200)), ("low", 33, line(30, 45, 120, 960, 900)), ("beat", -1, line(36, 46, 300, 240, 60))]
    hands, melody = [("p", 0, sorted(line(40, 50, 60, 1920, 1900) + line(60, 80, 400, 240, 100)))], [("m", 0, line(40, 80, 500, 240, 200))]
    files = {**{f"/raw/lakh/{i}.mid": band for i in range(4)}, "hands": hands, "melody": melody, "none": [], "one": [("m", 0, [(0, 10, 60, 60)])]}
    frame = build(spark, files, tempo="Tempo_2", genre="jazz", source="nobody")
    docs = sorted(map(tuple, frame.collect()), key=str)
    assert docs == sorted(map(tuple, build(spark, files, tempo="Tempo_2", genre="jazz", source="nobody").collect()), key=str)
    skip = {r[0]: r[4] for r in docs if r[4]}
    assert skip == {"none": "empty", "one": "empty"}
    kinds = {p: {r[1] for r in docs if r[0] == p} for p in files}
    assert kinds["/raw/lakh/0.mid"] == {"continuation", "accompaniment", "infill"} and kinds["melody"] == {"continuation", "infill"} and "accompaniment" in kinds["hands"]
    for path, kind, _, ids, reason in docs:
        if reason:
            continue
        assert ids[0] == V["BOS_None"] and (ids[-1] == EOS) == (kind == "continuation")
        head = names(ids[1 : ids.index(BAR)])
        assert head == sorted(head, key=lambda n: T.HEADER_FAMILIES.index(n.split("_")[0] + "_")) and {"Tempo_2", "Genre_jazz"} <= set(head) and not any(n.startswith("Source") for n in head)
        if kind == "accompaniment":
            at = ids.index(SEP)
            assert ids[:at].count(BAR) == ids[at:].count(BAR) == 16 and ids[1] == V["Task_accomp"]
        if kind == "infill":
            assert ids.count(V["MASK_None"]) == 1 and ids.count(SEP) == 1 and ids[1] == V["Task_infill"] and ids.count(BAR) == 16
    whole = [r for r in docs if r[0] == "melody" and r[1] == "continuation"]
    assert len(whole) == 1 and T.decode(whole[0][3]) and len(T.decode(whole[0][3])) == 500
    assert {tuple(r) for r in build(spark, {"melody": melody}, [(0, 11, 16)]).select("skip").collect()} == {("timesig",)}
    assert build(spark, {"melody": melody}, error="parse error").first().skip == "parse error"


def test_drums_of_documents_are_normalised(spark):
    kit = [(i * 240, 60, (36, 38, 42)[i % 3], 90) for i in range(90)]
    got = build(spark, {"x": [("Drums", 0, kit), ("lead", 5, [(i * 240, 200, 70, 80) for i in range(90)])]}).filter("kind = 'continuation'").collect()
    assert len(got) == 3 and all(V["Inst_Drums"] in r.ids or V["Inst_Piano"] in r.ids for r in got) and sum(V["Program_-1"] in r.ids for r in got) == 2
    assert not any(V["Pitch_36"] in r.ids for r in got)


def test_slow_records_are_given_up(spark):
    import time

    from partita.functions.guard import within

    assert within(0.2, time.sleep, 5) == (None, True) and within(5, len, "abc") == (3, False) and within(0, len, "abc") == (3, False)
    with pytest.raises(KeyError):
        within(1, lambda: {}["x"])
    notes = [(i, 1, 60, 60) for i in range(30_000)]
    rows = [("x", "m", 0, False, i, *n) for i, n in enumerate(notes)]
    heads = spark.createDataFrame([("x", 480, [(0, 4, 4)])], "path string, tpq int, meters array<struct<time:long,num:int,den:int>>")
    assert D.build(D.scores_of(spark.createDataFrame(rows, NOTE_ROW), heads), seconds=0.001).collect()[0].skip == "timeout"


def test_bar_lines_by_hand(spark):
    m = "array<struct<time:long,num:int,den:int>>"
    df = spark.createDataFrame([([(0, 4, 4), (2000, 3, 4), (2100, 2, 4)], 5000), ([], 1920), ([(0, 3, 4)], 0), ([(9000, 3, 4)], 100)], f"meters {m}, end long")
    assert [r[0] for r in df.select(D.bar_starts(F.col("meters"), F.col("end"), F.lit(480))).collect()] == [[0, 1920, 3840, 4800, 5760], [0, 1920, 3840], [0, 1440], [0, 1920]]
    assert [r[0] for r in df.select(D.bar_bounds(F.col("meters"), F.col("end"), F.lit(480))).collect()] == [[0, 1920, 3840, 4800, 5000], [0, 1920], [0], [0, 100]]


def test_seeded_sampler():
    from partita.operators.preferences import sample_top_k, seeded_uniform

    u = seeded_uniform(7, 1000)
    assert (u >= 0).all() and (u < 1).all() and len(set(u)) > 990 and (seeded_uniform(7, 3) == u[:3]).all()
    logits = np.array([0.0, 5.0, 5.0, -1.0])
    assert {sample_top_k(logits, x, top_k=1) for x in u[:200]} == {1, 2} and sample_top_k(logits, 0.5, ban=(1, 2), top_k=1) == 0
    assert sample_top_k(logits, 0.0, top_k=4, eos=0, hold_eos=True) == 1
    with pytest.raises(ValueError):
        sample_top_k(logits, 0.5, ban=(0, 1, 2, 3))


def test_older_augmentation_and_schemes(spark):
    import json

    ids = np.array([V["Pitch_125"], V["PitchDrum_36"], V["Velocity_127"]])
    assert names(T.shift_clipped(ids, 6, 2)) == ["Pitch_127", "PitchDrum_36", "Velocity_127"]
    bars = {"config": {"special_tokens": [*T.SPECIALS, *T.header_vocab()], "num_velocities": 32}, "tokenization": "REMI"}
    assert T.load_scheme(json.dumps(bars)) == "bars" and T.load_scheme('{"config": {"special_tokens": ["PAD_None"]}}') == "events"
    bars["config"]["special_tokens"].append("Foo_1")
    with pytest.raises(ValueError):
        T.load_scheme(json.dumps(bars))
    with pytest.raises(Exception, match="not an instrument family"):
        spark.range(1).select(T.with_instruments(F.array(F.lit("Tempo_1")), F.array(F.lit("Kazoo")))).collect()

"""Token queries over events seen as notes and over manifest paths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from partita.functions import documents as D
from partita.functions import notes as N
from partita.functions import tokens as T
from partita.plans.notes import NOTES, TPQ, _n, _tempos
from partita.tables import table

V = T.vocabulary()
BAR, EOS, BOS, SEP, MASK = (V[f"{x}_None"] for x in ("Bar", "EOS", "BOS", "SEP", "MASK"))


def _played(s, d):
    """Events as notes of 120 times their pace, so that a month spans some bars; drums on percussion keys."""
    drum = F.col("is_drum")
    n = _n(s, d).withColumn("program", F.when(drum, -1).otherwise(F.col("program")).cast("int")).withColumn("pitch", F.when(drum, 35 + F.col("pitch") % 20).otherwise(F.col("pitch")))
    return n.withColumn("start", F.floor(F.col("start") / 12)).withColumn("duration", F.floor(F.col("duration") / 4))


def _path():
    return F.concat(F.lit("/raw/user/"), "file_id", F.lit(".mid"))


def _meters():
    """3/4, or 4/4 with 6/8 from within the third bar on, or 4/4, by file."""
    m = lambda t, n, d: F.struct(F.lit(t).cast("long").alias("time"), F.lit(n).alias("num"), F.lit(d).alias("den"))
    by = F.col("file_id") % 3
    return F.when(by == 0, F.array(m(0, 3, 4))).when(by == 1, F.array(m(0, 4, 4), m(9 * TPQ, 6, 8))).otherwise(F.array(m(0, 4, 4)))


def _scores(s, d):
    note = F.struct("start", "note_idx", F.col("track_name").alias("track"), "program", "duration", "pitch", "velocity")
    return _played(s, d).groupBy("file_id").agg(F.array_sort(F.collect_list(note)).alias("notes")).select("file_id", _path().alias("path"), F.lit(TPQ).alias("tpq"), _meters().alias("meters"), "notes")


def encoded(s, d):
    return T.encode_files(_scores(s, d))


def roundtrip(s, d):
    """Whether encoding what was decoded gives the same ids, and how many bars and notes a file has."""
    def run(batches):
        for b in batches:
            rows = []
            for f, ids in zip(b["file_id"], b["ids"]):
                ids, notes = list(map(int, ids)), T.decode(list(map(int, ids)))
                meters, at, k = [], 0, 0
                names = [*V]
                for i in ids:
                    if names[i].startswith("TimeSig_"):
                        n, dd = map(int, names[i][8:].split("/"))
                        meters.append((at, n, dd))
                        at += T.GRID * 4 // dd * n
                again = T.encode(notes, meters, T.GRID)
                rows.append((f, again == ids, ids.count(BAR), len(notes)))
            yield pd.DataFrame(rows, columns=["file_id", "same", "bars", "notes"])

    return encoded(s, d).mapInPandas(run, "file_id long, same boolean, bars int, notes int")


def _documents(s, d):
    tempo = N.dominant_tempo(_tempos(s, d), _n(s, d).groupBy("file_id").agg(F.max(F.col("start") + F.col("duration")).alias("end")))
    files = _played(s, d).select("file_id").distinct().join(tempo, "file_id", "left")
    meters = F.when(F.col("file_id") % 11 == 7, F.array(F.struct(F.lit(0).cast("long").alias("time"), F.lit(11).alias("num"), F.lit(16).alias("den")))).otherwise(_meters())
    files = files.select(_path().alias("path"), F.lit(TPQ).alias("tpq"), meters.alias("meters"), N.tempo_token(F.col("tempo"), F.col("tempo"), F.lit("user")).alias("tempo"), F.lit("user").alias("source"), F.element_at(F.array(*map(F.lit, T.GENRES)), (F.col("file_id") % 16 + 1).cast("int")).alias("genre"))
    return D.build(D.scores_of(_played(s, d).withColumn("file_id", _path()), files))


def documents(s, d):
    return _documents(s, d).select("path", "kind", "part", F.size("ids").alias("tokens"), "skip", T.count_bars(F.col("ids")).alias("bars"))


def document_views(s, d):
    """How many continuation documents a file gives (itself and up to two of its long tracks), or why it gives none."""
    return _documents(s, d).groupBy("path").agg(F.count_if(F.col("kind") == "continuation").alias("views"), F.max("skip").alias("skip"))


def bar_lines(s, d):
    """Bar lines of every file under its own meters, to the first one past its end."""
    x = _played(s, d).groupBy("file_id").agg(F.max(F.col("start") + F.col("duration")).alias("end"))
    return x.select("file_id", F.posexplode(D.bar_starts(_meters(), F.col("end"), F.lit(TPQ))).alias("bar", "edge"))


def bar_bounds(s, d):
    """Bar lines before a file's end, and the end."""
    x = _played(s, d).groupBy("file_id").agg(F.max(F.col("start") + F.col("duration")).alias("end"))
    return x.select("file_id", F.posexplode(D.bar_bounds(_meters(), F.col("end"), F.lit(TPQ))).alias("bar", "edge"))


def _toks(s, d):
    """Events as a token stream: two header ids, then Bar, TimeSig and Position, Program and Pitch ids by type."""
    progs, pitches = T.ids_of("Program_"), T.ids_of("Pitch_")
    tok = F.when(F.col("track_name") == "error", BAR).when(F.col("track_name") == "signup", min(progs) + F.when(F.col("pitch") % 3 == 0, 0).otherwise(1 + F.col("pitch"))).when(F.col("track_name") == "view", V["TimeSig_3/4"]).otherwise(min(pitches) + F.col("pitch"))
    x = _n(s, d).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start", "note_idx", tok.cast("int").alias("t")))).alias("a"))
    return x.select("file_id", F.concat(F.array(F.lit(V["Inst_Bass"]), F.lit(V["Density_2"])), F.transform("a", lambda z: z["t"])).alias("ids"))


_T = f"""tk AS (SELECT file_id, start, note_idx, (CASE track_name WHEN 'error' THEN {BAR} WHEN 'signup' THEN {min(T.ids_of('Program_'))} + CASE WHEN pitch % 3 = 0 THEN 0 ELSE 1 + pitch END WHEN 'view' THEN {V['TimeSig_3/4']} ELSE {min(T.ids_of('Pitch_'))} + pitch END)::INT AS t FROM notes),
 ts AS (SELECT file_id, [{V['Inst_Bass']}, {V['Density_2']}]::INT[] || list(t ORDER BY start, note_idx) AS ids FROM tk GROUP BY 1)"""


def _text(c):
    return F.array_join(c.cast("array<string>"), " ")


def layouts(s, d):
    """Layouts of whole streams: accompaniment from half to half, infill with the middle third masked."""
    h, b = T.split_header(F.col("ids"))
    x = _toks(s, d).select("file_id", h.alias("h"), b.alias("b"), F.size(b).alias("n"))
    at = lambda k, of: F.floor(F.col("n") * k / of).cast("int")
    part = lambda k, of: F.slice("b", at(k, of) + 1, at(k + 1, of) - at(k, of))
    return x.select("file_id", _text(T.continuation(F.col("h"), F.col("b"))).alias("continuation"), _text(T.accompaniment(F.col("h"), part(0, 2), part(1, 2), end=True)).alias("accompaniment"), _text(T.infill(F.col("h"), part(0, 3), part(2, 3), part(1, 3))).alias("infill"))


def header_parts(s, d):
    h, b = T.split_header(F.col("ids"))
    return _toks(s, d).select("file_id", _text(h).alias("header"), F.size(b).alias("body"), T.count_bars(F.col("ids")).alias("bars"), T.ends_on_bar_line(F.col("ids")).alias("on_line"))


def padded(s, d):
    x = _toks(s, d)
    p = T.pad_to_bars(F.col("ids"), F.greatest(T.count_bars(F.col("ids")), F.lit(16)))
    return x.select("file_id", F.size(p).alias("padded"), _text(F.slice(p, -2, 2)).alias("tail"), F.size(T.close_bar(F.col("ids"))).alias("closed"))


def fitted(s, d):
    p, n = T.fit_to_context(F.col("ids"), F.col("file_id") * 3, 120, 40)
    return _toks(s, d).select("file_id", F.size(p).alias("prompt"), n.alias("new"), T.token_budget(F.size("ids"), T.count_bars(F.col("ids"))).alias("accompany"), T.infill_budget(F.size("ids"), T.count_bars(F.col("ids")), F.lit(4)).alias("infill"))


def bars_cut(s, d):
    a, b = T.split_bars(F.col("ids"), F.lit(2), F.lit(3))
    return _toks(s, d).filter(T.count_bars(F.col("ids")) >= 5).select("file_id", F.size(a).alias("prefix"), F.size(b).alias("suffix"))


def loops(s, d):
    """Loop metrics of bars reduced to whether they hold a note."""
    x = _n(s, d).withColumn("t", F.when(F.col("is_drum"), BAR).otherwise(F.col("pitch") % 2)).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start", "note_idx", F.col("t").cast("int").alias("t")))).alias("a"))
    x = x.select("file_id", T.loop_metrics(F.transform("a", lambda z: z["t"])).alias("m")).filter("m is not null")
    return x.select("file_id", F.round("m.adjacent_identical", 9).alias("adjacent"), F.round("m.distinct_fraction", 9).alias("distinct"), F.col("m.n_bars").alias("n"))


def half_drift(s, d):
    """Distinct tokens of the second half less those of the first, and their Bar shares."""
    n = F.size("ids")
    a, b = F.slice("ids", F.lit(1), F.floor(n / 2).cast("int")), F.slice("ids", (F.floor(n / 2) + 1).cast("int"), n)
    share = lambda c: T.count_bars(c) / F.size(c)
    return _toks(s, d).select("file_id", (F.size(F.array_distinct(b)) - F.size(F.array_distinct(a))).alias("distinct"), F.round(share(b) - share(a), 9).alias("bars"))


def programs(s, d):
    return _toks(s, d).select("file_id", F.posexplode(T.filled_program(F.col("ids"))).alias("pos", "program"))


def stream_clean(s, d):
    def run(batches):
        for b in batches:
            out = [T.clean_stream(bool(f % 2), [int(i) for i in ids][2:] + [EOS, BAR], 3 if f % 3 else None, bool(f % 5)) for f, ids in zip(b["file_id"], b["ids"])]
            yield pd.DataFrame({"file_id": b["file_id"], "n": [len(o) for o in out], "ids": out})

    return _toks(s, d).mapInPandas(run, "file_id long, n int, ids array<int>")


def header_sorting(s, d):
    x = _n(s, d).groupBy("file_id").agg(F.min("pitch").alias("p"))
    names = F.array(F.concat(F.lit("Density_"), (F.col("p") % 4).cast("string")), F.lit("Inst_Bass"), F.lit("Quality_1"), F.lit("Task_infill"), F.lit("Inst_Piano"), F.concat(F.lit("Genre_"), F.element_at(F.array(*map(F.lit, T.GENRES)), (F.col("file_id") % 16 + 1).cast("int"))))
    return x.select("file_id", F.array_join(T.sort_header(names), " ").alias("header"))


def rendered(s, d):
    """Every bar up to a file's last as text, beat:pitch:length of each note and beat:voice of each drum, empty bars marked."""
    n = _n(s, d).withColumn("bar", F.floor(F.col("start") / F.lit(float(TPQ)) / 128))
    at = F.format_string("%.2f", F.floor((F.col("start") - F.col("bar") * (128 * TPQ)) / 36) / F.lit(100.0))
    length = F.format_string("%.2f", F.floor(F.col("duration") / 36) / F.lit(100.0))
    x = n.withColumn("txt", F.when(F.col("is_drum"), F.concat_ws(":", at, T.drum_name(F.col("pitch")))).otherwise(F.concat_ws(":", at, T.pitch_name(F.col("pitch")), length)))
    g = x.groupBy("file_id", "bar").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "pitch", "note_idx", "txt"))), lambda z: z["txt"]), " ").alias("line"))
    grid = g.groupBy("file_id").agg(F.min("bar").alias("lo"), F.max("bar").alias("hi")).select("file_id", F.explode(F.sequence(F.least(F.lit(0).cast("long"), F.col("lo")), F.col("hi"))).alias("bar"))
    return grid.join(g, ["file_id", "bar"], "left").select("file_id", "bar", F.coalesce("line", F.lit("(missing)")).alias("line"))


def aliases(s, d):
    names = ["Synth Lead", "synth_lead", "KEYS", "Drum-Kit", "808", "unknown thing", "auto", "", "Sound FX", "saxophone", "Piano"]
    x = s.createDataFrame([(n,) for n in names], "name string")
    return x.select("name", T.resolve_family(F.col("name")).alias("family"), F.trim(F.lower("name")).isin(*T.AUTO).alias("auto"))


def maps(s, d):
    """Map functions over the flags and the properties: keys, lookups with default, inversion, distinct keys in order, numeric keys."""
    e = table(s, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    inv = F.map_from_arrays(F.map_values("m"), F.map_keys("m"))
    return e.select("event_id", F.element_at(inv, F.col("m")["k"]).alias("key"), F.coalesce(F.col("m")["missing"], F.col("m")["k"]).alias("value"), F.array_join(F.array_distinct(F.concat(F.map_keys("m"), F.array(F.lit("z")), F.map_keys("m"))), ",").alias("keys"))


def bans(s, d):
    """Ids a decoder may not sample, by purpose."""
    v = T.vocab_table(s)
    drum = (F.col("family") == "PitchDrum") | (F.col("token") == "Program_-1")
    pitched = (F.col("family") == "Pitch") | ((F.col("family") == "Program") & (F.col("token") != "Program_-1"))
    return v.select("id", drum.alias("drums"), pitched.alias("pitched"), (F.col("id") < 70).alias("structural")).filter("drums or pitched or structural")


def augment(s, d):
    """Sizes, kept programs and moved pitches of augmented streams."""
    a, b = encoded(s, d), T.augmented(encoded(s, d)).withColumnRenamed("ids", "out")
    x = a.join(b, "file_id")
    return x.select("file_id", F.size("ids").alias("n"), F.size("out").alias("m"), F.size(F.filter(F.zip_with("ids", "out", lambda p, q: p != q), lambda z: z)).alias("changed"))


def windows(s, d):
    """Training windows: x, y shifted by one, from the Bar nearest before a hashed place, with the program in force restored."""
    x = _toks(s, d).withColumn("n", F.size("ids")).filter("n > 40")
    starts = F.filter(T.bar_positions(F.col("ids")), lambda i: i <= F.col("n") - 33)
    x = x.withColumn("at", F.coalesce(F.try_element_at(starts, (F.col("file_id") % F.greatest(F.size(starts), F.lit(1)) + 1).cast("int")), F.lit(0)))
    prog = F.when(F.col("at") > 0, F.try_element_at(F.filter(F.slice("ids", F.lit(1), F.col("at")), lambda t: T._in(t, T.ids_of("Program_"))), F.lit(-1)))
    w = F.slice("ids", F.col("at") + 1, F.lit(33))
    return x.select("file_id", F.col("at").cast("int").alias("at"), prog.alias("program"), _text(F.slice(w, 1, 32)).alias("x"), _text(F.slice(w, 2, 32)).alias("y"))


QUERIES = {
    "remi_encode": encoded, "remi_roundtrip": roundtrip, "doc_builder": documents, "doc_layouts": layouts, "doc_views": document_views, "bar_lines": bar_lines, "bar_bounds": bar_bounds, "split_header": header_parts, "pad_bars": padded, "fit_context": fitted, "split_bars": bars_cut, "loop_metrics": loops, "half_drift": half_drift,
    "ffill_program": programs, "postprocess_stream": stream_clean, "header_sort": header_sorting, "pitch_render": rendered, "instrument_alias": aliases, "map_ops": maps, "ban_ids": bans, "augment_remap": augment, "training_windows": windows,
    "vocabulary": lambda s, d: T.vocab_table(s).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")),
}

_SIGS = f"BETWEEN {min(T.ids_of('TimeSig_'))} AND {max(T.ids_of('TimeSig_'))}"
_PROG = f"BETWEEN {min(T.ids_of('Program_'))} AND {max(T.ids_of('Program_'))}"


def _join(x):
    return f"array_to_string({x}, ' ')"


_LINES = f"""pl AS (SELECT file_id, max(start // 12 + duration // 4) AS e FROM notes GROUP BY 1),
 bl AS (SELECT file_id, e, unnest(CASE file_id % 3 WHEN 0 THEN range(0, e + {6 * TPQ} + 1, {3 * TPQ}) WHEN 1 THEN list_concat(range(0, {12 * TPQ}, {4 * TPQ}), range({12 * TPQ}, greatest(e, {12 * TPQ}) + {6 * TPQ} + 1, {3 * TPQ})) ELSE range(0, e + {8 * TPQ} + 1, {4 * TPQ}) END) AS edge FROM pl)"""

ORACLE = {
    "bar_lines": f"""WITH {NOTES}, {_LINES}, x AS (SELECT *, count(*) FILTER (edge > e) OVER (PARTITION BY file_id ORDER BY edge) AS past FROM bl)
      SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY edge) - 1)::INT AS bar, edge FROM x WHERE past <= 1""",
    "bar_bounds": f"""WITH {NOTES}, {_LINES}, x AS (SELECT file_id, edge FROM bl WHERE edge < e UNION SELECT file_id, e FROM pl)
      SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY edge) - 1)::INT AS bar, edge FROM x""",
    "doc_views": f"""WITH {NOTES}, t AS (SELECT file_id, track_name, count(*) AS n FROM notes GROUP BY ALL), f AS (SELECT file_id, sum(n) AS n, count(*) FILTER (n >= {D.VIEW_NOTES}) AS long FROM t GROUP BY 1),
      k AS (SELECT *, CASE WHEN file_id % 11 = 7 THEN 'timesig' WHEN n < 2 THEN 'empty' END AS skip FROM f)
      SELECT '/raw/user/' || file_id || '.mid' AS path, CASE WHEN skip IS NULL THEN 1 + CASE WHEN long > 1 THEN 2 ELSE 0 END ELSE 0 END::BIGINT AS views, skip FROM k""",
    "doc_layouts": f"""WITH {NOTES}, {_T}, x AS (SELECT file_id, ids[1:2] AS h, ids[3:] AS b, len(ids) - 2 AS n FROM ts)
      SELECT file_id, {_join(f'[{BOS}] || h || b || [{EOS}]')} AS continuation, {_join(f"[{BOS}, {V['Task_accomp']}] || h || b[1:n // 2] || [{SEP}] || b[n // 2 + 1:] || [{EOS}]")} AS accompaniment,
        {_join(f"[{BOS}, {V['Task_infill']}] || h || b[1:n // 3] || [{MASK}] || b[2 * n // 3 + 1:] || [{SEP}] || b[n // 3 + 1:2 * n // 3]")} AS infill FROM x""",
    "split_header": f"""WITH {NOTES}, {_T} SELECT file_id, {_join('ids[1:2]')} AS header, (len(ids) - 2)::INT AS body, len(list_filter(ids, lambda x: x = {BAR}))::INT AS bars, ids[-1] = {BAR} OR (ids[-1] {_SIGS} AND ids[-2] = {BAR}) AS on_line FROM ts""",
    "pad_bars": f"""WITH {NOTES}, {_T}, b AS (SELECT *, len(list_filter(ids, lambda x: x = {BAR})) AS n, coalesce(list_filter(ids, lambda x: x {_SIGS})[1], {V['TimeSig_4/4']}) AS sig FROM ts)
      SELECT file_id, (len(ids) + 2 * greatest(0, 16 - n))::INT AS padded, CASE WHEN n < 16 THEN '{BAR} ' || sig ELSE {_join('ids[-2:]')} END AS tail, (len(ids) + CASE WHEN ids[-1] = {BAR} OR (ids[-1] {_SIGS} AND ids[-2] = {BAR}) THEN 0 ELSE 2 END)::INT AS closed FROM b""",
    "fit_context": f"""WITH {NOTES}, {_T}, b AS (SELECT *, len(ids) AS n, len(list_filter(ids, lambda x: x = {BAR})) AS k, greatest(0, least(file_id * 3, 120 - least(40, len(ids)))) AS new FROM ts)
      SELECT file_id, least(n, 120 - new)::INT AS prompt, new::INT AS new, trunc(greatest(160.0::DOUBLE, 2 * n / greatest(1, k)) * k)::INT + 64 AS accompany, trunc(greatest(64.0::DOUBLE, 2 * (n / greatest(1, k))) * 4)::INT + 64 AS infill FROM b""",
    "split_bars": f"""WITH {NOTES}, {_T}, b AS (SELECT file_id, ids[3:] AS body, list_filter(range(1, len(ids) - 1), lambda i: ids[i + 2] = {BAR}) AS e FROM ts)
      SELECT file_id, (e[3] - 1)::INT AS prefix, (len(body) - coalesce(e[6] - 1, len(body)))::INT AS suffix FROM b WHERE len(e) >= 5""",
    "loop_metrics": f"""WITH {NOTES}, s AS (SELECT file_id, start, note_idx, is_drum, pitch % 2 AS t, sum(is_drum::INT) OVER (PARTITION BY file_id ORDER BY start, note_idx) AS bar FROM notes),
      g AS (SELECT file_id, bar, string_agg(t, ' ' ORDER BY start, note_idx) AS k FROM s WHERE NOT is_drum GROUP BY ALL), l AS (SELECT *, lead(k) OVER (PARTITION BY file_id ORDER BY bar) AS nx FROM g)
      SELECT file_id, round(count(*) FILTER (k = nx) / (count(*) - 1), 9) AS adjacent, round(count(DISTINCT k) / count(*), 9) AS "distinct", count(*)::INT AS n FROM l GROUP BY 1 HAVING count(*) >= 3""",
    "half_drift": f"""WITH {NOTES}, {_T}, h AS (SELECT file_id, ids[1:len(ids) // 2] AS a, ids[len(ids) // 2 + 1:] AS b FROM ts)
      SELECT file_id, (len(list_distinct(b)) - len(list_distinct(a)))::INT AS "distinct", round(len(list_filter(b, lambda x: x = {BAR})) / len(b) - len(list_filter(a, lambda x: x = {BAR})) / len(a), 9) AS bars FROM h""",
    "ffill_program": f"""WITH {NOTES}, {_T}, p AS (SELECT file_id, unnest(range(len(ids)))::INT AS pos, unnest(ids) AS t FROM ts)
      SELECT file_id, pos, coalesce(last_value(CASE WHEN t {_PROG} THEN t - {min(T.ids_of('Program_')) + 1} END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY pos), 0)::INT AS program FROM p""",
    "header_sort": f"""WITH {NOTES} SELECT file_id, 'Task_infill Inst_Bass Inst_Piano Density_' || (min(pitch) % 4) || ' Genre_' || {T.GENRES}[file_id % 16 + 1] || ' Quality_1' AS header FROM notes GROUP BY file_id""",
    "pitch_render": f"""WITH {NOTES}, x AS (SELECT *, floor(start / 3600 / 128)::BIGINT AS bar FROM notes), y AS (SELECT file_id, bar, start, pitch, note_idx, printf('%.2f', ((start - bar * 460800) // 36) / 100) || ':' ||
        CASE WHEN is_drum THEN CASE pitch {' '.join(f"WHEN {k} THEN '{v}'" for k, v in T.GM_DRUMS.items())} ELSE 'Perc' || pitch END
        ELSE ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][pitch % 12 + 1] || (pitch // 12 - 1) || ':' || printf('%.2f', (duration // 36) / 100) END AS t FROM x),
      g AS (SELECT file_id, bar, string_agg(t, ' ' ORDER BY start, pitch, note_idx) AS line FROM y GROUP BY ALL), f AS (SELECT file_id, unnest(range(least(0, min(bar)), max(bar) + 1)) AS bar FROM g GROUP BY file_id)
      SELECT file_id, f.bar, coalesce(line, '(missing)') AS line FROM f LEFT JOIN g USING (file_id, bar)""",
    "instrument_alias": """SELECT * FROM (VALUES ('Synth Lead', 'SynthLead', false), ('synth_lead', 'SynthLead', false), ('KEYS', 'Piano', false), ('Drum-Kit', 'Drums', false), ('808', 'Bass', false), ('unknown thing', NULL, false), ('auto', NULL, true), ('', NULL, true),
      ('Sound FX', 'SoundFX', false), ('saxophone', 'Reed', false), ('Piano', 'Piano', false)) v(name, family, auto)""",
    "map_ops": "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value, 'k,z' AS keys FROM events",
    "vocabulary": """SELECT family, n, first FROM (VALUES ('PAD', 1, 0), ('BOS', 1, 1), ('EOS', 1, 2), ('SEP', 1, 3), ('MASK', 1, 4), ('Task', 2, 5), ('Inst', 17, 7), ('Density', 4, 24), ('Poly', 3, 28), ('Range', 3, 31), ('Tempo', 7, 34), ('Source', 9, 41), ('Genre', 16, 50),
      ('Quality', 4, 66), ('Bar', 1, 70), ('Pitch', 128, 71), ('Velocity', 32, 199), ('Duration', 64, 231), ('Position', 96, 295), ('PitchDrum', 62, 391), ('Program', 129, 453), ('TimeSig', 16, 582)) v(family, n0, first), LATERAL (SELECT n0::BIGINT AS n)""",
    "ban_ids": "SELECT i::INT AS id, i BETWEEN 391 AND 453 AS drums, i BETWEEN 71 AND 198 OR i BETWEEN 454 AND 581 AS pitched, i < 70 AS structural FROM range(598) t(i) WHERE i < 70 OR i BETWEEN 71 AND 198 OR i BETWEEN 391 AND 581",
    "training_windows": f"""WITH {NOTES}, {_T}, b AS (SELECT *, list_filter(range(len(ids)), lambda i: ids[i + 1] = {BAR} AND i <= len(ids) - 33) AS st FROM ts WHERE len(ids) > 40), c AS (SELECT *, coalesce(st[file_id % greatest(len(st), 1) + 1], 0)::INT AS a0 FROM b)
      SELECT file_id, a0 AS "at", list_filter(list_slice(ids, 1, a0), lambda t: t {_PROG})[-1] AS program, {_join('list_slice(ids, a0 + 1, a0 + 32)')} AS x, {_join('list_slice(ids, a0 + 2, a0 + 33)')} AS y FROM c""",
    "remi_roundtrip": f"""WITH {NOTES}, x AS (SELECT file_id, floor((start // 12) * (CASE WHEN file_id % 3 = 1 THEN 16 ELSE 8 END) / {TPQ}.0::DOUBLE + 0.5)::BIGINT AS t FROM notes),
      y AS (SELECT file_id, CASE file_id % 3 WHEN 0 THEN t // 24 + 1 WHEN 2 THEN t // 32 + 1 ELSE CASE WHEN t >= 192 THEN 4 + (t - 192) // 48 WHEN (t // 64) * 64 + round_even((t % 64) / 2, 0) * 2 >= (t // 64 + 1) * 64 THEN t // 64 + 2 ELSE t // 64 + 1 END END AS bars FROM x)
      SELECT file_id, true AS same, max(bars)::INT AS bars, count(*)::INT AS notes FROM y GROUP BY 1""",
}

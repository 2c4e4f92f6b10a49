"""Queries over the rules of functions.requests, build summaries and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from partita.functions import notes as N
from partita.functions import requests as Q
from partita.functions import tokens as T
from partita.operators.positions import ranked
from partita.plans import corpus as PC
from partita.plans.notes import NOTES, SPT, TPQ, _n
from partita.plans.tokens import _T, _text, _toks
from partita.tables import clean_source_sql, table, with_totals


def _r(df, n=9):
    return df.select(*(F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def loudness(s, d):
    n = _n(s, d).withColumn("velocity", F.floor(F.col("velocity") * (1 + F.col("file_id") % 3) / 4) + 1)
    g = n.groupBy("file_id").agg(F.max("velocity").alias("peak")).withColumn("scale", Q.velocity_scale(F.col("peak")))
    x = n.join(g, "file_id").groupBy("file_id", "scale").agg(F.sum(Q.scaled_velocity(F.col("velocity").cast("int"), F.col("scale")).cast("long")).alias("total"))
    return _r(x)


def spans(s, d):
    """Span requests made from the events: each file's bars against a start and a length."""
    e = _n(s, d).groupBy("file_id").agg((F.floor(F.max(F.col("start") + F.col("duration")) / (16 * TPQ)) + 1).alias("bars"))
    x = e.withColumn("start", F.col("file_id") % 40 - 1).withColumn("span", F.col("file_id") % 6)
    b0, b1 = Q.context_window(F.col("bars"), F.col("start"), F.col("span"))
    return x.select("file_id", Q.span_problem(F.col("bars"), F.col("start"), F.col("span")).alias("problem"), b0.alias("b0"), b1.alias("b1"))


def text_rules(s, d):
    """Path, name and time rules over the manifest and labels."""
    p = table(s, d, "manifest").select("path").distinct()
    return p.select("path", Q.portable_path(F.col("path"), "/data").alias("portable"), Q.safe_name(F.col("path"), 12).alias("safe"), F.sha1(F.concat_ws(":", F.regexp_extract("path", r"([^/]*)$", 1), F.lit("0"))).alias("excerpt_id"))


def specs(s, d):
    rows = [("2",), ("0, 2",), ("all",), ("AUTO",), ("",), ("x",), (",",), ("-1",), (None,)]
    x = s.createDataFrame(rows, "raw string").select("raw", Q.track_spec(F.col("raw")).alias("t"))
    return x.select("raw", F.col("t.kind").alias("kind"), F.array_join("t.tracks", ",").alias("tracks"), F.col("t.error").alias("error"))


def weights(s, d):
    x = s.createDataFrame([("lakh:1.5, aria:0.25",), ("q0:2",)], "spec string")
    return x.select("spec", F.explode(Q.weight_spec(F.col("spec"))).alias("key", "weight"))


def prompt_texts(s, d):
    abc = F.concat(F.lit("X:1\nT:tmp\n%%MIDI\nM:4/4\n"), F.coalesce("prompt_path", F.lit("")), F.lit("\n\nK:C\n"))
    x = table(s, d, "pair_meta").select("pair_id", "mode", Q.score_text(abc).alias("ctx"), Q.judge_prompt(F.col("mode"), Q.score_text(abc), F.col("model_a"), F.col("model_b")).alias("prompt")).distinct()
    return x.select("pair_id", "mode", "ctx", F.length("prompt").alias("chars"), F.sha1("ctx").alias("digest"))


def prompts_cut(s, d):
    """Prompts at a boundary, continuations cut for scoring, and re-headed windows."""
    x = _toks(s, d)
    body = F.slice("ids", F.lit(3), F.size("ids"))
    tail = F.slice(body, F.greatest(F.lit(1), F.size(body) - 9).cast("int"), F.lit(10))
    return x.select("file_id", F.size(Q.cut_prompt(F.col("ids"), 40)).alias("prompt"), F.size(Q.fit_for_scoring(F.slice("ids", 1, 20), F.slice("ids", F.lit(21), F.size("ids")), 64)).alias("scored"), _text(Q.reheaded(F.slice("ids", 1, 2), tail, F.slice(body, F.lit(1), F.greatest(F.lit(0), F.size(body) - 10).cast("int")), 33)).alias("window"))


def fragments(s, d):
    x = _toks(s, d).withColumn("ids", F.concat("ids", F.array(F.lit(T.vocabulary()["EOS_None"]))))
    return x.select("file_id", F.size(Q.without_end(F.col("ids"), F.col("file_id") % 60, 30.0, F.lit("continuation"))).alias("n"))


def shard_probs(s, d):
    p = PC.shard_plan(s, d).groupBy(F.concat_ws("_", "split", "source", F.lpad(F.col("shard").cast("string"), 5, "0")).alias("name")).agg(F.sum("take").alias("tokens"))
    return _r(Q.shard_weights(p, {"aria": 0.5, "train_l": 2.0, "val": 0.0}, 2048), 9)


WINDOW, ANCHORED, DRAWS = 2048, 0.5, 8


def _shards(s, d):
    """Shards of a window or more: their tokens, and the starts of documents from which a whole window fits."""
    p = PC.shard_plan(s, d).groupBy("split", "source", "shard").agg(F.array_sort(F.collect_list(F.when(F.col("first") == 0, F.col("offset")))).alias("starts"), F.max(F.col("offset") + F.col("take")).alias("n"))
    return p.withColumn("fit", F.filter("starts", lambda o: o <= F.col("n") - WINDOW - 1))


def anchors(s, d):
    """Documents that begin in each shard, and how many of them can begin a window."""
    return _shards(s, d).filter("size(starts) > 0").select("split", "source", "shard", F.size("starts").alias("docs"), F.size("fit").alias("anchors"))


def window_starts(s, d):
    """Eight windows a shard: with a probability of a half one begins at a document's start, else anywhere."""
    x = _shards(s, d).filter(F.col("n") > WINDOW).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
    at = Q.window_start(F.col("fit"), F.col("n"), WINDOW, ANCHORED, F.concat_ws("_", "split", "source", "shard", "k"))
    return x.select("split", "source", "shard", "k", at.alias("start"), F.array_contains("starts", at).alias("anchored"))


def build_summary(s, d):
    """Counts of a build by source: files kept, skipped by reason, tokens, shards, and the share of tokens."""
    v = PC._verdict(PC._m(s, d)).groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("verdict") == "ok").alias("ok"), *(F.count_if(F.col("verdict") == r).alias(r) for r in ("unparseable", "too_few_notes", "too_sparse", "too_dense")))
    p = PC.shard_plan(s, d).groupBy("source").agg(F.sum("take").alias("tokens"), F.count_distinct("split", "shard").alias("shards"))
    x = v.join(p, "source", "left")
    return _r(with_totals(x, t=F.sum("tokens")).withColumn("share", F.round(F.col("tokens") / F.col("t"), 3)).drop("t"))


def cluster_dump(s, d):
    """Each near-duplicate cluster's paths in order, with their place; a cluster of any size is written row by row."""
    return _places(PC.dup_clusters(s, d))


def cluster_dump_whole(s, d):
    return _places(PC.dup_clusters_whole(s, d))


def _places(x):
    return ranked(x.select("cluster", "path"), ["cluster"], [F.col("path")]).select("cluster", F.col("pos").alias("place"), "path")


def flags(s, d):
    """Known and unknown flags of the votes, by side."""
    x = table(s, d, "labels").filter("flags is not null").select("pair_id", F.explode("flags").alias("side", "fs")).select("side", F.explode("fs").alias("flag"), "pair_id")
    return x.groupBy("side", "flag").agg(F.count_distinct("pair_id").alias("pairs")).withColumn("known", F.size(F.array_intersect(F.array("flag"), F.array(*map(F.lit, Q.FLAGS)))) > 0)


def languages(s, d):
    """Commonest languages and untagged documents of each source."""
    x = table(s, d, "documents").select("source", F.lower(F.regexp_replace("lang", "-.*", "")).alias("lang"))
    return x.groupBy("source").agg(F.count_if(F.col("lang").isNull() | (F.col("lang") == "und")).alias("untagged"), F.count_if(F.col("lang") == "en").alias("en"), F.count(F.lit(1)).alias("n"))


def repaired(s, d):
    """Pairs whose stored note count of side a differs from the one of side b, as a recomputed count would be."""
    m = table(s, d, "pair_meta").filter("mode = 'accompany' and pair_id <> ''").groupBy("pair_id").agg(F.max("n_notes_a").alias("stored"), F.max("n_notes_b").alias("b"))
    return Q.repair_counts(m.select("pair_id", "stored"), m.select("pair_id", F.col("b").alias("actual")), "pair_id")


def source_order(s, d):
    x = PC._m(s, d).groupBy(F.col("source").alias("id")).agg(F.count_if(F.col("n_notes").isNull()).alias("todo"), F.max("n_notes").alias("newest"))
    return Q.listed_order(x.withColumn("place", F.when(F.col("id") == "fma", 0).when(F.col("id") == "aria", 1))).select("id", F.col("rank"))


def sampled_spans(s, d):
    e = Q.bars_spanned(_n(s, d), TPQ).withColumn("n", F.floor(F.col("bars") / 4))
    a, b = Q.sampled_span(F.col("n"), F.col("file_id"))
    return e.select("file_id", F.round("bars", 9).alias("bars"), a.alias("start"), b.alias("span"))


def infill(s, d):
    """Each file's middle 40 beats as a fill: mean rates over all files."""
    from partita.plans.ordered import gap_split

    g = gap_split(s, d).withColumn("empty", F.col("fill") == 0).withColumn("bars_ok", F.col("fill") > 3).withColumn("pc_fit", F.when(F.col("file_id") % 5 == 0, float("nan")).otherwise(F.col("fill") / F.lit(10.0)))
    return _r(Q.infill_report(g.withColumn("density_ratio", F.coalesce("density_ratio", F.lit(float("nan"))))), 6)


def cards(s, d):
    """Scorecards side by side: metrics down, sources across, with the direction that is better."""
    from partita.plans.preferences import scorecard

    x = scorecard(s, d).groupBy("metric").pivot("source", ["aria", "lakh", "lamd"]).agg(F.first("mean"))
    return x.withColumn("better", F.when(F.col("metric") == "notes", "higher").otherwise("none"))


def steered(s, d):
    fam = lambda k: F.element_at(F.array(*map(F.lit, N.FAMILIES)), (F.pmod(F.col("file_id") + k, F.lit(16)) + 1).cast("int"))
    x = _n(s, d).select("file_id").distinct()
    names = F.array(*map(F.lit, ("Inst_Organ", "Tempo_3", "Density_1")))
    return x.select("file_id", F.array_join(T.with_instruments(names, F.array(fam(5), F.lit("Drums"), fam(0), fam(5))), " ").alias("header"))


def gbt(s, d):
    """Held-out error of boosted trees beside the mean, on grouped halves (a report, as trees differ between versions)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from partita.plans.preferences import COLS, _features

    x = VectorAssembler(inputCols=COLS, outputCol="features").transform(_features(s, d).fillna({"q": 25.0})).withColumn("fold", F.pmod(F.xxhash64("l_orderkey"), F.lit(2)))
    m = GBTRegressor(labelCol="y", maxIter=5, maxDepth=2, stepSize=0.3, subsamplingRate=0.8, seed=0).fit(x.filter("fold = 0"))
    mean = x.filter("fold = 0").agg(F.avg("y")).first()[0]
    return m.transform(x.filter("fold = 1")).agg(F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("mae"), F.avg(F.abs(F.col("y") - F.lit(mean))).alias("mae_of_mean"))


QUERIES = {
    "degeneracy": lambda s, d: _r(Q.degeneracy(_n(s, d).withColumn("pitch", F.when(F.col("file_id") % 4 == 0, F.lit(60).cast("long")).otherwise(F.col("pitch") % 5)))), "velocity_scale": loudness, "span_requests": spans, "path_text_rules": text_rules, "track_spec": specs, "weight_spec": weights,
    "judge_prompts": prompt_texts, "prompt_cuts": prompts_cut, "fragment_rule": fragments, "shard_sampling_weights": shard_probs, "doc_start_anchors": anchors, "window_starts": window_starts, "build_summary": build_summary, "cluster_dump": cluster_dump, "cluster_dump_whole": cluster_dump_whole, "flag_whitelist": flags, "untagged_counts": languages,
    "densest_track": lambda s, d: Q.densest_track(_n(s, d)), "piece_analysis": lambda s, d: _r(Q.piece_analysis(_n(s, d), TPQ, 120.0)), "note_roll": lambda s, d: Q.note_roll(_n(s, d), SPT, 60.0), "repair_counts": repaired, "source_order": source_order, "gbt_report": gbt, "sampled_spans": sampled_spans, "infill_report": infill, "scorecard_compare": cards, "header_steering": steered,
    "log_partitions": lambda s, d: table(s, d, "labels").filter("ts is not null").select(*(c.alias(a) for c, a in zip(Q.log_partition(F.col("ts")), ("day", "time")))).groupBy("day").agg(F.min("time").alias("first"), F.max("time").alias("last"), F.count(F.lit(1)).alias("n")),
}

_SP = "(60.0 / (120.0 * 3600))::DOUBLE"
ORACLE = {
    "degeneracy": f"""WITH {NOTES}, x AS (SELECT * REPLACE (CASE WHEN file_id % 4 = 0 THEN 60 ELSE pitch % 5 END AS pitch) FROM notes), c AS (SELECT file_id, pitch, count(*) AS c FROM x GROUP BY ALL), p AS (SELECT file_id, sum(c)::BIGINT AS n, max(c) / sum(c) AS top FROM c GROUP BY 1),
      rg AS (SELECT file_id, [{', '.join(f'lead(pitch, {i}) OVER w' for i in range(4))}] AS gram FROM x WHERE NOT is_drum WINDOW w AS (PARTITION BY file_id ORDER BY start, note_idx)), rc AS (SELECT file_id, gram, count(*) AS k FROM rg GROUP BY ALL),
      re AS (SELECT file_id, coalesce(sum(k) FILTER (gram[4] IS NOT NULL AND k > 1) / sum(k) FILTER (gram[4] IS NOT NULL), 0)::DOUBLE AS r FROM rc GROUP BY 1), y AS (SELECT file_id, n, top, CASE WHEN n >= 8 THEN coalesce(r, 0) ELSE 0 END AS rep FROM p LEFT JOIN re USING (file_id))
      SELECT file_id, n AS n_notes, round(top, 9) AS top_pitch_share, round(rep, 9) AS repetition, n < 8 OR top > 0.5 OR rep > 0.6 OR n > 600 AS degenerate, round((CASE WHEN n < 8 THEN (8 - n) / 8 ELSE 0 END) + greatest(0, top - 0.3) + greatest(0, rep - 0.3) + (n > 600)::INT, 9) AS badness FROM y""",
    "velocity_scale": f"""WITH {NOTES}, x AS (SELECT file_id, floor(velocity * (1 + file_id % 3) / 4)::BIGINT + 1 AS v FROM notes), g AS (SELECT file_id, greatest(1, least(3, 118 / greatest(max(v), 1)))::DOUBLE AS scale FROM x GROUP BY 1)
      SELECT file_id, round(scale, 9) AS scale, sum(CASE WHEN scale <= 1 THEN v ELSE greatest(1, least(127, round_even(v * scale, 0))) END)::BIGINT AS total FROM x JOIN g USING (file_id) GROUP BY ALL""",
    "span_requests": f"""WITH {NOTES}, e AS (SELECT file_id, max(start + duration) // 57600 + 1 AS bars, file_id % 40 - 1 AS start, file_id % 6 AS span FROM notes GROUP BY file_id), c AS (SELECT *, least(16, bars) AS ctx FROM e), b AS (SELECT *, greatest(0, least(start - floor((ctx - span) / 2)::BIGINT, bars - ctx)) AS b0 FROM c)
      SELECT file_id, CASE WHEN span NOT BETWEEN 1 AND 4 THEN 'bars=' || span WHEN start < 1 OR start + span > bars - 1 THEN CASE WHEN bars - span - 1 >= 1 THEN 'start=1..' || (bars - span - 1) ELSE 'none: the upload is too short' END END AS problem, b0, b0 + ctx AS b1 FROM b""",
    "path_text_rules": r"""WITH p AS (SELECT DISTINCT path, regexp_extract(path, '([^/]*)$', 1) AS name FROM manifest), q AS (SELECT *, substr(regexp_replace(regexp_replace(regexp_extract(name, '^(.*?)(\.[^.]*)?$', 1), '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 12) AS s FROM p)
      SELECT path, CASE WHEN starts_with(path, '/data/') THEN '~' || substr(path, 6) ELSE path END AS portable, CASE WHEN s = '' THEN 'seed' ELSE s END AS safe, sha1(name || ':0') AS excerpt_id FROM q""",
    "track_spec": "SELECT * FROM (VALUES ('2', 'list', '2', NULL), ('0, 2', 'list', '0,2', NULL), ('all', 'all', NULL, NULL), ('AUTO', 'auto', NULL, NULL), ('', 'auto', NULL, NULL), ('x', 'error', NULL, 'not a track: x'), (',', 'error', NULL, 'not a track: ,'), ('-1', 'list', '-1', NULL), (NULL, 'auto', NULL, NULL)) v(raw, kind, tracks, error)",
    "weight_spec": "SELECT * FROM (VALUES ('lakh:1.5, aria:0.25', 'lakh', 1.5::DOUBLE), ('lakh:1.5, aria:0.25', 'aria', 0.25::DOUBLE), ('q0:2', 'q0', 2.0::DOUBLE)) v(spec, key, weight)",
    "fragment_rule": f"WITH {NOTES}, {_T} SELECT file_id, (len(ids) + CASE WHEN file_id % 60 < 30 THEN 0 ELSE 1 END)::INT AS n FROM ts",
    "prompt_cuts": f"""WITH {NOTES}, {_T}, b AS (SELECT file_id, ids, ids[3:] AS body FROM ts), c AS (SELECT *, list_max(list_filter(range(9, least(40, len(ids))), lambda i: ids[i + 1] = {T.vocabulary()['Bar_None']} OR ids[i + 1] BETWEEN {min(T.ids_of('Position_'))} AND {max(T.ids_of('Position_'))})) AS st FROM b)
      SELECT file_id, coalesce(st, least(40, len(ids)))::INT AS prompt, CASE WHEN least(len(ids) - 20, 44) >= 8 THEN least(len(ids) - 20, 44) END::INT AS scored,
        array_to_string(list_slice([{T.vocabulary()['BOS_None']}] || ids[1:2] || list_slice(body, greatest(1, len(body) - 9), len(body)) || list_slice(body, greatest(1, len(body) - 29), len(body) - 10), 1, 33), ' ') AS window FROM c""",
    "shard_sampling_weights": f"""WITH {PC._M}, {PC._OK}, {PC._SHARD}, p AS (SELECT split || '_' || source || '_' || lpad(shard::VARCHAR, 5, '0') AS name, sum(take) AS tokens FROM sp GROUP BY ALL), w AS (SELECT name, greatest(tokens - 2049, 0)::DOUBLE * CASE WHEN contains(name, 'aria') THEN 0.5 WHEN contains(name, 'train_l') THEN 2 WHEN contains(name, 'val') THEN 0 ELSE 1 END AS w FROM p)
      SELECT name, round(w / sum(w) OVER (), 9) AS prob FROM w""",
    "doc_start_anchors": f"""WITH {PC._M}, {PC._OK}, {PC._SHARD}, x AS (SELECT split, source, shard, max("offset" + take) AS n, list("offset") AS o FROM sp WHERE "first" = 0 GROUP BY ALL) SELECT split, source, shard, len(o)::INT AS docs, len(list_filter(o, lambda z: z <= n - 2049))::INT AS anchors FROM x""",
    "build_summary": f"""WITH {PC._M}, {PC._OK}, {PC._SHARD}, v AS (SELECT source, {PC._V} AS verdict FROM m), f AS (SELECT source, count(*) AS files, count(*) FILTER (verdict = 'ok') AS ok, {', '.join(f"count(*) FILTER (verdict = '{r}') AS {r}" for r in ('unparseable', 'too_few_notes', 'too_sparse', 'too_dense'))} FROM v GROUP BY 1),
      t AS (SELECT source, sum(take)::BIGINT AS tokens, count(DISTINCT (split, shard)) AS shards FROM sp GROUP BY 1) SELECT f.*, tokens, shards, round(tokens / sum(tokens) OVER (), 3) AS share FROM f LEFT JOIN t USING (source)""",
    "cluster_dump": f"{PC._CLUSTER} SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY path) AS place, path FROM co",
    "cluster_dump_whole": f"{PC._WHOLE} SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY path) AS place, path FROM co",
    "flag_whitelist": f"""WITH k AS (SELECT pair_id, unnest(map_keys(flags)) AS side, unnest(map_values(flags)) AS fs FROM labels WHERE flags IS NOT NULL), f AS (SELECT pair_id, side, unnest(fs) AS flag FROM k) SELECT side, flag, count(DISTINCT pair_id) AS pairs, flag IN {Q.FLAGS} AS known FROM f GROUP BY ALL""",
    "untagged_counts": "WITH x AS (SELECT source, lower(regexp_replace(lang, '-.*', '')) AS lang FROM documents) SELECT source, count(*) FILTER (lang IS NULL OR lang = 'und') AS untagged, count(*) FILTER (lang = 'en') AS en, count(*) AS n FROM x GROUP BY 1",
    "densest_track": f"WITH {NOTES}, c AS (SELECT file_id, track_name, count(*) AS n, min(note_idx) AS i FROM notes GROUP BY ALL) SELECT file_id, track_name, n FROM c QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY n DESC, i) = 1",
    "piece_analysis": f"""WITH {NOTES}, b AS (SELECT file_id, start // 14400 AS bar, count(*) AS c, max(start + duration) AS e FROM notes GROUP BY ALL), g AS (SELECT file_id, max(bar) + 1 AS bars, sum(c)::BIGINT AS notes, max(e) / 3600 * (60.0 / 120.0)::DOUBLE AS secs FROM b GROUP BY 1),
      x AS (SELECT *, greatest(4, bars // 4) AS q FROM b JOIN g USING (file_id)), y AS (SELECT file_id, secs, bars, notes, q, least(bars, 8 + q) AS t, greatest(8, bars - q) AS lo, sum(CASE WHEN bar >= 8 AND bar < least(bars, 8 + q) THEN c ELSE 0 END) AS h, sum(CASE WHEN bar >= greatest(8, bars - q) THEN c ELSE 0 END) AS tl, count(*) FILTER (bar >= 8) AS sm FROM x GROUP BY ALL),
      z AS (SELECT file_id, secs, bars, notes, CASE WHEN bars > 12 THEN h / (t - 8) ELSE 0 END::DOUBLE AS head, CASE WHEN bars > 12 THEN tl / (bars - lo) ELSE 0 END::DOUBLE AS tail, greatest(0, bars - 8) - sm AS empty FROM y)
      SELECT file_id, round(secs, 9) AS secs, bars, notes, round(head, 9) AS head, round(tail, 9) AS tail, empty, secs >= 60 AND empty <= 1 AND tail >= 0.5 * head AS ok FROM z""",
    "note_roll": f"WITH {NOTES} SELECT file_id, note_idx, floor(start * {_SP} * 1000 + 0.5) / 1000 AS t, floor(duration * {_SP} * 1000 + 0.5) / 1000 AS d, pitch, is_drum AS drum, start * {_SP} < 60 AS prompt FROM notes",
    "repair_counts": "WITH m AS (SELECT pair_id, max(n_notes_a) AS stored, max(n_notes_b) AS actual FROM pair_meta WHERE mode = 'accompany' AND pair_id <> '' GROUP BY 1) SELECT * FROM m WHERE stored IS DISTINCT FROM actual",
    "source_order": f"""WITH {PC._M}, x AS (SELECT source AS id, count(*) FILTER (n_notes IS NULL) AS todo, max(n_notes) AS newest FROM m GROUP BY 1) SELECT id, row_number() OVER (ORDER BY todo = 0, CASE id WHEN 'fma' THEN 0 WHEN 'aria' THEN 1 ELSE 1073741824 END, newest DESC, id)::INT AS rank FROM x""",
    "sampled_spans": f"""WITH {NOTES}, e AS (SELECT file_id, (max(start + duration) - min(start)) / 14400.0::DOUBLE AS bars FROM notes GROUP BY 1), n AS (SELECT *, floor(bars / 4)::BIGINT AS n, ('0x' || substr(sha1('n:' || file_id), 1, 8))::BIGINT % 1000000007 AS un, ('0x' || substr(sha1('s:' || file_id), 1, 8))::BIGINT % 1000000007 AS us FROM e),
      k AS (SELECT *, 1 + un % greatest(1, least(4, n - 2)) AS k FROM n) SELECT file_id, round(bars, 9) AS bars, CASE WHEN n >= 3 THEN 1 + us % greatest(1, n - k - 1) END AS start, CASE WHEN n >= 3 THEN k END AS span FROM k""",
    "infill_report": f"""WITH {NOTES}, g AS (SELECT file_id, floor(avg(start))::BIGINT AS lo, floor(avg(start))::BIGINT + 144000 AS hi FROM notes GROUP BY 1),
      x AS (SELECT file_id, lo, hi, count(*) FILTER (start >= lo AND start < hi) AS fill, count(*) FILTER (NOT (start >= lo AND start < hi)) AS kept, max(start + duration) AS e FROM notes JOIN g USING (file_id) GROUP BY ALL), y AS (SELECT *, greatest(1e-9, (greatest(e, hi) - (hi - lo)) / 14400.0::DOUBLE) AS kb FROM x)
      SELECT round(avg((fill = 0)::INT), 6) AS empty_rate, round(avg((fill <= 3)::INT), 6) AS short_rate, round(avg(round(CASE WHEN kept > 0 THEN (fill / 10.0::DOUBLE) / (kept / round(kb, 6)) END, 6)), 6) AS density_ratio, round(avg(fill / 10) FILTER (file_id % 5 <> 0), 6) AS pc_fit FROM y""",
    "scorecard_compare": f"""WITH m AS (SELECT {clean_source_sql()} AS source, unnest(['notes', 'seconds', 'tracks']) AS metric, unnest([n_notes::DOUBLE, duration_seconds, n_tracks::DOUBLE]) AS v FROM (SELECT DISTINCT * FROM manifest))
      SELECT metric, {', '.join(f"round(avg(v) FILTER (source = '{x}'), 6) AS {x}" for x in ('aria', 'lakh', 'lamd'))}, CASE WHEN metric = 'notes' THEN 'higher' ELSE 'none' END AS better FROM m WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1""",
    "header_steering": f"""WITH f AS (SELECT DISTINCT user_id AS file_id FROM events), x AS (SELECT file_id, unnest([(file_id + 5) % 16, 16, file_id % 16]) AS r FROM f)
      SELECT file_id, string_agg('Inst_' || {[*N.FAMILIES, N.DRUMS]}[r + 1], ' ' ORDER BY r) || ' Density_1 Tempo_3' AS header FROM (SELECT DISTINCT * FROM x) GROUP BY 1""",
    "log_partitions": "SELECT strftime(ts, '%Y-%m-%d') AS day, min(strftime(ts, '%H%M%S')) AS first, max(strftime(ts, '%H%M%S')) AS last, count(*) AS n FROM labels WHERE ts IS NOT NULL GROUP BY 1",
    "judge_prompts": """WITH p AS (SELECT DISTINCT pair_id, mode, prompt_path, model_a, model_b FROM pair_meta), x AS (SELECT *, CASE WHEN trim(coalesce(prompt_path, '')) <> '' THEN 'M:4/4' || chr(10) || prompt_path || chr(10) || 'K:C' ELSE 'M:4/4' || chr(10) || 'K:C' END AS ctx,
        CASE mode WHEN 'accompany' THEN 'Which accompaniment fits the given part better?' WHEN 'infill' THEN 'Which filling fits the bars around it better?' ELSE 'Which continuation is better?' END AS ask FROM p)
      SELECT DISTINCT pair_id, mode, ctx, chars, sha1(ctx) AS digest FROM (SELECT *, length(ask || '..GIVEN:.' || ctx || '..1:.' || coalesce(model_a, '') || '..2:.' || coalesce(model_b, '') || '..Answer with JSON: {"winner": "1", "2" or "tie", "reason": "..."}')::INT AS chars FROM x)""",
    "window_starts": f"""WITH {PC._M}, {PC._OK}, {PC._SHARD}, x AS (SELECT split, source, shard, max("offset" + take) AS n, list_sort(list("offset") FILTER ("first" = 0)) AS o FROM sp GROUP BY ALL),
      y AS (SELECT *, coalesce(list_filter(o, lambda z: z <= n - {WINDOW + 1}), []) AS fit, unnest(range({DRAWS}))::INT AS k FROM x WHERE n > {WINDOW}), z AS (SELECT *, split || '_' || source || '_' || shard || '_' || k AS key FROM y),
      w AS (SELECT *, CASE WHEN {PC._sha("'c:' || key")} / 1e6::DOUBLE < {ANCHORED} AND len(fit) > 0 THEN fit[{PC._sha("'a:' || key")} % greatest(len(fit), 1) + 1] ELSE {PC._sha("'p:' || key")} % (n - {WINDOW}) END AS start FROM z)
      SELECT split, source, shard, k, start, coalesce(list_contains(o, start), false) AS anchored FROM w""",
}

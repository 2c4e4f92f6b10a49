"""Queries over the rules of functions.selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from partita.functions import requests as Q
from partita.functions import selection as S
from partita.operators import corpus as C
from partita.plans import corpus as PC
from partita.plans.notes import NOTES, _n
from partita.plans.tokens import _T, _toks
from partita.tables import table

MODES = ("continue", "accompany")


def evaluation_files(s, d):
    """Held-out files of 200 notes or more that last one to ten minutes."""
    m = table(s, d, "manifest").filter("path is not null").groupBy("path").agg(F.max("n_notes").alias("n"), F.max(F.when(~F.isnan("duration_seconds"), F.col("duration_seconds"))).alias("t"))
    return m.filter(S.fit_for_evaluation(C.split_by_path(F.col("path"), 0.05), F.col("n"), F.col("t"), 200, 60.0, 600.0)).select("path", "n", "t")


def request_problems(s, d):
    """What is wrong with pairs read as requests: their temperature, notes as top_k and bars, and mode."""
    p = table(s, d, "pair_meta").filter("pair_id <> ''").distinct()
    why = S.request_problem(F.round(F.col("temperature") * 2 - 0.5, 2), F.col("n_notes_a") - 4, F.floor(F.col("n_notes_b") / 4).cast("int"), F.col("mode"), MODES)
    return p.select("pair_id", F.regexp_extract(why, "^([a-z_ ]+)", 1).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def usable_pairs(s, d):
    p = table(s, d, "pair_meta").filter("pair_id <> ''").groupBy("pair_id").agg(F.max("n_notes_a").alias("a"), F.max("n_notes_b").alias("b"), F.min("mode").alias("mode"))
    return p.select("pair_id", S.usable_pair(F.col("a"), F.col("b"), F.col("a") + F.col("b")).alias("usable"))


def manifest_genres(s, d):
    """Each file with its genre, here the first mode of the pairs made from it; most files have none."""
    g = table(s, d, "pair_meta").filter("prompt_path is not null").groupBy(F.col("prompt_path").alias("path")).agg(F.min("mode").alias("genre"))
    return table(s, d, "manifest").filter("path is not null").select("path").distinct().join(g, "path", "left")


def stem_join(s, d):
    """Prompts of pairs beside files of the listing of the same name, wherever they are."""
    m = table(s, d, "manifest").filter("path is not null").select("path")
    return S.by_stem(table(s, d, "pair_meta").filter("prompt_path is not null").select(F.col("prompt_path").alias("path")), m)


def feature_rows(s, d):
    """Each user's total by event type, aligned over all types that occur."""
    e = table(s, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("v")).filter("v > 50")
    m = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    x, keys = S.aligned(m, "m")
    return x.select("user_id", F.posexplode("values").alias("i", "value")).select("user_id", F.element_at(F.array(*map(F.lit, keys)), F.col("i") + 1).alias("key"), "value")


def chosen_tracks(s, d):
    """Tracks chosen by requests made from the files' numbers, some of them for tracks that aren't there."""
    n = _n(s, d)
    raw = F.when(F.col("file_id") % 4 == 0, "auto").when(F.col("file_id") % 4 == 1, "all").otherwise(F.concat_ws(",", F.lit("0"), F.col("file_id") % 7))
    r = n.select("file_id").distinct().withColumn("t", Q.track_spec(raw)).select("file_id", "t.kind", "t.tracks")
    return S.choose_tracks(n, r)


def accompany_windows(s, d):
    """A window of 16 bars for each user in which clicks and views both have four notes, bars of half a day."""
    return S.accompany_window(_n(s, d), F.col("track_name") == "click", F.col("track_name") == "view", 43_200)


def clip_keys(s, d):
    m = table(s, d, "manifest").filter("path is not null and n_notes is not null and duration_seconds is not null and not isnan(duration_seconds)").groupBy("path").agg(F.max("n_notes").alias("n"), F.max("source").alias("s"))
    return m.select("path", S.clip_key(F.col("path"), F.col("s"), F.col("n"), F.col("n") * 2).alias("key"))


def _reverser():
    """A decoder that stands for a model: the request's ids backwards, at most as many as asked."""
    def decode(request: dict) -> list[int]:
        if len(request["ids"]) < 12:
            raise ValueError("too short")
        return [int(i) for i in reversed(request["ids"])][: int(request["most"])]

    return decode


def decoder_slot(s, d):
    x = S.with_model(_toks(s, d).withColumn("most", F.col("file_id") % 20), _reverser, ["ids", "most"], ["file_id"], "out array<int>")
    return x.select("file_id", F.array_join(F.col("out").cast("array<string>"), " ").alias("out"))


def _uniform():
    """A scorer that stands for a model: ids over 300 are half as likely as the rest."""
    import math

    return lambda row: [math.log(0.25) if i > 300 else math.log(0.5) for i in row["ids"]]


def loss_slot(s, d):
    """Mean loss of every stream, and of its ids but for the header."""
    x = S.with_model(_toks(s, d), _uniform, ["ids"], ["file_id", "ids"], "p array<double>")
    mask = F.transform("ids", lambda t, i: i >= 2)
    return x.select("file_id", F.round(S.mean_loss(F.col("p")), 9).alias("loss"), F.round(S.mean_loss(F.col("p"), mask), 9).alias("body_loss"))


QUERIES = {
    "evaluation_files": evaluation_files, "request_problems": request_problems, "usable_pairs": usable_pairs, "manifest_genres": manifest_genres, "stem_join": stem_join, "feature_rows": feature_rows, "clip_keys": clip_keys, "chosen_tracks": chosen_tracks, "accompany_windows": accompany_windows,
    "decoder_slot": decoder_slot, "loss_slot": loss_slot, "kind_shares": lambda s, d: S.shares(table(s, d, "pair_meta").filter("mode is not null"), "mode"),
}

ORACLE = {
    "evaluation_files": f"""WITH m AS (SELECT path, max(n_notes) AS n, max(CASE WHEN NOT isnan(duration_seconds) THEN duration_seconds END) AS t FROM manifest WHERE path IS NOT NULL GROUP BY 1)
      SELECT path, n, t FROM m WHERE {PC._sha('path')} / 1e6::DOUBLE < 0.05 AND n >= 200 AND t BETWEEN 60 AND 600""",
    "request_problems": f"""WITH p AS (SELECT DISTINCT * FROM pair_meta WHERE pair_id <> ''), x AS (SELECT round(temperature * 2 - 0.5, 2) AS t, n_notes_a - 4 AS k, n_notes_b // 4 AS b, mode FROM p)
      SELECT CASE WHEN t IS NOT NULL AND NOT (t > 0 AND t <= 2 AND NOT isnan(t)) THEN 'temperature must be over ' WHEN k < 1 THEN 'top_k must be ' WHEN b NOT BETWEEN 1 AND 64 THEN 'bars must be ' WHEN mode NOT IN {MODES} THEN 'no such mode' END AS problem, count(*) AS n FROM x GROUP BY 1""",
    "usable_pairs": f"SELECT pair_id, coalesce(max(n_notes_a) >= {S.TAKE_NOTES} AND max(n_notes_b) >= {S.TAKE_NOTES} AND max(n_notes_a) + max(n_notes_b) >= {S.PROMPT_IDS}, false) AS usable FROM pair_meta WHERE pair_id <> '' GROUP BY 1",
    "manifest_genres": "WITH g AS (SELECT prompt_path AS path, min(mode) AS genre FROM pair_meta WHERE prompt_path IS NOT NULL GROUP BY 1) SELECT path, genre FROM (SELECT DISTINCT path FROM manifest WHERE path IS NOT NULL) LEFT JOIN g USING (path)",
    "stem_join": r"""WITH x AS (SELECT path, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^(.*?)(\.[^.]*)?$', 1)) AS stem, side FROM (SELECT DISTINCT path, 'b' AS side FROM manifest UNION ALL SELECT DISTINCT prompt_path, 'a' FROM pair_meta) WHERE path IS NOT NULL)
      SELECT stem, a.path AS a, b.path AS b FROM x a JOIN x b USING (stem) WHERE a.side = 'a' AND b.side = 'b' AND stem <> ''""",
    "feature_rows": """WITH e AS (SELECT user_id, event_type, round(sum(value), 4) AS v FROM events GROUP BY ALL HAVING round(sum(value), 4) > 50), k AS (SELECT DISTINCT event_type AS key FROM e), u AS (SELECT DISTINCT user_id FROM e)
      SELECT u.user_id, k.key, coalesce(e.v, 'nan'::DOUBLE) AS value FROM u CROSS JOIN k LEFT JOIN e ON e.user_id = u.user_id AND e.event_type = k.key""",
    "clip_keys": "WITH m AS (SELECT path, max(n_notes) AS n, max(source) AS s FROM manifest WHERE path IS NOT NULL AND n_notes IS NOT NULL AND duration_seconds IS NOT NULL AND NOT isnan(duration_seconds) GROUP BY 1) SELECT path, sha256(path || '|' || coalesce(s, '') || '|' || printf('%.3f', n::DOUBLE) || '|' || printf('%.3f', 2 * n::DOUBLE)) AS key FROM m",
    "decoder_slot": f"WITH {NOTES}, {_T} SELECT file_id, CASE WHEN len(ids) >= 12 THEN array_to_string(list_slice(list_reverse(ids), 1, file_id % 20), ' ') END AS out FROM ts",
    "loss_slot": f"""WITH {NOTES}, {_T}, x AS (SELECT file_id, len(ids) AS n, len(list_filter(ids, lambda t: t > 300)) AS k, len(ids) - 2 AS m, len(list_filter(ids[3:], lambda t: t > 300)) AS j FROM ts)
      SELECT file_id, round(-(k * ln(0.25::DOUBLE) + (n - k) * ln(0.5::DOUBLE)) / n, 9) AS loss, round(-(j * ln(0.25::DOUBLE) + (m - j) * ln(0.5::DOUBLE)) / m, 9) AS body_loss FROM x""",
    "kind_shares": "SELECT mode, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 3) AS share FROM pair_meta WHERE mode IS NOT NULL GROUP BY 1",
    "chosen_tracks": f"""WITH {NOTES}, t AS (SELECT file_id, track_name, count(*) AS n FROM notes GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY track_name) - 1 AS i, count(*) OVER (PARTITION BY file_id) AS k, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, track_name) AS by_n FROM t)
      SELECT file_id, track_name, n, NULL::VARCHAR AS problem FROM r WHERE CASE file_id % 4 WHEN 0 THEN by_n = 1 WHEN 1 THEN true ELSE (i = 0 OR i = file_id % 7) AND file_id % 7 < k END
      UNION ALL SELECT DISTINCT file_id, NULL, NULL, 'no track ' || (file_id % 7) FROM r WHERE file_id % 4 > 1 AND file_id % 7 >= k""",
    "accompany_windows": f"""WITH {NOTES}, x AS (SELECT file_id, start // 43200 AS bar, (track_name = 'click')::INT AS c, (track_name = 'view')::INT AS t, max(start // 43200) OVER (PARTITION BY file_id) AS last FROM notes),
      w AS (SELECT file_id, unnest(range(greatest(0, bar - 15), bar + 1)) AS b0, c, t, last FROM x), g AS (SELECT file_id, b0, sum(c)::BIGINT AS n_condition, sum(t)::BIGINT AS n_target FROM w WHERE b0 + 16 <= last + 1 GROUP BY ALL HAVING sum(c) >= 4 AND sum(t) >= 4)
      SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY sha1(file_id || ':' || b0), b0) = 1""",
}

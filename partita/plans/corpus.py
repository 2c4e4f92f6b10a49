"""Corpus queries over manifest, quality_scores, file_notes, pair_meta and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from partita.functions import notes as N
from partita.operators import corpus as C
from partita.plans.notes import NOTES, _n
from partita.operators.positions import group_quantiles, ranked
from partita.tables import clean_source, clean_source_sql, table, with_totals

SRC = clean_source_sql()
STEM = r"regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^(.*?)(\.[^.]*)?$', 1)"


def _m(s, d):
    """Distinct manifest rows with usable sizes and a plain source."""
    m = table(s, d, "manifest").distinct()
    return m.withColumn("source", clean_source(F.col("source"), F.col("path"))).withColumn("duration_seconds", F.when(~F.isnan("duration_seconds") & (F.col("duration_seconds") >= 0), F.col("duration_seconds")))


_M = f"""m AS (SELECT DISTINCT * REPLACE ({SRC} AS source, CASE WHEN NOT isnan(duration_seconds) AND duration_seconds >= 0 THEN duration_seconds END AS duration_seconds) FROM (SELECT DISTINCT * FROM manifest))"""
_OK = "ok AS (SELECT * FROM m WHERE n_notes IS NOT NULL AND duration_seconds IS NOT NULL)"
_V = """CASE WHEN n_notes IS NULL OR duration_seconds IS NULL THEN 'unparseable' WHEN n_notes < 32 THEN 'too_few_notes' WHEN duration_seconds > 1800 THEN 'too_long'
  WHEN duration_seconds > 0 AND n_notes / duration_seconds < 0.3 THEN 'too_sparse' WHEN duration_seconds = 0 OR n_notes / duration_seconds > 80 THEN 'too_dense' ELSE 'ok' END"""


def _sha(text, m=1_000_000):
    out = "0"
    for i in range(5):
        out = f"(({out} * {2**32 % m} + ('0x' || substr(sha1({text}), {8 * i + 1}, 8))::BIGINT % {m}) % {m})"
    return out


def _verdict(df):
    return df.withColumn("verdict", N.clean_verdict(F.col("n_notes"), F.col("duration_seconds")))


def _good(s, d):
    return _m(s, d).filter("n_notes is not null and duration_seconds is not null")


def corpus_report(s, d):
    """Verdicts, exact duplicates, split and sizes: the first stages of a corpus build in one plan."""
    v = _verdict(_m(s, d))
    ok = C.keep_first(v.filter("verdict = 'ok'").select("path", "source", "n_notes", "content_hash", "verdict"), "content_hash", [F.col("path")])
    kept = ok.withColumn("kept", F.lit(True))
    x = v.select("path", "source", "n_notes", "verdict").distinct().join(kept.select("path", "kept").distinct(), "path", "left")
    x = x.withColumn("verdict", F.when((F.col("verdict") == "ok") & F.col("kept").isNull(), "exact_duplicate").otherwise(F.col("verdict")))
    return x.groupBy("source", "verdict", C.split_by_path(F.col("path"), 0.05).alias("split")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_notes").alias("n_notes"))


def detectors(s, d):
    m = table(s, d, "manifest").select("path").distinct()
    return m.select("path", *(c.alias(k) for k, c in C.source_detectors(F.col("path")).items()))


def guards(s, d):
    """What the guards look for: held-out stems (those of pair_meta's part files) in the manifest, and files under an ableton root."""
    stem = lambda c: F.regexp_extract(F.regexp_extract(c, r"([^/]*)$", 1), r"^(.*?)(\.[^.]*)?$", 1)
    m = table(s, d, "manifest").select("path", stem(F.col("path")).alias("stem")).distinct()
    held = table(s, d, "pair_meta").filter("part_path is not null").select(stem(F.col("part_path")).alias("stem")).distinct()
    x = m.join(held.withColumn("held", F.lit(True)), "stem", "left")
    return x.agg(F.count_distinct(F.when(F.col("held"), F.col("stem"))).alias("held_out"), F.count_if(F.col("path").rlike("/raw/ableton[^/]*/")).alias("ableton"))


def quality_join(s, d):
    """Manifest with quality by path (left) and the shard prefix each file goes to."""
    q = table(s, d, "quality_scores").filter("q_bucket is not null").groupBy("path").agg(F.max("q_bucket").alias("q"))
    m = table(s, d, "manifest").select("path").distinct().join(q, "path", "left").withColumn("split", C.split_by_path(F.col("path"), 0.05))
    return m.withColumn("prefix", F.when((F.col("split") == "val") | F.col("q").isNull(), F.col("split")).otherwise(F.concat(F.lit("train_q"), F.col("q").cast("string"))))


def snapshot_diff(s, d):
    """manifest against quality_scores as two snapshots of (path, source): missing, changed, same or left over."""
    a = table(s, d, "manifest").groupBy("path").agg(F.min(clean_source(F.col("source"), F.col("path"))).alias("sa"))
    b = table(s, d, "quality_scores").filter("path is not null").groupBy("path").agg(F.min(F.coalesce("source", F.lit(""))).alias("sb"))
    x = a.join(b, "path", "full_outer")
    return x.select("path", F.when(F.col("sb").isNull(), "missing").when(F.col("sa").isNull(), "left over").when(F.col("sa") != F.col("sb"), "changed").otherwise("same").alias("state"))


def set_operations(s, d):
    """Sizes of the unions, intersections and differences of the paths of three tables."""
    p = lambda t: table(s, d, t).select("path").filter("path is not null")
    m, q, f = p("manifest"), p("quality_scores"), p("file_notes")
    n = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n")
    return n(m.unionAll(q), "union_all").unionAll(n(m.union(q).distinct(), "union")).unionAll(n(m.intersect(f), "intersect")).unionAll(n(m.exceptAll(q), "except_all")).unionAll(n(m.subtract(q), "except")).unionAll(
        n(m.distinct().join(f.distinct(), "path", "left_anti"), "resume_anti"))


def samples(s, d):
    """Rows chosen by the group samplers; one table, so that one query covers them."""
    g = _good(s, d).groupBy("path").agg(F.min("source").alias("source"))
    tag = lambda df, k: df.select(F.lit(k).alias("how"), "source", "path")
    return tag(C.sample_per_group(g, "source", "path", 20), "reservoir").unionAll(tag(C.stratified(g, "source", "path", 300), "stratified")).unionAll(tag(C.round_robin(g, "source", "path", 55), "round_robin"))


def quota(s, d):
    sizes = _good(s, d).groupBy(F.col("source").alias("group")).agg(F.count_distinct("path").alias("have")).withColumn("weight", F.lit(1.0))
    return C.quotas(sizes, 700)


def weighted(s, d):
    w = _good(s, d).groupBy(F.col("source").alias("group")).agg(F.count_distinct("path").cast("double").alias("weight"))
    draws = table(s, d, "manifest").select("path").distinct()
    return C.weighted_pick(draws, w, C.sha1_mod(F.col("path")) / F.lit(1e6)).groupBy("group").agg(F.count(F.lit(1)).alias("n"))


def quartiles(s, d):
    """Bucket of each scored file: how many of the three quartile edges its score has reached."""
    q = table(s, d, "quality_scores").filter("quality is not null and not isnan(quality)").groupBy("path").agg(F.max("quality").alias("quality"))
    e = group_quantiles(q, [], "quality", [0.25, 0.5, 0.75]).first() or ()
    return q.select("path", sum((F.when(F.col("quality") >= x, 1).otherwise(0) for x in e), F.lit(0)).alias("bucket"))


def score_summary(s, d):
    q = table(s, d, "quality_scores").distinct().withColumn("source", clean_source(F.col("source"), F.col("path"))).filter("quality is not null and not isnan(quality)")
    x = q.groupBy("source").pivot("q_bucket", [0, 1, 2, 3]).agg(F.count(F.lit(1)))
    return q.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("mean")).join(x, "source").select("source", "n", "mean", *(F.coalesce(F.col(str(k)), F.lit(0)).alias(f"q{k}") for k in range(4)))


def extremes(s, d):
    """The ten best and ten worst files of each source by score, with their ranks."""
    q = table(s, d, "quality_scores").filter("quality is not null and not isnan(quality)").groupBy("path").agg(F.max("quality").alias("quality"), F.min(clean_source(F.col("source"), F.col("path"))).alias("source"))
    x = ranked(q.filter("source is not null"), ["source"], [F.desc("quality"), F.col("path")])
    x = x.join(x.groupBy("source").agg(F.max("pos").alias("n")), "source").withColumn("best", F.col("pos").cast("int"))
    return x.filter("pos <= 10 or pos > n - 10").select("source", "path", F.when(F.col("best") <= 10, "best").otherwise("worst").alias("label"), "best")


def shard_plan(s, d):
    g = _good(s, d).filter("n_notes > 0").groupBy("path").agg(F.min("source").alias("source"), F.max("n_notes").alias("tokens")).withColumn("split", C.split_by_path(F.col("path"), 0.05))
    return C.shard_packing(g, ["split", "source"], [C.shuffled(F.col("path")), F.col("path")], 50_000)


def mixture(s, d):
    """Tokens, share and shards of each tag; a shard name of exactly three parts carries its tag, others are untagged."""
    p = shard_plan(s, d).groupBy("split", "source", "shard").agg(F.sum("take").alias("tokens"))
    q = F.when(F.col("source").isin("aria", "lakh"), F.concat_ws("_", F.col("split"), F.col("source"), F.lit("q1"), F.col("shard"))).otherwise(F.concat_ws("_", F.col("split"), F.col("source"), F.col("shard")))
    p = p.withColumn("parts", F.split(q, "_")).withColumn("tag", F.when(F.size("parts") == 3, F.element_at("parts", 2)).otherwise("(untagged)"))
    x = p.groupBy("tag").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("shards"))
    return with_totals(x, t=F.sum("tokens")).select("tag", "tokens", "shards", F.round(F.col("tokens") / F.col("t"), 9).alias("prob"))


def size_registry(s, d):
    """Estimated notes of each source: files x its whole-number average, or x the corpus average for sources with under 200 measured files."""
    g = _good(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_notes").alias("t"))
    files = _m(s, d).groupBy("source").agg(F.count_distinct("path").alias("files"))
    x = with_totals(files.join(g, "source", "left"), avg=F.sum("t") / F.sum("n"))
    return x.select("source", "files", F.when(F.col("n") >= 200, F.col("files") * F.expr("t div n")).otherwise(F.floor(F.col("files") * F.col("avg"))).alias("estimate"), F.coalesce(F.col("n") >= 200, F.lit(False)).alias("measured"))


def header_of_position(s, d):
    """The document that holds each 10,000th token of its shard group: positions to documents by an as-of join."""
    from partita.operators.ordered import asof_join

    p = shard_plan(s, d).withColumn("t", F.col("shard") * 50_000 + F.col("offset"))
    docs = p.select("split", "source", "t", "path")
    ends = p.groupBy("split", "source").agg(F.max(F.col("t") + F.col("take")).alias("e"))
    pos = ends.select("split", "source", F.explode(F.expr("sequence(0L, e - 1, 10000L)")).alias("t"))
    return asof_join(pos, docs, ["split", "source"], "t", ["path"], bucket=200_000)


def shingle_counts(s, d):
    f = table(s, d, "file_notes").filter("path is not null and pitches is not null").select("path", "pitches").distinct()
    return C.shingled(f, "path", "pitches").select("path", F.size("sh").alias("n"), F.array_min("sh").alias("least"), F.array_max("sh").alias("most"))


def signatures(s, d):
    f = table(s, d, "file_notes").filter("path is not null and pitches is not null").select("path", "pitches").distinct()
    return C.minhash(C.shingled(f, "path", "pitches").filter(F.size("sh") >= C.LEAST), "path", "sh").select("path", F.posexplode("sig").alias("i", "h"))


def _with_notes(s, d):
    n = table(s, d, "manifest").groupBy("path").agg(F.max("n_notes").alias("n_notes"))
    return table(s, d, "file_notes").select("path", "pitches").join(n, "path", "left")


def dup_clusters(s, d):
    """The reference's result: buckets of over 200 files are passed over, and only their first member is compared."""
    return C.duplicate_clusters(_with_notes(s, d))


def dup_clusters_whole(s, d):
    """Buckets of any size, and all their pairs."""
    return C.whole_clusters(_with_notes(s, d))


def versions(s, d):
    """Distinct models that made a pair, without the floating alias."""
    m = table(s, d, "pair_meta")
    return m.select(F.explode(F.array("model_a", "model_b")).alias("model")).filter("model is not null").distinct().join(s.createDataFrame([("ckpt_last",)], "model string"), "model", "left_anti")


QUERIES = {
    "corpus_report": corpus_report,
    "drop_reasons": lambda s, d: _verdict(_m(s, d)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n")),
    "exact_dedup_keep_first": lambda s, d: C.keep_first(table(s, d, "manifest").filter("content_hash is not null").select("path", "content_hash"), "content_hash", [F.col("path")]),
    "source_summary_p95": lambda s, d: C.group_summary(_good(s, d), "source"),
    "hash_split": lambda s, d: table(s, d, "manifest").select("path").distinct().select("path", C.split_by_path(F.col("path"), 0.05).alias("split"), C.parity(F.col("path")).alias("dev_test"), C.parity(F.concat(F.lit("7:"), F.col("path"))).alias("coin")),
    "source_detect_all": detectors, "path_guards": guards, "quality_left_join": quality_join, "snapshot_diff": snapshot_diff, "set_operations": set_operations,
    "group_samples": samples, "quota_redistribute": quota, "weighted_source_choice": weighted,
    "blind_repeats": lambda s, d: C.blind_repeats(table(s, d, "pair_meta").select("pair_id").distinct(), "pair_id", 50),
    "quartile_buckets": quartiles, "score_summary": score_summary, "score_extremes": extremes,
    "shard_packing": lambda s, d: shard_plan(s, d).select("split", "source", "path", "shard", "offset", "first", "take"),
    "mixture_report": mixture, "size_registry": size_registry, "header_asof_doc_start": header_of_position,
    "shingles_6gram": shingle_counts, "minhash_signature": signatures, "near_dup_clusters": dup_clusters,
    "near_dup_keepers": lambda s, d: dup_clusters(s, d).filter("path <> keeper").select("path"),
    "near_dup_clusters_whole": dup_clusters_whole,
    "near_dup_keepers_whole": lambda s, d: dup_clusters_whole(s, d).filter("path <> keeper").select("path"),
    "content_hash": lambda s, d: C.content_hash(_n(s, d)), "version_list": versions,
}

_SPLIT = f"CASE WHEN {_sha('path')} / 1e6::DOUBLE < 0.05 THEN 'val' ELSE 'train' END"
_SHARD = f"""g AS (SELECT path, min(source) AS source, max(n_notes) AS tokens, {_SPLIT} AS split FROM ok WHERE n_notes > 0 GROUP BY path),
 l AS (SELECT *, (sum(tokens) OVER (PARTITION BY split, source ORDER BY sha1('0:' || path), path) - tokens)::BIGINT AS st FROM g),
 e AS (SELECT *, unnest(range(st // 50000, (st + tokens - 1) // 50000 + 1)) AS shard FROM l),
 sp AS (SELECT split, source, path, shard, greatest(st, shard * 50000) - shard * 50000 AS "offset", greatest(st, shard * 50000) - st AS "first", least(st + tokens, (shard + 1) * 50000) - greatest(st, shard * 50000) AS take FROM e)"""
_SH = """fl AS (SELECT DISTINCT path, list_filter(pitches, lambda p: p IS NOT NULL) AS ps FROM file_notes WHERE path IS NOT NULL AND pitches IS NOT NULL),
 st AS (SELECT path, list_transform(range(1, len(ps)), lambda i: (ps[i + 1] - ps[i] + 128)::BIGINT) AS s FROM fl WHERE len(ps) > 6),
 sh AS (SELECT DISTINCT path, unnest(list_transform(range(1, len(s) - 4), lambda i: s[i] + s[i+1] * 131 + s[i+2] * 17161 + s[i+3] * 2248091 + s[i+4] * 294499921 + s[i+5] * 38579489651)) AS x FROM st)"""
_A, _B = C.hash_family()
_SIG = f"""{_SH}, big AS (SELECT path FROM sh GROUP BY 1 HAVING count(*) >= 64), hf AS (SELECT unnest({[int(x) for x in _A]})::HUGEINT AS a, unnest({[int(x) for x in _B]})::HUGEINT AS b, unnest(range(128)) AS i),
 sig AS (SELECT path, i::INT AS i, min(((a * x + b) % 18446744073709551616) % 2305843009213693951)::BIGINT AS h FROM sh JOIN big USING (path), hf GROUP BY ALL)"""
_CLUSTER = f"""WITH RECURSIVE {_SIG}, bd AS (SELECT path, i // 4 AS band, list(h ORDER BY i) AS k FROM sig GROUP BY ALL), bk AS (SELECT band, k, min(path) AS a, count(*) AS n FROM bd GROUP BY ALL HAVING count(*) BETWEEN 2 AND 200),
 cd AS (SELECT DISTINCT a, path AS b FROM bk JOIN bd USING (band, k) WHERE a < path),
 lk AS (SELECT cd.a, cd.b FROM cd JOIN sig x ON x.path = cd.a JOIN sig y ON y.path = cd.b AND y.i = x.i GROUP BY ALL HAVING avg((x.h = y.h)::INT) >= 0.65),
 ed AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk), re AS (SELECT a, a AS b FROM ed UNION SELECT re.a, ed.b FROM re JOIN ed ON re.b = ed.a),
 co AS (SELECT a AS path, min(b) AS cluster FROM re GROUP BY 1), nn AS (SELECT path, max(n_notes) AS n FROM manifest GROUP BY 1),
 kp AS (SELECT cluster, arg_min(path, (-coalesce(n, 0), path)) AS keeper FROM co LEFT JOIN nn USING (path) GROUP BY 1)"""
_WHOLE = f"""WITH RECURSIVE {_SIG}, bd AS (SELECT path, i // 4 AS band, list(h ORDER BY i) AS k FROM sig GROUP BY ALL),
 cd AS (SELECT DISTINCT x.path AS a, y.path AS b FROM bd x JOIN bd y USING (band, k) WHERE x.path < y.path), {_CLUSTER[_CLUSTER.index("lk AS"):]}"""


def _pick(k, order="sha1('0:' || path), path"):
    return f"row_number() OVER (PARTITION BY source ORDER BY {order}) AS r"


ORACLE = {
    "corpus_report": f"""WITH {_M}, v AS (SELECT *, {_V} AS verdict FROM m), k AS (SELECT DISTINCT path FROM (SELECT path FROM v WHERE verdict = 'ok' QUALIFY content_hash IS NULL OR row_number() OVER (PARTITION BY content_hash ORDER BY path) = 1)),
      x AS (SELECT DISTINCT path, source, n_notes, CASE WHEN verdict = 'ok' AND path NOT IN (SELECT path FROM k) THEN 'exact_duplicate' ELSE verdict END AS verdict FROM v)
      SELECT source, verdict, {_SPLIT} AS split, count(*) AS n_files, sum(n_notes)::BIGINT AS n_notes FROM x GROUP BY ALL""",
    "drop_reasons": f"WITH {_M} SELECT {_V} AS verdict, count(*) AS n FROM m GROUP BY 1",
    "exact_dedup_keep_first": "SELECT min(path) AS path, content_hash FROM manifest WHERE content_hash IS NOT NULL GROUP BY 2",
    "source_summary_p95": f"""WITH {_M}, {_OK} SELECT source, count(*) AS n_files, sum(n_notes)::BIGINT AS total_notes, floor(median(n_notes))::BIGINT AS median_notes, round(median(duration_seconds), 1) AS median_duration_s,
      floor(median(n_tracks))::BIGINT AS median_tracks, round(list_sort(list(duration_seconds))[floor(count(*) * 0.95::DOUBLE)::INT + 1], 1) AS p95_duration_s FROM ok GROUP BY 1""",
    "hash_split": f"SELECT DISTINCT path, {_SPLIT} AS split, ('0x' || substr(sha1(path), 40, 1))::INT % 2 AS dev_test, ('0x' || substr(sha1('7:' || path), 40, 1))::INT % 2 AS coin FROM manifest",
    "source_detect_all": f"""SELECT DISTINCT path, CASE {' '.join(f"WHEN contains(path, '/raw/{x}/') THEN '{x}'" for x in C.LAYOUT)} END AS layout,
      CASE {' '.join("WHEN " + " OR ".join(f"contains(lower(path), '{p}')" for p in ps) + f" THEN '{x}'" for x, ps in C.PATTERNS)} ELSE 'other' END AS pattern,
      CASE WHEN regexp_extract(path, '/raw/([^/]+)/', 1) IN {C.RATED} THEN regexp_extract(path, '/raw/([^/]+)/', 1) ELSE 'unknown' END AS rated, CASE WHEN regexp_extract(path, '/raw/([^/]+)/', 1) IN {C.RATED} THEN regexp_extract(path, '/raw/([^/]+)/', 1) END AS prompt,
      CASE WHEN starts_with(regexp_extract(path, '([^/]*)$', 1), 'ableton') THEN 'ableton' WHEN starts_with(regexp_extract(path, '([^/]*)$', 1), 'transcribed') THEN 'fma' ELSE 'other' END AS prefix FROM manifest""",
    "path_guards": f"""WITH a AS (SELECT DISTINCT path, {STEM} AS stem FROM manifest), b AS (SELECT DISTINCT {STEM} AS stem FROM (SELECT part_path AS path FROM pair_meta WHERE part_path IS NOT NULL))
      SELECT count(DISTINCT b.stem) AS held_out, count(*) FILTER (regexp_matches(path, '/raw/ableton[^/]*/')) AS ableton FROM a LEFT JOIN b USING (stem)""",
    "quality_left_join": f"""SELECT path, q, split, CASE WHEN split = 'val' OR q IS NULL THEN split ELSE 'train_q' || q END AS prefix FROM (SELECT path, q, {_SPLIT} AS split FROM (SELECT DISTINCT path FROM manifest)
      LEFT JOIN (SELECT path, max(q_bucket) AS q FROM quality_scores WHERE q_bucket IS NOT NULL GROUP BY 1) USING (path))""",
    "snapshot_diff": f"""SELECT path, CASE WHEN sb IS NULL THEN 'missing' WHEN sa IS NULL THEN 'left over' WHEN sa <> sb THEN 'changed' ELSE 'same' END AS state FROM (SELECT path, min({SRC}) AS sa FROM manifest GROUP BY 1)
      FULL JOIN (SELECT path, min(coalesce(source, '')) AS sb FROM quality_scores WHERE path IS NOT NULL GROUP BY 1) USING (path)""",
    "set_operations": """WITH m AS (SELECT path FROM manifest WHERE path IS NOT NULL), q AS (SELECT path FROM quality_scores WHERE path IS NOT NULL), f AS (SELECT path FROM file_notes WHERE path IS NOT NULL)
      SELECT 'union_all' AS op, count(*) AS n FROM (FROM m UNION ALL FROM q) UNION ALL SELECT 'union', count(*) FROM (FROM m UNION FROM q) UNION ALL SELECT 'intersect', count(*) FROM (FROM m INTERSECT FROM f)
      UNION ALL SELECT 'except_all', count(*) FROM (FROM m EXCEPT ALL FROM q) UNION ALL SELECT 'except', count(*) FROM (FROM m EXCEPT FROM q) UNION ALL SELECT 'resume_anti', count(DISTINCT path) FROM m WHERE path NOT IN (FROM f)""",
    "group_samples": f"""WITH {_M}, {_OK}, g AS (SELECT path, min(source) AS source FROM ok GROUP BY 1), r AS (SELECT *, {_pick(0)}, count(*) OVER (PARTITION BY source) AS c, count(*) OVER () AS t FROM g)
      SELECT 'reservoir' AS how, source, path FROM r WHERE r <= 20 UNION ALL SELECT 'stratified', source, path FROM r WHERE r <= greatest(1, round_even(c * 300 / t, 0))
      UNION ALL (SELECT 'round_robin', source, path FROM r ORDER BY r, source LIMIT 55)""",
    "quota_redistribute": f"""WITH {_M}, {_OK}, s AS (SELECT source AS grp, count(DISTINCT path) AS have FROM ok GROUP BY 1), w AS (SELECT *, round_even(700.0::DOUBLE * 1.0 / count(*) OVER (), 0)::BIGINT AS want FROM s),
      x AS (SELECT *, greatest(have - want, 0) AS room, sum(greatest(want - have, 0)) OVER () AS short, sum(greatest(have - want, 0)) OVER () AS rooms FROM w)
      SELECT grp AS "group", have, least(want + CASE WHEN room > 0 AND short > 0 THEN round_even(short::DOUBLE * room / rooms, 0)::BIGINT ELSE 0 END, have) AS want FROM x""",
    "weighted_source_choice": f"""WITH {_M}, {_OK}, s AS (SELECT source AS grp, count(DISTINCT path) AS w FROM ok GROUP BY 1), c AS (SELECT grp, sum(w) OVER (ORDER BY grp) / sum(w) OVER () AS hi, (sum(w) OVER (ORDER BY grp) - w) / sum(w) OVER () AS lo FROM s)
      SELECT grp AS "group", count(*) AS n FROM (SELECT DISTINCT path, {_sha('path')} / 1e6::DOUBLE AS u FROM manifest) JOIN c ON u < hi AND u >= lo GROUP BY 1""",
    "blind_repeats": """WITH p AS (SELECT DISTINCT pair_id FROM pair_meta), a AS (SELECT pair_id, false AS is_repeat FROM p UNION ALL (SELECT pair_id, true FROM p ORDER BY sha1('0r:' || pair_id), pair_id LIMIT 50))
      SELECT pair_id, is_repeat, row_number() OVER (ORDER BY sha1('0o:' || pair_id || ':' || is_repeat), pair_id, is_repeat) - 1 AS idx FROM a""",
    "quartile_buckets": """WITH q AS (SELECT path, max(quality) AS quality FROM quality_scores WHERE quality IS NOT NULL AND NOT isnan(quality) GROUP BY 1), e AS (SELECT quantile_cont(quality, [0.25, 0.5, 0.75]) AS e FROM q)
      SELECT path, ((quality >= e[1])::INT + (quality >= e[2])::INT + (quality >= e[3])::INT)::INT AS bucket FROM q, e""",
    "score_summary": f"""SELECT source, count(*) AS n, round(avg(quality), 6) AS mean, count(*) FILTER (q_bucket = 0) AS q0, count(*) FILTER (q_bucket = 1) AS q1, count(*) FILTER (q_bucket = 2) AS q2, count(*) FILTER (q_bucket = 3) AS q3
      FROM (SELECT * REPLACE ({SRC} AS source) FROM (SELECT DISTINCT * FROM quality_scores)) WHERE quality IS NOT NULL AND NOT isnan(quality) GROUP BY 1""",
    "score_extremes": f"""WITH q AS (SELECT path, max(quality) AS quality, min({SRC}) AS source FROM quality_scores WHERE quality IS NOT NULL AND NOT isnan(quality) GROUP BY 1),
      r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quality DESC, path)::INT AS best, row_number() OVER (PARTITION BY source ORDER BY quality, path DESC) AS worst FROM q)
      SELECT source, path, CASE WHEN best <= 10 THEN 'best' ELSE 'worst' END AS label, best FROM r WHERE best <= 10 OR worst <= 10""",
    "shard_packing": f"WITH {_M}, {_OK}, {_SHARD} SELECT * FROM sp",
    "mixture_report": f"""WITH {_M}, {_OK}, {_SHARD}, p AS (SELECT split, source, shard, sum(take)::BIGINT AS tokens FROM sp GROUP BY ALL), t AS (SELECT CASE WHEN source IN ('aria', 'lakh') THEN '(untagged)' ELSE source END AS tag, tokens FROM p)
      SELECT tag, sum(tokens)::BIGINT AS tokens, count(*) AS shards, round(sum(tokens) / (SELECT sum(tokens) FROM p), 9) AS prob FROM t GROUP BY 1""",
    "size_registry": f"""WITH {_M}, {_OK}, g AS (SELECT source, count(*) AS n, sum(n_notes)::BIGINT AS t FROM ok GROUP BY 1), f AS (SELECT source, count(DISTINCT path) AS files FROM m GROUP BY 1)
      SELECT source, files, CASE WHEN n >= 200 THEN files * (t // n) ELSE floor(files * (SELECT sum(t) / sum(n) FROM g))::BIGINT END AS estimate, coalesce(n >= 200, false) AS measured FROM f LEFT JOIN g USING (source)""",
    "header_asof_doc_start": f"""WITH {_M}, {_OK}, {_SHARD}, x AS (SELECT split, source, shard * 50000 + "offset" AS t, path, take FROM sp), ee AS (SELECT split, source, max(t + take) AS e FROM x GROUP BY ALL),
      p AS (SELECT split, source, unnest(range(0, e, 10000)) AS t FROM ee) SELECT p.split, p.source, p.t, x.path FROM p ASOF LEFT JOIN x ON p.split = x.split AND p.source = x.source AND p.t >= x.t""",
    "shingles_6gram": f"WITH {_SH} SELECT path, count(*)::INT AS n, min(x) AS least, max(x) AS most FROM sh GROUP BY 1",
    "minhash_signature": f"WITH {_SIG} SELECT path, i, h FROM sig",
    "near_dup_clusters": f"{_CLUSTER} SELECT path, cluster, keeper FROM co JOIN kp USING (cluster)",
    "near_dup_keepers": f"{_CLUSTER} SELECT path FROM co JOIN kp USING (cluster) WHERE path <> keeper",
    "near_dup_clusters_whole": f"{_WHOLE} SELECT path, cluster, keeper FROM co JOIN kp USING (cluster)",
    "near_dup_keepers_whole": f"{_WHOLE} SELECT path FROM co JOIN kp USING (cluster) WHERE path <> keeper",
    "content_hash": f"""WITH {NOTES}, h AS (SELECT file_id, track_name, note_idx, lpad(hex(pitch), 16, '0') AS p, lpad(hex(start), 16, '0') AS s, lpad(hex(duration), 16, '0') AS u FROM notes)
      SELECT file_id, sha1(unhex(string_agg(substr(p, 15, 2) || substr(p, 13, 2) || {' || '.join(f'substr(s, {15 - 2 * i}, 2)' for i in range(8))} || {' || '.join(f'substr(u, {15 - 2 * i}, 2)' for i in range(8))}, '' ORDER BY track_name, note_idx))) AS content_hash FROM h GROUP BY 1""",
    "version_list": "SELECT DISTINCT model FROM (SELECT unnest([model_a, model_b]) AS model FROM pair_meta) WHERE model IS NOT NULL AND model <> 'ckpt_last'",
}

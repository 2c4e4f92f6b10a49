"""Preference queries over labels, pair_meta, quality_scores and embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from partita.operators import preferences as P
from partita.operators.positions import group_quantiles
from partita.tables import clean_source, clean_source_sql, table

LBL = "lb AS (SELECT DISTINCT ts, session_id, pair_id, idx, choice, left_is, right_is, preferred, left_model, right_model, corrected_from FROM labels WHERE pair_id <> '' AND ts IS NOT NULL)"


def _l(s, d):
    return table(s, d, "labels").filter("pair_id <> '' and ts is not null").select("ts", "session_id", "pair_id", "idx", "choice", "left_is", "right_is", "preferred", "left_model", "right_model", "corrected_from").distinct()


def _r(df, n=9):
    return df.select(*(F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _ratings(s, d):
    """Votes as ratings: the choice's place in a scale, a corrected row as a revision."""
    rating = F.when(F.col("choice") == "left", 5).when(F.col("choice") == "right", 4).when(F.col("choice") == "tie", 3).when(F.col("choice") == "bad", 1)
    return _l(s, d).select(F.col("pair_id").alias("excerpt_id"), rating.cast("double").alias("rating"), F.col("corrected_from").isNotNull().alias("revision"), F.struct("ts", "session_id", F.col("corrected_from").isNotNull(), F.coalesce("choice", F.lit(""))).alias("ord"), "session_id")


_RAT = f"""{LBL}, rt AS (SELECT pair_id AS excerpt_id, CASE choice WHEN 'left' THEN 5 WHEN 'right' THEN 4 WHEN 'tie' THEN 3 WHEN 'bad' THEN 1 END::DOUBLE AS rating, corrected_from IS NOT NULL AS revision,
  row_number() OVER (ORDER BY ts, session_id, corrected_from IS NOT NULL, coalesce(choice, '')) AS ord FROM lb)"""


def ceiling(s, d):
    """The last later vote of each pair against its first, where that was decided."""
    l = _l(s, d).withColumn("ord", F.struct("ts", "session_id", F.coalesce("choice", F.lit(""))))
    first = l.groupBy("pair_id").agg(F.min("ord").alias("o"), F.min_by("preferred", "ord").alias("original"))
    rep = l.join(first.select("pair_id", "o"), "pair_id").filter("ord > o")
    return _r(P.repeat_ceiling(rep, first.filter(F.col("original").isin("a", "b")).select("pair_id", "original")))


def _judged(s, d):
    """Votes as a judge's two passes: the first by the displayed side, the second by the hash of the pair for one in three."""
    w = F.when(F.col("choice") == "left", "1").when(F.col("choice") == "right", "2").otherwise("tie")
    back = F.when(w == "1", "2").when(w == "2", "1").otherwise("tie")
    odd = F.conv(F.substring(F.sha1("pair_id"), 40, 1), 16, 10).cast("int") % 3 == 0
    return _l(s, d).select("pair_id", "preferred", "left_is", w.alias("first"), F.when(odd, w).otherwise(back).alias("second"))


def judge_metrics(s, d):
    v, same = P.swap_verdict(F.col("first"), F.col("second"))
    x = _judged(s, d).withColumn("verdict", v).withColumn("same", same)
    human = F.when(F.col("preferred") == F.col("left_is"), "1").when(F.col("preferred").isin("a", "b"), "2")
    g = x.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") != "tie").alias("n_decided"), F.avg(F.when((F.col("verdict") != "tie") & human.isNotNull(), (F.col("verdict") == human).cast("double"))).alias("agreement"),
              F.avg(F.col("same").cast("double")).alias("swap_consistency"), F.avg((F.col("first") == "1").cast("double")).alias("first_pick"), (1 - F.avg((F.col("verdict") != "tie").cast("double"))).alias("tie_rate"))
    return _r(g)


def judge_parse(s, d):
    """Replies built from the votes, well-formed or not, and what is read from them."""
    r = F.concat(F.lit("Sure:\n"), F.when(F.col("choice") == "skip", F.lit("no idea")).when(F.col("choice") == "bad", F.lit('{"winner": broken}')).otherwise(
        F.concat(F.lit('{"winner": " '), F.when(F.col("choice") == "left", "1").when(F.col("choice") == "right", "2").otherwise("TIE"), F.lit('", "reason": "'), F.repeat(F.lit("since "), 20), F.lit('"} ok'))))
    x = _l(s, d).filter("choice is not null").select("choice", P.parse_reply(r).alias("p"))
    return x.groupBy("choice", F.col("p.winner").alias("winner"), F.col("p.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def wilson_sets(s, d):
    """Wins of side a with their interval: over all, by mode, by session."""
    meta = table(s, d, "pair_meta").groupBy("pair_id").agg(F.min("mode").alias("mode"))
    x = _l(s, d).filter(F.col("preferred").isin("a", "b")).join(meta, "pair_id").withColumn("hour", F.hour("ts"))
    x.createOrReplaceTempView("partita_wilson")
    g = s.sql("SELECT grouping_id(mode, hour) AS g, mode, hour, count_if(preferred = 'a') AS k, count(*) AS n FROM partita_wilson GROUP BY GROUPING SETS ((), (mode), (hour))")
    lo, hi = P.wilson(F.col("k"), F.col("n"))
    return _r(g.select(F.col("g").cast("int").alias("g"), "mode", "hour", "k", "n", lo.alias("lo"), hi.alias("hi")))


def _scored(s, d):
    q = table(s, d, "quality_scores").filter("quality is not null and not isnan(quality)").groupBy("path").agg(F.max("quality").alias("quality"), F.min(clean_source(F.col("source"), F.col("path"))).alias("source"))
    m = table(s, d, "manifest").filter("n_notes is not null").groupBy("path").agg(F.max("n_notes").cast("double").alias("notes"))
    return q.join(m, "path")


_SCORED = f"""q AS (SELECT path, max(quality) AS quality, min({clean_source_sql()}) AS source FROM quality_scores WHERE quality IS NOT NULL AND NOT isnan(quality) GROUP BY 1),
 mm AS (SELECT path, max(n_notes)::DOUBLE AS notes FROM manifest WHERE n_notes IS NOT NULL GROUP BY 1), sc AS (SELECT * FROM q JOIN mm USING (path))"""


def _emb(s, d):
    a = table(s, d, "embeddings")
    w, l = a.filter("vec_id % 2 = 0"), a.filter("vec_id % 2 = 1")
    x = w.select(F.col("vec_id").alias("pair_id"), F.col("label").alias("grp"), F.col("embedding").alias("w")).join(l.select((F.col("vec_id") - 1).alias("pair_id"), F.col("embedding").alias("l")), "pair_id")
    return x.withColumn("diff", F.zip_with("w", "l", lambda p, q: p.cast("double") - q.cast("double")))


_EMB = "em AS (SELECT a.vec_id AS pair_id, a.label AS grp, list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"


def metric_agreement(s, d):
    """How often each component is larger for the winner, among the pairs in which it differs."""
    return _agreement(_emb(s, d).select(F.posexplode("diff").alias("metric", "v")))


def _agreement(x):
    x = x.filter("v <> 0")
    return _r(x.groupBy("metric").agg(F.avg((F.col("v") > 0).cast("double")).alias("agreement"), F.count(F.lit(1)).alias("n")))


def reward(s, d):
    w = [((i * 7) % 11 - 5) / 5 for i in range(64)]
    sd = [0.0 if i % 16 == 0 else 0.1 + i / 64 for i in range(64)]
    return _r(_emb(s, d).select("pair_id", P.linear_reward(F.col("diff"), sd, w).alias("reward")))


def calibrate(s, d):
    p = _emb(s, d).select((1 / (1 + F.exp(-3 * F.element_at("diff", 1)))).alias("p"))
    return _r(P.calibration(p))


def top_k_mask(s, d):
    """Each vector as logits: ids kept by temperature, bans and the fifth-largest value (ties kept)."""
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: F.when(i.isin(3, 17), float("-inf")).otherwise(x.cast("double") / 0.8)).alias("v"))
    e = e.withColumn("k", F.element_at(F.sort_array("v", asc=False), 5))
    return e.select("vec_id", F.posexplode("v").alias("id", "x"), "k").filter("x >= k").select("vec_id", "id", F.round("x", 6).alias("x"))


def seeded_sample(s, d):
    """One token of each vector as logits, by the seeded sampler."""
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "id": [P.sample_top_k(np.array(v), P.seeded_uniform(int(i), 1)[0], 0.9, 8, (3,)) for i, v in zip(b["vec_id"], b["embedding"])]})

    return table(s, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, id int")


def _features(s, d):
    x = table(s, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("y0"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"))
    return x.withColumn("y", F.greatest(F.lit(1.0), F.least(F.lit(5.0), 1 + F.col("y0") / 25_000))).withColumn("q", F.when(F.col("l_orderkey") % 7 != 0, F.col("q")))


COLS = ["q", "disc", "tax"]


def ridge(s, d):
    m = P.fit_ridge(_features(s, d), COLS, "y", 3.0)
    return s.createDataFrame([(n, round(float(c), 8), round(float(mu), 8), round(float(sd), 8)) for n, c, mu, sd in zip(m.names, m.coef, m.means, m.stds)], "name string, coef double, mean double, std double")


def cv(s, d):
    x = _features(s, d).fillna({"q": 25.0})
    return P.grouped_cv(x, COLS, "y", "l_orderkey", [0.1, 10.0, 1000.0])


def layer_sweep(s, d):
    """Held-out accuracy of each half of the vectors, taken as layers."""
    x, out = _emb(s, d), None
    for k in range(2):
        a = P.leave_group_out(x.withColumn("diff", F.slice("diff", 32 * k + 1, 32)), 1.0, scale=True).agg(F.avg((F.col("p") > 0.5).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("layer"), "accuracy", "n")
        out = a if out is None else out.unionByName(a)
    return out


def scorecard(s, d):
    """Mean, median, sample and population deviation of three metrics of the manifest, of finite values only, by source; six digits."""
    m = table(s, d, "manifest").distinct().select(clean_source(F.col("source"), F.col("path")).alias("source"), F.explode(F.create_map(F.lit("notes"), F.col("n_notes").cast("double"), F.lit("seconds"), F.col("duration_seconds"), F.lit("tracks"), F.col("n_tracks").cast("double"))).alias("metric", "v"))
    m = m.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    med = group_quantiles(m, ["source", "metric"], "v", [0.5]).select("source", "metric", F.round("q0", 6).alias("median"))
    return med.join(m.groupBy("source", "metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.coalesce(F.nanvl(F.stddev_samp("v"), F.lit(0.0)), F.lit(0.0)), 6).alias("std"), F.count(F.lit(1)).alias("n")), ["source", "metric"])


def compare(s, d):
    """Mean of model b less mean of model a by metric, for two models side by side."""
    m = table(s, d, "pair_meta").distinct()
    m = m.select(F.explode(F.array(F.struct(F.col("model_a").alias("model"), F.col("n_notes_a").alias("n")), F.struct(F.col("model_b").alias("model"), F.col("n_notes_b").alias("n")))).alias("x"), "mode").select("mode", "x.model", F.col("x.n").cast("double").alias("n"))
    g = m.filter(F.col("model").isin("v4-base", "v5-dpo") & F.col("n").isNotNull()).groupBy("mode").pivot("model", ["v4-base", "v5-dpo"]).agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))
    return _r(g.select("mode", F.col("`v4-base_mean`").alias("mean_a"), F.col("`v5-dpo_mean`").alias("mean_b"), (F.col("`v5-dpo_mean`") - F.col("`v4-base_mean`")).alias("diff"), F.col("`v4-base_sd`").alias("sd_a"), F.col("`v5-dpo_sd`").alias("sd_b")), 6)


def prompts(s, d):
    """How often each prompt was used, and the least used of each mode (first path of equals)."""
    u = table(s, d, "pair_meta").filter("prompt_path is not null and mode is not null").groupBy("mode", "prompt_path").agg(F.count_distinct("pair_id").alias("uses"))
    return u.groupBy("mode").agg(F.min_by("prompt_path", F.struct("uses", "prompt_path")).alias("next"), F.min("uses").alias("uses"), F.count(F.lit(1)).alias("prompts"))


def schedules(s, d):
    """Warm-up with cosine, and warm-up, stable, decay, at each step of a run."""
    x = s.range(0, 1000, 10).withColumn("step", F.col("id").cast("double"))
    warm = F.lit(0.001) * (F.col("step") + 1) / 100
    cos = F.lit(0.0001) + 0.5 * (1 + F.cos(F.lit(np.pi) * (F.col("step") - 100) / 900)) * 0.0009
    wsd = F.when(F.col("step") < 900, F.lit(0.001)).otherwise(F.lit(0.001) + F.least(F.lit(1.0), (F.col("step") - 900) / 100) * F.lit(-0.0009))
    return x.select("id", F.round(F.when(F.col("step") < 100, warm).otherwise(cos), 12).alias("cosine"), F.round(F.when(F.col("step") < 100, warm).otherwise(wsd), 12).alias("wsd"))


def agreement_of_decoders(s, d):
    """Two vectors as logits of two engines: top-1 match rate and KL by label."""
    e = _emb(s, d)
    sm = lambda c: F.transform(c, lambda x: F.exp(x.cast("double")))
    tot = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    e = e.withColumn("p", sm("w")).withColumn("q", sm("l")).withColumn("sp", tot("p")).withColumn("sq", tot("q"))
    kl = tot(F.zip_with("p", "q", lambda a, b: a / F.col("sp") * (F.ln(a / F.col("sp")) - F.ln(b / F.col("sq")))))
    top = F.array_position("w", F.array_max("w")) == F.array_position("l", F.array_max("l"))
    return _r(e.groupBy("grp").agg(F.avg(top.cast("double")).alias("top1"), F.avg(kl).alias("kl"), F.avg(P.k3_kl(F.transform("w", lambda x: x.cast("double")), F.transform("l", lambda x: x.cast("double")))).alias("k3")), 6)


QUERIES = {
    "vote_canonical": lambda s, d: _l(s, d).groupBy(P.canonical_vote(F.col("choice"), F.col("left_is"), F.col("right_is")).alias("side"), "preferred").agg(F.count(F.lit(1)).alias("n")),
    "majority_vote": lambda s, d: P.majority(_l(s, d)), "consistency_majority": lambda s, d: _r(P.consistency_majority(_l(s, d))), "consistency_consecutive": lambda s, d: _r(P.consistency_consecutive(_ratings(s, d))), "relabel_ceiling": ceiling,
    "ratings_aggregate": lambda s, d: _r(P.aggregate_ratings(_ratings(s, d))),
    "ratings_stats": lambda s, d: _r(_ratings(s, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("events"), F.count("rating").alias("rated"), F.avg("rating").alias("mean"), F.count_distinct(F.when(F.col("rating").isNotNull(), F.col("excerpt_id"))).alias("excerpts"), *(F.count_if(F.col("rating") == k).alias(f"r{k}") for k in range(1, 6)))),
    "judge_metrics": judge_metrics, "judge_parse": judge_parse, "wilson_grouping_sets": wilson_sets,
    "side_balance": lambda s, d: _r(_l(s, d).agg(F.avg(F.when(F.col("preferred").isin("a", "b"), (F.col("preferred") == "a").cast("double"))).alias("a_share"), F.avg(F.when(F.col("choice").isNotNull(), (F.col("choice") == "tie").cast("double"))).alias("tie_rate"))),
    "last_vote": lambda s, d: _l(s, d).groupBy("pair_id").agg(F.max_by(F.coalesce("choice", F.lit("")), F.struct("ts", "session_id", F.col("corrected_from").isNotNull(), F.coalesce("choice", F.lit("")))).alias("choice")),
    "spearman_avg_rank": lambda s, d: _r(P.spearman(_scored(s, d), "quality", "notes", ["source"]), 8),
    "per_source_bias": lambda s, d: _r(P.spearman(_scored(s, d).withColumn("pred", F.col("notes") / 1000), "quality", "pred", ["source"]).join(_scored(s, d).groupBy("source").agg(F.avg("quality").alias("mean_true"), F.avg(F.col("notes") / 1000).alias("mean_pred"), F.avg(F.abs(F.col("quality") - F.col("notes") / 1000)).alias("mae")), "source"), 8),
    "group_advantage": lambda s, d: _r(P.group_advantage(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_totalprice"), 6).drop("o_totalprice"),
    "calibration": calibrate, "per_metric_agreement": metric_agreement, "linear_reward": reward, "topk_mask": top_k_mask, "seeded_topk_sample": seeded_sample,
    "ridge_fit": ridge, "grouped_cv_alpha": cv, "logo_accuracy": lambda s, d: P.leave_group_out(_emb(s, d)), "layer_sweep": layer_sweep,
    "bradley_terry": lambda s, d: s.createDataFrame([(i, float(v)) for i, v in enumerate(P.fit_bt_rows(_emb(s, d)))], "feature int, weight double"),
    "scorecard_agg": scorecard, "checkpoint_compare": compare, "least_used_prompt": prompts, "lr_schedules": schedules, "decoder_agreement": agreement_of_decoders,
}

_ODD = "('0x' || substr(sha1(pair_id), 40, 1))::INT % 3 = 0"
_JW = "CASE choice WHEN 'left' THEN '1' WHEN 'right' THEN '2' ELSE 'tie' END"
_RANK = """rk AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY quality) + (count(*) OVER (PARTITION BY source, quality) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY source ORDER BY notes) + (count(*) OVER (PARTITION BY source, notes) - 1) / 2.0::DOUBLE AS rb FROM sc),
 rh AS (SELECT source, count(*) AS n, CASE WHEN var_pop(ra) > 0 AND var_pop(rb) > 0 THEN corr(ra, rb) ELSE 'nan'::DOUBLE END AS rho FROM rk GROUP BY 1)"""

ORACLE = {
    "vote_canonical": f"WITH {LBL} SELECT CASE choice WHEN 'left' THEN left_is WHEN 'right' THEN right_is ELSE choice END AS side, preferred, count(*) AS n FROM lb GROUP BY ALL",
    "majority_vote": f"WITH {LBL} SELECT pair_id, CASE WHEN 2 * count(*) FILTER (preferred = 'a') > count(*) THEN 'a' ELSE 'b' END AS winner, count(*) AS n_votes FROM lb WHERE preferred IN ('a', 'b') GROUP BY 1 HAVING 2 * count(*) FILTER (preferred = 'a') <> count(*)",
    "consistency_majority": f"WITH {LBL}, c AS (SELECT count(*) FILTER (preferred = 'a') AS a, count(*) AS n FROM lb WHERE preferred IN ('a', 'b') GROUP BY pair_id HAVING count(*) > 1) SELECT round(sum(greatest(a, n - a)) / sum(n), 9) AS consistency, sum(n)::BIGINT AS votes FROM c",
    "consistency_consecutive": f"WITH {_RAT}, x AS (SELECT abs(rating - lag(rating) OVER (PARTITION BY excerpt_id ORDER BY ord)) AS d FROM rt WHERE rating IS NOT NULL) SELECT count(*) AS pairs, round(avg((d = 0)::INT), 9) AS exact, round(avg(d), 9) AS mean_abs_diff FROM x WHERE d IS NOT NULL",
    "relabel_ceiling": f"""WITH {LBL}, n AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ts, session_id, coalesce(choice, '')) AS i, rank() OVER (PARTITION BY pair_id ORDER BY ts, session_id, coalesce(choice, '')) AS ri FROM lb),
      o AS (SELECT pair_id, preferred AS original FROM n WHERE i = 1 AND preferred IN ('a', 'b')), r AS (SELECT * FROM n WHERE ri > 1 QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY ts DESC, session_id DESC, coalesce(choice, '') DESC) = 1),
      g AS (SELECT count(*) FILTER (preferred IN ('a', 'b')) AS n, count(*) FILTER (preferred IN ('a', 'b') AND preferred = original) AS a, count(*) FILTER (NOT coalesce(preferred IN ('a', 'b'), false) AND coalesce(choice <> 'bad', true)) AS ab, count(*) FILTER (NOT coalesce(preferred IN ('a', 'b'), false) AND choice = 'bad') AS bad FROM r JOIN o USING (pair_id))
      SELECT n, round(a / n, 9) AS self_consistency, round(sqrt((a / n) * (1 - a / n) / n), 9) AS se, ab AS n_abstained, bad AS n_bad, round(ab / (n + ab), 9) AS skip_rate, round(a / (n + ab), 9) AS floor FROM g""",
    "ratings_aggregate": f"WITH {_RAT}, f AS (SELECT excerpt_id, max(ord) FILTER (revision) AS f FROM rt WHERE rating IS NOT NULL GROUP BY 1) SELECT excerpt_id, round(avg(rating), 9) AS rating, count(*) AS n FROM rt JOIN f USING (excerpt_id) WHERE rating IS NOT NULL AND (f IS NULL OR ord >= f) GROUP BY 1",
    "ratings_stats": f"""WITH {LBL}, r AS (SELECT session_id, pair_id, CASE choice WHEN 'left' THEN 5 WHEN 'right' THEN 4 WHEN 'tie' THEN 3 WHEN 'bad' THEN 1 END::DOUBLE AS rating FROM lb)
      SELECT session_id, count(*) AS events, count(rating) AS rated, round(avg(rating), 9) AS mean, count(DISTINCT CASE WHEN rating IS NOT NULL THEN pair_id END) AS excerpts, {', '.join(f'count(*) FILTER (rating = {k}) AS r{k}' for k in range(1, 6))} FROM r GROUP BY 1""",
    "judge_metrics": f"""WITH {LBL}, j AS (SELECT *, {_JW} AS f, {_ODD} AND {_JW} <> 'tie' AS bad FROM lb), v AS (SELECT *, CASE WHEN bad THEN 'tie' ELSE f END AS verdict, CASE WHEN preferred = left_is THEN '1' WHEN preferred IN ('a', 'b') THEN '2' END AS human FROM j)
      SELECT count(*) AS n, count(*) FILTER (verdict <> 'tie') AS n_decided, round(avg((verdict = human)::INT) FILTER (verdict <> 'tie' AND human IS NOT NULL), 9) AS agreement, round(avg((NOT bad)::INT), 9) AS swap_consistency, round(avg((f = '1')::INT), 9) AS first_pick, round(1 - avg((verdict <> 'tie')::INT), 9) AS tie_rate FROM v""",
    "judge_parse": f"""WITH {LBL} SELECT choice, CASE choice WHEN 'left' THEN '1' WHEN 'right' THEN '2' ELSE 'tie' END AS winner, CASE WHEN choice IN ('skip', 'bad') THEN 'unparseable' ELSE substr(repeat('since ', 20), 1, 80) END AS reason, count(*) AS n FROM lb WHERE choice IS NOT NULL GROUP BY ALL""",
    "wilson_grouping_sets": f"""WITH {LBL}, pm AS (SELECT pair_id, min(mode) AS mode FROM pair_meta GROUP BY 1), x AS (SELECT *, extract(hour FROM ts)::INT AS hour FROM lb JOIN pm USING (pair_id) WHERE preferred IN ('a', 'b')),
      g AS (SELECT grouping(mode, hour)::INT AS g, mode, hour, count(*) FILTER (preferred = 'a') AS k, count(*) AS n FROM x GROUP BY GROUPING SETS ((), (mode), (hour)))
      SELECT g, mode, hour, k, n, round((k / n + 3.8416 / (2 * n) - 1.96 * sqrt((k / n) * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 9)::DOUBLE AS lo, round((k / n + 3.8416 / (2 * n) + 1.96 * sqrt((k / n) * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 9)::DOUBLE AS hi FROM g""",
    "side_balance": f"WITH {LBL} SELECT round(avg((preferred = 'a')::INT) FILTER (preferred IN ('a', 'b')), 9) AS a_share, round(avg((choice = 'tie')::INT), 9) AS tie_rate FROM lb",
    "last_vote": f"WITH {LBL} SELECT pair_id, coalesce(choice, '') AS choice FROM lb QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY ts DESC, session_id DESC, corrected_from IS NOT NULL DESC, coalesce(choice, '') DESC) = 1",
    "spearman_avg_rank": f"WITH {_SCORED}, {_RANK} SELECT source, n, round(rho, 8) AS rho FROM rh",
    "per_source_bias": f"WITH {_SCORED}, {_RANK}, b AS (SELECT source, avg(quality) AS t, avg(notes / 1000) AS p, avg(abs(quality - notes / 1000)) AS e FROM sc GROUP BY 1) SELECT source, n, round(rho, 8) AS rho, round(t, 8) AS mean_true, round(p, 8) AS mean_pred, round(e, 8) AS mae FROM rh JOIN b USING (source)",
    "group_advantage": "WITH g AS (SELECT o_custkey, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders GROUP BY 1 HAVING count(*) > 1) SELECT o_orderkey, o_custkey, round((o_totalprice - m) / (s + 1e-6), 6) AS advantage FROM orders JOIN g USING (o_custkey)",
    "calibration": f"""WITH {_EMB}, p AS (SELECT 1 / (1 + exp(-3 * d[1])) AS p FROM em), x AS (SELECT p, 1.0 AS y FROM p UNION ALL SELECT 1 - p, 0.0 FROM p), e AS (SELECT quantile_cont(p, [0.25, 0.5, 0.75]) AS e FROM x)
      SELECT ((p >= e[1])::INT + (p >= e[2])::INT + (p >= e[3])::INT)::INT AS bin, round(avg(p), 9) AS predicted, round(avg(y), 9) AS empirical, count(*) AS n FROM x, e GROUP BY 1""",
    "per_metric_agreement": f"WITH {_EMB}, x AS (SELECT unnest(range(64))::INT AS metric, unnest(d) AS v FROM em) SELECT metric, round(avg((v > 0)::INT), 9) AS agreement, count(*) AS n FROM x WHERE v <> 0 GROUP BY 1",
    "linear_reward": f"WITH {_EMB} SELECT pair_id, round(list_sum(list_transform(range(64), lambda i: d[i + 1] / (CASE WHEN i % 16 = 0 THEN 1 ELSE 0.1::DOUBLE + i / 64::DOUBLE END) * (((i * 7) % 11 - 5) / 5::DOUBLE))), 9) AS reward FROM em",
    "topk_mask": "WITH e AS (SELECT vec_id, unnest(range(64))::INT AS id, unnest(embedding)::DOUBLE / 0.8::DOUBLE AS x FROM embeddings), k AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS r FROM e WHERE id NOT IN (3, 17)) SELECT vec_id, id, round(x, 6) AS x FROM k WHERE r <= 5",
    "scorecard_agg": f"""WITH m AS (SELECT {clean_source_sql()} AS source, unnest(['notes', 'seconds', 'tracks']) AS metric, unnest([n_notes::DOUBLE, duration_seconds, n_tracks::DOUBLE]) AS v FROM (SELECT DISTINCT * FROM manifest))
      SELECT source, metric, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(coalesce(stddev_samp(v), 0), 6) AS std, count(*) AS n FROM m WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY ALL""",
    "checkpoint_compare": """WITH m AS (SELECT mode, unnest([model_a, model_b]) AS model, unnest([n_notes_a, n_notes_b]) AS n FROM (SELECT DISTINCT * FROM pair_meta))
      SELECT mode, round(avg(n) FILTER (model = 'v4-base'), 6) AS mean_a, round(avg(n) FILTER (model = 'v5-dpo'), 6) AS mean_b, round(avg(n) FILTER (model = 'v5-dpo') - avg(n) FILTER (model = 'v4-base'), 6) AS diff,
        round(stddev_pop(n) FILTER (model = 'v4-base'), 6) AS sd_a, round(stddev_pop(n) FILTER (model = 'v5-dpo'), 6) AS sd_b FROM m WHERE model IN ('v4-base', 'v5-dpo') AND n IS NOT NULL GROUP BY 1""",
    "least_used_prompt": "WITH u AS (SELECT mode, prompt_path, count(DISTINCT pair_id) AS uses FROM pair_meta WHERE prompt_path IS NOT NULL AND mode IS NOT NULL GROUP BY ALL) SELECT mode, arg_min(prompt_path, (uses, prompt_path)) AS next, min(uses) AS uses, count(*) AS prompts FROM u GROUP BY 1",
    "lr_schedules": """SELECT i AS id, round(CASE WHEN i < 100 THEN 0.001::DOUBLE * (i + 1) / 100 ELSE 0.0001::DOUBLE + 0.5::DOUBLE * (1 + cos(pi() * (i - 100) / 900)) * 0.0009::DOUBLE END, 12)::DOUBLE AS cosine,
      round(CASE WHEN i < 100 THEN 0.001::DOUBLE * (i + 1) / 100 WHEN i < 900 THEN 0.001::DOUBLE ELSE 0.001::DOUBLE - least(1, (i - 900) / 100) * 0.0009::DOUBLE END, 12)::DOUBLE AS wsd FROM range(0, 1000, 10) t(i)""",
    "decoder_agreement": """WITH e AS (SELECT a.vec_id, a.label AS grp, a.embedding::DOUBLE[] AS w, b.embedding::DOUBLE[] AS l, a.embedding AS w0, b.embedding AS l0 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
      z AS (SELECT *, list_sum(list_transform(w, lambda x: exp(x))) AS sw, list_sum(list_transform(l, lambda x: exp(x))) AS sl FROM e)
      SELECT grp, round(avg((list_position(w0, list_max(w0)) = list_position(l0, list_max(l0)))::INT), 6) AS top1, round(avg(list_sum(list_transform(range(1, 65), lambda i: exp(w[i]) / sw * (ln(exp(w[i]) / sw) - ln(exp(l[i]) / sl))))), 6) AS kl,
        round(avg(list_avg(list_transform(range(1, 65), lambda i: exp(l[i] - w[i]) - (l[i] - w[i]) - 1))), 6) AS k3 FROM z GROUP BY 1""",
    "ridge_fit": """WITH f AS (SELECT greatest(1, least(5, 1 + l_extendedprice / 25000))::DOUBLE AS y, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity::DOUBLE END AS q0, l_discount::DOUBLE AS b, l_tax::DOUBLE AS c FROM lineitem),
      md AS (SELECT median(q0) AS m FROM f), x AS (SELECT y, coalesce(q0, m) AS a, b, c FROM f, md), st AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(c) AS sc FROM x),
      g AS (SELECT n + 3.0::DOUBLE AS p, ma, mb, mc, sa, sb, sc, n * covar_pop(a, b) / (sa * sb) AS ab, n * covar_pop(a, c) / (sa * sc) AS ac, n * covar_pop(b, c) / (sb * sc) AS bc,
        n * covar_pop(a, y) / sa AS ay, n * covar_pop(b, y) / sb AS by_, n * covar_pop(c, y) / sc AS cy FROM x, st GROUP BY n, ma, mb, mc, sa, sb, sc),
      dt AS (SELECT *, p * (p * p - bc * bc) - ab * (ab * p - bc * ac) + ac * (ab * bc - p * ac) AS det FROM g)
      SELECT unnest(['q', 'disc', 'tax']) AS name, round(unnest([(ay * (p * p - bc * bc) - ab * (by_ * p - bc * cy) + ac * (by_ * bc - p * cy)) / det, (p * (by_ * p - bc * cy) - ay * (ab * p - bc * ac) + ac * (ab * cy - by_ * ac)) / det,
        (p * (p * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - p * ac)) / det]), 8) AS coef, round(unnest([ma, mb, mc]), 8) AS mean, round(unnest([sa, sb, sc]), 8) AS std FROM dt""",
}

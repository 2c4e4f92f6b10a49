"""Preference analytics: votes, consistency, intervals, rank statistics, ridge and Bradley-Terry fits."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.operators.positions import group_quantiles, ranked
from partita.tables import stash


def canonical_vote(choice: Column, left_is: Column, right_is: Column) -> Column:
    """The side chosen: a or b for left and right, other choices as they are."""
    return F.when(choice == "left", left_is).when(choice == "right", right_is).otherwise(choice)


def majority(votes: DataFrame) -> DataFrame:
    """pair_id, winner, n_votes: the side with more of the a/b votes; pairs without one are left out."""
    n, a = F.count(F.lit(1)), F.count_if(F.col("preferred") == "a")
    g = votes.filter(F.col("preferred").isin("a", "b")).groupBy("pair_id").agg(a.alias("a"), n.alias("n_votes"))
    return g.filter("2 * a <> n_votes").select("pair_id", F.when(F.expr("2 * a > n_votes"), "a").otherwise("b").alias("winner"), "n_votes")


def consistency_majority(votes: DataFrame) -> DataFrame:
    """Share of votes that agree with the commonest of their pair, over pairs with two a/b votes or more; and how many."""
    c = votes.filter(F.col("preferred").isin("a", "b")).groupBy("pair_id").agg(F.count_if(F.col("preferred") == "a").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return c.agg(F.try_divide(F.sum(F.greatest("a", F.col("n") - F.col("a"))), F.sum("n")).alias("consistency"), F.coalesce(F.sum("n"), F.lit(0)).alias("votes"))


def consistency_consecutive(ratings: DataFrame) -> DataFrame:
    """Exact agreement and mean difference of consecutive ratings of one excerpt."""
    d = ratings.filter("rating is not null").withColumn("d", F.abs(F.col("rating") - F.lag("rating").over(Window.partitionBy("excerpt_id").orderBy("ord")))).filter("d is not null")
    return d.agg(F.count(F.lit(1)).alias("pairs"), F.avg((F.col("d") == 0).cast("double")).alias("exact"), F.avg("d").alias("mean_abs_diff"))


def repeat_ceiling(repeats: DataFrame, originals: DataFrame) -> DataFrame:
    """Agreement of the last repeated vote of each pair with the original, with error, abstentions and floor. Both-bad pairs count for nobody."""
    last = repeats.groupBy("pair_id").agg(F.max_by(F.struct("preferred", "choice"), "ord").alias("v")).select("pair_id", "v.preferred", "v.choice")
    x = last.join(originals, "pair_id")
    ab = F.col("preferred").isin("a", "b")
    g = x.agg(F.count_if(ab).alias("n"), F.count_if(ab & (F.col("preferred") == F.col("original"))).alias("agree"), F.count_if(~F.coalesce(ab, F.lit(False)) & F.coalesce(F.col("choice") != "bad", F.lit(True))).alias("n_abstained"), F.count_if(~F.coalesce(ab, F.lit(False)) & (F.col("choice") == "bad")).alias("n_bad"))
    div, seen = F.try_divide, F.col("n") + F.col("n_abstained")
    p = div(F.col("agree"), F.col("n"))
    return g.select("n", p.alias("self_consistency"), F.sqrt(div(p * (1 - p), F.col("n"))).alias("se"), "n_abstained", "n_bad", div(F.col("n_abstained"), seen).alias("skip_rate"), div(F.col("agree"), seen).alias("floor"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    n = F.when(n > 0, n)
    p, d = k / n, 1 + z * z / n
    c, h = (p + z * z / (2 * n)) / d, F.lit(z) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    nan = F.lit(float("nan"))
    return F.coalesce(c - h, nan), F.coalesce(c + h, nan)


def parse_reply(reply: Column) -> Column:
    """struct(winner, reason) of a judge's reply: the JSON from the first brace to the last; anything else is a tie."""
    d = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "winner string, reason string", {"mode": "PERMISSIVE"})
    w = F.lower(F.trim(d["winner"]))
    bad = d.isNull() | (F.regexp_extract(reply, r"(?s)\{.*\}", 0) == "") | (d["winner"].isNull() & d["reason"].isNull())
    return F.struct(F.when(~bad & w.isin("1", "2"), w).otherwise("tie").alias("winner"), F.when(bad, "unparseable").otherwise(F.substring(F.coalesce(d["reason"], F.lit("")), 1, 80)).alias("reason"))


def swap_verdict(first: Column, second: Column) -> tuple[Column, Column]:
    """(verdict, consistent): the second answer was given with the sides swapped; disagreement is a tie."""
    back = F.when(second == "1", "2").when(second == "2", "1").otherwise(second)
    same = first == back
    return F.when(same, first).otherwise("tie"), same


def aggregate_ratings(records: DataFrame) -> DataFrame:
    """excerpt_id, rating, n: mean rating; a revision discards all that came before it, null ratings count for nothing. With a column features (a map or array), also the first that isn't empty, of any record."""
    r = records.filter("rating is not null and excerpt_id is not null")
    last = r.groupBy("excerpt_id").agg(F.max(F.when(F.col("revision"), F.col("ord"))).alias("_from"))
    out = r.join(last, "excerpt_id").filter("_from is null or ord >= _from").groupBy("excerpt_id").agg(F.avg("rating").alias("rating"), F.count(F.lit(1)).alias("n"))
    if "features" in records.columns:
        some = records.filter(F.size("features") > 0).groupBy("excerpt_id").agg(F.min_by("features", "ord").alias("features"))
        out = out.join(some, "excerpt_id", "left")
    return out


def average_ranks(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Adds the average rank of value within `by`. Values are counted before they are ranked, over a range partition of all of them, so that a group of any size is spread over many tasks."""
    c = ranked(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c")), by, [F.col(value)], weight="_c")
    return df.join(c.select(*by, value, (F.col("start") + (F.col("_c") + 1) / F.lit(2.0)).alias(out)), [*by, value])


def _correlated(x: DataFrame, b: str, by: list[str], **sums: Column) -> DataFrame:
    """by, n, rho, and means of `sums`: rows with the average ranks _ra of one value, against the average ranks of b.

    Rows with one b have one rank, so their number and sums are all that is ranked, and nothing is joined back.
    """
    g = x.filter(F.col(b).isNotNull()).groupBy(*by, b).agg(F.count(F.lit(1)).alias("_c"), F.sum("_ra").alias("_a"), F.sum(F.col("_ra") * F.col("_ra")).alias("_aa"), *(F.sum(c).alias(f"_s_{k}") for k, c in sums.items()))
    r = ranked(g, by, [F.col(b)], weight="_c").withColumn("_rb", F.col("start") + (F.col("_c") + 1) / F.lit(2.0))
    n = F.sum("_c")
    middle = (n + 1) / F.lit(2.0)  # the mean of average ranks
    va, vb = F.sum("_aa") / n - middle * middle, F.sum(F.col("_rb") * F.col("_rb") * F.col("_c")) / n - middle * middle
    cov = F.sum(F.col("_a") * F.col("_rb")) / n - middle * middle
    rho = F.when((va > 1e-6) & (vb > 1e-6), cov / F.sqrt(F.greatest(va * vb, F.lit(1e-300)))).otherwise(F.lit(float("nan")))
    return r.groupBy(*by).agg(n.cast("long").alias("n"), rho.alias("rho"), *((F.sum(f"_s_{k}") / n).alias(k) for k in sums))


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """by, n, rho: Pearson correlation of average ranks; NaN for constants or under two rows. Rows with a null on either side are left out."""
    whole = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return _correlated(average_ranks(whole, a, by, "_ra"), b, by)


def group_advantage(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Adds advantage: (reward - mean) / (population std + 1e-6) in groups with two scored rows or more. The statistics are aggregated before they are joined, so a hot group is no hot window."""
    g = df.filter(F.col(reward).isNotNull()).groupBy(group).agg(F.avg(reward).alias("_m"), F.stddev_pop(reward).alias("_s"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return df.join(g, group).withColumn("advantage", (F.col(reward) - F.col("_m")) / (F.col("_s") + F.lit(1e-6))).drop("_m", "_s", "_n")


def calibration(probs: DataFrame, bins: int = 4) -> DataFrame:
    """bin, predicted, empirical, n: every winner-first probability counts as p with a hit and 1 - p without; bins by quantile, the last one closed."""
    x = probs.select(F.explode(F.array(F.struct(F.col("p").alias("p"), F.lit(1.0).alias("y")), F.struct((1 - F.col("p")).alias("p"), F.lit(0.0).alias("y")))).alias("s")).select("s.*")
    e = group_quantiles(x, [], "p", [k / bins for k in range(1, bins)]).first() or ()
    x = x.withColumn("bin", sum((F.when(F.col("p") >= v, 1).otherwise(0) for v in e), F.lit(0)))
    return x.groupBy("bin").agg(F.avg("p").alias("predicted"), F.avg("y").alias("empirical"), F.count(F.lit(1)).alias("n"))


def linear_reward(feats: Column, std: list[float], weights: list[float]) -> Column:
    """w . (f / std), a std of 0 counting as 1."""
    s = F.array(*(F.lit(float(v) or 1.0) for v in std))
    w = F.array(*(F.lit(float(v)) for v in weights))
    return F.aggregate(F.zip_with(F.zip_with(feats, s, lambda a, b: a / b), w, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def k3_kl(logp: Column, ref: Column, mask: Column | None = None) -> Column:
    """Mean of exp(d) - d - 1 with d = ref - logp, over the elements, or those whose mask is true; null if there are none."""
    t = F.zip_with(logp, ref, lambda p, q: F.exp(q - p) - (q - p) - 1)
    if mask is not None:
        t = F.transform(F.filter(F.arrays_zip(t.alias("t"), mask.alias("m")), lambda x: x["m"]), lambda x: x["t"])
        return F.when(F.size(t) > 0, F.aggregate(t, F.lit(0.0), lambda a, v: a + v) / F.size(t))
    return F.aggregate(t, F.lit(0.0), lambda a, v: a + v) / F.size(t)


# ---- fits ----


def gram(df: DataFrame, cols: list[str], y: str, by: str | None = None) -> DataFrame:
    """Sums of 1, x, y, x x', x y and y y for each group: all a ridge fit needs, aggregated in the cluster."""
    names = [*cols, y]
    sums = [F.count(F.lit(1)).cast("double").alias("n")] + [F.sum(c).alias(f"s_{i}") for i, c in enumerate(names)]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return (df.groupBy(by) if by else df.groupBy()).agg(*sums)


class Ridge:
    """Ridge regression on standardised columns (population std) from the sums of gram(); JSON in and out."""

    def __init__(self, names, means, stds, coef, intercept, alpha, medians=None):
        self.names, self.means, self.stds, self.coef, self.intercept, self.alpha = names, list(means), list(stds), list(coef), float(intercept), float(alpha)
        self.medians = list(medians) if medians is not None else list(means)

    @classmethod
    def from_sums(cls, row: dict, cols: list[str], alpha: float, medians=None) -> Ridge:
        d, n = len(cols), row["n"]
        m = np.array([row[f"s_{i}"] / n for i in range(d + 1)])
        c = np.array([[row[f"p_{min(i, j)}_{max(i, j)}"] / n - m[i] * m[j] for j in range(d + 1)] for i in range(d + 1)])
        sd = np.sqrt(np.maximum(np.diag(c)[:d], 0))
        sd = np.where(sd < 1e-12, 1.0, sd)
        z = n * c[:d, :d] / np.outer(sd, sd)
        coef = np.linalg.solve(z + alpha * np.eye(d), n * c[:d, d] / sd)
        return cls(cols, m[:d], sd, coef, m[d], alpha, medians)

    def predict(self, clip: tuple[float, float] | None = (1.0, 5.0)) -> Column:
        """The prediction as a Column; nulls take the median."""
        out = F.lit(self.intercept)
        for c, m, s, w, med in zip(self.names, self.means, self.stds, self.coef, self.medians):
            out = out + (F.coalesce(F.nanvl(F.col(c), F.lit(None)), F.lit(float(med))) - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(w))
        return F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), out)) if clip else out

    def to_json(self) -> str:
        return json.dumps({"type": "ridge", "feature_names": self.names, "medians": self.medians, "means": self.means, "stds": self.stds, "coef": self.coef, "intercept": self.intercept, "alpha": self.alpha})

    @classmethod
    def from_json(cls, text: str) -> Ridge:
        d = json.loads(text)
        return cls(d["feature_names"], d["means"], d["stds"], d["coef"], d["intercept"], d["alpha"], d["medians"])


def fit_ridge(df: DataFrame, cols: list[str], y: str, alpha: float) -> Ridge:
    """Medians fill nulls, then one pass sums the Gram matrix; only (d + 2)^2 numbers reach the driver."""
    med = {c: (group_quantiles(df.filter(~F.isnan(c)), [], c, [0.5]).first() or [0.0])[0] for c in cols}
    x = df.select(y, *(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(med[c]))).alias(c) for c in cols))
    return Ridge.from_sums(gram(x, cols, y).first().asDict(), cols, alpha, [med[c] for c in cols])


def grouped_cv(df: DataFrame, cols: list[str], y: str, group: str, alphas: list[float], k: int = 5, seed: str = "0") -> DataFrame:
    """alpha, rho, mae of grouped k-fold predictions. A fold's sums are all sums less its own, so the data are read twice whatever k and the number of alphas. The best alpha is the one with the highest rho, the smaller of equals."""
    x = df.withColumn("fold", F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(k)).cast("int"))
    parts = {r["fold"]: r.asDict() for r in gram(x, cols, y, "fold").collect()}
    keys = [c for c in next(iter(parts.values())) if c != "fold"] if parts else []
    if not parts:
        return df.sparkSession.createDataFrame([], "alpha double, n long, rho double, mae double")

    def predicted(a: float) -> Column:
        p = F.lit(None).cast("double")
        for f in parts:
            row = {c: sum(parts[g][c] for g in parts if g != f) for c in keys}
            p = F.when(F.col("fold") == f, Ridge.from_sums(row, cols, a).predict()).otherwise(p)
        return p

    every = F.array(*(F.struct(F.lit(float(a)).alias("alpha"), predicted(a).alias("pred")) for a in alphas))
    one = stash(x.select(F.lit(0).alias("_g"), F.col(y).alias("y"), every.alias("p")), "predictions")
    one = average_ranks(one, "y", ["_g"], "_ra")  # the same whatever the alpha
    preds = one.select("y", "_ra", F.explode("p").alias("p")).select("y", "_ra", "p.alpha", "p.pred")
    return _correlated(preds, "pred", ["alpha"], mae=F.abs(F.col("y") - F.col("pred")))


def fit_bt(diffs: np.ndarray, l2: float = 1.0, w: np.ndarray | None = None) -> np.ndarray:
    """Bradley-Terry weights of winner-first rows by Newton steps; the penalty is l2 / n."""
    n, d = diffs.shape
    w = np.zeros(d) if w is None else w.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(diffs @ w, -500, 500)))
        g = diffs.T @ (1 - p) / n - l2 * w / n
        h = (diffs * (p * (1 - p))[:, None]).T @ diffs / n + l2 / n * np.eye(d)
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-12:
            break
    return w


def fit_bt_rows(pairs: DataFrame, l2: float = 1.0) -> np.ndarray:
    """fit_bt over all rows of pairs (diff, winner less loser): gradient and Hessian are summed in the cluster at each step."""
    x = stash(pairs.select("diff"), "diffs")
    n, d = x.count(), x.agg(F.max(F.size("diff"))).first()[0]
    if not n:
        raise ValueError("no pairs")
    w = np.zeros(d)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(d * (d + 1))
        for b in batches:
            v = np.asarray(b.column(0).flatten(), dtype=float).reshape(-1, d)
            p = 1 / (1 + np.exp(-np.clip(v @ w, -500, 500)))
            acc += np.concatenate([v.T @ (1 - p), ((v * (p * (1 - p))[:, None]).T @ v).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(acc))), pa.array(acc)], names=["i", "v"])

    for _ in range(100):
        t = np.array([r[1] for r in sorted(x.mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v")).collect())])
        step = np.linalg.solve(t[d:].reshape(d, d) / n + l2 / n * np.eye(d), t[:d] / n - l2 * w / n)
        w = w + step
        if np.abs(step).max() < 1e-12:
            break
    return w


#: Rows of difference vectors that one fold's task holds; more are drawn down to it by hash, as the fit is on a bounded sample.
FIT_ROWS = 200_000


def leave_group_out(pairs: DataFrame, l2: float = 1.0, scale: bool = False) -> DataFrame:
    """pair_id, grp, p: the held-out probability of each pair's winner. pairs: pair_id, grp, diff (winner less loser).

    Each group is a fold, fitted in its own task on the others' rows (at most FIT_ROWS, chosen by hash). With
    `scale`, features are divided by their training std, never centred.
    """
    n = pairs.count()
    rows = pairs if n <= FIT_ROWS else pairs.filter(F.pmod(F.xxhash64("pair_id"), F.lit(1_000_000)) < int(1e6 * FIT_ROWS / n))
    got = rows.select("grp", "diff").toPandas()
    data = pairs.sparkSession.sparkContext.broadcast((np.array(got["diff"].tolist(), dtype=float), got["grp"].to_numpy()))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        d, g = data.value
        train = d[g != pdf["grp"].iloc[0]]
        sd = np.where((s := train.std(0)) < 1e-12, 1.0, s) if scale and len(train) else np.ones(d.shape[1])
        w = fit_bt(train / sd, l2) if len(train) else np.zeros(d.shape[1])
        x = np.array(pdf["diff"].tolist(), dtype=float) / sd
        return pd.DataFrame({"pair_id": pdf["pair_id"], "grp": pdf["grp"], "p": 1 / (1 + np.exp(-(x @ w)))})

    s = pairs.schema
    return pairs.select("pair_id", "grp", "diff").groupBy("grp").applyInPandas(fold, f"pair_id {s['pair_id'].dataType.simpleString()}, grp {s['grp'].dataType.simpleString()}, p double")


# ---- samplers ----


def seeded_uniform(seed: int, n: int) -> np.ndarray:
    """n numbers of the 32-bit generator of the browser decoder (mulberry32 over both words of the seed)."""
    m = 0xFFFFFFFF
    a = (seed & m) ^ ((seed >> 32) & m) ^ 0x9E3779B9
    out = np.empty(n)
    for i in range(n):
        a = (a + 0x6D2B79F5) & m
        t = ((a ^ (a >> 15)) * (a | 1)) & m
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & m)) & m
        out[i] = ((t ^ (t >> 14)) & m) / 4294967296
    return out


def sample_top_k(logits: np.ndarray, u: float, temperature: float = 1.0, top_k: int | None = None, ban: tuple[int, ...] = (), eos: int | None = None, hold_eos: bool = False) -> int:
    """One draw by inverse CDF in id order; values equal to the k-th largest stay in; float32 values as in the browser."""
    v = (np.asarray(logits, dtype=np.float64) / max(temperature, 1e-6)).astype(np.float32)
    v[[b for b in ban if 0 <= b < len(v)]] = -np.inf
    if hold_eos and eos is not None and eos < len(v):
        v[eos] = -np.inf
    floor = np.sort(v)[len(v) - max(1, top_k)] if top_k is not None and top_k < len(v) else -np.inf
    keep = v >= floor
    if not np.isfinite(v[keep]).any():
        raise ValueError("no token may be drawn")
    w = np.where(keep, np.exp((v - v[keep].max()).astype(np.float64)), 0.0).astype(np.float32).astype(np.float64)
    ids = np.flatnonzero(w > 0)
    below = np.flatnonzero(u * w.sum() - np.cumsum(w[ids]) < 0)
    return int(ids[below[0]] if len(below) else ids[-1])

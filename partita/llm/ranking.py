"""Global ranking from pairwise comparisons: probit strengths by distributed iteratively reweighted least squares.

P(i beats j) = Phi(s_i - s_j), with a normal prior of precision RIDGE on each strength. The counts of each pair,
the strengths and all vectors of the solver are tables; the driver sees sums only, so there is one way for twenty
items and for millions. Each step solves the sparse normal equations by conjugate gradients. Their preconditioner
solves the equations of each BLOCK of items by itself (at most BLOCK^2 distinct pairs), so that the equations of
up to BLOCK items are solved in one iteration.

Standard errors, of strengths relative to the mean of all, come from the diagonal of the inverse, found with PROBES
right-hand sides at once: each item has one of PROBES colours and a random sign, and a right-hand side holds the
signs of one colour. With up to PROBES items every item has a colour of its own and the errors are exact; beyond
that the variances are unbiased estimates, held above their Cauchy-Schwarz bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.operators.components import salted_join
from partita.operators.positions import ranked
from partita.plans.votes import cast_votes
from partita.tables import stash, table, unstash

RIDGE = 0.01
BLOCK, PROBES = 512, 32
#: Pairs of one item that are joined under one key; an item with more is split.
SPLIT = 200_000

_erf = np.vectorize(math.erf, otypes=[float])


def _weights(mu: np.ndarray, wins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fisher weight and score of each pair at difference mu."""
    phi = np.exp(-mu * mu / 2) / math.sqrt(2 * math.pi)
    p = np.clip(0.5 * (1 + _erf(mu / math.sqrt(2))), 1e-12, 1 - 1e-12)
    return n * phi * phi / (p * (1 - p)), (wins - n * p) * phi / (p * (1 - p))


def _weighed(mu: pd.Series, wins: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Observed weight (for the steps, which it brings to the end in fewer rounds), Fisher weight (for the errors) and score."""
    m, y, k = mu.to_numpy(), wins.to_numpy(), n.to_numpy()
    fisher, g = _weights(m, y, k)
    phi, p = np.exp(-m * m / 2) / math.sqrt(2 * math.pi), np.clip(0.5 * (1 + _erf(m / math.sqrt(2))), 1e-12, 1 - 1e-12)
    won, lost = phi / p, phi / (1 - p)
    return pd.DataFrame({"w": np.maximum(y * won * (won + m) + (k - y) * lost * (lost - m), 1e-9 * k), "f": fisher, "g": g})


def _matrix(t: pa.Table | pa.RecordBatch, c: str) -> np.ndarray:
    col = t.column(c)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))


STATE = "id long, salts long, d double, x array<double>, r array<double>, z array<double>, p array<double>"


def _advance(a: np.ndarray):
    """A block's state after a step of length a along p: x, r, and z, the solution of the block's own equations for r."""

    def go(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        ids, d = rows.column("id").to_numpy(), rows.column("d").to_numpy()
        x, r, p, q = (_matrix(rows, c) for c in "xrpq")
        x, r = x + a * p, r - a * q
        order = np.argsort(ids)
        m = np.diag(d)
        if pairs.num_rows:
            i, j = (order[np.searchsorted(ids[order], pairs.column(c).to_numpy())] for c in "ij")
            m[i, j] -= pairs.column("w").to_numpy()
        z = np.linalg.solve(m, r)
        return pa.Table.from_arrays([rows.column("id"), rows.column("salts"), rows.column("d"), *map(_lists, (x, r, z, p))], names=["id", "salts", "d", "x", "r", "z", "p"])

    return go


def _products(df: DataFrame, of: list[tuple[str, str]]) -> np.ndarray:
    """The inner products of columns of vectors: a row for each of `of`; every task sums its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = 0.0
        for b in batches:
            if b.num_rows:
                m = {c: _matrix(b, c) for c in {c for two in of for c in two}}
                acc = acc + np.concatenate([(m[u] * m[v]).sum(0) for u, v in of])
        if np.ndim(acc):
            yield pa.RecordBatch.from_arrays([_lists(acc[None])], names=["v"])

    cols = sorted({c for two in of for c in two})
    got = df.select(*cols).mapInArrow(run, "v array<double>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("v")).orderBy("pos").collect()
    return np.array([r.v for r in got]).reshape(len(of), -1)


def _plus(x: str, y: str, by: np.ndarray) -> Column:
    """Vector x + by * y, element by element."""
    return F.zip_with(F.arrays_zip(F.col(x).alias("x"), F.array(*(F.lit(float(v)) for v in by)).alias("b")), F.col(y), lambda u, v: u["x"] + u["b"] * v)


def _solve(w: DataFrame, base: DataFrame, width: int, block: int, tol: float, most: int) -> DataFrame:
    """(id, x): the solutions of (D - W) x = r for `width` right-hand sides by preconditioned conjugate gradients.

    base: id, salts, d (the diagonal), r; w: i, j, salt (of j), w. Raises if a residual is still above tol times
    its right-hand side after `most` iterations.
    """
    zero = F.array_repeat(F.lit(0.0), width)
    state = base.select("id", "salts", "d", "r", *(zero.alias(c) for c in "xpq"))
    blk = lambda c: F.floor(F.col(c) / block)
    inner = w.filter(blk("i") == blk("j")).select(blk("i").alias("blk"), "i", "j", "w")
    a, rz, first, old = np.zeros(width), None, None, []
    for _ in range(most):
        t = state.withColumn("blk", blk("id")).groupBy("blk").cogroup(inner.groupBy("blk")).applyInArrow(_advance(a), STATE)
        t = stash(t, "state")
        b = np.zeros(width)
        if rz is not None:
            new = _products(t, [("r", "z")])[0]
            b = np.where(rz > 0, new / np.where(rz > 0, rz, 1), 0)
        step = t.withColumn("p", _plus("z", "p", b))
        to = step.select(F.col("id").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "p")
        sums = w.join(to, ["j", "salt"]).groupBy(F.col("i").alias("id")).agg(F.array(*(F.sum(F.col("w") * F.col("p")[k]) for k in range(width))).alias("c"))
        q = step.join(sums, "id", "left").withColumn("q", F.zip_with("p", F.coalesce("c", zero), lambda u, c: F.col("d") * u - c)).drop("c")
        q = stash(q, "step")
        pq, rz, rr, rq, qq = _products(q, [("p", "q"), ("r", "z"), ("r", "r"), ("r", "q"), ("q", "q")])
        a = np.where(pq > 0, rz / np.where(pq > 0, pq, 1), 0)
        first = rr if first is None else first
        left = np.sqrt(np.maximum(rr - 2 * a * rq + a * a * qq, 0))
        for df in old:
            unstash(df)
        old, state = [t, q], q
        if (left <= tol * np.sqrt(first)).all():
            return q.select("id", "d", _plus("x", "p", a).alias("x"))
    raise RuntimeError(f"conjugate gradients did not converge in {most} iterations: {float((left / np.maximum(np.sqrt(first), 1e-300)).max()):.2g} of the right-hand side is left")


def strengths(comparisons: DataFrame, ridge: float = RIDGE, rounds: int = 50, block: int = BLOCK, probes: int = PROBES, most: int = 2000) -> DataFrame:
    """item, strength, std_error, wins, losses, rank (1 is best; ties by item), for all items of comparisons (winner, loser).

    Rows with a null side or the same item on both sides are left out. With no rows the result is empty. Items
    that never meet are compared through others; in parts that never meet each other strengths are relative to
    the prior's mean 0. Raises if the steps have not become smaller than 1e-8 after `rounds`, or a solve has not
    converged after `most` iterations. Strengths are rounded to nine decimals, beyond which the solver's noise
    would order equal items. With more than `probes` items the standard errors are estimates.
    """
    a, b = F.least("winner", "loser"), F.greatest("winner", "loser")
    pairs = comparisons.filter("winner <> loser").groupBy(a.alias("a"), b.alias("b")).agg(F.sum((F.col("winner") == a).cast("double")).alias("wins"), F.count(F.lit(1)).cast("double").alias("n"))
    pairs = stash(pairs, "pairs")
    total = pairs.count()
    each = pairs.select(F.col("a").alias("item"), "wins", (F.col("n") - F.col("wins")).alias("losses")).unionAll(pairs.select("b", F.col("n") - F.col("wins"), "wins"))
    each = each.groupBy("item").agg(F.count(F.lit(1)).alias("deg"), F.sum("wins").cast("long").alias("wins"), F.sum("losses").cast("long").alias("losses"))
    items = ranked(each.withColumn("_g", F.lit(0)), ["_g"], [F.col("item")]).select("item", (F.col("pos") - 1).alias("id"), "deg", "wins", "losses", (1 + F.floor(F.col("deg") / SPLIT)).alias("salts"))
    items = stash(items, "items")
    n_items = items.count()
    none = items.select("item", F.lit(0.0).alias("strength"), F.lit(0.0).alias("std_error"), "wins", "losses", "id")
    if not n_items:
        return none.withColumnRenamed("id", "rank")
    end = lambda x, k: items.select(F.col("item").alias(x), F.col("id").alias(k), F.col("salts").alias(f"{k}salts"), "deg")
    x = salted_join(salted_join(pairs, end("a", "i"), "a", "b", total), end("b", "j"), "b", "a", total)
    salt = lambda of, n: F.pmod(F.hash(of), F.col(n)).cast("long")
    x = x.select("i", "j", "wins", "n", salt("j", "isalts").alias("isalt"), salt("i", "jsalts").alias("salt"))
    both = stash(x.unionAll(x.select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("n") - F.col("wins")).alias("wins"), "n", F.col("salt").alias("isalt"), F.col("isalt").alias("salt"))), "coded")
    weigh = F.pandas_udf(_weighed, "w double, f double, g double")

    def system(s: DataFrame, weight: str = "w") -> DataFrame:
        """i, j, salt, w, g of every pair, in both directions, at the strengths s."""
        at = s.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("k"), "s")
        y = both.join(at.toDF("i", "isalt", "si"), ["i", "isalt"]).join(at.toDF("j", "salt", "sj"), ["j", "salt"])
        y = y.withColumn("v", weigh(F.col("si") - F.col("sj"), F.col("wins"), F.col("n")))
        return stash(y.select("i", "j", "salt", F.col(f"v.{weight}").alias("w"), "v.g"), "system")

    diagonal = lambda w: w.groupBy(F.col("i").alias("id")).agg((F.sum("w") + ridge).alias("d"), F.sum("g").alias("g"))
    s = stash(items.select("id", "salts", F.lit(0.0).alias("s")), "strengths")
    for _ in range(rounds):
        w = system(s)
        base = s.join(diagonal(w), "id").select("id", "salts", "d", F.array(F.col("g") - ridge * F.col("s")).alias("r"))
        move = _solve(w, base, 1, block, 1e-7, most).select("id", F.col("x")[0].alias("move"))
        far = move.agg(F.max(F.abs("move"))).first()[0]
        nxt = stash(s.join(move, "id").select("id", "salts", (F.col("s") + F.col("move") * min(1.0, 2.0 / max(far, 1e-300))).alias("s")), "strengths")
        for df in (s, w):
            unstash(df)
        s = nxt
        if far < 1e-8:
            break
    else:
        raise RuntimeError(f"strengths did not settle in {rounds} rounds; the last step was {far:.2g}")

    w = system(s, "f")
    colour = s.withColumn("colour", F.pmod("id", F.lit(probes))).withColumn("sign", F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    mean = {r.colour: r.m / n_items for r in colour.groupBy("colour").agg(F.sum("sign").alias("m")).collect()}
    used = sorted(mean)
    # A 1 = ridge 1 for the normal matrix A, so centred right-hand sides give the errors relative to the mean
    rhs = F.array(*(F.when(F.col("colour") == k, F.col("sign")).otherwise(0.0) - F.lit(float(mean[k])) for k in used))
    base = colour.join(diagonal(w), "id").select("id", "salts", "d", rhs.alias("r"))
    inverse = _solve(w, base, len(used), block, 1e-6, most)
    # what an item's own pairs of its colour add to its estimate is known to first order, and taken off
    at = base.join(colour.select("id", "colour", "sign"), "id").select(F.col("id").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "colour", (F.col("sign") / F.col("d")).alias("v"))
    near = w.join(at, ["j", "salt"]).groupBy(F.col("i").alias("id"), "colour").agg(F.sum(F.col("w") * F.col("v")).alias("near"))
    least = F.lit((1 - 1 / n_items) ** 2) / (F.col("d") - ridge / n_items)
    variance = F.col("sign") * (F.element_at("x", (F.col("colour") + 1).cast("int")) - F.coalesce("near", F.lit(0.0)) / F.col("d"))
    fit = colour.join(inverse, "id").join(near, ["id", "colour"], "left").select("id", F.round("s", 9).alias("strength"), F.sqrt(F.greatest(variance, least)).alias("std_error"))
    out = ranked(items.join(fit, "id").withColumn("_g", F.lit(0)), ["_g"], [F.col("strength").desc(), F.col("item")])
    return out.select("item", "strength", "std_error", "wins", "losses", F.col("pos").alias("rank"))


def decided(labels: DataFrame) -> DataFrame:
    """winner, loser of each vote as cast, with two different models and a winner: the side in choice or, where choice is null, the one that preferred names."""
    v = cast_votes(labels).filter("left_model <> right_model")
    left = F.when(F.col("choice").isNotNull(), F.col("choice") == "left").otherwise(F.coalesce((F.col("preferred") == F.col("left_is")) & ~F.coalesce(F.col("preferred") == F.col("right_is"), F.lit(False)), F.lit(False)))
    right = F.when(F.col("choice").isNotNull(), F.col("choice") == "right").otherwise(F.coalesce((F.col("preferred") == F.col("right_is")) & ~F.coalesce(F.col("preferred") == F.col("left_is"), F.lit(False)), F.lit(False)))
    return v.filter(left | right).select(F.when(left, F.col("left_model")).otherwise(F.col("right_model")).alias("winner"), F.when(left, F.col("right_model")).otherwise(F.col("left_model")).alias("loser"))


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    return strengths(decided(table(spark, d, "labels")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose better-ranked model has lost more of their direct votes than it has won."""
    votes = stash(decided(table(spark, d, "labels")), "decided")
    rank = strengths(votes).select("item", "rank")
    a, b = F.least("winner", "loser"), F.greatest("winner", "loser")
    met = votes.groupBy(a.alias("model_1"), b.alias("model_2")).agg(F.sum(F.when(F.col("winner") == a, 1).otherwise(-1)).alias("lead"))
    met = met.join(rank.toDF("model_1", "r1"), "model_1").join(rank.toDF("model_2", "r2"), "model_2")
    return met.filter("(r1 < r2 and lead < 0) or (r2 < r1 and lead > 0)").select("model_1", "model_2")

"""Exact positions and running sums over a global order, however uneven the keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.tables import stash


def ranked(df: DataFrame, keys: list[str], order: list[Column], weight: str | None = None) -> DataFrame:
    """Adds `pos` (1, 2, ... within the keys, by `order`) and, with a weight, `start` (the weights before the row).

    Rows are range-partitioned by keys and order, so that a key with a third of all rows is spread over many
    tasks; the sorted rows are written once, then each partition's rows are counted and the counts of earlier
    partitions added. Only one row for each (key, partition) is ever windowed. Keys must not be null.
    Empty input gives empty output.
    """
    cols = [F.col(k) for k in keys]
    s = df.repartitionByRange(*cols, *order).sortWithinPartitions(*cols, *order)
    s = stash(s.withColumn("_m", F.monotonically_increasing_id()), "ranked").withColumn("_pid", F.shiftright("_m", 33))
    sums = [F.sum(weight).alias("_sum")] if weight else []
    parts = s.groupBy(*keys, "_pid").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"), *sums)
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if weight:
        parts = parts.withColumn("_woff", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    out = s.join(parts.drop("_n", "_sum"), [*keys, "_pid"])
    out = out.withColumn("pos", F.col("_off") + F.col("_m") - F.col("_first") + 1)
    if weight:
        here = Window.partitionBy(*keys, "_pid").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("start", F.col("_woff") + F.coalesce(F.sum(weight).over(here), F.lit(0)))
    return out.drop("_m", "_pid", "_first", "_off", "_woff")


def group_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """by, q0, q1, ...: exact linearly interpolated quantiles of each group; null values are left out, NaN is the greatest.

    Values are counted, ranked over a range partition, and only the rows at the wanted positions are kept, so
    neither a group nor its distinct values have to fit into one task.
    """
    v = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    keys = by or ["_all"]
    if not by:
        v = v.withColumn("_all", F.lit(0))
    r = ranked(v, keys, [F.col(value)], weight="_c")
    n = r.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    r = r.join(n, keys)
    sums = []
    for i, q in enumerate(qs):
        at = F.lit(float(q)) * (F.col("_n") - 1)
        lo, hi = F.floor(at), F.ceil(at)
        has = lambda p: (F.col("start") <= p) & (p < F.col("start") + F.col("_c"))  # noqa: B023, E731
        sums += [F.max(F.when(has(lo), F.col(value).cast("double"))).alias(f"_lo{i}"), F.max(F.when(has(hi), F.col(value).cast("double"))).alias(f"_hi{i}"), F.max(at - lo).alias(f"_f{i}")]
    g = r.groupBy(*keys).agg(*sums)
    part = lambda i: F.when(F.col(f"_f{i}") == 0, F.col(f"_lo{i}")).otherwise((1 - F.col(f"_f{i}")) * F.col(f"_lo{i}") + F.col(f"_f{i}") * F.col(f"_hi{i}"))
    return g.select(*by, *(part(i).alias(f"q{i}") for i in range(len(qs))))


def at_share(df: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """by, value: the value at index int(share x n), from 0, of each group's values in ascending order."""
    v = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    r = ranked(v, by, [F.col(value)], weight="_c")
    r = r.join(r.groupBy(*by).agg(F.sum("_c").alias("_n")), by)
    at = F.floor(F.col("_n") * F.lit(share))
    return r.filter((F.col("start") <= at) & (at < F.col("start") + F.col("_c"))).select(*by, value)

"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.tables import stash, unstash

#: A key with more than 1/HEAVY of all rows is salted, so there are fewer than HEAVY such keys. It is split SALTS ways, or as many as leave SALT_ROWS rows each.
HEAVY, SALTS, SALT_ROWS = 256, 32, 1_000_000


def salted_join(big: DataFrame, small: DataFrame, key: str, other: str, total: int) -> DataFrame:
    """big joined with small on key. small has one row for each key and `deg`, the key's rows in big.

    Keys with over 1/HEAVY of the rows (fewer than HEAVY of them, so their list is broadcast) are split by the
    hash of `other`, the more ways the more rows they have.
    """
    hot = F.col("deg") > max(total // HEAVY, 10_000)
    ways = F.greatest(F.lit(SALTS), F.ceil(F.col("deg") / SALT_ROWS)).cast("int")
    heavy = small.filter(hot).select(key, ways.alias("_ways"))
    b = big.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.when(F.col("_ways").isNotNull(), F.pmod(F.hash(other), F.col("_ways"))).otherwise(0))
    s = small.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), ways - 1)).otherwise(F.array(F.lit(0))))).drop("deg")
    return b.join(s, [key, "_salt"]).drop("_salt", "_ways")


def _star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg"))
    low = low.withColumn("m", F.least("m", "u"))
    if large:
        near = near.filter("v > u")
    out = salted_join(near, low, "u", "v", 2 * total)
    if large:
        out = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of each node with an edge to another; component is the smallest node.

    edges: columns a, b of one orderable type; loops, nulls and repeated edges are allowed. Each half-round is
    written to the shared folder, so no lineage grows and nothing is sent to the driver but two sums.
    """
    e = stash(edges.select("a", "b").dropna().filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def seen(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    last = seen(e)
    for _ in range(max_rounds):
        if last[0] == 0:
            break
        big = stash(_star(e, last[0], large=True), "large")
        n = big.count()
        nxt = stash(_star(big, n, large=False), "small")
        unstash(e)
        unstash(big)
        e, now = nxt, seen(nxt)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

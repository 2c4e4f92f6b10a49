"""Filling fixed-capacity containers with items: cost-balanced packing.

An item of l tokens costs l + l^2 / capacity (linear layers plus attention). Items go in descending order to the
lowest-cost container that still has room; a new container is opened only if none has. An item longer than the
capacity is cut into full pieces, each a container of its own, and a rest that is packed like any other item.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.llm.bpe import sized
from partita.tables import stash, table

CAPACITY = 4096
#: Items that one task packs. Items are dealt to tasks by hash; what a task leaves in badly filled containers is packed once more.
TASK_ITEMS = 50_000
#: A container below this share of the capacity counts as badly filled.
WELL = 0.95


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The container (0, 1, ...) of each item; sizes in descending order, none above the capacity.

    Containers are kept by the room they have left; a segment tree over the rooms finds the cheapest with enough.
    """
    width = 1 << int(capacity).bit_length()
    best = [np.inf] * (2 * width)
    rooms: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]

    def fix(room: int) -> None:
        i = room + width
        best[i] = rooms[room][0][0] if rooms[room] else np.inf
        i >>= 1
        while i:
            best[i] = min(best[2 * i], best[2 * i + 1])
            i >>= 1

    def cheapest(least: int) -> int:
        """The room, at least `least`, of the cheapest container, or -1."""
        lo, hi, at = least + width, 2 * width, []
        while lo < hi:
            if lo & 1:
                at.append(lo)
                lo += 1
            if hi & 1:
                hi -= 1
                at.append(hi)
            lo >>= 1
            hi >>= 1
        i = min(at, key=best.__getitem__)
        if best[i] == np.inf:
            return -1
        while i < width:
            i = 2 * i if best[2 * i] <= best[2 * i + 1] else 2 * i + 1
        return i - width

    n = max(1, -(-int(sizes.sum()) // capacity)) if len(sizes) else 0
    rooms[capacity] = [(0.0, k) for k in range(n)]
    fix(capacity)
    out = np.empty(len(sizes), dtype=np.int64)
    for k, s in enumerate(sizes.tolist()):
        room = cheapest(s)
        if room < 0:
            room, cost, box, n = capacity, 0.0, n, n + 1
        else:
            cost, box = heapq.heappop(rooms[room])
            fix(room)
        out[k] = box
        heapq.heappush(rooms[room - s], (cost + s + s * s / capacity, box))
        fix(room - s)
    return out


def _pack_group(capacity: int):
    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "item", "part"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        box = pack(pdf["tokens"].to_numpy(np.int64), capacity)
        pdf["container"] = pdf["task"].astype(str) + "-" + pd.Series(box).astype(str)
        pdf["fill"] = np.bincount(box, pdf["tokens"].to_numpy())[box].astype(np.int64)
        return pdf[["item", "part", "first", "tokens", "container", "fill"]]

    return go


def containers(items: DataFrame, capacity: int = CAPACITY, task_items: int = TASK_ITEMS) -> DataFrame:
    """item, part, first, tokens, container, fill: every part of every item once.

    items: item, tokens (0 or more; null counts as 0). Repeated items are packed as often as they come. `first` is
    the part's first token in its item. Items of size 0 take no room but are put into a container. An empty table
    gives an empty result.
    """
    kind = items.schema["item"].dataType.simpleString()
    schema = f"item {kind}, part long, first long, tokens long, container string, fill long"
    items = stash(items.select("item", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")), "sized")
    parts = items.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("tokens") / capacity) - 1))))
    parts = parts.withColumn("first", F.col("part") * capacity).withColumn("tokens", F.least(F.lit(capacity), F.col("tokens") - F.col("first")))
    full = parts.filter(F.col("tokens") == capacity).select("item", "part", "first", "tokens", F.concat(F.lit("full-"), F.col("item").cast("string"), F.lit("-"), F.col("part"), F.lit("-"), F.monotonically_increasing_id()).alias("container"), F.col("tokens").alias("fill"))
    rest = parts.filter(F.col("tokens") < capacity)

    def run(df: DataFrame, name: str) -> DataFrame:
        n = -(-df.count() // task_items)
        dealt = df.select("item", "part", "first", "tokens", F.concat(F.lit(name), F.pmod(F.xxhash64("item", "part"), F.lit(max(n, 1)))).alias("task"))
        return stash(dealt.groupBy("task").applyInPandas(_pack_group(capacity), schema), "packed")

    once = run(rest, "a")
    bad = once.filter(F.col("fill") < WELL * capacity)
    again = run(bad.drop("container", "fill"), "b")
    return full.unionByName(once.filter(F.col("fill") >= WELL * capacity)).unionByName(again)


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return containers(sized(table(spark, d, "documents").filter("doc_id is not null")).withColumnRenamed("doc_id", "item"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnRenamed("item", "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that lie in several containers, which only those that don't fit into one do."""
    return _packed(spark, d).groupBy(F.col("item").alias("doc_id")).agg(F.min("container").alias("a"), F.max("container").alias("b")).filter("a <> b").select("doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, the least number that could hold the tokens, and the share of room used."""
    c = _packed(spark, d).groupBy("container").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("t") / CAPACITY).alias("least"), (F.sum("t") / F.count(F.lit(1)) / CAPACITY).alias("used"), F.max("t").alias("fullest"), F.sum("n").alias("parts"))

"""Splits that keep related records together: connected components over shared entities, hashed into ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.operators.components import connected_components, salted_join
from partita.operators.corpus import sha1_mod
from partita.tables import stash, table

SPLITS = (("train", 0.9), ("validation", 0.05), ("test", 0.05))


def piece(path):
    """The folder after /raw/ and the file name up to its first character that is neither letter nor digit, in lower case; null for other paths."""
    p = F.lower(path)
    folder, name = F.regexp_extract(p, r"/raw/([^/]+)/", 1), F.regexp_extract(p, r"([^/]*)$", 1)
    return F.when(folder != "", F.concat_ws("/", folder, F.regexp_extract(name, r"^([\p{L}\p{N}]*)", 1)))


def memberships(meta: DataFrame) -> DataFrame:
    """record (pair_id), path, entity (the path's piece), for all paths of a pair's rows. A path outside /raw/ is an entity of its own, whatever its case. Null and empty pairs, and null paths, are left out."""
    rows = meta.filter("pair_id <> ''").select(F.col("pair_id").alias("record"), F.explode(F.array("prompt_path", "part_path")).alias("path")).filter("path is not null")
    return rows.distinct().withColumn("entity", F.coalesce(piece(F.col("path")), F.concat(F.lit("="), F.lower("path"))))


def groups(links: DataFrame) -> DataFrame:
    """(record, component) of every record of links (record, entity); component is the smallest record reached through shared entities. Null entities link nothing.

    Each entity is first replaced by its smallest record (the first small-star step), so that only records are nodes.
    """
    links = stash(links.select("record", "entity").filter("record is not null").distinct(), "links")
    total = links.count()
    used = links.filter("entity is not null")
    low = used.groupBy("entity").agg(F.min("record").alias("low"), F.count(F.lit(1)).alias("deg"))
    edges = salted_join(used, low, "entity", "record", total).select(F.col("record").alias("a"), F.col("low").alias("b"))
    found = connected_components(edges).select(F.col("node").alias("record"), "component")
    return links.select("record").distinct().join(found, "record", "left").withColumn("component", F.coalesce("component", "record"))


def assign(component, splits=SPLITS, seed: int = 7):
    """The split of a component: its hash, uniform in [0, 1), falls into one of the ranges of the given proportions."""
    u = sha1_mod(F.concat_ws(":", component, F.lit(str(seed)))) / F.lit(1e6)
    total, at, out = sum(p for _, p in splits), 0.0, F.lit(splits[-1][0])
    cuts = []
    for name, p in splits:
        at += p / total
        cuts.append((name, at))
    for name, at in reversed(cuts[:-1]):
        out = F.when(u < at, name).otherwise(out)
    return out


def _voted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").filter("pair_id <> ''").select(F.col("pair_id").alias("record")).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups are formed over all pairs of pair_meta with a path, then restricted to voted pairs."""
    g = stash(groups(memberships(table(spark, d, "pair_meta"))).join(_voted(spark, d), "record", "left_semi"), "groups")
    of = g.groupBy("component").agg(F.min("record").alias("first_pair_id"), F.count(F.lit(1)).alias("deg"))
    several = of.filter("deg > 1")
    return salted_join(g, several, "component", "record", g.count()).select(F.col("record").alias("pair_id"), "first_pair_id")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """kind (pair or file), id, component, split. Voted pairs without any path are components of their own; a file goes with its pairs."""
    m = stash(memberships(table(spark, d, "pair_meta")), "memberships")
    g = groups(m)
    pairs = _voted(spark, d).join(g, "record", "left").withColumn("component", F.coalesce("component", "record"))
    files = m.join(g, "record").groupBy("path").agg(F.min("component").alias("component"))
    both = pairs.select(F.lit("pair").alias("kind"), F.col("record").alias("id"), "component").unionByName(files.select(F.lit("file").alias("kind"), F.col("path").alias("id"), "component"))
    return both.withColumn("split", assign(F.col("component")))

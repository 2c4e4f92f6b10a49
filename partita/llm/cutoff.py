"""Cutoff keeping a target fraction: an exact position of every file in its source's order by score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.operators.positions import ranked
from partita.tables import bounded, clean_source, stash, table

#: Rows of targets up to which they are broadcast; beyond that the joins shuffle.
SMALL = 100_000


def scored_files(scores: DataFrame) -> DataFrame:
    """path, source, quality, q_bucket; each path once. Null and NaN are no score; of several scores of a path the highest counts, with its bucket. Rows without path or source are left out."""
    rows = scores.filter(F.col("path").isNotNull() & F.col("quality").isNotNull() & ~F.isnan("quality"))
    rows = rows.select("path", clean_source(F.col("source"), F.col("path")).alias("source"), "quality", "q_bucket")
    rows = rows.groupBy("path").agg(F.min("source").alias("source"), F.max(F.struct("quality", "q_bucket")).alias("m"))
    return rows.select("path", "source", "m.quality", "m.q_bucket").filter("source is not null")


def cutoffs(files: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, kept).

    Files are sorted within each source by score, highest first, and path; the score at position
    ceil(keep_fraction x n), at least 1, is the cutoff, and files with that score or more are kept, ties
    included. report: source, keep_fraction, n, cutoff, kept, for each source of targets that has a scored file.
    kept: the kept files. Of repeated targets of a source the largest fraction holds; null and NaN fractions are
    left out, others are taken into 0..1.
    """
    t = targets.filter(F.col("keep_fraction").isNotNull() & ~F.isnan("keep_fraction")).select(clean_source(F.col("source"), F.lit("")).alias("source"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "keep_fraction")).alias("keep_fraction"))
    t = t.filter("source is not null").groupBy("source").agg(F.max("keep_fraction").alias("keep_fraction"))
    files = stash(ranked(files.join(bounded(t.select("source"), SMALL), "source", "left_semi"), ["source"], [F.col("quality").desc(), F.col("path")]), "scored")
    n = files.groupBy("source").agg(F.max("pos").alias("n")).join(t, "source")
    n = n.withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("keep_fraction") * F.col("n"))).cast("long"))
    n = bounded(n, SMALL)
    cut = files.join(n, "source").filter("pos = k").select("source", "keep_fraction", "n", F.col("quality").alias("cutoff"))
    cut = stash(cut, "cutoffs")
    kept = files.join(bounded(cut.select("source", "cutoff"), SMALL), "source").filter("quality >= cutoff").drop("pos")
    report = cut.join(kept.groupBy("source").agg(F.count(F.lit(1)).alias("kept")), "source")
    return report, kept


def _cut(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return cutoffs(scored_files(table(spark, d, "quality_scores")), table(spark, d, "keep_targets"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d)[1].select("path")


def p2_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d)[0]


def p2_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Kept files of each source and q_bucket as logged; files without a bucket under null."""
    return _cut(spark, d)[1].groupBy("source", "q_bucket").agg(F.count(F.lit(1)).alias("kept"))

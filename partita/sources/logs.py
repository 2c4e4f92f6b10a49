"""Readers of logs and tables of the corpus tools, each as lenient or strict as its log asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "path string, n_notes bigint, n_tracks int, duration_seconds double, content_hash string"
VOTES = """ts string, session_id string, pair_id string, idx int, choice string, left_is string, right_is string, preferred string, left_model string, right_model string, set_id string, flags map<string,array<string>>,
judge_model string, judge_prompt string, swap_consistent boolean, a_shown_first boolean, reason string"""
RATINGS = "ts string, session_id string, rater string, excerpt_id string, path string, source string, rating int, flags array<string>, is_repeat boolean, revision boolean, features map<string,double>"
PAIR_META = "pair_id string, mode string, prompt_file string, prompt_ids array<int>, cont_a_ids array<int>, cont_b_ids array<int>, model_a string, model_b string, tempo_bpm double, temperature double, gap_beats array<double>, n_notes_a int, n_notes_b int"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; a missing file is empty and lines that are no JSON object are skipped."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad is null").drop("_bad")


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; a malformed line fails the query. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def pair_files(spark: SparkSession, folder: str, schema: str = PAIR_META) -> DataFrame:
    """One JSON object a file, with its file name; unreadable files are skipped."""
    if not _exists(spark, f"{folder}/*.json"):
        return spark.createDataFrame([], schema + ", file string")
    rows = spark.read.schema(schema + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(f"{folder}/*.json")
    return rows.withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)\.json$", 1)).filter("_bad is null").drop("_bad")


def preferences(spark: SparkSession, path: str) -> DataFrame:
    """The historical preference file; votes group by pair_id, the file preferred being the vote."""
    s = "response_id string, pair_id string, preferred string, file_preferred string, file_rejected string, model string, source_csv string"
    return spark.read.schema(s).option("header", True).csv(path)


def two_headers(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with two header rows; columns are named upper_lower. The header is read from the first two lines, the rest in parallel."""
    head = [r.value for r in spark.read.text(path).limit(2).collect()]
    if len(head) < 2:
        raise ValueError(f"{path} has no two header rows")
    import csv

    top, sub = (next(csv.reader([h])) for h in head)
    names, last = [], ""
    for a, b in zip(top, sub):
        last = a or last
        names.append("_".join(x.strip().lower().replace(" ", "_") for x in (last, b) if x.strip()) or "id")
    lines = spark.read.text(path).filter(~F.col("value").isin(*head))
    return lines.select(F.from_csv("value", ", ".join(f"`{n}` string" for n in names)).alias("r")).select("r.*")


def genre_filter(df: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Rows whose genre holds any of the wanted words, without regard to case; null genres are left out."""
    g = F.lower(F.col(column))
    return df.filter(g.isNotNull() & F.exists(F.array(*map(F.lit, [w.lower() for w in wanted])), lambda w: F.contains(g, w)))


def held_out(df: DataFrame) -> DataFrame:
    """Rows with a verdict under either of its names, without degenerate and empty ones."""
    return df.withColumn("verdict", F.coalesce(*(F.col(c) for c in ("filter_verdict", "verdict") if c in df.columns))).filter(~F.coalesce(F.col("verdict").isin("degenerate", "empty"), F.lit(False)))


def append_events(df: DataFrame, path: str) -> None:
    """Adds rows to a log folder; every task writes a file of its own."""
    df.write.mode("append").json(path)

"""Sinks: manifests, split manifests, metric series, request logs and pools."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from partita.tables import clean_source

log = logging.getLogger(__name__)


def write_manifest(df: DataFrame, path: str) -> None:
    """Lines of JSON, one file a task; nulls are left out as the readers expect."""
    df.write.mode("overwrite").json(path)


def write_by_source(df: DataFrame, path: str) -> None:
    """One folder a source (the first known folder of the path, else its own). Rows are dealt by source and hash, so a source with most rows is written by many tasks."""
    x = df.withColumn("source", F.coalesce(clean_source(F.lit(None).cast("string"), F.col("path")), F.lit("unknown")))
    x.repartition("source", F.pmod(F.xxhash64("path"), F.lit(16))).write.mode("overwrite").partitionBy("source").json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Rows of a training series; blanks stay blank."""
    df.write.mode("append").option("header", True).option("nullValue", "").csv(path)


def write_scores(df: DataFrame, path: str) -> None:
    """Scores to four digits, halves away from zero."""
    df.withColumn("quality", F.round("quality", 4)).write.mode("overwrite").json(path)


def write_pool(picks: DataFrame, path: str) -> None:
    """The picks and, beside them, how many each source supplied of how many it had. picks: source, path, picked."""
    picks.filter("picked").select("source", "path").write.mode("overwrite").json(f"{path}/picks")
    picks.groupBy("source").agg(F.count_if("picked").alias("picked"), F.count(F.lit(1)).alias("available")).coalesce(1).write.mode("overwrite").json(f"{path}/pool")


def request_log(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of requests as JSON in folders by day. A batch that can't be written is reported and passed over, so that logging never stops the caller."""
    def write(batch: DataFrame, number: int) -> None:
        try:
            batch.withColumn("date", F.date_format("time", "yyyy-MM-dd")).write.mode("append").partitionBy("date").json(path)
        except Exception as e:
            log.warning("batch %d not logged: %s", number, e)

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

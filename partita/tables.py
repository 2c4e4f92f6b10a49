"""Tables, written intermediate results and the column rules shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session without that setting gets a folder of this machine."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="partita-")
        _ROOTS[app] = f"{base.rstrip('/')}/partita-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit
        pass


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:10]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._partita_path = path
    return out


def unstash(df: DataFrame) -> None:
    """Deletes a table made by stash() that no later result reads."""
    if path := getattr(df, "_partita_path", None):
        _remove(df.sparkSession, path)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most `rows` rows; beyond that it is left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def clean_source(source: Column, path: Column) -> Column:
    """Source without regard to case and surrounding blanks; where null or blank, the folder after /raw/ in path."""
    named = F.regexp_replace(F.lower(source), r"^\s+|\s+$", "")
    folder = F.regexp_extract(F.lower(path), r"/raw/([^/]+)/", 1)
    return F.coalesce(F.when(named != "", named), F.when(folder != "", folder))


def clean_source_sql(source: str = "source", path: str = "path") -> str:
    """The same rule for DuckDB."""
    return f"coalesce(nullif(regexp_replace(lower({source}), '^\\s+|\\s+$', '', 'g'), ''), nullif(regexp_extract(lower({path}), '/raw/([^/]+)/', 1), ''))"


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """df with one-row aggregates of itself as constant columns; no join. df is written first, so it is worked out once."""
    df = stash(df, "totals")
    sums = df.agg(*(c.alias(k) for k, c in totals.items()))
    row, kinds = sums.first(), dict(sums.dtypes)
    return df.withColumns({k: F.lit(row[k]).cast(kinds[k]) for k in totals})

"""Queries on a file that is far longer than those of the test tables."""

import pytest
from pyspark.sql import functions as F

from partita.plans import registry
from tests.oracle import compare


@pytest.fixture(scope="module")
def long_file(spark, sf, tmp_path_factory):
    """The events of the smallest tables four times over, a third of them of one user."""
    d = tmp_path_factory.mktemp("long")
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("event_id", F.col("event_id") + F.col("k") * 1_000_000).drop("k")
    e.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id")).cast("long")).write.parquet(f"{d}/events.parquet")
    most = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").count().agg(F.max("count")).first()[0]
    assert most > 1002
    return str(d)


def same_as_sql(spark, d, name):
    assert compare(spark, d, registry.QUERIES[name], registry.ORACLE[name]) > 0


def test_layouts_hold_every_token(spark, long_file):
    same_as_sql(spark, long_file, "doc_layouts")
    n = {r.file_id: r.body for r in registry.QUERIES["split_header"](spark, long_file).collect()}
    got = registry.QUERIES["doc_layouts"](spark, long_file).collect()
    assert len(got) == len(n)
    for r in got:
        assert [len(x.split()) - n[r.file_id] for x in (r.continuation, r.accompaniment, r.infill)] == [4, 6, 6]


def test_every_note_is_rendered(spark, long_file):
    same_as_sql(spark, long_file, "pitch_render")
    from partita.plans.notes import _n

    notes = _n(spark, long_file)
    got = registry.QUERIES["pitch_render"](spark, long_file)
    lines = got.filter("line <> '(missing)'").select(F.explode(F.split("line", " ")).alias("t"))
    assert lines.count() == notes.count()
    assert lines.filter(r"t rlike '^[0-9.]+:(Kick|Rim|Snare|Clap|Tom|Hat|Crash|Ride|Bell|Splash|Perc)'").count() == notes.filter("is_drum").count() > 0
    assert got.agg(F.max("bar")).first()[0] > 3


def test_prompt_cuts_of_a_long_stream(spark, long_file):
    same_as_sql(spark, long_file, "prompt_cuts")

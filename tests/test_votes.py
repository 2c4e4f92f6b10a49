import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from partita.operators import changefeed
from partita.plans import votes
from partita.tables import table
from tests.brute_votes import standing


def brute(spark, d):
    rows = lambda t: [r.asDict(True) for r in table(spark, d, t).collect()]
    return standing(rows("labels"), rows("corrections"))


@pytest.mark.parametrize("chunk", [20_000, 3])
def test_state_equals_brute_force(spark, sf, chunk, monkeypatch):
    monkeypatch.setattr(changefeed, "CHUNK", chunk)
    every, found = brute(spark, sf)
    assert {r.pair_id: (r.choice, r.standing) for r in votes.p3_state(spark, sf).collect()} == every
    assert {r.pair_id: r.choice for r in votes.p3_found(spark, sf).collect()} == found


def test_hot_group_in_cuts_equals_one_fold(spark, monkeypatch):
    import random

    rnd = random.Random(3)
    rows, changes = [], []
    for i in range(300):
        rows.append(("g", f"{i:05d}", 10 * i, "x"))
    for i in range(120):
        t = rnd.randrange(0, 3100) // 10 * 10 + 5
        named = rnd.random() < 0.4
        changes.append(("g", f"c{i:04d}", t + i / 1000 * 0, 1 + (rnd.random() < 0.7), 10 * rnd.randrange(300) if named else None, f"v{i}"))
    changes = list({(c[2], c[3]): c for c in changes}.values())
    r = spark.createDataFrame(rows, "grp string, row string, t long, value string")
    c = spark.createDataFrame([(*x[:2], int(x[2]), *x[3:]) for x in changes], "grp string, change string, t long, kind int, target_t long, value string")
    get = lambda: sorted(map(tuple, changefeed.apply_changes(r, c).select("row", "value").collect()))
    whole = get()
    monkeypatch.setattr(changefeed, "CHUNK", 7)
    assert get() == whole
    state = {}
    for ev in sorted([(x[2], 0, x[1], x[3]) for x in rows] + [(x[2], x[3], x[4], x[5], x[1]) for x in changes], key=lambda e: (e[0], e[1], e[-1])):
        if ev[1] == 0:
            state[ev[2]] = ev[3]
        else:
            k = (f"{ev[2] // 10:05d}" if ev[2] is not None else (max(state) if state else None))
            if k in state:
                if ev[1] == 1:
                    state[k] = ev[3]
                else:
                    del state[k]
    assert sorted(state.items()) == whole


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_feed_in_batches_equals_brute_force(spark, sf, batches):
    assert {r.pair_id: (r.choice, r.standing) for r in votes.p3_feed(spark, sf, batches).collect()} == brute(spark, sf)[0]


def test_late_rows_and_changes_undo_what_was_decided(spark):
    """A batch brings a row older than a change that named none, and the row's better version: the earlier decision is taken back."""
    row = "grp string, row string, t long, value string, prio int"
    change = "grp string, change string, t long, kind int, target_t long, value string"
    feed = changefeed.Feed(spark)
    feed.apply(spark.createDataFrame([("g", "1", 1, "a", 1), ("h", "1", 1, "x", 0)], row), spark.createDataFrame([("g", "c1", 9, 2, None, None), ("g", "c2", 10, 1, None, "z")], change))
    assert feed.read().select("grp", "row", "value").collect() == [("h", "1", "x")]
    feed.apply(spark.createDataFrame([("g", "5", 5, "b", 0), ("g", "1", 1, "A", 0), ("h", "1", 1, "y", 7)], row), spark.createDataFrame([("g", "c1", 9, 2, None, None)], change))
    assert sorted(map(tuple, feed.read().select("grp", "row", "value", "touched").collect())) == [("g", "1", "z", True), ("h", "1", "x", False)]
    feed.apply(changes=spark.createDataFrame([("g", "c0", 6, 2, 1, None)], change))
    feed.apply(spark.createDataFrame([], row), spark.createDataFrame([], change))
    feed.apply()
    assert feed.read().select("grp", "row").collect() == [("h", "1")]


def test_index_and_file_numbers_are_exact(spark):
    t = changefeed.VectorTable(spark, ["k"])
    for i in range(3):
        t.append(spark.range(1000 * i, 1000 * (i + 1)).select(F.col("id").alias("k"), F.lit(i).alias("v")).repartition(5))
    i = t.index().toPandas()
    assert len(i) == 3000 and i.groupby(["_file", "_pos"]).ngroups == 3000 and i._file.nunique() == 15
    t.supersede(spark.range(0, 1).select(F.col("id").alias("k")))
    t.supersede(spark.range(0, 3000, 10).select(F.col("id").alias("k")))
    left = t.read().toPandas()
    assert sorted(left.k) == [x for x in range(3000) if x % 10] and (left.v == left.k // 1000).all()


def test_hot_group_with_many_deaths(spark, monkeypatch):
    """Most rows of the group are deleted by name, long after; cuts of five events against one fold."""
    import random

    rnd = random.Random(8)
    rows = [("g", f"{i:05d}", 2 * i, 2 * i + 1 + 2 * rnd.randrange(1, 400) if rnd.random() < 0.8 else None) for i in range(400)]
    changes = [("g", f"c{i:04d}", 2 * rnd.randrange(400) + 1, 1 + (rnd.random() < 0.8)) for i in range(250)]
    r = spark.createDataFrame(rows, "grp string, row string, t long, death long")
    c = spark.createDataFrame(list({(x[2], x[3]): x for x in changes}.values()), "grp string, change string, t long, kind int")
    get = lambda: sorted(map(tuple, changefeed.resolve_unnamed(r, c).collect()))
    whole = get()
    monkeypatch.setattr(changefeed, "CHUNK", 5)
    assert len(whole) > 50 and get() == whole


def test_vector_table_supersedes_twice(spark):
    t = changefeed.VectorTable(spark, ["k"])
    t.append(spark.range(100_000).select(F.col("id").alias("k"), F.lit(0).alias("v")).repartition(3))
    for i in (1, 2):
        keys = spark.range(0, 100_000, 1000 * i).select(F.col("id").alias("k"))
        t.supersede(keys)
        t.append(keys.withColumn("v", F.lit(i)))
    got = dict(t.read().groupBy("v").count().collect())
    assert got == {0: 99_900, 1: 50, 2: 50} and t.read().select("k").distinct().count() == 100_000


def test_empty_and_null_tables(spark, sf):
    labels, corr = table(spark, sf, "labels").limit(0), table(spark, sf, "corrections").limit(0)
    assert votes.newest_standing(labels, corr).count() == 0
    nothing = table(spark, sf, "labels").limit(5).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in table(spark, sf, "labels").schema))
    assert votes.newest_standing(nothing.withColumn("value", F.lit(1)), table(spark, sf, "corrections")).count() == 0

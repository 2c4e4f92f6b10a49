import pytest
from pyspark.sql import functions as F

from partita.functions import requests as Q
from partita.functions import selection as S


def test_requests_with_missing_and_wrong_values(spark):
    rows = [(None, None, None, None), (0.0, 5, 4, "continue"), (2.0, 1, 64, "continue"), (float("nan"), 1, 1, "continue"), (2.01, 0, 0, "x"), (1.0, 0, 0, "x"), (1.0, 1, 65, "x"), (1.0, 1, 1, "x")]
    df = spark.createDataFrame(rows, "t double, k int, b int, m string")
    got = [r[0] for r in df.select(S.request_problem(F.col("t"), F.col("k"), F.col("b"), F.col("m"), ("continue",))).collect()]
    assert [g and g.split(":")[0] for g in got] == [None, "temperature must be over 0 and at most 2", None, "temperature must be over 0 and at most 2", "temperature must be over 0 and at most 2", "top_k must be 1 or more", "bars must be 1 to 64", "no such mode"]


def test_unknown_values_are_not_fit(spark):
    df = spark.createDataFrame([("val", 300, 90.0, 8, 8), ("val", None, 90.0, 8, None), ("val", 300, float("nan"), 7, 9), (None, 300, 90.0, None, None), ("train", 300, 90.0, 9, 9)], "s string, n int, t double, a int, b int")
    got = df.select(S.fit_for_evaluation(F.col("s"), F.col("n"), F.col("t"), 200, 60.0, 600.0).alias("f"), S.usable_pair(F.col("a"), F.col("b")).alias("u")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, False), (False, False), (False, True)]


def test_stems_pair_up(spark):
    a = spark.createDataFrame([("/x/One.mid",), ("/x/one.MIDI",), ("/x/two",), ("/x/.mid",), (None,)], "path string")
    b = spark.createDataFrame([("/y/ONE.json",), ("/y/three.json",)], "path string")
    assert sorted(map(tuple, S.by_stem(a, b).collect())) == [("one", "/x/One.mid", "/y/ONE.json"), ("one", "/x/one.MIDI", "/y/ONE.json")]


def test_maps_are_aligned(spark, monkeypatch):
    df = spark.createDataFrame([(1, {"b": 1.0}), (2, {"a": 2.0, "b": None}), (3, None), (4, {})], "id int, m map<string,double>")
    x, keys = S.aligned(df, "m")
    got = {r.id: [None if v != v else v for v in r["values"]] for r in x.collect()}
    assert keys == ["a", "b"] and got == {1: [None, 1.0], 2: [2.0, None], 3: [None, None], 4: [None, None]}
    assert S.aligned(df.limit(0), "m")[1] == []
    monkeypatch.setattr(S, "MOST_KEYS", 1)
    with pytest.raises(ValueError):
        S.aligned(df, "m")


def test_a_model_is_set_up_once_a_task_and_may_refuse(spark):
    def set_up():
        n = [0]

        def model(row):
            n[0] += 1
            if row["x"] < 0:
                raise ValueError
            return n[0]

        return model

    df = spark.range(-2, 6).select(F.col("id").alias("x"), F.lit("k").alias("key")).coalesce(1)
    got = S.with_model(df, set_up, ["x"], ["key", "x"], "out long").orderBy("x").collect()
    assert [r.out for r in got] == [None, None, 3, 4, 5, 6, 7, 8] and S.with_model(df.limit(0), set_up, ["x"], ["x"], "out long").count() == 0


def test_mean_loss(spark):
    df = spark.createDataFrame([([-1.0, -3.0], [True, False]), ([-1.0], [False]), ([], [])], "p array<double>, m array<boolean>")
    assert [tuple(r) for r in df.select(S.mean_loss(F.col("p")), S.mean_loss(F.col("p"), F.col("m"))).collect()] == [(2.0, 1.0), (1.0, None), (None, None)]


def test_window_starts_stay_inside(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(7), F.lit(30))).alias("a"), F.col("id").cast("string").alias("key"))
    x = df.withColumn("at", Q.window_start(F.col("a"), F.lit(100), 64, 0.5, F.col("key")))
    assert x.filter("at < 0 or at > 35").count() == 0 and 100 < x.filter("array_contains(a, at)").count() < 250
    assert df.select(Q.window_start(F.col("a"), F.lit(100), 64, 1.0, F.col("key")).alias("at"), "a").filter("size(a) > 0 and not array_contains(a, at)").count() == 0


def test_choices_of_tracks(spark):
    notes = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "a")], "file_id int, track_name string")
    ask = spark.createDataFrame([(1, "auto", None), (2, "list", [0, 3]), (3, "all", None)], "file_id int, kind string, tracks array<int>")
    assert sorted(map(tuple, S.choose_tracks(notes, ask).collect())) == [(1, "b", 2, None), (2, None, None, "no track 3")]
    assert [tuple(r) for r in S.choose_tracks(notes, ask.withColumn("kind", F.lit("some"))).select("problem").distinct().collect()] == [("no such choice: some",)]

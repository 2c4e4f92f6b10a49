import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from partita.functions import notes as N
from partita.operators import corpus as C
from partita.operators import ordered as O
from partita.operators import preferences as P
from partita.operators.components import connected_components
from partita.operators.positions import ranked

NOTE = "file_id long, track_name string, program int, is_drum boolean, note_idx long, start long, duration long, pitch long, velocity long"


def notes(spark, rows):
    return spark.createDataFrame([(f, t, 0, t == "d", i, s, du, p, 64) for i, (f, t, s, du, p) in enumerate(rows)], NOTE)


def test_ranked_with_ties_hot_key_and_weights(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", i % 7, i, float(i % 4)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, s int, id int, w double").repartition(7)
    got = ranked(df, ["k"], [F.col("s").desc(), F.col("id")], weight="w").toPandas()
    want = pd.DataFrame(rows, columns=["k", "s", "id", "w"]).sort_values(["k", "s", "id"], ascending=[True, False, True])
    want["pos"], want["start"] = want.groupby("k").cumcount() + 1, want.groupby("k")["w"].cumsum() - want["w"]
    m = got.merge(want, on=["k", "id"])
    assert len(m) == 2000 and (m.pos_x == m.pos_y).all() and np.allclose(m.start_x, m.start_y)
    assert ranked(df.limit(0), ["k"], [F.col("s")]).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (200, 201), (201, 200), (200, 201)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_metrics_of_odd_files(spark):
    df = notes(spark, [(1, "d", 0, 5, 36), (2, "p", 0, 10, 60), (3, "p", 0, 10, 60), (3, "p", 0, 10, 64), (3, "p", 5, 0, 67), (3, "p", 20, 5, 60)])
    poly = {r.file_id: (r.polyphony_prior, r.polyphony_counts) for r in N.polyphony(df).collect()}
    assert poly[2] == (1.0, 1.0) and poly[3] == ((1 + 2 + 3 + 1) / 4, (2 + 2 + 2 + 1) / 4)
    keys = {r.file_id: (r.tonic, r.mode, r.scale_consistency) for r in N.scale_consistency(N.detect_key(N.pitch_classes(df))).collect()}
    assert keys[1] == (0, "major", 0.0) and keys[3][:2] == (0, "major") and keys[3][2] == 1.0
    assert {r.file_id: r.repetition_rate for r in N.repetition(df).collect()} == {2: 0.0, 3: 0.0}
    d = {r.file_id: (r.note_density_hz, r.pitch_range) for r in N.density_and_range(df, 0.5).collect()}
    assert d[1] == (0.0, 0) and d[2] == (0.2, 0)
    with pytest.raises(KeyError):
        N.compute(df, ["nothing"])
    assert N.compute(df, ["polyphony", "repetition"]).count() == 3


def test_verdict_order(spark):
    rows = [(None, 1.0), (10, 5.0), (100, 2000.0), (100, 0.0), (100, 1000.0), (100, 20.0), (100, float("nan")), (100, 1.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "n long, d double").select(N.clean_verdict(F.col("n"), F.col("d"))).collect()]
    assert got == ["unparseable", "too_few_notes", "too_long", "too_dense", "too_sparse", "ok", "unparseable", "too_dense"]


def test_asof_in_buckets_equals_one_window(spark):
    import random

    rnd = random.Random(1)
    left = spark.createDataFrame([(k, rnd.randrange(1000), i) for i, k in enumerate("aab" * 60)], "k string, t int, id int")
    right = spark.createDataFrame([(k, rnd.randrange(1000), i) for i, k in enumerate("aaac" * 9)], "k string, t int, v int")
    a, b = (sorted(map(tuple, O.asof_join(left, right, ["k"], "t", ["v"], bucket=x).collect()), key=str) for x in (None, 50))
    assert a == b and len(a) == 180 and any(r[3] is None for r in a)


def test_seconds_before_the_first_tempo_and_without_any(spark):
    p = spark.createDataFrame([(1, 0), (1, 480), (1, 960), (2, 480)], "file_id long, start long")
    t = spark.createDataFrame([(1, 480, 60.0)], "file_id long, time long, qpm double")
    assert {(r.file_id, r.start): r.seconds for r in O.seconds_of(p, t, 480).collect()} == {(1, 0): 0.0, (1, 480): 1.0, (1, 960): 2.0, (2, 480): 0.5}


def test_held_under_looks_back_24_only(spark):
    low = [(1, "p", 0, 100_000, 40)] + [(1, "p", 10 + i, 1, 41) for i in range(24)]
    high = [(1, "p", 5000, 10, 70)]
    h = lambda rows: O.held_under(notes(spark, rows), notes(spark, high), 480).first().held
    assert h(low) == 0.0 and h(low[:24]) == 1.0


def test_degenerate_presets(spark):
    loop = [(1, "p", i * 10, 5, 60) for i in range(20)]
    music = [(2, "p", i * 13 + i % 3, 5, 50 + i * 7 % 24) for i in range(20)]
    few = [(3, "p", i, 5, 60) for i in range(7)]
    got = {r.file_id: r.degenerate for r in O.degenerate_windows(notes(spark, loop + music + few), F.col("start") * 0.01).collect()}
    assert got == {1: True, 2: False, 3: False}


@pytest.mark.parametrize("name, want", [("TR-909", True), ("909_kit", True), ("785909_0.mid", False), ("What a Wonderful World", False), ("Tomorrow", False), ("Drumset", True), (None, False), ("tom 1", True)])
def test_drum_names(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(O.name_says_drums(F.col("n"))).first()[0] is want


def test_minhash_links_and_keeper(spark):
    import random

    rnd = random.Random(5)
    base = [rnd.randrange(40, 90) for _ in range(200)]
    edit = base[:150] + [61] + base[150:]
    other = [rnd.randrange(40, 90) for _ in range(200)]
    rows = [("b", base, 10), ("a", edit, 20), ("c", other, 5), ("d", base[:40], 9), ("e", None, 1), (None, base, 1)]
    got = C.duplicate_clusters(spark.createDataFrame(rows, "path string, pitches array<int>, n_notes int")).collect()
    assert {(r.path, r.cluster, r.keeper) for r in got} == {("a", "a", "a"), ("b", "a", "a")}
    a, b = C.hash_family()
    sh = C.shingled(spark.createDataFrame([("x", base)], "k string, p array<int>"), "k", "p")
    x = sh.first().sh
    want = [min(((int(p) * v + int(q)) % 2**64) % C.MERSENNE for v in x) for p, q in zip(a, b)]
    assert C.minhash(sh, "k", "sh").first().sig == want


def test_clusters_of_copies_and_pairs_beside_the_anchor(spark):
    import random

    rnd = random.Random(6)
    base = [rnd.randrange(40, 90) for _ in range(200)]
    rows = [(f"c{i:03}", base, i) for i in range(250)] + [("d", base[:150] + [61] + base[150:], 1), ("e", [rnd.randrange(40, 90) for _ in range(200)], 1)]
    df = spark.createDataFrame(rows, "path string, pitches array<int>, n_notes int")
    assert C.duplicate_clusters(df).filter("path like 'c%'").count() == 0  # the reference's cap
    got = C.whole_clusters(df).collect()
    assert {(r.path, r.cluster, r.keeper) for r in got} == {(p, "c000", "c249") for p, _, _ in rows if p != "e"}
    # b and c share with a its first band alone, and only that with each other: they are 0.76 alike, a is like neither
    b = list(range(128))
    c = [x + 1000 if i > 3 and i % 4 == 0 else x for i, x in enumerate(b)]
    a = [x if i < 4 else x + 2000 for i, x in enumerate(b)]
    sigs = spark.createDataFrame([("a", a), ("b", b), ("c", c)], "k string, sig array<bigint>")
    assert C.lsh_links(sigs, "k", None).count() == 0
    assert {tuple(r) for r in C.lsh_components(sigs, "k").collect()} == {("b", "b"), ("c", "b")}


def test_guard(spark):
    m = spark.createDataFrame([("a",), ("b",)], "stem string")
    C.guard(m, spark.createDataFrame([("c",)], "stem string"))
    with pytest.raises(ValueError, match="1 held-out"):
        C.guard(m, m.limit(1))


def test_ridge_recovers_a_planted_signal(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = np.clip(3 + x @ [0.5, -0.3, 0.0] + rng.normal(scale=0.1, size=400), 1, 5)
    rows = [(f"g{i % 80}", *(None if i % 7 == 0 and k == 2 else float(v) for k, v in enumerate(r)), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, y double")
    m = P.fit_ridge(df, ["a", "b", "c"], "y", 1.0)
    med = df.select(F.median("c")).first()[0]
    z = np.array([[r[1], r[2], med if r[3] is None else r[3]] for r in rows])
    s = (z - z.mean(0)) / z.std(0)
    want = np.linalg.solve(s.T @ s + np.eye(3), s.T @ (y - y.mean()))
    assert np.allclose(m.coef, want, atol=1e-6) and P.Ridge.from_json(m.to_json()).coef == m.coef
    cv = {r.alpha: r.rho for r in P.grouped_cv(df.fillna({"c": 0.0}), ["a", "b", "c"], "y", "g", [0.1, 1.0]).collect()}
    assert min(cv.values()) > 0.95
    assert abs(df.select(F.avg(F.abs(m.predict() - F.col("y")))).first()[0]) < 0.12


def test_bradley_terry_and_held_out_groups(spark):
    rng = np.random.default_rng(1)
    d = rng.normal(size=(300, 4))
    d[(d @ [2.0, -1.0, 0, 0]) < 0] *= -1
    w = P.fit_bt(d)
    p = 1 / (1 + np.exp(-(d @ w)))
    assert np.allclose(d.T @ (1 - p) - w, 0, atol=1e-8) and w[0] > 0 > w[1]
    rows = [(i, i % 6, [float(v) for v in r]) for i, r in enumerate(d)]
    got = P.leave_group_out(spark.createDataFrame(rows, "pair_id int, grp int, diff array<double>")).toPandas()
    assert len(got) == 300 and (got.p > 0.5).mean() > 0.9


def test_statistics_of_constants_and_empties(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0), ("b", 2.0, 3.0)], "g string, x double, y double")
    got = {r.g: r.rho for r in P.spearman(df, "x", "y", ["g"]).collect()}
    assert math.isnan(got["a"]) and abs(got["b"] - pd.Series([1, 2.5, 2.5]).corr(pd.Series([1, 2, 3]))) < 1e-12
    lo, hi = P.wilson(F.lit(0), F.lit(0))
    assert all(math.isnan(v) for v in df.limit(1).select(lo, hi).first())
    empty = spark.createDataFrame([], "pair_id string, preferred string")
    assert P.consistency_majority(empty).first().votes == 0 and P.majority(empty).count() == 0
    v, same = P.swap_verdict(F.col("a"), F.col("b"))
    rows = spark.createDataFrame([("1", "2"), ("1", "1"), ("tie", "tie")], "a string, b string").select(v, same).collect()
    assert [tuple(r) for r in rows] == [("1", True), ("tie", False), ("tie", True)]


def test_quota_shortfall_goes_to_those_with_room(spark):
    s = spark.createDataFrame([("a", 1.0, 2), ("b", 1.0, 100), ("c", 2.0, 60)], "group string, weight double, have int")
    assert {r.group: r.want for r in C.quotas(s, 100).collect()} == {"a": 2, "b": 25 + 20, "c": 50 + 3}


def test_quantiles_and_shares_by_rank(spark):
    import random

    from partita.operators.positions import at_share, group_quantiles

    rnd = random.Random(6)
    rows = [("a" if i % 3 else "b", rnd.choice([1.0, 2.0, 2.5, rnd.random() * 10])) for i in range(701)] + [("one", 4.0), ("none", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r[0]: list(r)[1:] for r in group_quantiles(df, ["g"], "v", qs).collect()}
    for g in ("a", "b", "one"):
        x = sorted(v for k, v in rows if k == g and v is not None)
        assert np.allclose(got[g], np.quantile(x, qs))
        assert at_share(df, ["g"], "v", 0.95).filter(F.col("g") == g).first().v == x[int(len(x) * 0.95)]
    assert set(got) == {"a", "b", "one"}
    assert np.allclose(list(group_quantiles(df, [], "v", qs).first()), np.quantile([v for _, v in rows if v is not None], qs))
    assert group_quantiles(df.limit(0), [], "v", qs).count() == 0


def test_salted_join_equals_plain_join(spark):
    from partita.operators.components import salted_join

    big = spark.range(40_000).select(F.when(F.col("id") < 25_000, F.lit(0)).otherwise(F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("deg"), F.max("v").alias("m")).filter("k <> 3")
    got = salted_join(big, small, "k", "v", 40_000)
    assert sorted(got.columns) == ["k", "m", "v"] and got.exceptAll(big.join(small.drop("deg"), "k").select(got.columns)).count() == 0 and got.count() == big.filter("k <> 3").count()


def test_bradley_terry_sees_every_pair(spark, sf, monkeypatch):
    from partita.plans import preferences as PP

    monkeypatch.setattr(P, "FIT_ROWS", 20)
    rows = np.array([r[0] for r in PP._emb(spark, sf).select("diff").collect()])
    assert len(rows) > 20
    got = {r.feature: r.weight for r in PP.QUERIES["bradley_terry"](spark, sf).collect()}
    assert np.allclose([got[i] for i in range(64)], P.fit_bt(rows), atol=1e-9)


def test_agreement_of_every_component(spark, sf):
    from partita.plans import preferences as PP

    want = {i for r in PP._emb(spark, sf).select("diff").collect() for i, v in enumerate(r[0]) if v}
    got = {r.metric for r in PP.QUERIES["per_metric_agreement"](spark, sf).collect()}
    assert got == want and len(got) == 64


def test_ratings_keep_the_first_features(spark):
    rows = [("a", 3, False, 1, {}), ("a", None, False, 2, {"x": 1.0}), ("a", 5, True, 3, {"x": 2.0}), ("a", 4, False, 4, None), ("b", 2, False, 1, None), (None, 1, False, 1, None)]
    got = P.aggregate_ratings(spark.createDataFrame(rows, "excerpt_id string, rating int, revision boolean, ord int, features map<string,double>"))
    assert {r.excerpt_id: (r.rating, r.n, r.features) for r in got.collect()} == {"a": (4.5, 2, {"x": 1.0}), "b": (2.0, 1, None)}


def test_masked_divergence(spark):
    df = spark.createDataFrame([([-1.0, -2.0], [-1.0, -1.0], [True, False]), ([-1.0], [-2.0], [False])], "p array<double>, q array<double>, m array<boolean>")
    got = df.select(P.k3_kl(F.col("p"), F.col("q")), P.k3_kl(F.col("p"), F.col("q"), F.col("m"))).collect()
    assert math.isclose(got[0][0], (math.e - 2) / 2) and got[0][1] == 0 and got[1][1] is None

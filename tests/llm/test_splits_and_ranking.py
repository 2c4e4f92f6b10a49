import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.llm import ranking, splits


def test_piece(spark):
    rows = [("/data/raw/Lakh/x/AB12_3 (2).mid", "lakh/ab12"), ("~/raw/aria/ext/00 - 0.mid", "aria/00"), ("/home/raw/aria/-x.mid", "aria/"), ("/none/aria/x.mid", None), (None, None), ("", None), ("/raw/fma/Ünï9.mid", "fma/ünï9")]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, w string").select(splits.piece(F.col("p"))).collect()]
    assert got == [w for _, w in rows]


def test_groups_against_union_find(spark):
    rnd = random.Random(4)
    links = [(f"r{rnd.randrange(400):04d}", f"e{rnd.randrange(450)}") for _ in range(500)] + [(f"h{i:04d}", "hot") for i in range(300)] + [("lone", None), (None, "hot"), ("h0000", "hot")]
    got = dict(splits.groups(spark.createDataFrame(links, "record string, entity string")).collect())
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r, e in links:
        if r is not None:
            root(r)
            if e is not None:
                a, b = root(r), root(("e", e))
                if a != b:
                    up[a] = b
    by = {}
    for r in {r for r, _ in links if r}:
        by.setdefault(root(r), []).append(r)
    assert got == {r: min(v) for v in by.values() for r in v} and got["lone"] == "lone" and got["h0299"] == "h0000"
    assert splits.groups(spark.createDataFrame([], "record string, entity string")).count() == 0


def test_paths_outside_the_corpus_link_as_well(spark):
    """Pairs that share a path without a piece go together, so its file and they are on one side."""
    rows = [("p1", "/tmp/A.mid", None), ("p2", "/tmp/a.mid", "/raw/lakh/x_1.mid"), ("p3", None, "/raw/lakh/x_2.mid"), ("p4", "/tmp/b.mid", None), ("", "/tmp/b.mid", None), (None, "/tmp/b.mid", None), ("p5", None, None)]
    m = splits.memberships(spark.createDataFrame(rows, "pair_id string, prompt_path string, part_path string"))
    assert dict(splits.groups(m).collect()) == {"p1": "p1", "p2": "p1", "p3": "p1", "p4": "p4"}


def test_assign_proportions(spark):
    n = {r.s: r.c for r in spark.range(20_000).select(splits.assign(F.col("id").cast("string")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert abs(n["train"] - 18_000) < 300 and abs(n["validation"] - 1000) < 150 and sum(n.values()) == 20_000
    one = spark.range(9).select(splits.assign(F.lit("c"), (("a", 3.0), ("b", 1.0))).alias("s")).distinct()
    assert one.count() == 1


def test_splits_keep_groups_whole(spark, sf):
    x = splits.p4_splits(spark, sf)
    assert x.groupBy("component").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert x.filter("id is null or split is null").count() == 0 and x.groupBy("kind", "id").count().filter("count > 1").count() == 0


def votes(spark, rows):
    return spark.createDataFrame(rows, "winner string, loser string, rank int, item string")


def fit(n, wins, ridge):
    """Dense Newton steps, for comparison."""
    s = np.zeros(n)
    for _ in range(100):
        g, h = -ridge * s, ridge * np.eye(n)
        for (i, j), (w, t) in wins.items():
            x = np.eye(n)[i] - np.eye(n)[j]
            wt, sc = ranking._weights(np.array([s[i] - s[j]]), np.array([w]), np.array([t]))
            g, h = g + x * sc[0], h + wt[0] * np.outer(x, x)
        step = np.linalg.solve(h, g)
        s = s + step
        if np.abs(step).max() < 1e-12:
            break
    c = np.linalg.inv(h)
    m = np.eye(n) - 1 / n
    return s, np.sqrt(np.diag(m @ c @ m))


@pytest.mark.parametrize("block", [ranking.BLOCK, 2])
def test_strengths_equal_dense_fit(spark, block):
    rnd = random.Random(2)
    true = {f"m{i}": i / 3 for i in range(6)}
    rows, wins = [], {}
    for _ in range(600):
        i, j = sorted(rnd.sample(range(6), 2))
        if (i, j) in ((0, 5), (1, 4)):
            continue
        w = rnd.gauss(0, 1) < true[f"m{i}"] - true[f"m{j}"]
        rows.append((f"m{i}", f"m{j}", 1, "x") if w else (f"m{j}", f"m{i}", 1, "x"))
        a = wins.setdefault((i, j), [0, 0])
        a[0] += w
        a[1] += 1
    rows += [(None, "m1", 1, "x"), ("m1", None, 1, "x"), ("m1", "m1", 1, "x")]
    got = {r.item: r for r in ranking.strengths(votes(spark, rows), block=block).collect()}
    s, se = fit(6, wins, ranking.RIDGE)
    assert np.allclose([got[f"m{i}"].strength for i in range(6)], s, atol=1e-5) and np.allclose([got[f"m{i}"].std_error for i in range(6)], se, atol=1e-5)
    assert sorted(got, key=lambda m: got[m].rank)[0] == "m5" and sum(r.wins for r in got.values()) == sum(r.losses for r in got.values()) == len(rows) - 3


def test_ranking_of_little(spark):
    assert ranking.strengths(votes(spark, []).limit(0)).count() == 0
    got = {r.item: r for r in ranking.strengths(votes(spark, [("a", "b", 1, "x")] * 50 + [("c", "d", 1, "x")])).collect()}
    assert got["a"].strength == -got["b"].strength > got["c"].strength > 0 and all(np.isfinite(r.std_error) for r in got.values())


def test_decided(spark):
    import datetime as dt

    t = lambda i: dt.datetime(2026, 1, 1, 0, 0, i)
    base = dict(session_id="s", left_is="b", right_is="a", preferred=None, left_model="L", right_model="R", corrected_from=None)
    rows = [dict(base, pair_id="1", ts=t(1), choice="left"), dict(base, pair_id="2", ts=t(2), choice=None, preferred="a"), dict(base, pair_id="3", ts=t(3), choice="tie", preferred="a"), dict(base, pair_id="4", ts=t(4), choice="left", right_model="L"),
            dict(base, pair_id="5", ts=t(5), choice="tie", corrected_from="right"), dict(base, pair_id="6", ts=t(6), choice="left", left_model=None), dict(base, pair_id="", ts=t(7), choice="left"), dict(base, pair_id="8", ts=None, choice="left"),
            dict(base, pair_id="9", ts=t(9), choice=None, preferred="a", left_is="a"), dict(base, pair_id="1", ts=t(1), choice="left")]
    schema = "pair_id string, session_id string, ts timestamp_ntz, choice string, left_is string, right_is string, preferred string, left_model string, right_model string, corrected_from string"
    got = sorted(map(tuple, ranking.decided(spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)).collect()))
    assert got == [("L", "R"), ("R", "L"), ("R", "L")]

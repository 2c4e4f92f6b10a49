import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from partita.llm import neardup


def test_signatures_are_unbiased_for_weighted_sets():
    rnd = random.Random(0)
    a = {i: rnd.choice([1, 1, 2, 3, 7, 20]) for i in range(150)}
    b = {i + 40: (a.get(i + 40, 5) if i % 3 else rnd.choice([1, 4, 9])) for i in range(150)}
    keys = set(a) | set(b)
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    lists = [sorted(x.items()) for x in (a, b)]
    m = 8192
    sig = neardup.signatures(pa.array([[k for k, _ in x] for x in lists], pa.list_(pa.int64())), pa.array([[w for _, w in x] for x in lists], pa.list_(pa.int32())), m)
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / m)
    alone = neardup.signatures(pa.array([[k for k, _ in lists[1]]], pa.list_(pa.int64())), pa.array([[w for _, w in lists[1]]], pa.list_(pa.int32())), m)
    assert (alone[0] == sig[1]).all()


def test_signatures_of_nothing_and_in_pieces():
    codes, counts = pa.array([[], [5], [1, 2, 3]], pa.list_(pa.int64())), pa.array([[], [3], [1, 1, 1]], pa.list_(pa.int32()))
    a, b = neardup.signatures(codes, counts, 16), neardup.signatures(codes, counts, 16, most=2)
    assert (a == b).all() and a.shape == (3, 16) and neardup.signatures(codes.slice(0, 0), counts.slice(0, 0)).shape == (0, neardup.M)


def test_runs():
    c, n = neardup.runs_of([60, None, 62, 64, 62, 60, 62, 64, 65])
    assert len(c) == 2 and n.tolist() == [1, 1] and len(neardup.runs_of([60] * 6)[0]) == 0 and neardup.runs_of([60] * 50)[1].tolist() == [44]
    assert len(neardup.runs_of([0, 100_000, 0, 5, 9, 2, 1, 7])[0]) == 2 and len(neardup.runs_of([])[0]) == 0


@pytest.mark.parametrize("run", [1, 6, 7, 9])
def test_runs_of_a_batch_equal_runs_of_each(run):
    rnd = random.Random(run)
    lists = [None, [], [60], [60, 62] * 40, [None] * 9, [0, 300, 5, 9, 2, 1, 7, 8, 400, 3, 3, 3, 3], [60, None, 61, 62, 63, 64, 65, 66, 67, 68, 69]] + [[rnd.randrange(55, 60) for _ in range(rnd.randrange(60))] for _ in range(60)]
    rnd.shuffle(lists)
    col = pa.array([[1]] + lists + [[2, 3]], pa.list_(pa.int32())).slice(1, len(lists))
    at, code, count = neardup.runs_of_batch(col, run)
    for i, x in enumerate(lists):
        c, n = neardup.runs_of(x or [], run)
        assert code[at == i].tolist() == c.tolist() and count[at == i].tolist() == n.tolist()


def brute(files, threshold):
    sets = {}
    for p, x in files:
        x = [v for v in x or [] if v is not None]
        d = [b - a for a, b in zip(x, x[1:])]
        s = {tuple(d[i : i + 6]) for i in range(len(d) - 5)}
        if p and len(s) >= 64:
            sets[p] = s
    return {(p, q) for p in sets for q in sets if p < q and len(sets[p] & sets[q]) >= threshold * len(sets[p] | sets[q])}


@pytest.mark.parametrize("cell", [500, 4])
def test_pairs_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(neardup, "CELL", cell)
    rnd = random.Random(8)
    files = []
    for g in range(12):
        base = [rnd.randrange(30, 100) for _ in range(rnd.choice([90, 200, 260]))]
        for k in range(7):
            x = list(base)
            for _ in range(k * k // 2):
                x[rnd.randrange(len(x))] = rnd.randrange(30, 100)
            files.append((f"f{g}-{k}", [v + k for v in x]))
    files += [(f"copy{i}", files[0][1]) for i in range(9)] + [files[3], (None, files[0][1]), ("null", None), ("empty", []), ("short", [1, 2, 3]), ("loop", [60, 62] * 100)]
    df = spark.createDataFrame([(p, x, 1, b"") for p, x in files], "path string, pitches array<int>, size int, cls binary")
    members, links = neardup.near_duplicates(df)
    got = links.join(members.toDF("p", "a"), "a").join(members.toDF("q", "b"), "b").select(F.least("p", "q"), F.greatest("p", "q")).unionAll(neardup.pairs_within(members, "cls", "path"))
    got = list(map(tuple, got.collect()))
    assert len(got) == len(set(got)) and set(got) == brute(files, 0.65) and len(got) > 60
    assert links.filter("similarity < 0.65 or a >= b").count() == 0
    assert all(x.count() == 0 for x in neardup.near_duplicates(df.limit(0)))

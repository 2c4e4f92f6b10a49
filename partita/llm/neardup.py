"""Near-duplicate records with small edits: BagMinHash signatures, banding, exact verification.

A record is a weighted set of elements. Weights are discretised into integer levels; an element of weight w owns
the Poisson processes of the dyadic level ranges [0,1), [1,2), [2,4), [4,8) ... up to w, each with a rate equal
to its width; of the last, only partly covered range the points at levels of w or more are dropped. Every point
falls into one of M slots, and a slot's signature value is its earliest point. Two records agree in a slot with
a probability equal to their weighted Jaccard similarity.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.operators.components import connected_components, salted_join
from partita.operators.corpus import sorted_within
from partita.tables import stash, table, unstash

#: 42 bands of 3 slots: two records with similarity 0.65 share no band with a probability of about 1e-6.
BANDS, ROWS = 42, 3
M = BANDS * ROWS
THRESHOLD, RUN, LEAST = 0.65, 6, 64
CELL = 500
PART = 2000  # records that are worked on at a time
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _sign(row: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n x m, as the bits of the earliest times) of the elements `code` with `weight` of rows `row`."""
    with np.errstate(over="ignore", divide="ignore"):
        base = _mix(code.astype(np.int64).view(_U) + _U(0x9E3779B97F4A7C15))
        rows, keys, lows, widths, caps = [], [], [], [], []
        lo, width = 0, 1
        live = weight > 0
        while live.any():
            rows.append(row[live])
            keys.append(_mix(base[live] ^ _mix(np.full(live.sum(), lo + 1, dtype=_U))))
            lows.append(np.full(live.sum(), lo, dtype=float))
            widths.append(np.full(live.sum(), width, dtype=float))
            caps.append(weight[live].astype(float))
            lo, width = lo + width, max(1, lo + width)
            live = weight > lo
        sig = np.full(n * m, np.inf)
        if not rows:
            return sig.view(np.int64).reshape(n, m)
        row, key, low, wid, cap = map(np.concatenate, (rows, keys, lows, widths, caps))
        total = np.bincount(row, np.minimum(wid, cap - low), n)
        limit = m * (np.log(m) + 3) / np.maximum(total, 1e-300)
        todo = total > 0
        while todo.any():
            at = np.flatnonzero(todo[row])
            r, k, lw, wd, cp = row[at], key[at], low[at], wid[at], cap[at]
            t, c = np.zeros(len(r)), _U(0)
            while len(r):
                c += _U(1)
                u = _mix(k + c * _U(0x9E3779B97F4A7C15))
                t = t - np.log(((u >> _U(11)).astype(float) + 1) * 2.0**-53) / wd
                on = t <= limit[r]
                r, k, lw, wd, cp, t, u = r[on], k[on], lw[on], wd[on], cp[on], t[on], u[on]
                v = _mix(u)
                level = lw + ((v >> _U(32)).astype(float) * 2.0**-32) * wd
                hit = level < cp
                np.minimum.at(sig, r[hit] * m + ((v[hit] & _U(0xFFFFFFFF)) % _U(m)).astype(np.int64), t[hit])
            open_ = np.isinf(sig.reshape(n, m)).any(1) & todo
            limit[open_] *= 2
            sig.reshape(n, m)[open_] = np.inf
            todo = open_
    return sig.view(np.int64).reshape(n, m)


def signatures(codes: pa.ListArray, counts: pa.ListArray, m: int = M, most: int = 400_000) -> np.ndarray:
    """One signature for each list of elements with its list of weights, at most `most` elements at a time."""
    ends = np.concatenate([[0], np.cumsum(codes.value_lengths().to_numpy(zero_copy_only=False))])
    flat, weight = codes.flatten().to_numpy(), counts.flatten().to_numpy()
    out, lo = [], 0
    while lo < len(codes):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
        row = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
        out.append(_sign(row, flat[ends[lo] : ends[hi]], weight[ends[lo] : ends[hi]], hi - lo, m))
        lo = hi
    return np.concatenate(out) if out else np.zeros((0, m), dtype=np.int64)


def runs_of(pitches: list, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of `run` successive pitch steps, as codes in ascending order, with their counts; null pitches are passed over.

    Steps within -128..127 are packed exactly, eight bits each; others are hashed.
    """
    x = np.array([p for p in pitches if p is not None], dtype=np.int64)
    d = np.diff(x)
    if len(d) < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = np.lib.stride_tricks.sliding_window_view(d, run)
    if np.abs(d).max() < 128 and run <= 7:
        code = ((w + 128) << (8 * np.arange(run))).sum(1)
    else:
        with np.errstate(over="ignore"):
            h = np.zeros(len(w), dtype=_U)
            for i in range(run):
                h = _mix(h * _U(31) + w[:, i].astype(np.int64).view(_U) + _U(0x9E3779B97F4A7C15))
            code = (h | _U(1 << 63)).view(np.int64)
    return np.unique(code, return_counts=True)


def runs_of_batch(pitches: pa.ListArray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of runs_of() for every list of a batch, by row and code; lists with nulls or steps beyond eight bits go one by one."""
    lengths = np.asarray(pitches.value_lengths().fill_null(0)).astype(np.int64)
    values = pitches.flatten()
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)
    apart = np.zeros(len(lengths), dtype=bool)
    if values.null_count:
        apart[row[np.asarray(values.is_null())]] = True
    flat = np.asarray(values.fill_null(0)).astype(np.int64)
    step = np.diff(flat)
    apart[row[:-1][(np.abs(step) > 127) & (row[:-1] == row[1:])]] = True
    n = max(0, len(flat) - run)
    code = np.zeros(n, dtype=np.int64)
    for i in range(run):
        code += (np.clip(step[i : i + n], -128, 127) + 128) << (8 * i)
    at = row[:n]
    keep = (np.arange(n) + run < ends[at]) & ~apart[at] if run <= 7 else np.zeros(n, dtype=bool)
    at, code = at[keep], code[keep]
    rows, codes = [at], [code]
    for r in np.flatnonzero(apart if run <= 7 else lengths > 0):
        c, k = runs_of(pitches[int(r)].as_py(), run)
        rows.append(np.full(int(k.sum()), r))
        codes.append(np.repeat(c, k))
    at, code = np.concatenate(rows), np.concatenate(codes)
    at, code = sorted_within(at, code)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (code[1:] != code[:-1])
    first = np.flatnonzero(new)
    return at[first], code[first], np.diff(np.append(first, len(at)))


def _shape(multiset: bool, run: int, least: int):
    """path, pitches, cls (a digest of the runs and their weights) and n (the sum of the weights) of the records with enough runs."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, PART):
                paths, lists = b.column(0).slice(lo, PART), b.column(1).slice(lo, PART)
                at, code, count = _runs(lists, multiset, run)
                size = np.bincount(at, minlength=len(paths))
                kept = np.flatnonzero(size >= max(1, least))
                ends = np.concatenate([[0], np.cumsum(size)])
                cls = [hashlib.md5(code[i:j].tobytes() + count[i:j].tobytes()).digest() for i, j in zip(ends[kept], ends[kept + 1])]
                total = np.bincount(at, count, len(paths))[kept].astype(np.int64)
                take = pa.array(kept)
                yield pa.RecordBatch.from_arrays([paths.take(take), lists.take(take), pa.array(cls, pa.binary()), pa.array(total)], names=["path", "pitches", "cls", "n"])

    return go


def _runs(lists: pa.ListArray, multiset: bool, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, code, count = runs_of_batch(lists, run)
    return at, code, count.astype(np.int64) if multiset else np.ones(len(code), np.int64)


def _signed(multiset: bool, run: int):
    """id, n, the keys of the bands, and a sketch: one byte of each slot's value."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, PART):
                part = b.slice(lo, PART)
                at, code, count = _runs(part.column("pitches"), multiset, run)
                sig = _mix(_sign(at, code, count, part.num_rows, M).view(_U))
                with np.errstate(over="ignore"):
                    key = np.zeros((len(sig), BANDS), dtype=_U)
                    for i in range(ROWS):
                        key = _mix(key * _U(31) + sig[:, i::ROWS][:, :BANDS] + np.arange(BANDS, dtype=_U))
                keys = pa.FixedSizeListArray.from_arrays(pa.array(key.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
                sketch = pa.array([x.tobytes() for x in (sig & _U(255)).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n"), keys, sketch], names=["id", "n", "keys", "sketch"])

    return go


def pairs_within(df: DataFrame, key: str, id_: str) -> DataFrame:
    """(a, b), a < b: all pairs of ids that share a key, each once. Each (key, id) of df must come once.

    Groups of over CELL ids are cut into k blocks by hash and joined cell by cell (block i with block j), so that a
    hot group's pairs are spread over k(k+1)/2 join keys. df is read twice.
    """
    df = df.select(key, id_)
    n = stash(df.groupBy(key).agg(F.count(F.lit(1)).alias("deg")).filter("deg > 1").withColumn("k", F.ceil(F.col("deg") / CELL).cast("int")), "groups")
    total = n.agg(F.sum("deg")).first()[0] or 0
    m = salted_join(df, n, key, id_, total)
    m = m.withColumn("blk", F.pmod(F.xxhash64(id_), F.col("k")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    m = m.select(key, F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", id_)
    a, b = m.withColumnsRenamed({id_: "a", "blk": "ba"}), m.withColumnsRenamed({id_: "b", "blk": "bb"})
    return a.join(b, [key, "i", "j"]).filter("a < b and (i = j or ba <> bb)").select("a", "b").distinct()


def least_agreement(threshold: float, m: int = M, miss: float = 1e-7) -> int:
    """The most slots of which a pair at the threshold agrees in fewer with a probability below `miss`."""
    tail, k = 0.0, 0
    while k <= m and tail + (p := math.comb(m, k) * threshold**k * (1 - threshold) ** (m - k)) < miss:
        tail, k = tail + p, k + 1
    return k


def _likely(threshold: float):
    """The candidates whose weights allow the threshold (an exact bound) and whose sketches agree often enough for it."""
    least = least_agreement(threshold)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, M) for c in ("sa", "sb"))
            on = (np.minimum(na, nb) >= threshold * np.maximum(na, nb)) & ((x == y).sum(1) >= least)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(on)), b.column("b").filter(pa.array(on))], names=["a", "b"])

    return go


def _overlap(multiset: bool, run: int):
    """The similarity of every pair, from all its runs."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, PART):
                part = b.slice(lo, PART)
                at, code, count = (np.concatenate(x) for x in zip(*(_runs(part.column(c), multiset, run) for c in ("pa", "pb"))))
                order = np.argsort((at << 48) | code, kind="stable") if len(code) and 0 <= code.min() and code.max() < 1 << 48 else np.lexsort((code, at))
                at, code, count = at[order], code[order], count[order]
                twice = np.flatnonzero((at[1:] == at[:-1]) & (code[1:] == code[:-1]))
                both = np.bincount(at[twice], np.minimum(count[twice], count[twice + 1]), part.num_rows)
                every = np.bincount(at, count, part.num_rows) - both
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(both / np.maximum(every, 1))], names=["a", "b", "similarity"])

    return go


def near_duplicates(notes: DataFrame, threshold: float = THRESHOLD, run: int = RUN, least: int = LEAST, multiset: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    notes: path, pitches. members: path, cls; files with equal runs have one class. links: a, b, similarity of all
    classes found at the threshold or more (weighted Jaccard of the runs' counts with multiset, else of the
    distinct runs). Files with fewer than `least` distinct runs, null paths and null arrays are left out. Of
    several rows of a path the one with the greatest weight counts (ties: the greatest digest).

    Candidates share a band; those go on to the exact comparison whose weights and sketches allow the threshold.
    A pair at the threshold is missed by the bands with a probability of about 1e-6 and by the sketches with less
    than 1e-7. Runs are taken from the pitches wherever they are needed, as these are a tenth of their size.
    """
    rows = notes.filter("path is not null and pitches is not null").select("path", F.col("pitches").cast("array<int>").alias("pitches"))
    shaped = rows.mapInArrow(_shape(multiset, run, least), "path string, pitches array<int>, cls binary, n long")
    shaped = stash(shaped.withColumn("id", F.monotonically_increasing_id()), "shaped")  # written once, so the ids stay
    best = stash(shaped.groupBy("path").agg(F.max(F.struct("n", "cls", "id")).alias("m")).select("path", "m.cls", "m.id"), "best")
    classes = best.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("deg"))
    classes = stash(classes, "classes")
    members = salted_join(best.drop("id"), classes, "cls", "path", best.count()).select("path", F.col("rep").alias("cls"))
    members = stash(members, "members")
    unstash(best)
    reps = shaped.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    signed = stash(reps.select("id", "n", "pitches").mapInArrow(_signed(multiset, run), "id long, n long, keys array<long>, sketch binary"), "signed")
    pairs = stash(pairs_within(signed.select("id", F.explode("keys").alias("key")), "key", "id"), "candidates")
    side = lambda s: signed.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    likely = stash(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_likely(threshold), "a long, b long"), "likely")
    unstash(pairs)
    unstash(signed)
    of = lambda s: likely.join(shaped.select(F.col("id").alias(s), F.col("pitches").alias(f"p{s}")), s)
    links = of("a").join(of("b"), ["a", "b"]).mapInArrow(_overlap(multiset, run), "a long, b long, similarity double")
    links = stash(links.filter(F.col("similarity") >= threshold), "links")
    unstash(shaped)
    return members, links


def across(links: DataFrame, members: DataFrame) -> DataFrame:
    """(path_1, path_2) of all members of linked classes. The members of a class are dealt into blocks of CELL, and blocks joined with blocks, so that a hot class is many join keys."""
    size = stash(members.groupBy("cls").agg(F.count(F.lit(1)).alias("size")), "sizes")
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("deg"))
    blocks = stash(size.join(degree, "cls").withColumn("k", F.ceil(F.col("size") / CELL).cast("int")), "blocks")
    total = links.count()
    x = salted_join(links.select("a", "b"), blocks.select(F.col("cls").alias("a"), "deg", F.col("k").alias("ka")), "a", "b", total)
    x = salted_join(x, blocks.select(F.col("cls").alias("b"), "deg", F.col("k").alias("kb")), "b", "a", total)
    for s in "ab":
        x = x.withColumn(f"i{s}", F.explode(F.sequence(F.lit(0), F.col(f"k{s}") - 1)))
    m = salted_join(members, blocks.select("cls", F.col("size").alias("deg"), "k"), "cls", "path", members.count()).withColumn("i", F.pmod(F.xxhash64("path"), F.col("k")).cast("int"))
    for s, q in ("a", "p"), ("b", "q"):
        x = x.join(m.select(F.col("cls").alias(s), F.col("i").alias(f"i{s}"), F.col("path").alias(q)), [s, f"i{s}"])
    return x.select(F.least("p", "q").alias("path_1"), F.greatest("p", "q").alias("path_2"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of files, as TESTDATA.md fixes it: links between classes times their members, and the pairs within classes."""
    members, links = near_duplicates(table(spark, d, "file_notes"))
    return across(links, members).unionAll(pairs_within(members, "cls", "path").toDF("path_1", "path_2"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """path, class_id (the smallest path of its class), links (of its class to other classes), group (the smallest path it hangs together with), by the overlap of the runs' counts. One row for each file with enough runs."""
    members, links = near_duplicates(table(spark, d, "file_notes"), multiset=True)
    n = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    of = connected_components(links).toDF("cls", "part")
    classes = members.groupBy("cls").agg(F.min("path").alias("class_id"), F.count(F.lit(1)).alias("deg")).join(n, "cls", "left").join(of, "cls", "left")
    classes = stash(classes.withColumn("part", F.coalesce("part", "cls")), "classes")
    parts = classes.groupBy("part").agg(F.min("class_id").alias("group"), F.sum("deg").alias("deg"))
    total = members.count()
    classes = salted_join(classes.withColumnRenamed("deg", "size"), parts, "part", "cls", total).withColumnRenamed("size", "deg")
    out = salted_join(members, classes, "cls", "path", total)
    return out.select("path", "class_id", F.coalesce("links", F.lit(0)).alias("links"), "group")

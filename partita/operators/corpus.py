"""Corpus preparation: splits by hash, exact and MinHash duplicates, samples, sources, shard packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.operators.components import connected_components, salted_join
from partita.operators.positions import ranked
from partita.tables import stash, with_totals


def sha1_mod(text: Column, m: int = 1_000_000) -> Column:
    """The SHA-1 of text as a number, modulo m (below 2^31), folded from eight hex digits at a time."""
    h, out = F.sha1(text), F.lit(0).cast("long")
    for i in range(5):
        out = (out * (2**32 % m) + F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") % m) % m
    return out


def split_by_path(path: Column, val: float) -> Column:
    return F.when(sha1_mod(path) / F.lit(1e6) < val, "val").otherwise("train")


def parity(text: Column) -> Column:
    """SHA-1 of text modulo 2."""
    return F.conv(F.substring(F.sha1(text), 40, 1), 16, 10).cast("int") % 2


def keep_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key by order; rows with a null key are all kept. Aggregates before the shuffle, so a hot key is no hot task."""
    cols = df.columns
    first = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r")).select("_r.*")
    return first.unionByName(df.filter(F.col(key).isNull()))


# Known sources of the corpus layout: fixed values. The five detectors differ and are all kept.
LAYOUT = ("lakh", "lamd", "aria", "gigamidi", "maestro", "pop909", "giantmidi", "user", "fma")
PATTERNS = (("lakh", ("/lakh/", "/lmd_full/", "/lmd_matched/")), ("maestro", ("/maestro",)), ("pop909", ("/pop909/", "/pop909-")), ("giantmidi", ("/giantmidi",)), ("lamd", ("/lamd/", "/los-angeles-midi")))
RATED = ("lakh", "lamd", "aria", "gigamidi", "maestro", "pop909", "giantmidi")


def source_detectors(path: Column) -> dict[str, Column]:
    a = F.coalesce(*(F.when(path.contains(f"/raw/{s}/"), s) for s in LAYOUT))
    low = F.lower(path)
    b = F.coalesce(*(F.when(F.greatest(F.lit(False), *(low.contains(x) for x in ps)), s) for s, ps in PATTERNS), F.lit("other"))
    folder = F.regexp_extract(path, r"/raw/([^/]+)/", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return {
        "layout": a, "pattern": b, "rated": F.when(folder.isin(*RATED), folder).otherwise("unknown"), "prompt": F.when(folder.isin(*RATED), folder),
        "prefix": F.when(name.startswith("ableton"), "ableton").when(name.startswith("transcribed"), "fma").otherwise("other"),
    }


def guard(manifest: DataFrame, held_out: DataFrame, key: str = "stem") -> None:
    """Fails with a count and five examples if any held-out key is in the manifest."""
    bad = manifest.join(held_out.select(key).distinct(), key, "left_semi").select(key).distinct()
    n = bad.count()
    if n:
        raise ValueError(f"{n} held-out files in the manifest, such as {[r[0] for r in bad.orderBy(key).limit(5).collect()]}")


def group_summary(df: DataFrame, by: str) -> DataFrame:
    """Files, notes, medians, and the duration at index int(0.95 n) of the sorted durations, for each group.

    All columns' values are counted and ranked at once, over one range partition of (group, column, value), so no
    group has to fit into one task.
    """
    cols = ("n_notes", "duration_seconds", "n_tracks")
    df = stash(df.select(by, *cols), "sizes")
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_notes").alias("total_notes"))
    v = df.select(by, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols))).alias("v")).select(by, "v.*")
    v = v.filter("value is not null").filter(F.col(by).isNotNull()).groupBy(by, "column", "value").agg(F.count(F.lit(1)).alias("_c"))
    r = ranked(v, [by, "column"], [F.col("value")], weight="_c")
    r = r.join(r.groupBy(by, "column").agg(F.sum("_c").alias("_n")), [by, "column"])
    at = lambda c, k: F.max(F.when((F.col("column") == c) & (F.col("start") <= k) & (k < F.col("start") + F.col("_c")), F.col("value")))
    half = (F.col("_n") - 1) / F.lit(2.0)
    middle = lambda c: (at(c, F.floor(half)) + at(c, F.ceil(half))) / 2
    got = r.groupBy(by).agg(
        F.floor(middle("n_notes")).alias("median_notes"), F.round(middle("duration_seconds"), 1).alias("median_duration_s"), F.floor(middle("n_tracks")).alias("median_tracks"),
        F.round(at("duration_seconds", F.floor(F.col("_n") * F.lit(0.95))), 1).alias("p95_duration_s"),
    )
    return out.join(got, by, "left")


# ---- samples: hash order stands for a seeded shuffle ----


def shuffled(key: Column, seed: str = "0") -> Column:
    return F.sha1(F.concat_ws(":", F.lit(seed), key.cast("string")))


def sample_per_group(df: DataFrame, by: str, key: str, k: int, seed: str = "0") -> DataFrame:
    """k rows of each group, uniformly by hash order. Each task keeps its own k first; only those are shuffled by group."""
    d = df.withColumn("_h", shuffled(F.col(key), seed)).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(64)))
    near = Window.partitionBy(by, "_salt").orderBy("_h", key)
    d = d.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= k)
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("_h", key))).filter(F.col("_r") <= k)
    return d.drop("_h", "_salt", "_r")


def stratified(df: DataFrame, by: str, key: str, n: int, seed: str = "0") -> DataFrame:
    """max(1, round(n x share)) rows of each group, halves to even."""
    c = df.groupBy(by).agg(F.count(F.lit(1)).alias("_c"))
    c = with_totals(c, _t=F.sum("_c")).select(by, F.greatest(F.lit(1), F.bround(F.col("_c") * n / F.col("_t"))).cast("int").alias("_k"))
    d = df.withColumn("_h", shuffled(F.col(key), seed)).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(64))).join(c, by)
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_salt").orderBy("_h", key))).filter("_r <= _k")
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("_h", key))).filter("_r <= _k").drop("_h", "_salt", "_k", "_r")


def round_robin(df: DataFrame, by: str, key: str, n: int, seed: str = "0") -> DataFrame:
    """n rows dealt in turns from the groups in name order, with their turn. At most n rows of a group can matter."""
    d = sample_per_group(df, by, key, n, seed).withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(shuffled(F.col(key), seed), key)))
    return d.orderBy("turn", by).limit(n)


def quotas(sizes: DataFrame, n: int) -> DataFrame:
    """group, want: n shared by weight (halves to even); what a group cannot supply goes to those with room, by their room. sizes: group, weight, have."""
    t = with_totals(sizes, _w=F.sum("weight")).withColumn("want", F.bround(F.lit(n) * F.col("weight") / F.col("_w")).cast("long"))
    t = t.withColumn("room", F.greatest(F.col("have") - F.col("want"), F.lit(0)))
    t = with_totals(t, _short=F.sum(F.greatest(F.col("want") - F.col("have"), F.lit(0))), _room=F.sum("room"))
    more = F.when((F.col("room") > 0) & (F.col("_short") > 0), F.bround(F.col("_short") * F.col("room") / F.col("_room"))).otherwise(0).cast("long")
    return t.select("group", "have", F.least(F.col("want") + more, F.col("have")).alias("want"))


def blind_repeats(df: DataFrame, key: str, d: int, seed: str = "0") -> DataFrame:
    """All rows and d of them again, in a new order with an index. Rows: key, is_repeat, idx (from 0)."""
    again = df.select(key).orderBy(shuffled(F.col(key), seed + "r"), key).limit(d).withColumn("is_repeat", F.lit(True))
    rows = df.select(key, F.lit(False).alias("is_repeat")).unionByName(again)
    h = F.sha1(F.concat_ws(":", F.lit(seed + "o"), F.col(key).cast("string"), F.col("is_repeat").cast("string")))
    return ranked(rows.withColumn("_all", F.lit(0)).withColumn("_h", h), ["_all"], [F.col("_h"), F.col(key), F.col("is_repeat")]).select(key, "is_repeat", (F.col("pos") - 1).alias("idx"))


MOST_GROUPS = 1000


def weighted_pick(draws: DataFrame, weights: DataFrame, u: Column) -> DataFrame:
    """Each draw with the group whose stretch of the cumulative weights (in group order) holds u. weights: group, weight; at most MOST_GROUPS rows, which become one constant."""
    rows = sorted((r["group"], r["weight"]) for r in weights.filter("weight > 0").select("group", "weight").limit(MOST_GROUPS + 1).collect())
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    total, at, cuts = sum(w for _, w in rows), 0.0, []
    for g, w in rows:
        at += w
        cuts.append(F.struct(F.lit(at / total).alias("hi"), F.lit(g).alias("group")))
    return draws.withColumn("group", F.try_element_at(F.filter(F.array(*cuts), lambda x: x["hi"] > u), F.lit(1))["group"] if cuts else F.lit(None).cast("string"))


def shard_packing(docs: DataFrame, by: list[str], order: list[Column], shard: int, size: str = "tokens") -> DataFrame:
    """doc parts by shard: each group's documents laid end to end by order and cut at exactly `shard` tokens.

    Adds shard, offset (in the shard), first (in the document) and take; a document that straddles a cut has a row for each shard.
    """
    x = ranked(docs.filter(F.col(size) > 0), by, order, weight=size)
    x = x.withColumn("shard", F.explode(F.sequence(F.floor(F.col("start") / shard), F.floor((F.col("start") + F.col(size) - 1) / shard))))
    lo = F.greatest(F.col("start"), F.col("shard") * shard)
    hi = F.least(F.col("start") + F.col(size), (F.col("shard") + 1) * shard)
    return x.withColumn("offset", lo - F.col("shard") * shard).withColumn("first", lo - F.col("start")).withColumn("take", hi - lo).drop("start", "pos")


# ---- MinHash duplicates ----

NGRAM, HASHES, BANDS, LEAST, THRESHOLD, MOST_IN_BUCKET = 6, 128, 32, 64, 0.65, 200
MERSENNE = (1 << 61) - 1


def hash_family(n: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(0)
    return rng.integers(1, MERSENNE, size=n, dtype=np.uint64), rng.integers(0, MERSENNE, size=n, dtype=np.uint64)


def sorted_within(at: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes in ascending order within each row `at`, and rows in order. Codes of 48 bits are sorted together with their row as one number."""
    if len(at) and at.max() < 1 << 15 and code.min() >= 0 and code.max() < 1 << 48:
        both = np.sort((at.astype(np.int64) << 48) | code)
        return both >> 48, both & ((1 << 48) - 1)
    order = np.lexsort((code, at))
    return at[order], code[order]


def shingled(df: DataFrame, key: str, pitches: str, n: int = NGRAM) -> DataFrame:
    """(key, sh): distinct hashes, ascending, of the n-grams of pitch steps: sum of (step + 128) x 131^i. Null pitches are passed over; rows below n + 1 pitches are left out."""
    power = 131 ** np.arange(n, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            col = rb.column(1)
            row = np.repeat(np.arange(rb.num_rows), np.asarray(col.value_lengths().fill_null(0)))
            values = col.flatten()
            there = np.asarray(values.is_valid())
            row, x = row[there], np.asarray(values.fill_null(0)).astype(np.int64)[there]
            size = np.bincount(row, minlength=rb.num_rows)
            code, at = np.zeros(max(0, len(x) - n), dtype=np.int64), row[: max(0, len(x) - n)]
            for i, p in enumerate(power):
                code += (x[i + 1 : i + 1 + len(code)] - x[i : i + len(code)] + 128) * p
            inside = np.arange(len(code)) + n < np.cumsum(size)[at]
            at, code = at[inside], code[inside]
            at, code = sorted_within(at, code)
            new = np.ones(len(at), dtype=bool)
            new[1:] = (at[1:] != at[:-1]) | (code[1:] != code[:-1])
            at, code = at[new], code[new]
            keep = np.flatnonzero(size > n)
            ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=rb.num_rows)[keep])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(keep)), pa.ListArray.from_arrays(pa.array(ends), pa.array(code))], names=[key, "sh"])

    return df.select(key, pitches).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, sh array<bigint>")


#: Shingles hashed at a time, so that a batch's work stays in the processor's cache.
AT_ONCE = 50_000


def minhash(df: DataFrame, key: str, sh: str) -> DataFrame:
    """(key, sig): HASHES minima of (a x + b mod 2^64) mod 2^61 - 1, with unsigned wrap-around, over whole Arrow batches."""
    a, b = hash_family()
    m, bits = np.uint64(MERSENNE), np.uint64(61)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            sizes = np.asarray(rb.column(1).value_lengths()).astype(np.int64)
            ends, x = np.concatenate([[0], np.cumsum(sizes)]), rb.column(1).flatten().to_numpy().view(np.uint64)
            sig, lo = np.empty((rb.num_rows, HASHES), dtype=np.uint64), 0
            while lo < rb.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + AT_ONCE, "right")) - 1)
                part, begins = x[ends[lo] : ends[hi]], ends[lo:hi] - ends[lo]
                with np.errstate(over="ignore"):
                    for k in range(HASHES):
                        h = part * a[k] + b[k]
                        h = (h & m) + (h >> bits)  # the remainder, or up to 7 above it
                        h = np.where(h >= m, h - m, h)
                        sig[lo:hi, k] = np.minimum.reduceat(h, begins)
                lo = hi
            flat = pa.FixedSizeListArray.from_arrays(pa.array(sig.view(np.int64).ravel()), HASHES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([rb.column(0), flat], names=[key, "sig"])

    return df.filter(F.size(sh) > 0).select(key, sh).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, sig array<bigint>")


def _bands(sigs: DataFrame, key: str) -> DataFrame:
    rows = HASHES // BANDS
    return sigs.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * rows + 1, rows)))).alias("band"))


def _alike(cand: DataFrame, sigs: DataFrame, key: str, threshold: float) -> DataFrame:
    """(a, b, similarity) of the candidates whose signatures agree enough."""
    x = cand.join(sigs.select(F.col(key).alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col(key).alias("b"), F.col("sig").alias("sb")), "b")
    same = F.aggregate(F.zip_with("sa", "sb", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v) / F.lit(float(HASHES))
    return x.select("a", "b", same.alias("similarity")).filter(F.col("similarity") >= threshold)


def lsh_links(sigs: DataFrame, key: str, most: int | None = MOST_IN_BUCKET, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity): each member of a band bucket linked to the bucket's first member if their signatures agree enough.

    Star links only, so a bucket of n members gives n - 1 candidates, however large it is. Buckets of over `most`
    members are passed over as the reference semantics ask; with most=None none is. lsh_components misses neither.
    """
    band = _bands(sigs, key)
    first = band.groupBy("band").agg(F.min(key).alias("anchor"), F.count(F.lit(1)).alias("deg")).filter(F.col("deg") > 1)
    if most:
        first = first.filter(F.col("deg") <= most)
    cand = salted_join(band, first, "band", key, band.count()).filter(F.col("anchor") < F.col(key)).select(F.col("anchor").alias("a"), F.col(key).alias("b")).distinct()
    return _alike(cand, sigs, key, threshold)


#: Members of a bucket are paired block by block, so that no task gets all pairs of a hot bucket.
BLOCK = 500


def lsh_components(sigs: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component) over all pairs that share a band bucket, of any size, and agree enough.

    Star links come first. Pairs they leave in one component can't change it, so only buckets that still hold
    several components are paired in full, across components.
    """
    cc = stash(connected_components(lsh_links(sigs, key, None, threshold).select("a", "b")), "stars")
    band = _bands(sigs, key).join(cc.withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("component", key))
    open_ = band.groupBy("band").agg(F.count(F.lit(1)).alias("deg"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    x = salted_join(band, open_.select("band", "deg", F.ceil(F.col("deg") / BLOCK).cast("int").alias("blocks")), "band", key, band.count())
    x = x.withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = stash(x.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), key, "component"), "blocks")
    p, q = x.select("band", "i", "j", F.col(key).alias("a"), F.col("component").alias("ca")), x.select("band", "i", "j", F.col(key).alias("b"), F.col("component").alias("cb"))
    cand = p.join(q, ["band", "i", "j"]).filter("a < b and ca <> cb").select("a", "b").distinct()
    more = _alike(cand, sigs, key, threshold)
    comp = lambda c: cc.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    more = stash(more.join(comp("a"), "a", "left").join(comp("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "more")
    up = stash(connected_components(more), "merged")
    all_ = cc.unionByName(up.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
    return all_.join(up.select(F.col("node").alias("component"), F.col("component").alias("m")), "component", "left").select("node", F.coalesce("m", "component").alias("component"))


def whole_clusters(files: DataFrame) -> DataFrame:
    """duplicate_clusters without its cap on buckets and over all pairs of a bucket: equal shingle sets are one class, classes hang together by lsh_components."""
    f = _by_path(files)
    sh = shingled(f, "path", "pitches").filter(F.size("sh") >= LEAST)
    sh = stash(sh.withColumn("class", F.sha2(F.array_join(F.col("sh").cast("array<string>"), ","), 256)), "shingles")
    first = stash(sh.groupBy("class").agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("deg")), "classes")
    of = stash(salted_join(sh.select("class", "path"), first, "class", "path", sh.count()).select("path", "first"), "copies")
    one = sh.join(first.select(F.col("first").alias("path")), "path", "left_semi")
    cc = lsh_components(stash(minhash(one, "path", "sh"), "sigs"), "path").withColumnRenamed("node", "first")
    x = first.join(cc, "first", "left").filter("component is not null or deg > 1").select("first", F.coalesce("component", "first").alias("component"), "deg")
    return _with_keepers(salted_join(of, x, "first", "path", sh.count()).select(F.col("path").alias("node"), "component"), f)


def _by_path(files: DataFrame) -> DataFrame:
    f = files.filter("path is not null").groupBy("path").agg(F.max("n_notes").alias("n_notes"), F.max(F.struct(F.size("pitches"), F.col("pitches"))).alias("p")).select("path", "n_notes", F.col("p.pitches").alias("pitches"))
    return stash(f, "files")


def _with_keepers(cc: DataFrame, f: DataFrame) -> DataFrame:
    x = cc.join(f.select(F.col("path").alias("node"), "n_notes"), "node")
    keep = x.groupBy("component").agg(F.min_by("node", F.struct(-F.coalesce("n_notes", F.lit(0)), F.col("node"))).alias("keeper"), F.count(F.lit(1)).alias("deg"))
    return salted_join(x, keep, "component", "node", x.count()).select(F.col("node").alias("path"), F.col("component").alias("cluster"), "keeper")


def duplicate_clusters(files: DataFrame) -> DataFrame:
    """path, cluster (its smallest path), keeper: files (path, pitches, n_notes) that hang together by MinHash links; the keeper has the most notes, the smallest path of equals."""
    f = _by_path(files)
    sh = shingled(f, "path", "pitches").filter(F.size("sh") >= LEAST)
    links = lsh_links(stash(minhash(sh, "path", "sh"), "sigs"), "path")
    return _with_keepers(connected_components(links.select("a", "b")), f)


def content_hash(notes: DataFrame) -> DataFrame:
    """file_id, content_hash: SHA-1 over each note's pitch (u16), start and duration (u64), little-endian, in track and note order."""
    le = lambda c, n: F.concat(*(F.substring(F.lpad(F.hex(c.cast("long")), 16, "0"), 17 - 2 * (i + 1), 2) for i in range(n)))
    packed = F.concat(le(F.col("pitch"), 2), le(F.col("start"), 8), le(F.col("duration"), 8))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("track_name", "note_idx", packed.alias("h")))), lambda s: s["h"])
    return notes.groupBy("file_id").agg(F.sha1(F.unhex(F.array_join(rows, ""))).alias("content_hash"))

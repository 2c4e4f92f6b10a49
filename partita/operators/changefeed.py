"""Applying a feed of inserts, updates and deletes with delete vectors.

A `VectorTable` is a set of Parquet files that are never rewritten. Its index, a table of its own in buckets by
key, holds the file and position of every row written; the rows a change supersedes are found through it, and
their positions become bits of per-file bitmaps (words of 64 rows); new images are appended as new files; a read
filters the positions whose bit is set. A `Feed` keeps such a table at the state after all batches applied so far.
"""

from __future__ import annotations

import bisect
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partita.operators.positions import ranked
from partita.tables import shared_dir, stash

#: Events of one group that a single task folds at first; longer groups are cut by time and their cuts merged.
CHUNK = 20_000
#: Rows of the index in one of its buckets, as far as the first batch tells.
BUCKET_ROWS = 1_000_000


FILE = r"/batch=(\d+)/part-(\d+)-.*c(\d+)\.[^/]*$"


class VectorTable:
    """Files, their delete vectors and the key-to-position index of one table in the shared folder."""

    def __init__(self, spark: SparkSession, keys: list[str]):
        self.spark, self.keys = spark, keys
        self.name = uuid.uuid4().hex[:10]
        self.root = f"{shared_dir(spark)}/vectors-{self.name}"
        self.batches, self.marks, self.buckets = 0, 0, 0
        self.schema = None

    def append(self, rows: DataFrame) -> None:
        """Adds rows as new files and their positions to the index."""
        self.schema = self.schema or rows.schema
        at = f"{self.root}/batch={self.batches:05d}"
        rows.select(*self.schema.names).write.parquet(at)
        new = self._numbered(self.spark.read.schema(self.schema).parquet(at)).select(*self.keys, "_file", "_pos")
        self.buckets = self.buckets or 4 + new.count() // BUCKET_ROWS
        new.repartition(self.buckets, *self.keys).write.mode("append").bucketBy(self.buckets, *self.keys).option("path", f"{self.root}/index").saveAsTable(f"partita_index_{self.name}")
        self.batches += 1

    @staticmethod
    def _numbered(df: DataFrame) -> DataFrame:
        """df with the number of each row's file (from its batch, task and count within the task) and the row's place in it."""
        part = lambda k: F.regexp_extract("_metadata.file_path", FILE, k).cast("long")
        return df.withColumns({"_file": part(1) * 2**40 + part(2) * 2**10 + part(3), "_pos": F.col("_metadata.row_index")})

    def index(self) -> DataFrame:
        """The file and position of every row written under a key, superseded or not. A row once superseded stays so; marking it again changes nothing."""
        return self.spark.table(f"partita_index_{self.name}")

    def supersede(self, keys: DataFrame) -> None:
        """Sets the bits of all rows written so far under these keys."""
        hit = self.index().join(keys.select(*self.keys), self.keys, "left_semi")
        word = hit.groupBy("_file", F.shiftright("_pos", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_pos % 64 as int))")).alias("_bits"))
        word.write.parquet(f"{self.root}/mark={self.marks:05d}")
        self.marks += 1

    def _vectors(self) -> DataFrame:
        """_file, _word, _bits over all marks."""
        v = self.spark.read.schema("_file long, _word long, _bits long").parquet(*(f"{self.root}/mark={i:05d}" for i in range(self.marks)))
        return v.groupBy("_file", "_word").agg(F.bit_or("_bits").alias("_bits")) if self.marks > 1 else v

    def read(self) -> DataFrame:
        """The current rows. Files without a mark are read as they are; the list of marked ones has at most a row for each file."""
        scan = lambda p: self.spark.read.schema(self.schema).parquet(*p)
        paths = [f"{self.root}/batch={i:05d}" for i in range(self.batches)]
        if not self.marks:
            return scan(paths)
        marks = self._vectors()
        marked = {r[0] for r in marks.select("_file").distinct().toLocalIterator()}
        clean, dirty = [], []
        for f in (f for p in paths for f in scan([p]).inputFiles()):
            b, task, k = map(int, re.search(FILE, f).groups())
            (dirty if (b << 40) + (task << 10) + k in marked else clean).append(f)
        out = scan(clean) if clean else self.spark.createDataFrame([], self.schema)
        if dirty:
            rows = self._numbered(scan(dirty)).withColumn("_word", F.shiftright("_pos", 6)).join(marks, ["_file", "_word"], "left")
            rows = rows.filter("_bits is null or bit_get(_bits, cast(_pos % 64 as int)) = 0").select(*self.schema.names)
            out = out.unionByName(rows) if clean else rows
        return out


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """Gives each change without a target the newest row standing at its time, in time order within each (group, cut).

    kind 0: a row is added (t its time, death the time it is deleted by name or None); 1: update; 2: delete.
    Returns the resolved changes, those for which nothing stood in the cut, and the rows standing at its end.
    """
    pdf = pdf.sort_values(["grp", "cut", "t", "kind", "row"], kind="stable", na_position="first")
    stack: list[tuple[int, str, int | None]] = []
    out, at = [], None
    cols = (pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in ("grp", "cut", "t", "kind", "row", "death", "change"))
    for grp, cut, t, kind, row, death, change in zip(*cols):
        if (grp, cut) != at:
            if at:
                out += [(*at, None, r, x, 0, d, True) for x, r, d in stack]
            stack, at = [], (grp, cut)
        if kind == 0:
            stack.append((t, row, death))
            continue
        while stack and stack[-1][2] is not None and stack[-1][2] <= t:
            stack.pop()
        out.append((grp, cut, change, stack[-1][1] if stack else None, t, kind, None, False))
        if stack and kind == 2:
            stack.pop()
    if at:
        out += [(*at, None, r, x, 0, d, True) for x, r, d in stack]
    return pd.DataFrame(out, columns=["grp", "cut", "change", "row", "t", "kind", "death", "left"]).astype({"death": "Int64"})


def _outlived(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows left by cuts that later changes can still reach: those with fewer than `need` newer ones of their cut that live as long."""
    pdf = pdf.sort_values(["grp", "cut", "t", "row"], ascending=False, kind="stable")
    keep, at, deaths = [], None, []
    ends = pdf["death"].astype(object).where(pdf["death"].notna(), None)
    for key, need, death in zip(zip(pdf["grp"], pdf["cut"]), pdf["need"], ends):
        if key != at:
            at, deaths = key, []
        end = float("inf") if death is None else death
        on = len(deaths) - bisect.bisect_left(deaths, end) < need
        if on:
            bisect.insort(deaths, end)
        keep.append(on)
    return pdf[keep]


FOLDED = "grp string, cut long, change string, row string, t long, kind int, death long, left boolean"


def _in_tasks(ev: DataFrame, do, schema: str) -> DataFrame:
    """`do` over tasks of about CHUNK events, each holding whole (group, cut)s."""
    n = max(1, -(-ev.count() // CHUNK))
    of = F.pmod(F.xxhash64("grp", "cut"), F.lit(n))
    return ev.withColumn("_of", of).groupBy("_of").applyInPandas(lambda pdf: do(pdf.drop(columns="_of")), schema)


def resolve_unnamed(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """(change, row): for each change that names no row, the newest row of its group standing at its time.

    rows: grp, row, t, death (the time of the row's deletion by name, or null); changes: grp, change, t, kind
    (1 update, 2 delete). Only groups with such changes are touched. A group longer than CHUNK events is cut by
    time and every cut folded by itself; then the changes that found nothing in their cut are folded over what
    earlier cuts left, in cuts of eight times as many events, until each has met all earlier ones. Of what a cut
    leaves only the rows go on that die after the next such change and have fewer newer rows of their cut that
    live as long than there are such changes: unless almost all changes of a hot group name no row, far fewer
    than come in, so the growing cuts stay small.
    """
    groups = changes.select("grp").distinct()
    ev = rows.join(groups, "grp", "left_semi").select("grp", "row", "t", F.lit(0).alias("kind"), "death", F.lit(None).cast("string").alias("change"))
    ev = ev.unionByName(changes.select("grp", F.lit(None).cast("string").alias("row"), "t", "kind", F.lit(None).cast("long").alias("death"), "change"))
    chunk, found = CHUNK, None
    while True:
        ev = ranked(ev, ["grp"], [F.col("t"), F.col("kind"), F.col("row"), F.col("change")]).withColumn("cut", F.floor((F.col("pos") - 1) / chunk)).drop("pos")
        done = stash(_in_tasks(stash(ev, "cuts"), _fold, FOLDED), "folded")
        hit = done.filter("kind > 0 and row is not null").select("change", "row")
        found = hit if found is None else found.unionByName(hit)
        open_ = done.filter("kind > 0 and row is null and cut > 0")
        if open_.limit(1).count() == 0:
            return found
        later = Window.partitionBy("grp").orderBy("cut").rowsBetween(1, Window.unboundedFollowing)
        cuts = done.groupBy("grp", "cut").agg(F.count(F.when(F.col("kind") > 0, F.when(F.col("row").isNull(), 1))).alias("n"), F.min(F.when((F.col("kind") > 0) & F.col("row").isNull(), F.col("t"))).alias("t0"))
        cuts = cuts.select("grp", "cut", F.sum("n").over(later).alias("need"), F.min("t0").over(later).alias("next")).filter("need > 0")
        left = done.filter("left").join(cuts, ["grp", "cut"]).filter("death is null or death > next").select("grp", "cut", "row", "t", "death", "need")
        left = _in_tasks(stash(left, "left"), _outlived, "grp string, cut long, row string, t long, death long, need long")
        ev = left.select("grp", "row", "t", F.lit(0).alias("kind"), "death", F.lit(None).cast("string").alias("change")).unionByName(open_.select("grp", "row", "t", "kind", "death", "change"))
        chunk *= 8


def images(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """grp, row, value, death of each row that a change reaches, by all changes of its group: its last value, or the time of its deletion. Both tables should be written ones."""
    named = changes.filter("target_t is not null").alias("c").join(rows.alias("r"), (F.col("c.grp") == F.col("r.grp")) & (F.col("c.target_t") == F.col("r.t")))
    named = stash(named.select("c.grp", "c.change", "c.t", "c.kind", "c.value", "r.row", F.col("r.t").alias("added")), "named")
    death = named.filter("kind = 2 and t >= added").groupBy("grp", "row").agg(F.min("t").alias("death"))
    unnamed = stash(changes.filter("target_t is null"), "unnamed")
    touched = stash(rows.join(unnamed.select("grp").distinct(), "grp", "left_semi"), "touched")
    found = resolve_unnamed(touched.join(death, ["grp", "row"], "left"), unnamed)
    unnamed = unnamed.join(found, "change").join(touched.select("grp", "row", F.col("t").alias("added")), ["grp", "row"])
    every = stash(named.unionByName(unnamed.select("grp", "change", "t", "kind", "value", "row", "added")).filter("t >= added"), "every")
    death = every.filter("kind = 2").groupBy("grp", "row").agg(F.min("t").alias("death"))
    last = every.filter("kind = 1").join(death, ["grp", "row"], "left").filter("death is null or t <= death").groupBy("grp", "row").agg(F.max_by("value", F.struct("t", "change")).alias("value"))
    return last.join(death, ["grp", "row"], "full_outer")


class Feed:
    """The state of a table under a feed whose batches may come late, repeated and in any order.

    A batch has rows: grp, row (unique in grp), t (long), value and, optionally, prio; and changes: grp, change
    (unique), t (long), kind (1 update, 2 delete), target_t (the row's t, or null: the newest standing row),
    value. Within a batch each row and change comes once. Of a row delivered by several batches the smallest prio
    counts; a change delivered again is passed over. A batch is applied by finding the groups it names, working
    out the images of their rows from all rows and changes of these groups delivered so far, superseding what the
    table holds of the rows reached now or before, and appending the new images. The state after any split of the
    feed into batches is that after one batch.

    An update or delete of a row that does not stand at its time (not yet added, deleted before, never added) has
    no effect. Two changes of one row at one time apply updates first, then by change id. Rows with null t or grp
    must have been left out. Empty batches are allowed.
    """

    ROWS, CHANGES = ("grp", "row", "t", "value", "prio"), ("grp", "change", "t", "kind", "target_t", "value")

    def __init__(self, spark: SparkSession):
        self.table = VectorTable(spark, ["grp", "row"])
        self.rows: list[DataFrame] = []
        self.changes: list[DataFrame] = []
        self.images: DataFrame | None = None

    @staticmethod
    def _all(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _base(self) -> DataFrame:
        """Each row delivered so far, with its smallest prio."""
        if len(self.rows) == 1:
            return self.rows[0]
        return self._all(self.rows).groupBy("grp", "row").agg(F.min(F.struct("prio", "t", "value")).alias("v")).select("grp", "row", "v.t", "v.value", "v.prio")

    def apply(self, rows: DataFrame | None = None, changes: DataFrame | None = None) -> None:
        if rows is None and changes is None:
            return
        new, again, first = None, None, not self.rows
        if rows is not None:
            new = rows if "prio" in rows.columns else rows.withColumn("prio", F.lit(0))
            new = new.select(*self.ROWS)
            if self.rows:
                known = self._base().select("grp", "row", F.col("prio").alias("_prio"))
                new = new.join(known, ["grp", "row"], "left").filter("_prio is null or prio < _prio").withColumn("_again", F.col("_prio").isNotNull()).drop("_prio")
                new = stash(new, "rows")
                again, new = new.filter("_again").select("grp", "row"), new.drop("_again")
            else:
                new = stash(new, "rows")
            self.rows.append(new)
            self.table.append(new.select("grp", "row", "t", "value", F.lit(False).alias("touched")))
        if changes is not None and self.rows:
            more = changes.select(*self.CHANGES)
            if self.changes:
                more = more.join(self._all(self.changes).select("grp", "change"), ["grp", "change"], "left_anti")
            more = stash(more, "changes")
            self.changes.append(more)
        elif changes is not None:
            raise ValueError("the first batch must have rows; they may be none")
        if not self.changes and again is None:
            return
        every, base = (self._all(self.changes) if self.changes else None), self._base()
        if first or (len(self.rows) == 1 and len(self.changes) == 1):
            of = lambda df: df
        else:
            groups = [x.select("grp") for x in (new, more if changes is not None else None) if x is not None]
            groups = stash(self._all(groups).distinct(), "groups")
            of = lambda df: df.join(groups, "grp", "left_semi")
            base = stash(of(base), "base")
            every = stash(of(every), "log") if every is not None else None
        now = stash(images(base, every), "images") if every is not None else None
        keys = [x for x in (now, again, of(self.images) if self.images is not None else None) if x is not None]
        keys = self._all([x.select("grp", "row") for x in keys])
        keys = stash(keys.distinct() if len(self.rows) + len(self.changes) > 2 else keys, "keys")
        self.table.supersede(keys)
        out = base.join(keys, ["grp", "row"])
        if now is not None:
            out = out.join(now.select("grp", "row", F.col("value").alias("_value"), "death", F.lit(True).alias("touched")), ["grp", "row"], "left").filter("death is null")
            out = out.select("grp", "row", "t", F.when(F.col("touched"), F.col("_value")).otherwise(F.col("value")).alias("value"), F.coalesce("touched", F.lit(False)).alias("touched"))
        else:
            out = out.select("grp", "row", "t", "value", F.lit(False).alias("touched"))
        self.table.append(out)
        if now is not None:
            kept = self.images.join(groups, "grp", "left_anti") if self.images is not None else None
            self.images = now if kept is None else stash(kept.unionByName(now), "images")

    def read(self) -> DataFrame:
        """grp, row, t, value, touched (whether an update has reached it) of each standing row."""
        return self.table.read()


def apply_changes(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows as they stand after all changes, as a feed of two batches: the inserts, then what changes them."""
    feed = Feed(rows.sparkSession)
    feed.apply(rows)
    feed.apply(changes=changes)
    return feed.read()

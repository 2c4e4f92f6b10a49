"""The vote log: votes, the changes made to them, and their state after all changes (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.operators.changefeed import Feed
from partita.tables import table


def _micros(c: str):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")


def _row_id(session: str, t: str):
    return F.concat_ws("|", F.lpad(F.col(t).cast("string"), 20, "0"), F.coalesce(F.col(session), F.lit("")))


def cast_votes(labels: DataFrame, more: tuple = ("preferred", "left_is", "right_is", "left_model", "right_model")) -> DataFrame:
    """One row for each vote (pair_id, session_id, ts) as it was cast: pair_id, session_id, t, choice, the columns of `more`, prio.

    Rows with null or empty pair_id or null ts are no votes. Repeated rows count once; a vote of which only a
    corrected state was delivered was cast as `corrected_from`. Of conflicting rows of one vote the row as cast
    goes first, then the smallest values; prio is what decides.
    """
    later = F.col("corrected_from").isNotNull()
    v = labels.filter("pair_id <> '' and ts is not null").select(
        "pair_id", F.coalesce("session_id", F.lit("")).alias("session_id"), _micros("ts").alias("t"), later.alias("later"), F.coalesce("corrected_from", "choice").alias("choice"),
        *(F.when(~later, F.col(c)).alias(c) if c == "preferred" else F.col(c) for c in more),
    )
    first = F.struct("later", F.col("choice").isNull().alias("n"), "choice", *more)
    return v.groupBy("pair_id", "session_id", "t").agg(F.min(first).alias("v")).select("pair_id", "session_id", "t", "v.choice", *(f"v.{c}" for c in more), F.struct("v.later", "v.n", "v.choice").alias("prio"))


def vote_changes(labels: DataFrame, corrections: DataFrame) -> DataFrame:
    """Each distinct change once: pair_id, t, kind (1 set, 2 undo), target_t (null: names no vote), value."""
    late = labels.filter("pair_id <> '' and ts is not null and corrected_from is not null and corrected_at is not null")
    late = late.select("pair_id", _micros("corrected_at").alias("t"), F.lit(1).alias("kind"), _micros("ts").alias("target_t"), F.col("choice").alias("value"))
    c = corrections.withColumn("pair_id", F.coalesce(F.expr("nullif(pair_id, '')"), F.expr("nullif(original.pair_id, '')"), F.expr("nullif(removed.pair_id, '')")))
    c = c.filter("pair_id is not null and ts is not null").withColumn("_a", F.regexp_replace(F.lower(F.coalesce("action", F.lit(""))), r"\s+", ""))
    undo = F.col("_a") == "undo"
    c = c.filter(undo | ((F.col("_a") == "") & F.coalesce("to_choice", "new_choice").isNotNull())).select(
        "pair_id", _micros("ts").alias("t"), F.when(undo, 2).otherwise(1).alias("kind"),
        F.when(undo, _micros("removed.ts")).otherwise(_micros("original.ts")).alias("target_t"),
        F.when(~undo, F.coalesce("to_choice", "new_choice")).alias("value"),
    )
    return late.unionByName(c).distinct()


def vote_rows(labels: DataFrame) -> DataFrame:
    """The votes as rows of a feed: grp (pair), row, t, value (choice), prio."""
    return cast_votes(labels, ()).select(F.col("pair_id").alias("grp"), _row_id("session_id", "t").alias("row"), "t", F.col("choice").alias("value"), "prio")


def change_rows(labels: DataFrame, corrections: DataFrame) -> DataFrame:
    """The changes as changes of a feed; `change` is made of all they say."""
    ch = vote_changes(labels, corrections).withColumnRenamed("pair_id", "grp")
    return ch.withColumn("change", F.concat_ws("|", F.lpad(F.col("t").cast("string"), 20, "0"), "kind", F.sha1(F.to_json(F.struct("grp", "t", "kind", "target_t", "value")))))


def standing_votes(labels: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(standing, cast): the votes that stand after all changes (grp, row, t, value, touched), and all votes as cast. Empty tables give empty results."""
    feed = Feed(labels.sparkSession)
    feed.apply(vote_rows(labels))
    feed.apply(changes=change_rows(labels, corrections))
    return feed.read(), feed.rows[0]


def _newest(standing: DataFrame) -> DataFrame:
    return standing.groupBy(F.col("grp").alias("pair_id")).agg(F.max_by("value", "row").alias("choice"), F.count(F.lit(1)).alias("standing"))


def newest_standing(labels: DataFrame, corrections: DataFrame) -> DataFrame:
    """pair_id, choice, standing: the newest standing vote of each pair and how many of its votes stand."""
    return _newest(standing_votes(labels, corrections)[0])


def p3_state(spark: SparkSession, d: str) -> DataFrame:
    return newest_standing(table(spark, d, "labels"), table(spark, d, "corrections"))


def p3_feed(spark: SparkSession, d: str, batches: int = 3) -> DataFrame:
    """p3_state by a feed of several batches, cut at even times of delivery; rows without one come first."""
    labels, corrections = table(spark, d, "labels"), table(spark, d, "corrections")
    at = labels.select(_micros("ingested_at").alias("t")).unionAll(corrections.select(_micros("ingested_at"))).agg(F.min("t"), F.max("t")).first()
    lo, hi = at[0] or 0, (at[1] or 0) + 1
    feed = Feed(spark)
    for b in range(batches):
        i = F.coalesce(F.floor((_micros("ingested_at") - lo) * batches / (hi - lo)), F.lit(0)) == b
        feed.apply(vote_rows(labels.filter(i)), change_rows(labels.filter(i), corrections.filter(i)))
    return _newest(feed.read())


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    labels, corrections = table(spark, d, "labels"), table(spark, d, "corrections")
    standing, cast = standing_votes(labels, corrections)
    case = corrections.select(F.coalesce(F.expr("nullif(pair_id, '')"), F.col("original.pair_id"), F.col("removed.pair_id")).alias("grp")).unionAll(labels.filter("corrected_from is not null").select("pair_id")).filter("grp <> ''")
    # one pass over the pairs: what stands, how many votes were cast, and whether a change names them
    none, zero, one = F.lit(None).cast("string"), F.lit(0), F.lit(1)
    every = standing.select("grp", "row", "value", zero.alias("cast"), zero.alias("case")).unionAll(cast.select("grp", none, none, one, zero)).unionAll(case.select("grp", none, none, zero, one))
    found = every.groupBy(F.col("grp").alias("pair_id")).agg(F.max(F.when(F.col("row").isNotNull(), F.struct("row", "value"))).alias("v"), F.sum("cast").alias("n"), F.sum("case").alias("c"))
    return found.filter("v is not null and (n > 1 or c > 0)").select("pair_id", F.col("v.value").alias("choice"))


QUERIES = {"p3_found": p3_found, "p3_state": p3_state, "p3_feed": p3_feed}

_STATE = r"""WITH RECURSIVE lb AS (SELECT DISTINCT pair_id, coalesce(session_id, '') AS session_id, epoch_us(ts) AS t, corrected_from IS NOT NULL AS later, coalesce(corrected_from, choice) AS choice, choice AS now, epoch_us(corrected_at) AS cat
   FROM labels WHERE pair_id <> '' AND ts IS NOT NULL),
 v AS (SELECT pair_id, session_id, t, choice FROM lb QUALIFY row_number() OVER (PARTITION BY pair_id, session_id, t ORDER BY later, choice IS NULL, choice) = 1),
 cc AS (SELECT coalesce(nullif(pair_id, ''), nullif(original.pair_id, ''), nullif(removed.pair_id, '')) AS pair_id, epoch_us(ts) AS t, regexp_replace(lower(coalesce(action, '')), '\s+', '', 'g') AS a, coalesce(to_choice, new_choice) AS value, epoch_us(original.ts) AS o, epoch_us(removed.ts) AS r FROM corrections),
 ch AS (SELECT pair_id, cat AS t, 1 AS kind, t AS target, now AS value FROM lb WHERE later AND cat IS NOT NULL UNION SELECT pair_id, t, CASE WHEN a = 'undo' THEN 2 ELSE 1 END, CASE WHEN a = 'undo' THEN r ELSE o END, CASE WHEN a <> 'undo' THEN value END
   FROM cc WHERE pair_id IS NOT NULL AND t IS NOT NULL AND (a = 'undo' OR (a = '' AND value IS NOT NULL))),
 ev AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY t, kind, target, value) AS i FROM (SELECT pair_id, t, 0 AS kind, t AS target, choice AS value FROM v UNION ALL SELECT * FROM ch)),
 st AS (SELECT DISTINCT pair_id, 0::BIGINT AS i, []::STRUCT(t BIGINT, c VARCHAR)[] AS s FROM ev UNION ALL
  SELECT st.pair_id, ev.i, CASE kind WHEN 0 THEN list_append(s, {'t': ev.t, 'c': value}) WHEN 1 THEN list_transform(s, lambda x: CASE WHEN x.t = coalesce(target, s[-1].t) THEN {'t': x.t, 'c': value} ELSE x END)
    ELSE list_filter(s, lambda x: x.t <> coalesce(target, s[-1].t)) END FROM st JOIN ev ON ev.pair_id = st.pair_id AND ev.i = st.i + 1),
 fin AS (SELECT pair_id, s FROM st QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY i DESC) = 1),
 out AS (SELECT pair_id, s[-1].c AS choice, len(s)::BIGINT AS standing FROM fin WHERE len(s) > 0)"""

ORACLE = {
    "p3_state": f"{_STATE} SELECT * FROM out",
    "p3_feed": f"{_STATE} SELECT * FROM out",
    "p3_found": f"""{_STATE}, cases AS (SELECT pair_id FROM cc UNION SELECT pair_id FROM labels WHERE corrected_from IS NOT NULL UNION SELECT pair_id FROM v GROUP BY 1 HAVING count(*) > 1)
      SELECT pair_id, choice FROM out WHERE pair_id IN (SELECT pair_id FROM cases WHERE pair_id <> '')""",
}

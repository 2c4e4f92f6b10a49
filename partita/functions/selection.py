"""Rules that select files, pairs and requests, joins of listings, aligned maps, and slots for outside models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.tables import with_totals

#: Notes of a take and ids and bars of a prompt below which a pair is not worth a vote.
TAKE_NOTES, PROMPT_IDS, PROMPT_BARS = 8, 32, 2
MOST_KEYS = 1000


def fit_for_evaluation(split: Column, notes: Column, seconds: Column, least_notes: int, shortest: float, longest: float) -> Column:
    """Whether a file may be in an evaluation set: held out, enough notes, neither too short nor too long. Unknown values are not fit."""
    return F.coalesce((split == "val") & (notes >= least_notes) & seconds.between(shortest, longest) & ~F.isnan(seconds), F.lit(False))


def request_problem(temperature: Column, top_k: Column, bars: Column, mode: Column, modes: tuple[str, ...], most_bars: int = 64) -> Column:
    """The first thing wrong with a request, or null. Missing values take their defaults later; a value that is there must be right."""
    number = lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
    return (
        F.when(temperature.isNotNull() & ~(number(temperature) & (temperature > 0) & (temperature <= 2)), F.concat(F.lit("temperature must be over 0 and at most 2: "), temperature.cast("string")))
        .when(top_k < 1, F.concat(F.lit("top_k must be 1 or more: "), top_k.cast("string")))
        .when(~bars.between(1, most_bars), F.concat(F.lit(f"bars must be 1 to {most_bars}: "), bars.cast("string")))
        .when(mode.isNotNull() & ~mode.isin(*modes), F.concat(F.lit("no such mode: "), mode))
    )


def usable_pair(notes_a: Column, notes_b: Column, prompt_ids: Column | None = None, prompt_bars: Column | None = None) -> Column:
    """Whether both takes have notes enough and, where known, the prompt ids and bars enough. Unknown counts of notes are not usable."""
    ok = (F.least(notes_a, notes_b) >= TAKE_NOTES) & notes_a.isNotNull() & notes_b.isNotNull()
    for x, least in ((prompt_ids, PROMPT_IDS), (prompt_bars, PROMPT_BARS)):
        if x is not None:
            ok = ok & F.coalesce(x >= least, F.lit(False))
    return F.coalesce(ok, F.lit(False))


def stem(path: Column) -> Column:
    """A path's file name without its last extension, in lower case."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^(.*?)(\.[^.]*)?$", 1))


def by_stem(a: DataFrame, b: DataFrame, path: str = "path") -> DataFrame:
    """(stem, a, b): files of two listings that share a stem; listings with several files of a stem give all of their pairings."""
    side = lambda df, s: df.select(stem(F.col(path)).alias("stem"), F.col(path).alias(s)).filter("stem <> ''").distinct()
    return side(a, "a").join(side(b, "b"), "stem")


def aligned(df: DataFrame, maps: str) -> tuple[DataFrame, list[str]]:
    """df with `values`, its map's numbers in the order of the sorted keys of all maps (missing and null ones NaN), and the keys. At most MOST_KEYS keys."""
    keys = [r[0] for r in df.select(F.explode(F.map_keys(maps)).alias("k")).distinct().orderBy("k").limit(MOST_KEYS + 1).collect()]
    if len(keys) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys")
    value = lambda k: F.coalesce(F.try_element_at(maps, F.lit(k)).cast("double"), F.lit(float("nan")))
    return df.withColumn("values", F.array(*map(value, keys)) if keys else F.array().cast("array<double>")), keys


def choose_tracks(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """file_id, track_name, n, problem: the tracks a request means, numbered from 0 in the order of their names.

    requests: file_id, kind (auto, all, list), tracks array<int>, as of requests.track_spec. auto means the track
    with the most notes, the first of equals. A number without a track is a problem, and then nothing is chosen.
    """
    t = notes.groupBy("file_id", "track_name").agg(F.count(F.lit(1)).alias("n"))
    g = t.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("track_name", "n"))).alias("all"), F.max("n").alias("most"))
    x = g.join(requests, "file_id")
    wrong = F.filter(F.coalesce("tracks", F.array().cast("array<int>")), lambda i: (i < 0) | (i >= F.size("all")))
    problem = F.when((F.col("kind") == "list") & (F.size(wrong) > 0), F.concat(F.lit("no track "), wrong[0].cast("string"))).when(~F.col("kind").isin("auto", "all", "list"), F.concat(F.lit("no such choice: "), F.col("kind")))
    chosen = F.when(F.col("kind") == "auto", F.slice(F.filter("all", lambda a: a["n"] == F.col("most")), 1, 1)).when(F.col("kind") == "all", F.col("all")).otherwise(F.filter("all", lambda a, i: F.array_contains("tracks", i)))
    return x.withColumn("problem", problem).select("file_id", "problem", F.explode_outer(F.when(F.col("problem").isNull(), chosen)).alias("t")).select("file_id", "t.track_name", "t.n", "problem")


def accompany_window(notes: DataFrame, condition: Column, target: Column, bar: int, bars: int = 16, least: int = 4) -> DataFrame:
    """file_id, b0, n_condition, n_target: of the windows of `bars` bars in which both parts have at least `least` notes, one by hash. Files without any are left out.

    Every note is counted for the windows that hold its bar, so no window is formed that has no note.
    """
    x = notes.withColumn("_bar", F.floor(F.col("start") / bar)).groupBy("file_id", "_bar").agg(F.count_if(condition).alias("c"), F.count_if(target).alias("t"))
    last = x.groupBy("file_id").agg(F.max("_bar").alias("_last"))
    w = x.join(last, "file_id").withColumn("b0", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_bar") - bars + 1), F.col("_bar")))).filter(F.col("b0") + bars <= F.col("_last") + 1)
    w = w.groupBy("file_id", "b0").agg(F.sum("c").alias("n_condition"), F.sum("t").alias("n_target")).filter((F.col("n_condition") >= least) & (F.col("n_target") >= least))
    key = F.struct(F.sha1(F.concat_ws(":", "file_id", "b0")), F.col("b0"))
    return w.groupBy("file_id").agg(F.min_by(F.struct("b0", "n_condition", "n_target"), key).alias("w")).select("file_id", "w.*")


def clip_key(path: Column, name: Column, start: Column, length: Column) -> Column:
    """The identity of a clip: SHA-256 of its file, name, and start and length to three decimals."""
    return F.sha2(F.concat_ws("|", path, F.coalesce(name, F.lit("")), F.format_string("%.3f", start.cast("double")), F.format_string("%.3f", length.cast("double"))), 256)


def shares(df: DataFrame, by: str) -> DataFrame:
    """by, n, share (of all rows, to three decimals)."""
    c = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return with_totals(c, _t=F.sum("n")).select(by, "n", F.round(F.col("n") / F.col("_t"), 3).alias("share"))


# ---- slots: a model from outside, set up once a task ----


def with_model(df: DataFrame, set_up: Callable[[], Callable[[dict], object]], inputs: list[str], keep: list[str], out: str) -> DataFrame:
    """`keep` and a column (out: "name type") of what the model gives for each row's inputs.

    set_up runs once in each task and gives the model, a function of a plain dict of the inputs: a decoder maps a
    request to ids, a scorer a piece to a number. A row on which the model raises ValueError has null.
    """
    name, kind = out.split(" ", 1)
    fields = df.select(*keep).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = set_up()

        def one(row: dict):
            try:
                return model(row)
            except ValueError:
                return None

        for b in batches:
            got = pd.Series([one(dict(zip(inputs, values))) for values in zip(*(b[c] for c in inputs))], dtype=object)
            yield b[keep].assign(**{name: got.to_numpy()})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{name} {kind}"])
    return df.select(*dict.fromkeys([*keep, *inputs])).mapInPandas(run, schema)


def mean_loss(log_probs: Column, mask: Column | None = None) -> Column:
    """The mean negative log-likelihood of an array of log-probabilities, of those whose mask is true; null if there are none."""
    kept = F.transform(F.filter(F.arrays_zip(log_probs.alias("p"), mask.alias("m")), lambda x: x["m"]), lambda x: x["p"]) if mask is not None else log_probs
    return F.when(F.size(kept) > 0, -F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.llm import reading
from partita.tables import table


@pytest.fixture(scope="module")
def samples(spark):
    return [(r.level, r.text) for r in table(spark, "/root/testdata/sf0.001", "level_samples").orderBy("sample_id").collect()]


@pytest.fixture(scope="module")
def rarity(spark):
    return reading.rarity_bits(reading.word_counts(table(spark, "/root/testdata/sf0.001", "documents")))


def test_clean():
    dirty = "\ufeff> It\u2019s a fine di\ufb00er-\nence,\u200b caf\u00c3\u00a9 &amp;amp; <b>more</b> trans\u00adcript </s>\n- next"
    assert reading.clean(dirty).split() == ["It\u2019s", "a", "fine", "difference,", "caf\u00e9", "&", "more", "transcript", "next"]
    assert reading.clean("a &lt; b \u2014 c\r\nd") == "a < b \u2014 c\nd" and reading.clean("") == ""


def test_word_counts_cover_all_documents(spark):
    docs = spark.createDataFrame([("The cat. The CAT!",), (None,), ("",), ("thé dog",)], "text string").repartition(3)
    c = reading.word_counts(docs)
    assert c[reading.bucket("the")] == 3 and c[reading.bucket("cat")] == 2 and c[reading.bucket("dog")] == 1 and c.sum() == 6
    assert reading.word_counts(docs.limit(0)).sum() == 0


def test_ordinal_model_recovers_a_planted_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = np.digitize(x @ [2.0, -1.0, 0.0] + 0.2 * rng.normal(size=400), [-2, 0, 2]) + 1
    m = reading.OrdinalModel(x, y)
    assert (m.level(x) == y).mean() > 0.85 and m.w[0] > 0 > m.w[1] and list(m.cuts) == sorted(m.cuts)
    assert np.corrcoef(m.expected(x), y)[0, 1] > 0.95


def test_held_out_accuracy(samples, rarity):
    idx = list(range(len(samples)))
    random.Random(0).shuffle(idx)
    hit = near = four = 0
    for f in range(5):
        test = idx[f::5]
        r = reading.Reader([samples[i] for i in idx if i not in test], rarity)
        _, level, _ = r.read([samples[i][1] for i in test])
        for i, got in zip(test, level):
            hit += got == samples[i][0]
            near += abs(got - samples[i][0]) <= 1
            four += (got == 4) == (samples[i][0] == 4)
    assert hit / len(idx) >= 0.9 and near == len(idx) and four / len(idx) >= 0.98


def test_rough_texts_keep_their_level(samples, rarity):
    r = reading.Reader(samples, rarity)
    four = [t for level, t in samples if level == 4]
    rough = [t.upper() for t in four] + [t.replace("ti", "ti­") for t in four] + ["> " + t.replace(", ", " &mdash; ") for t in four] + [t.encode().decode("latin-1") for t in four] + ["Draft 2\n\n" + t + "\n\n0:C5:1.5 0.75:B4:1.5 1:D6:1.5" for t in four]
    assert (r.read(rough)[1] == 4).mean() > 0.98
    three = [t.upper() for level, t in samples if level in (1, 2, 3)]
    assert (r.read(three)[1] == 4).mean() < 0.02


def test_rows(spark, sf):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " \n\t", 0), (4, "The cat is small. The cat is old.", 0), (4, "The cat is small. The cat is old.", 0), (5, "| Am | G |\n| C | F |\n| Am | G7 |", 0), (6, "word " * 200_000, 0), (7, "\x00", 0)], "doc_id long, text string, level int")
    rows = reading.levels(docs, table(spark, sf, "level_samples")).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 8 and all(got[i].level == 0 and got[i].prose == 0 for i in (1, 2, 3, 7)) and got[4].level == 1 and got[5].level == 0 and got[6].level >= 1
    assert reading.levels(docs.limit(0), table(spark, sf, "level_samples")).count() == 0


def test_last_words_count_for_diversity():
    some = ("in the long days of summer the children of our small village went down to the wide river every morning and "
            "came back with many stones which they laid before the door of the old house where she had always").split()[:40]
    more = "lived alone among books maps birds and quiet clever animals".split()
    at, none = reading.LEVEL.index("diversity"), np.zeros(reading.BUCKETS)
    of = lambda words: reading.level_features(" ".join(words).capitalize() + ".", none)[at]
    assert len(some) == 40 and of(some + more) > of(some + ["the"] * 10)

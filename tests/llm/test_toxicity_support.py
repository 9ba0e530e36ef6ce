import math
import random

import pytest
from pyspark.sql import functions as F
from test_toxicity import make

from rimefield.llm import toxicity as tx


def test_rare_toxic_words_are_learned(spark):
    """A word in 15 of 2,000 toxic rows, and in no other, is an entry; one in as many toxic as other rows is not."""
    docs, labels = make(12000)
    rng = random.Random(2)
    bad, good = ([i for i, y in labels if y == k] for k in (1, 0))
    more = {i: "zorble" for i in bad[:15]} | {i: "common" for i in [*rng.sample(bad[15:], 15), *rng.sample(good, 15)]}
    docs = [(i, f"{t} {more[i]}" if i in more else t) for i, t in docs]
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = tx.learn(d, l)
    assert any(tx.fold("zorble").startswith(e) for e in lexicon.entries)
    assert not any(tx.fold("common").startswith(e) for e in lexicon.entries)


def test_ratio(spark):
    r = spark.range(1).select(tx.ratio(F.lit(5), F.lit(0), 100, 500).alias("r"), tx.ratio(F.lit(10), F.lit(50), 100, 500).alias("same")).first()
    assert r.r == pytest.approx(2 * sum(o * math.log(o / e) for o, e in ((5, 5 / 6), (95, 595 / 6), (500, 2975 / 6)))) and r.same == pytest.approx(0, abs=1e-9)

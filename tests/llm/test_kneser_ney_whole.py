import random

import pytest
from pyspark.sql import functions as F

from rimefield.llm import kneser_ney as kn


def test_model_learns_from_all_trusted_rows_but_the_held_out(spark):
    """The share of training rows stays at four fifths above 250,000 trusted rows, where 200,000 used to be the most."""
    labels = spark.range(400_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert kn.trusted_rows(labels).where("trains").count() == pytest.approx(320_000, rel=0.01)
    assert kn.trusted_rows(labels, 60_000).where("trains").count() == pytest.approx(60_000, rel=0.02)


def test_sent_and_joined_ids_give_equal_models(spark):
    rng = random.Random(9)
    docs = [(i, "".join(rng.choice("abc dé") for _ in range(rng.randrange(0, 90))), "en" if i % 2 else "de") for i in range(150)] + [(None, "abc", "en"), (7, "dé", "de")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)] + [(None, 1)], "doc_id long, quality int")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_units, round(r.perplexity, 9), round(r.threshold, 9), r.keep)
    a, b = (sorted(map(key, kn.classify(d, labels, sent=n).collect())) for n in (10**9, 0))
    assert a == b and len(a) == len(docs)

import random

import pytest

from rimefield.llm import kneser_ney as kn


def test_thresholds_cover_all_held_out_rows(spark):
    """Thresholds are the quantiles of all trusted rows that the model hasn't seen; languages of 50 trusted rows have their own."""
    rng = random.Random(3)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(20))
    docs = [(i, text("ab" if i % 2 else "stuvwxyz"), "de" if i % 2 else "en") for i in range(240)] + [(1000 + i, text("klm"), "fr") for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in docs], "doc_id long, quality int")
    trains = {r.doc_id: r.trains for r in kn.trusted_rows(labels, 60).collect()}
    assert len(trains) == 300 and 30 < sum(trains.values()) < 100
    rows = kn.classify(d, labels, quantile=1.0, margin=1.0, fitted=60).collect()
    for lang, least in (("de", 50), ("en", 50), ("fr", 0)):
        mine = [r for r in rows if r.lang == lang]
        outside = [r.perplexity for r in mine if not trains[r.doc_id]]
        used = outside if len(outside) >= kn.LEAST else [r.perplexity for r in mine]
        assert len(outside) >= least and [r.threshold for r in mine] == pytest.approx([max(used)] * len(mine))
    assert sum(kn.trusted_rows(labels).toPandas().trains) < 270  # a fifth is held out where all could be learned


def test_both_ways_of_scoring_agree(spark):
    rng = random.Random(4)
    docs = [(i, "".join(rng.choice("abc dé😀") for _ in range(rng.randrange(0, 200))), None if i % 5 else "en") for i in range(100)] + [(None, None, "en"), (None, "zz\ud7ff\x02\x03", "x"), (3, "", "de")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(100)] + [(None, 1), (2, None)], "doc_id long, quality int")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_units, round(r.perplexity, 9), r.lang or "")
    a, b = (sorted(map(key, kn.classify(d, labels, most=m).collect())) for m in (10**9, 0))
    assert a == b and len(a) == len(docs)
    none = {(r.doc_id, r.n_units) for r in kn.classify(d, labels.where("false")).collect()}
    assert none == {(x[0], x[2]) for x in [(i, 0, len((t or "").encode("utf-16-le")) // 2 + 1) for i, t, _ in docs]}

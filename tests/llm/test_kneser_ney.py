import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rimefield.llm import kneser_ney as kn


def by_hand(train):
    """Interpolated modified Kneser-Ney by its definition."""
    orders = {4: Counter()}
    for t in train:
        u = [kn.START] * 3 + np.frombuffer(t.lower().encode("utf-16-le"), "<u2").tolist() + [kn.END]
        orders[4].update(tuple(u[i : i + 4]) for i in range(len(u) - 3))
    for n in (3, 2, 1):
        orders[n] = Counter(g[1:] for g in orders[n + 1])
    disc = {}
    for n, c in orders.items():
        k = Counter(c.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] + k[2] else 0.5
        d = [min(j, max(0.0, j - (j + 1) * y * k[j + 1] / k[j])) if k[j] else y for j in (1, 2, 3)]
        disc[n] = [x if x > 0 else 0.1 for x in d]
    dis = lambda n, c: disc[n][min(c, 3) - 1] if c else 0.0

    def p(g):
        n, c = len(g), orders[len(g)]
        if n == 1:
            return (c[g] - dis(1, c[g]) + sum(dis(1, x) for x in c.values()) / (len(c) + 1)) / sum(c.values())
        same = {k: x for k, x in c.items() if k[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        return (c[g] - dis(n, c[g]) + sum(dis(n, x) for x in same.values()) * p(g[1:])) / sum(same.values())

    return p


def test_perplexity_equals_definition(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde é") for _ in range(rng.randrange(2, 7)))
    data = [(i, " ".join(word() for _ in range(rng.randrange(1, 20))), "en" if i % 2 else "de") for i in range(80)]
    data += [(100, "ZZZ 😀 qqq", "en"), (101, None, None), (102, "", "en"), (102, "", "en")]
    labels = [(i, int(i % 3 == 0)) for i in range(80)] + [(None, 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("perplexity", F.lit("clash"))
    rows = kn.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(rows) == len(data)
    trains = {r.doc_id for r in kn.trusted_rows(spark.createDataFrame(labels, "doc_id long, quality int")).where("trains").collect()}
    assert 0 < len(trains) < 27
    p = by_hand([t for i, t, _ in data if i in trains])
    for r in rows:
        t = {i: t for i, t, _ in data}[r.doc_id] or ""
        units = np.frombuffer(t.lower().encode("utf-16-le"), "<u2").tolist()
        u = [kn.START] * 3 + units + [kn.END]
        want = math.exp(-sum(math.log(p(tuple(u[i : i + 4]))) for i in range(len(u) - 3)) / (len(u) - 3))
        assert r.perplexity == pytest.approx(want, rel=1e-6)
        assert r.keep == (r.perplexity <= r.threshold)


def test_no_trust_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    assert [r.keep for r in kn.classify(docs, labels).collect()] == [True]
    assert kn.classify(docs.where("false"), labels.withColumn("quality", F.lit(1))).count() == 0

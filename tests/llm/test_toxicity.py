import math
import random

import pytest
from pyspark.sql import functions as F

from rimefield.llm import toxicity as tx


def test_fold():
    assert tx.fold("1d10t, ІDІОТ! Café") == " idiot idiot cafe "
    assert tx.fold("loser 1oser") == " ioser ioser "
    assert tx.fold(None) == tx.fold("") == tx.fold(" \n")


def test_fold_sees_through_marks_and_ligatures():
    assert tx.fold("idio\u0301t id\u200biot \u00ad\ufeffidiot i\u0307diot") == " idiot idiot idiot idiot "
    assert tx.fold("\ufb01lth \uff26ilth") == " fiith fiith "


def test_scores_equal_brute_force(spark):
    """Every place of every entry, tried one by one."""
    docs, labels = make(900)
    docs += [(5000, None), (5001, ""), (5002, "sn\u200bark hunting snark " * 4000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_text", F.lit("x"))
    lexicon = tx.learn(d.select("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert lexicon.exceptions
    for r in tx.apply(d, lexicon, ["doc_id", "_text"]).collect():
        ws = tx.fold(dict(docs)[r.doc_id]).split()
        total = 0.0
        for i, w in enumerate(ws):
            best = max((v for e, v in lexicon.entries.items() if (e[1:-1] == w if e.endswith(" ") else w.startswith(e[1:]))), default=0.0)
            if best > 0 and not (i and f" {ws[i - 1]} {w} " in lexicon.exceptions) and not (i + 1 < len(ws) and f" {w} {ws[i + 1]} " in lexicon.exceptions):
                total += best
        z = lexicon.line[0] + lexicon.line[1] * math.log1p(total) + lexicon.line[2] * math.log1p(100 * total / max(1, len(ws)))
        assert r._score == pytest.approx(1 / (1 + math.exp(-z))) and r._text == "x"


def make(n=1500):
    rng = random.Random(6)
    clean = [f"{a}{b}" for a in ("ba", "ke", "mo", "ru") for b in ("n", "tor", "lim", "sav")]
    docs, labels = [], []
    for i in range(n):
        ws = [rng.choice(clean) for _ in range(rng.randrange(5, 80))]
        toxic = i % 6 == 0
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(["snark", "Snаrk", "5nark", "grumble" + rng.choice(["x", "ed", "ing"])]))
        if not toxic and i % 50 == 1:
            ws[2:2] = ["hunting", "snark"]
        docs.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_learned_scores(spark):
    docs, labels = make()
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = tx.learn(d.where("doc_id < 1000"), l)
    assert any(e.startswith(" snar") for e in lexicon.entries) and any(e.startswith(" grum") for e in lexicon.entries)
    assert " hunting snark " in lexicon.exceptions
    out = {r.doc_id: r._score for r in tx.apply(d, lexicon, ["doc_id"]).collect()}
    wrong = sum((out[i] >= 0.5) != bool(y) for i, y in labels if i >= 1000)
    assert wrong <= 5


def test_nulls_empty_and_clashes(spark):
    docs, labels = make(300)
    d = spark.createDataFrame([*docs, (None, None), (9999, ""), (9999, "")], "doc_id long, text string").withColumn("toxic", F.lit("x"))
    l = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    lexicon = tx.learn(d.select("doc_id", "text"), l)
    rows = tx.apply(d, lexicon, ["doc_id", "toxic"]).collect()
    assert len(rows) == len(docs) + 3 and all(0 <= r._score <= 1 for r in rows)
    assert len({r._score for r in rows if r.doc_id in (None, 9999)}) == 1
    assert tx.learn(d.select("doc_id", "text"), l.where("toxic = 0")).entries == {}
    none = tx.learn(d.select("doc_id", "text").where("false"), l)
    assert tx.apply(d.where("false"), none, ["doc_id"]).count() == 0

import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rimefield.llm import lattice as lt

SMALL = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"the", lt.MARK + b"a", lt.MARK + b"ab", lt.MARK + b"the", lt.MARK]


def all_segmentations(pieces, l, word):
    number = {p: i for i, p in enumerate(pieces.bodies)}

    def rest(i):
        return math.exp(l.stop) if i == len(word) else sum(math.exp(l.inner[number[word[i:j]]]) * rest(j) for j in range(i + 1, len(word) + 1) if word[i:j] in number)

    return math.exp(l.start[-1]) * rest(0) + sum(math.exp(l.start[number[word[:j]]]) * rest(j) for j in range(1, len(word) + 1) if word[:j] in number)


def test_forward_sums_all_segmentations():
    pieces, l = lt.from_ranks(SMALL)
    for w in (b"abc", b"theabcab", b"x", "éa".encode(), b"abcabcabcthe"):
        got = l.log_probability(len(w), 1, pieces.find([w]))[0]
        assert got == pytest.approx(math.log(all_segmentations(pieces, l, w)), rel=1e-9)


def test_expected_counts_match_derivative():
    """The expected use of a piece is the derivative of the log probability by the log of its weight."""
    pieces, l = lt.from_ranks(SMALL)
    word = b"abctheab"
    found = pieces.find([word])
    n = len(pieces.bodies)
    start, inner, stop = np.zeros((1, n + 1)), np.zeros((1, n)), np.zeros(1)
    l.expect(len(word), found, np.ones((1, 1)), start, inner, stop)
    for p in (b"ab", b"abc", b"the", b"a"):
        i = pieces.bodies.index(p)
        before = l.inner[i]
        l.inner[i] = before + 1e-5
        up = l.log_probability(len(word), 1, found)[0]
        l.inner[i] = before - 1e-5
        down = l.log_probability(len(word), 1, found)[0]
        l.inner[i] = before
        assert inner[0, i] == pytest.approx((up - down) / 2e-5, abs=1e-5)
    assert stop[0] == 1 and start.sum() == pytest.approx(1)


def test_scores(spark):
    words = ["red", "Blue", "green", "grün", "the", "a", "of"]
    rng = np.random.default_rng(1)
    data = [(i, " ".join(rng.choice(words, rng.integers(0, 30))) + (" rare%d" % i if i % 9 == 0 else ""), "en" if i % 3 else "de") for i in range(400)]
    data += [(1000, None, None), (1001, "", "en"), (1001, "", "en"), (1002, "x" * 5000 + " the\t\x0bof", "en"), (None, "the of", "fr")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("block", F.lit(1))
    rows = lt.score(docs, block_bytes=6000, listed=2).collect()
    again = lt.score(docs).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, round(r.score, 6), round(r.lattice_score, 6))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert len(rows) == len(data)
    tokens = lambda t: "".join(c.lower() if c.isascii() else c for c in (t or "")).encode().split() + [b""]
    c = Counter(w for i, t, _ in data if zlib.crc32(str("" if i is None else i).encode()) % 10 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    text = {i: t for i, t, _ in data}
    for r in rows:
        ws = tokens(text[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 10 == 0)
        assert math.isfinite(r.score) and r.score < 0
    known = [r for r in rows if r.n_known == r.n_tokens]
    assert sum(r.score for r in known) > 1.2 * sum(r.base_score for r in known)
    assert lt.score(docs.where("false")).count() == 0


def test_long_words_agree_with_short_ones():
    """Words beyond the limit are worked off one by one, by the same recursion."""
    pieces, l = lt.from_ranks(SMALL)
    words = [b"abctheab" * 3, b"x", b"theabc" * 5]
    for w in words:
        edges, found = pieces.edges(w), pieces.find([w])
        assert l.forward_one(len(w), edges)[-1] + l.stop == pytest.approx(l.log_probability(len(w), 1, found)[0], rel=1e-12)
        a, b = ([np.zeros((1, len(pieces.bodies) + 1)), np.zeros((1, len(pieces.bodies))), np.zeros(1)] for _ in range(2))
        l.expect(len(w), found, np.ones((1, 1)), *a)
        l.expect(len(w), edges, np.ones((1, 1)), *b)
        assert all(x == pytest.approx(y) for x, y in zip(a, b, strict=True))
    began = time.time()
    assert math.isfinite(lt.piece_paths(pieces, [l] * 5, [b"abcthe" * 20_000])[0, 0])
    assert time.time() - began < 15


def test_mixture_equals_definition(spark):
    """Every score from the definition: counts by hand, piece paths by listing all segmentations."""
    rng = np.random.default_rng(2)
    words = ["ab", "the", "abc", "cab", "b"]
    data = [(i, " ".join(rng.choice(words, rng.integers(0, 9))) + (" thab" if i % 10 == 3 else ""), "en" if i % 3 else "de") for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in lt.score(docs, block_bytes=2000).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    d = docs.select(lt.remainder(F.col("doc_id"), 10).alias("h"), F.when(F.col("lang") == "de", 0).otherwise(1).alias("k"), F.col("text").cast("binary").alias("text"), F.lit(0).cast("long").alias("block"))
    requests = d.select("block", F.when(F.col("h") == 0, -1).otherwise(F.col("k")).cast("int").alias("k"), "text").mapInArrow(lt._counts, "block long, word binary, k int, c long")
    model, _ = lt.fit(requests, 2, lt.load_pieces(), 1)
    tokens = lambda t: [*t.encode().split(), b""]
    train = [(x, lang) for i, t, lang in data if not held(i) for x in tokens(t)]
    c = [Counter(w for w, _ in train), Counter(w for w, k in train if k == "de"), Counter(w for w, k in train if k == "en")]
    n_docs = [sum(not held(i) and k == lang for i, _, k in data) for lang in ("de", "en")]
    e = sum(n_docs) / sum(c[0].values())
    disc = []
    for x in c:
        n1, n2 = (sum(v == j for v in x.values()) for j in (1, 2))
        disc.append(min(0.9, max(0.1, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5)))

    def prob(k, w):
        piece = e if not w else (1 - e) * (0.1 * all_segmentations(model.pieces, model.lattices[0], w) + 0.9 * all_segmentations(model.pieces, model.lattices[k], w))
        n, b = [sum(x.values()) for x in c], sum(c[0][x] > c[k][x] for x in c[k]) / len(c[k])
        b = min(0.99, max(0.01, b))
        lower = b * max(c[0][w] - disc[0], 0) / (n[0] - disc[0] * len(c[0])) + (1 - b) * piece
        return max(c[k][w] - disc[k], 0) / n[k] + disc[k] * len(c[k]) / n[k] * lower

    for i, t, _ in data:
        want = math.log10(sum(n_docs[k - 1] / sum(n_docs) * math.prod(prob(k, w) for w in tokens(t)) for k in (1, 2)))
        assert rows[i].score == pytest.approx(want, rel=1e-9)
        assert rows[i].lattice_score == pytest.approx(sum(math.log10((1 - e) * all_segmentations(model.pieces, model.lattices[0], w) if w else e) for w in tokens(t)), rel=1e-9)

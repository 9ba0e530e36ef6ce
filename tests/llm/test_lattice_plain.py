import time

import numpy as np
import pytest
from test_lattice import SMALL

from rimefield.llm import lattice as lt


def by_log(pieces, lattices, words):
    return np.array([[l.log_probability(len(w), 1, pieces.find([w]))[0] for l in lattices] for w in words])


def two(pieces):
    rng = np.random.default_rng(3)
    return [lt.Lattice(rng.random(len(pieces.bodies) + 1), rng.random(len(pieces.bodies)) + 1e-3, 4.0) for _ in range(2)]


WORDS = [b"abctheab", b"x", b"theabc" * 5, "grün".encode(), b"abcthe" * 9, b"bc", b"the", bytes([0, 255, 32, 7]), b"\x00" * 64, b"ab" * 32]


def test_plain_sums_equal_log_space():
    pieces, first = lt.from_ranks(SMALL)
    lattices = [first, *two(pieces)]
    assert lt.piece_paths(pieces, lattices, WORDS) == pytest.approx(by_log(pieces, lattices, WORDS), rel=1e-11)
    assert lt.piece_paths(pieces, lattices, [b"", b"ab"])[0].tolist() == [lt.NEG] * 3
    member = np.random.default_rng(4).random((2, len(WORDS))) < 0.6
    n = len(pieces.bodies)
    a, b = ([np.zeros((2, n + 1)), np.zeros((2, n)), np.zeros(2)] for _ in range(2))
    assert not lattices[1].expect_many(pieces, pieces.walk(WORDS), member, *a).any()
    for i, w in enumerate(WORDS):
        lattices[1].expect(len(w), pieces.find([w]), member[:, i : i + 1].astype(float), *b)
    assert all(x == pytest.approx(y, rel=1e-10, abs=1e-14) for x, y in zip(a, b, strict=True))


def test_sums_beyond_the_range_of_doubles(spark):
    """Bytes of next to no weight: such words are told and go by log space, in the scores and in the expected counts."""
    pieces, _ = lt.from_ranks(SMALL)
    inner = np.full(len(pieces.bodies), 1.0)
    inner[pieces.bodies.index(b"\x01")] = 1e-30
    odd = lt.Lattice(np.full(len(pieces.bodies) + 1, 1.0), inner, 1.0)
    words = [b"ab", b"\x01" * 40, b"the", b"x" + b"\x01" * 63, b"\x01" * 70]
    assert np.isnan(odd.log_probability_many(pieces, pieces.walk(words[:4]))).tolist() == [False, True, False, True]
    want = by_log(pieces, [odd], words)
    assert (want[1] < -2000).all() and lt.piece_paths(pieces, [odd], words) == pytest.approx(want, rel=1e-11)
    table = spark.createDataFrame([(w, int(i != 2), int(i > 1)) for i, w in enumerate([*words, b""])], "word binary, c1 int, c2 int")
    for lattices in ([odd], [odd, two(pieces)[0]]):
        got = lt._expected(table, pieces, lattices, 2)
        for k, holds in enumerate(([0, 1, 3, 4], [2, 3, 4])):
            sums = [np.zeros((1, len(inner) + 1)), np.zeros((1, len(inner))), np.zeros(1)]
            for i in holds:
                lattices[k % len(lattices)].expect(len(words[i]), pieces.find([words[i]]), np.ones((1, 1)), *sums)
            assert all(x == pytest.approx(y[0], rel=1e-9, abs=1e-7) for x, y in zip(got[k], sums, strict=True))


def test_edges_are_all_pieces_in_a_word():
    vocabulary = lt.load_pieces()
    pieces, _ = lt.from_ranks(vocabulary)
    number = {p: i for i, p in enumerate(pieces.bodies)}
    words = [b"cancellation", "überraschung".encode(), b"x", "日本語".encode(), b"[[the]]***"]
    e = pieces.walk(words)
    got = {(w, s - e.starts[w], d - e.starts[w], x) for w, s, d, x in zip(e.word, e.src, e.dst, e.ids, strict=True)}
    assert len(got) == len(e.src)
    assert got == {(k, i, j, number[w[i:j]]) for k, w in enumerate(words) for i in range(len(w)) for j in range(i + 1, len(w) + 1) if w[i:j] in number}


def test_edges_and_sums_cost_little_more_than_the_recursion_in_log_space_alone():
    pieces, first = lt.from_ranks(lt.load_pieces())
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(["er", "en", "th", "ou", "a", "i", "sch", "é", "%", "x", "men"], 8)).encode() for _ in range(10_000)]
    n = len(pieces.bodies)
    lattices = [first, *(lt.Lattice(rng.random(n + 1), rng.random(n), 9.0) for _ in range(4))]
    found = [(len(part), len(words[part[0]]), pieces.find([words[i] for i in part])) for part in lt.by_length(words)]

    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    once = least(lambda: [l.log_probability(size, n, x) for n, size, x in found for l in lattices])
    assert least(lambda: lt.piece_paths(pieces, lattices, words)) < 1.5 * once

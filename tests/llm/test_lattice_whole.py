import numpy as np
import pytest
from test_lattice import SMALL, all_segmentations

from rimefield.llm import lattice as lt


def test_known_words_take_all_lattices():
    pieces, pooled = lt.from_ranks(SMALL)
    rng = np.random.default_rng(1)
    own = lt.Lattice(rng.random(len(pieces.bodies) + 1), rng.random(len(pieces.bodies)), 40.0)
    model = lt.Model(pieces, [pooled, own], [(20, 9, 5, 2, 0), (20, 9, 5, 2, 3)], [1.0], 4)
    words, counts = [b"theab", b"abcx", b"abc"], np.array([[3, 3], [1, 1], [0, 0]], float)
    d, e = 5 / 9, 4 / 20
    for w, (c, _), (got, alone) in zip(words, counts, model.answers(words, counts), strict=True):
        l = (1 - e) * (0.1 * all_segmentations(pieces, pooled, w) + 0.9 * all_segmentations(pieces, own, w))
        assert 10**alone == pytest.approx((1 - e) * all_segmentations(pieces, pooled, w))
        direct = max(c - d, 0) / 20
        assert 10**got == pytest.approx(direct + d * 9 / 20 * (direct * 20 / (20 - d * 9) / 3 + l * 2 / 3), rel=1e-9)


def test_long_pieces_are_edges():
    vocabulary = lt.load_pieces()
    assert lt.MARK + b"cancellation" in vocabulary or b"cancellation" in vocabulary
    assert max(len(p.removeprefix(lt.MARK)) for p in vocabulary) > 10
    pieces, _ = lt.from_ranks(vocabulary)
    at = pieces.find([b"cancellation"])[0, 12][0]
    assert pieces.bodies[at] == b"cancellation"

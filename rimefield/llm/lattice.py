"""Language-model scores over a subword lattice.

A text is a row of words and one end. A word's lattice has an edge for each piece of an existing tokenizer vocabulary
that stands in it; a piece's weight starts from its rank in that vocabulary (1 / rank; the installed vocabularies have
no unigram scores) and is re-estimated by expected counts over all distinct training words: once for all components,
then once more for each. The first piece carries the word-start mark and a stop weight ends the word, so the piece
paths of all words sum to one. One more edge spans a whole word that the training rows hold, weighted by its
discounted count; what the discounts leave goes to the piece paths. A forward recursion sums all paths: in plain
doubles for many words at once, in log space for long words and for those whose sums leave the range of the doubles.

Parameters: counts c of words in the training rows, in all and per component (the languages that hold 1% of the
training rows or more, at most 100 by that rule, and the rest, if any). With N tokens, V distinct ones, the discount
D = n1 / (n1 + 2 n2), and e the end's share of the tokens, a half at most:

    P_k(w) = max(c_k - D_k, 0) / N_k + D_k V_k / N_k * (b_k * max(c - D, 0) / (N - D V) + (1 - b_k) * L_k(w))
    b_k    = share of the component's distinct words that others hold too: of words new to k, so many are known
    L_k(w) = (1 - e) * (0.1 * piece paths of all components + 0.9 * piece paths of k), and e for the end
    score  = log10 of the sum over k of share_k * product of P_k over the text's words and end
    lattice_score = log10 of the product of (1 - e) * piece paths of all components, and e for the end

Scores use the text alone, never its language. Counting and scoring go by blocks of rows of bounded bytes: each block
asks for the distinct words it holds, the counts of words that several blocks hold go back to them (a row lists at most
about 1,024 blocks), and each block is scored with its own answers, so no table of words is sent to all tasks.

Null and empty texts are one end. Repeated rows score alike; a null doc_id counts as the empty text for the split.
Words without white space of any length are one word; beyond 64 bytes they are worked off one by one, in linear time.
An empty table gives no rows; one without training rows gives base and score with N = 0: all weight is on the pieces
and the end's share is a half.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, remainder, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK, BLOCK_BYTES, LISTED, FLUSH, LONG, LEAST_SHARE, POOLED, SCALE = "▁".encode(), 24 << 20, 1024, 1_000_000, 64, 0.01, 0.1, 10
END = b""
NEG = float("-inf")


def load_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of the vocabulary by rank, as bytes; each single byte is one of them. Those with a mark past their start are in no word and are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[bytes, None] = {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            out[bytes([int(model.id_to_piece(i)[3:5], 16)])] = None
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            piece = model.id_to_piece(i).encode()
            if MARK not in piece.removeprefix(MARK):
                out[piece] = None
    return list(out)


class Edges:
    """Lattice edges of many words, which stand one after the other with a place between: where they start and end, and by the edge's start
    in its word: the edge's places, piece number and word. bounds: where the edges of each start begin."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, src: np.ndarray, dst: np.ndarray, ids: np.ndarray, word: np.ndarray, bounds: np.ndarray):
        self.starts, self.ends, self.src, self.dst, self.ids, self.word, self.bounds = starts, ends, src, dst, ids, word, bounds

    def of(self, words: np.ndarray) -> "Edges":
        """The edges of some words alone (a mask); the places stay."""
        keep = words[self.word]
        return Edges(self.starts, self.ends, self.src[keep], self.dst[keep], self.ids[keep], self.word[keep], np.concatenate([[0], np.cumsum(keep)])[self.bounds])

    def steps(self) -> list[slice]:
        return [slice(x, y) for x, y in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)]

    def within(self, sums: np.ndarray) -> np.ndarray:
        """Words whose sums are all so far from the ends of the doubles' range that nothing of weight was lost."""
        return (np.minimum.reduceat(sums, self.starts) >= 1e-250) & (np.maximum.reduceat(sums, self.starts) <= 1e250)


class Pieces:
    """Numbers of the pieces' bodies, found for all substrings of many words at once by a trie: the child of a node by a code (byte + 1; 0 ends
    a word) stands at the node's base + code, if its parent is that node."""

    def __init__(self, bodies: list[bytes]):
        self.bodies = bodies
        self.sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        children, number = [{}], [-1]
        for n, body in enumerate(bodies):
            at = 0
            for x in body:
                to = children[at].get(x + 1)
                if to is None:
                    to = children[at][x + 1] = len(children)
                    children.append({})
                    number.append(-1)
                at = to
            number[at] = n
        # Nodes of many children are placed first, each where it fits first; those of one fill the gaps.
        free, place, base = np.ones(3 * len(children) + 4096, bool), np.zeros(len(children), np.int64), np.zeros(len(children), np.int64)
        free[:257], low = False, 257
        order = sorted((i for i, c in enumerate(children) if c), key=lambda i: -len(children[i]))
        many = [i for i in order if len(children[i]) > 1]
        for i in many:
            codes, lo, fits = np.fromiter(children[i], np.int64), low - 1024, []
            while not len(fits):
                lo += 1024
                if lo + 2048 > len(free):
                    free = np.append(free, np.ones(len(free), bool))
                at = np.flatnonzero(free[lo : lo + 1024]) + lo - codes[0]
                fits = at[free[at[:, None] + codes].all(1)]
            base[i] = fits[0]
            place[[*children[i].values()]] = fits[0] + codes
            free[fits[0] + codes] = False
            while not free[low : low + 64].any():
                low += 64
        one = order[len(many) :]
        at = np.flatnonzero(free)[: len(one)]
        for i, x in zip(one, at.tolist(), strict=True):
            ((code, to),) = children[i].items()
            base[i], place[to] = x - code, x
        size = int(max(place.max(), base.max())) + 258
        self.base, self.parent, self.number = (np.full(size, x, np.int64) for x in (0, -1, -1))
        self.base[place], self.number[place] = base, number
        for i in order:
            self.parent[place[[*children[i].values()]]] = place[i]

    def _found(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, then starts, ends and piece numbers of the edges, by the pieces' length."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        codes = np.frombuffer(b" ".join([*words, b""]), np.uint8).astype(np.int16) + np.int16(1)
        codes[ends] = 0
        at = np.flatnonzero(codes)
        node, size, parts = np.zeros(len(at), np.int64), 0, []
        while len(at) or not parts:
            to = self.base[node] + codes[at + size]
            ok = np.flatnonzero(self.parent[to] == node)
            at, node, size = at[ok], to[ok], size + 1
            ids = self.number[node]
            has = np.flatnonzero(ids >= 0)
            parts.append((at[has], at[has] + size, ids[has]))
        return np.concatenate([[0], ends[:-1] + 1]), ends, *(np.concatenate(c) for c in zip(*parts, strict=True))

    def walk(self, words: list[bytes]) -> Edges:
        """Edges of words of 1 to 255 bytes."""
        starts, ends, src, dst, ids = self._found(words)
        sizes = ends - starts
        word = np.repeat(np.arange(len(words)), sizes + 1)[src]
        offset = (src - starts[word]).astype(np.uint8)
        order = np.argsort(offset, kind="stable")
        return Edges(starts, ends, src[order], dst[order], ids[order], word[order], np.concatenate([[0], np.cumsum(np.bincount(offset, minlength=int(sizes.max())))]))

    def find(self, words: list[bytes]) -> dict[tuple[int, int], np.ndarray]:
        """For words of one length: by start and end, each word's piece number or -1."""
        wide = len(words[0]) + 1
        _, _, src, dst, ids = self._found(words)
        word, key = src // wide, src % wide * wide + dst % wide
        order, out = np.argsort(key, kind="stable"), {}
        for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(part):
                got = out[divmod(int(key[part[0]]), wide)] = np.full(len(words), -1)
                got[word[part]] = ids[part]
        return out

    def edges(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and piece numbers of one word's edges, by end."""
        _, _, i, j, ids = self._found([word])
        order = np.argsort(j, kind="stable")
        return i[order], j[order], ids[order]


def by_length(words: list[bytes], most: int = 2048) -> Iterator[np.ndarray]:
    """Places of words of equal length, at most so many at once; longer words than LONG alone."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        step = 1 if len(part) and sizes[part[0]] > LONG else most
        for a in range(0, len(part), step):
            yield part[a : a + step]


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > NEG else a


class Lattice:
    """Log weights of pieces that start a word (the last: the mark alone), of inner pieces (the last: no piece), and of the stop."""

    def __init__(self, start: np.ndarray, inner: np.ndarray, stop: float):
        with np.errstate(divide="ignore"):
            self.start = np.log(start / start.sum())
            total = inner.sum() + stop
            self.inner, self.stop = np.append(np.log(inner / total), NEG), math.log(stop / total)
        self._plain: tuple[np.ndarray, np.ndarray] | None = None

    def forward(self, size: int, n: int, found: dict) -> np.ndarray:
        a = np.full((size + 1, n), NEG)
        a[0] = self.start[-1]
        for (i, j), ids in sorted(found.items()):
            if i == 0:
                a[j] = np.logaddexp(a[j], np.where(ids >= 0, self.start[ids], NEG))
            a[j] = np.logaddexp(a[j], a[i] + self.inner[ids])
        return a

    def log_probability(self, size: int, n: int, found: dict) -> np.ndarray:
        return self.forward(size, n, found)[-1] + self.stop

    def plain(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Weights of starts (the last: the mark alone) and of inner pieces, times 2 ** SCALE for each byte: so the sums of usual words stay near 1."""
        if self._plain is None:
            with np.errstate(over="ignore", invalid="ignore"):
                by = np.exp2(SCALE * pieces.sizes.astype(float))
                self._plain = np.append(np.exp(self.start[:-1]) * by, np.exp(self.start[-1])), np.exp(self.inner[:-1]) * by
        return self._plain

    def forward_many(self, e: Edges, start: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """The recursion without logarithms, for many words: sums by place."""
        a = np.zeros(e.ends[-1] + 1)
        a[e.starts] = start[-1]
        weights, first = inner[e.ids], e.bounds[1]
        a[e.dst[:first]] = start[e.ids[:first]]
        for s in e.steps():
            # Edges of one start in one word end apart.
            a[e.dst[s]] += a[e.src[s]] * weights[s]
        return a

    def backward_many(self, e: Edges, inner: np.ndarray) -> np.ndarray:
        b = np.zeros(e.ends[-1] + 1)
        b[e.ends] = 1
        weights = inner[e.ids]
        for s in reversed(e.steps()):
            np.add.at(b, e.src[s], weights[s] * b[e.dst[s]])
        return b

    def log_probability_many(self, pieces: Pieces, e: Edges) -> np.ndarray:
        """NaN where the sums leave the range of the doubles."""
        with np.errstate(all="ignore"):
            a = self.forward_many(e, *self.plain(pieces))
            return np.where(e.within(a), np.log(a[e.ends]) - SCALE * math.log(2) * (e.ends - e.starts) + self.stop, np.nan)

    def expect_many(self, pieces: Pieces, e: Edges, member: np.ndarray, start: np.ndarray, inner: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """expect() for many words; a mask of those left out, since their sums leave the range of the doubles. member: booleans."""
        with np.errstate(all="ignore"):
            w_start, w_inner = self.plain(pieces)
            a, b = self.forward_many(e, w_start, w_inner), self.backward_many(e, w_inner)
            good, first = e.within(a) & e.within(b), e.bounds[1]
            whole = 1 / a[e.ends]
            use = a[e.src] * w_inner[e.ids] * b[e.dst] * whole[e.word]
            begin = w_start[e.ids[:first]] * b[e.dst[:first]] * whole[e.word[:first]]
            alone = w_start[-1] * b[e.starts] * whole
        for k, m in enumerate(member & good):
            stop[k] += m.sum()
            start[k, -1] += alone[m].sum()
            at = np.flatnonzero(m[e.word])
            inner[k] += np.bincount(e.ids[at], use[at], inner.shape[1])
            at = at[: np.searchsorted(at, first)]
            start[k, :-1] += np.bincount(e.ids[at], begin[at], inner.shape[1])
        return member.any(0) & ~good

    def forward_one(self, size: int, edges) -> list[float]:
        """The same recursion for one long word."""
        i, j, ids = edges
        a = [NEG] * (size + 1)
        a[0] = float(self.start[-1])
        for x, y, inner, start in zip(i.tolist(), j.tolist(), self.inner[ids].tolist(), np.where(i == 0, self.start[ids], NEG).tolist(), strict=True):
            a[y] = _add(a[y], _add(a[x] + inner, start) if start > NEG else a[x] + inner)
        return a

    def backward_one(self, size: int, edges) -> list[float]:
        i, j, ids = edges
        b = [NEG] * (size + 1)
        b[-1] = 0.0
        order = np.argsort(-i, kind="stable")
        for x, y, inner in zip(i[order].tolist(), j[order].tolist(), self.inner[ids[order]].tolist(), strict=True):
            b[x] = _add(b[x], inner + b[y])
        return b

    def expect(self, size: int, found, member: np.ndarray, start: np.ndarray, inner: np.ndarray, stop: np.ndarray) -> None:
        """Add the expected use of each piece in the words' segmentations to the rows of the groups that hold them (member: groups x words).
        found: of find(), or of edges() for one long word."""
        stop += member.sum(1)
        if isinstance(found, tuple):
            a, b = (np.array(f(size, found)) for f in (self.forward_one, self.backward_one))
            i, j, ids = found
            use, begin = np.exp(a[i] + self.inner[ids] + b[j] - a[-1]), np.flatnonzero(i == 0)
            first = np.exp(self.start[ids[begin]] + b[j[begin]] - a[-1])
            for k in np.flatnonzero(member[:, 0]):
                start[k, -1] += np.exp(self.start[-1] + b[0] - a[-1]) * member[k, 0]
                np.add.at(inner[k], ids, use * member[k, 0])
                np.add.at(start[k], ids[begin], first * member[k, 0])
            return
        n = member.shape[1]
        a, b = self.forward(size, n, found), np.full((size + 1, n), NEG)
        b[-1] = 0
        for (i, j), ids in sorted(found.items(), key=lambda x: -x[0][0]):
            b[i] = np.logaddexp(b[i], self.inner[ids] + b[j])
        whole = a[-1]
        start[:, -1] += member @ np.exp(self.start[-1] + b[0] - whole)
        for (i, j), ids in found.items():
            has = np.flatnonzero(ids >= 0)
            p = ids[has]
            use = np.exp(a[i, has] + self.inner[p] + b[j, has] - whole[has])
            begin = np.exp(self.start[p] + b[j, has] - whole[has]) if i == 0 else None
            for k in range(len(member)):
                m = member[k, has]
                np.add.at(inner[k], p, use * m)
                if begin is not None:
                    np.add.at(start[k], p, begin * m)

    def updated(self, start: np.ndarray, inner: np.ndarray, stop: float, prior: float = 300.0) -> "Lattice":
        """Weights from expected counts, and as many as `prior` counts of the weights so far."""
        return Lattice(start + prior * np.exp(self.start), inner + prior * np.exp(self.inner[:-1]), stop + prior * math.exp(self.stop))


def from_ranks(pieces: list[bytes]) -> tuple[Pieces, Lattice]:
    bodies = list(dict.fromkeys(p.removeprefix(MARK) for p in pieces if p != MARK))
    number = {p: i for i, p in enumerate(bodies)}
    start, inner = np.zeros(len(bodies) + 1), np.zeros(len(bodies))
    start[-1] = 1e-3
    for rank, p in enumerate(pieces, 3):
        if p.startswith(MARK) and p != MARK:
            start[number[p[len(MARK) :]]] = 1 / rank
        elif p != MARK:
            inner[number[p]] = 1 / rank
    return Pieces(bodies), Lattice(start, inner, 0.4 * inner.sum())


def short(words: list[bytes], most: int = 1 << 15) -> Iterator[np.ndarray]:
    """Places of words of 1 to LONG bytes, of about so many bytes at once."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    at = np.flatnonzero((sizes > 0) & (sizes <= LONG))
    if len(at):
        yield from np.split(at, np.flatnonzero(np.diff(np.cumsum(sizes[at]) // most)) + 1)


def piece_paths(pieces: Pieces, lattices: list[Lattice], words: list[bytes]) -> np.ndarray:
    """Log probability of each word by the pieces of each lattice; the empty word has none."""
    out = np.full((len(words), len(lattices)), np.nan)
    for part in short(words):
        e = pieces.walk([words[i] for i in part])
        for k, l in enumerate(lattices):
            out[part, k] = l.log_probability_many(pieces, e)
    rest = np.flatnonzero(np.isnan(out).any(1))
    for part in by_length([words[i] for i in rest]):
        part = rest[part]
        own = [words[i] for i in part]
        size = len(own[0])
        if size > LONG:
            edges = pieces.edges(own[0])
            out[part[0]] = [l.forward_one(size, edges)[-1] + l.stop for l in lattices]
        elif size:
            found = pieces.find(own)
            for k, l in enumerate(lattices):
                out[part, k] = l.log_probability(size, len(own), found)
        else:
            out[part] = NEG
    return out


def with_word(paths: np.ndarray, edge: np.ndarray, rest: float) -> np.ndarray:
    """The recursion's last step: the edge that spans the whole word joins the piece paths, which have the rest of the weight. log10."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(edge), paths + np.log(rest)) / math.log(10)


def numbered(block_bytes: int):
    """Rows with the number of their block: a task's rows in order, cut where the bytes of the texts would exceed block_bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            numbers = np.empty(b.num_rows, np.int64)
            for i, n in enumerate(pc.binary_length(b.column("text")).to_pylist()):
                n = (n or 0) + 64
                if size and size + n > block_bytes:
                    block, size = block + 1, 0
                size += n
                numbers[i] = block
            yield pa.record_batch([*b.columns, pa.array(numbers)], [*b.schema.names, "block"])

    return rows


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, k, text) to (block, word, k, c), k = -1 and c = 0 for rows that are held out."""
    store: dict[tuple[int, int], Counter] = {}

    def out():
        for (block, k), c in store.items():
            words = list(c)
            n = len(words)
            yield pa.record_batch([pa.array(np.full(n, block)), pa.array(words, pa.binary()), pa.array(np.full(n, k, np.int32)), pa.array(np.zeros(n, np.int64) if k < 0 else np.fromiter(c.values(), np.int64, n))], ["block", "word", "k", "c"])
        store.clear()

    for b in batches:
        for block, k, text in zip(b.column("block").to_pylist(), b.column("k").to_pylist(), b.column("text"), strict=True):
            words = (text.as_py() or b"").lower().split()
            words.append(END)
            c = store.get((block, k))
            if c is None:
                c = store[block, k] = Counter()
            c.update(words)
        if sum(map(len, store.values())) > FLUSH:
            yield from out()
    yield from out()


def _components(train: DataFrame) -> tuple[list[str], bool]:
    """The kinds that are components, and whether rows are left for a further one."""
    rows = train.groupBy("kind").count()
    total = rows.agg(F.sum("count")).first()[0] or 0
    own = rows.where(F.col("kind").isNotNull() & (F.col("count") >= LEAST_SHARE * total)).collect()
    return sorted(r[0] for r in own), sum(r[1] for r in own) < total or not own


def _log(x):
    with np.errstate(divide="ignore"):
        return np.log10(x)


class Model:
    """Totals and lattices; small whatever the corpus."""

    def __init__(self, pieces: Pieces, lattices: list[Lattice], totals: list[tuple[int, int, int, int, int]], shares: list[float], ends: int):
        #: totals: N, V, n1, n2, and words that other components hold too, of all training tokens, then of each component; lattices likewise. ends: training rows.
        self.pieces, self.lattices, self.totals, self.shares, self.ends = pieces, lattices, totals, shares, ends

    def answers(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """For each word: log10 P_k of the components, then the pieces of all components; counts[:, 0] of all, then by component."""
        end = np.fromiter((not w for w in words), bool, len(words))
        e = self.end_share
        paths = np.where(end[:, None], math.log(e), piece_paths(self.pieces, self.lattices, words) + math.log1p(-e))
        direct, low = self._step(0, counts[:, 0])
        out = []
        for k in range(1, len(self.totals)):
            own, less = self._step(k, counts[:, k])
            v, shared = self.totals[k][1], self.totals[k][4]
            b = min(0.99, max(0.01, shared / v)) if v and low < 1 else 0.0
            both = np.logaddexp(paths[:, 0] + math.log(POOLED), paths[:, k] + math.log(1 - POOLED))
            out.append(with_word(both, own + less * b * direct / max(1 - low, 1e-9), less * (1 - b)))
        return np.maximum(np.stack([*out, paths[:, 0] / math.log(10)], axis=1), -1e300)

    @property
    def end_share(self) -> float:
        return min(0.5, self.ends / self.totals[0][0]) if self.ends else 0.5

    def base(self, c: np.ndarray) -> np.ndarray:
        n, v, *_ = self.totals[0]
        return _log((c + 0.1) / (n + 0.1 * (v + 1)))

    def _step(self, k, c):
        """Discounted share of each word, and what is left for the words below."""
        n, v, n1, n2, _ = self.totals[k]
        if not n:
            return np.zeros(len(c)), 1.0
        d = min(0.9, max(0.1, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))
        return np.maximum(c - d, 0) / n, d * v / n


def _expected(words: DataFrame, pieces: Pieces, lattices: list[Lattice], groups: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Expected uses of each piece in the distinct training words of each group; lattices: one for all groups, or one each."""
    size = len(pieces.bodies)
    sent = words.sparkSession.sparkContext.broadcast((pieces, lattices))

    def count(batches):
        pieces, lattices = sent.value
        start, inner, stop = np.zeros((groups, size + 1)), np.zeros((groups, size)), np.zeros(groups)
        for b in batches:
            got = b.column("word").to_pylist()
            member = np.stack([b.column(f"c{k + 1}").to_numpy() for k in range(groups)]) > 0
            left = np.fromiter((len(w) > LONG for w in got), bool, len(got)) & member
            for part in short(got):
                e, m = pieces.walk([got[i] for i in part]), member[:, part]
                if len(lattices) == 1:
                    left[:, part] = m & lattices[0].expect_many(pieces, e, m, start, inner, stop)
                else:
                    for k in np.flatnonzero(m.any(1)):
                        left[k, part] = lattices[k].expect_many(pieces, e.of(m[k]), m[k : k + 1], start[k : k + 1], inner[k : k + 1], stop[k : k + 1])
            rest = np.flatnonzero(left.any(0))
            for part in by_length([got[i] for i in rest]):
                part = rest[part]
                own = [got[i] for i in part]
                found = pieces.edges(own[0]) if len(own[0]) > LONG else pieces.find(own)
                if len(lattices) == 1:
                    lattices[0].expect(len(own[0]), found, left[:, part].astype(float), start, inner, stop)
                else:
                    for k in range(groups):
                        here = np.flatnonzero(left[k, part])
                        if len(here):
                            few = found if isinstance(found, tuple) else {x: ids[here] for x, ids in found.items()}
                            lattices[k].expect(len(own[0]), few, np.ones((1, len(here))), start[k : k + 1], inner[k : k + 1], stop[k : k + 1])
        for k in range(groups):
            flat = np.concatenate([start[k], inner[k], stop[k : k + 1]])
            at = np.flatnonzero(flat > 1e-9)
            if len(at):
                yield pa.record_batch([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(flat[at])], ["k", "at", "v"])

    # One row for each group and piece of the vocabulary at most.
    use = words.mapInArrow(count, "k int, at int, v double").groupBy("k", "at").agg(F.sum("v").alias("v")).toPandas()
    flat = np.zeros((groups, 2 * size + 2))
    flat[use["k"], use["at"]] = use["v"]
    return [(x[: size + 1], x[size + 1 : -1], x[-1]) for x in flat]


def fit(requests: DataFrame, n_components: int, vocabulary: list[bytes], n_blocks: int, listed: int = LISTED) -> tuple[Model, DataFrame]:
    """The model, and the table (word, part, c0, c1, ..., blocks, spread) of counts. A row lists the blocks of one part that hold the word,
    parts of about `listed` blocks; one exchange by word serves the lists and the sums over the parts. spread: blocks of all parts."""
    names = [f"c{k}" for k in range(n_components + 1)]
    parts = -(-n_blocks // listed)
    wide = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")) < n_blocks // 4
    r = requests.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
    r = r.repartition(n_blocks // 4, "word") if wide else r.repartition("word") if parts > 1 else r
    words = r.groupBy("word", "part").agg(F.sum("c").alias("c0"), *(F.sum(F.when(F.col("k") == k - 1, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(1, n_components + 1)), F.collect_set("block").alias("blocks"))
    words = words.withColumns({"lead": F.lit(True), "spread": F.size("blocks")})
    if parts > 1:
        w = Window.partitionBy("word")
        words = words.withColumns({c: F.sum(c).over(w) for c in [*names, "spread"]} | {"lead": F.col("part") == F.min("part").over(w)})
    words = materialize(words)
    lead = words.where("lead")
    row = lead.agg(*(f for c in names for f in (F.sum(c), F.count_if(F.col(c) > 0), F.count_if(F.col(c) == 1), F.count_if(F.col(c) == 2), F.count_if((F.col(c) > 0) & (F.col("c0") > F.col(c)))))).first()
    totals = [tuple(int(x or 0) for x in row[5 * k : 5 * k + 5]) for k in range(n_components + 1)]
    ends = lead.where(F.length("word") == 0).first()
    docs = [int(ends[c]) if ends else 0 for c in names[1:]]
    shares = [d / sum(docs) for d in docs] if sum(docs) else [1 / n_components] * n_components
    pieces, first = from_ranks(vocabulary)
    train = lead.where(F.col("c0") > 0).drop("blocks")
    once = _expected(train, pieces, [first], n_components)
    each = [first.updated(*x) for x in once]
    each = [old.updated(*x) for old, x in zip(each, _expected(train, pieces, each, n_components), strict=True)]
    pooled = first.updated(*(sum(x[i] for x in once) for i in range(3)))
    return Model(pieces, [pooled, *each], totals, shares, sum(docs)), words


def score(docs: DataFrame, held_out: F.Column | None = None, component: str | None = "lang", vocabulary: str = VOCABULARY, block_bytes: int = BLOCK_BYTES, listed: int = LISTED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score for each row of docs."""
    spark = docs.sparkSession
    held = remainder(F.col("doc_id"), 10) == 0 if held_out is None else held_out
    kind = F.col(component).cast("string") if component in docs.columns else F.lit(None).cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), kind.alias("kind"), F.col("text").cast("binary").alias("text"))
    names, rest = _components(d.where("NOT held"))
    n = len(names) + rest
    k = reduce(lambda w, x: w.when(F.col("kind") == x[1], x[0]), enumerate(names), F.when(F.lit(False), 0)).otherwise(n - 1)
    d = d.select("doc_id", "held", F.when(F.col("held"), -1).otherwise(k).cast("int").alias("k"), "text")
    blocks = materialize(d.mapInArrow(numbered(block_bytes), "doc_id long, held boolean, k int, text binary, block long"))
    n_blocks = blocks.select("block").distinct().count()
    requests = blocks.select("block", "k", "text").mapInArrow(_counts, "block long, word binary, k int, c long")
    model, words = fit(requests, n, load_pieces(vocabulary), n_blocks, listed)
    sent = spark.sparkContext.broadcast(model)

    def answer(batches):
        model = sent.value
        for b in batches:
            got = b.column("word").to_pylist()
            if got:
                m = model.answers(got, np.stack([b.column(f"c{i}").to_numpy() for i in range(n + 1)], axis=1).astype(float))
                packed, size = np.ascontiguousarray(m, "<f8").tobytes(), 8 * (n + 1)
                yield pa.record_batch([b.column("blocks"), b.column("word"), b.column("c0"), pa.array([packed[i : i + size] for i in range(0, len(packed), size)], pa.binary())], ["blocks", "word", "c0", "answer"])

    # Packed, since a row goes to each block that holds the word.
    # A word of one block is answered there, from the block's own counts.
    known = words.where("spread > 1").mapInArrow(answer, "blocks array<long>, word binary, c0 long, answer binary")
    told = known.select(F.explode("blocks").alias("block"), "word", "c0", "answer")

    def scored(asked: pa.Table, rows: pa.Table) -> pa.Table:
        model = sent.value
        c0 = asked.column("c0").to_numpy().astype(float)
        lm = np.frombuffer(b"".join(asked.column("answer").to_pylist()), "<f8").reshape(-1, n + 1)
        at = defaultdict(count(len(c0)).__next__, zip(asked.column("word").to_pylist(), range(len(c0)), strict=True))
        places = []
        for text in rows.column("text"):
            found = (text.as_py() or b"").lower().split()
            found.append(END)
            places.append(np.fromiter(map(at.__getitem__, found), np.int32, len(found)))
        own = list(islice(at, len(c0), None))
        counts = np.zeros((len(own), n + 1))
        for k, p in zip(rows.column("k").to_pylist(), places, strict=True):
            if k >= 0:
                p = p[p >= len(c0)] - len(c0)
                np.add.at(counts, (p, 0), 1)
                np.add.at(counts, (p, k + 1), 1)
        c0 = np.concatenate([c0, counts[:, 0]])
        m = np.column_stack([c0 > 0, model.base(c0), np.concatenate([lm, model.answers(own, counts)]) if own else lm])
        out = np.zeros((rows.num_rows, n + 3))
        sizes = np.fromiter(map(len, places), np.int64, len(places))
        for i, p in enumerate(places):
            for a in range(0, len(p), 1 << 16):
                out[i] += m[p[a : a + (1 << 16)]].sum(0)
        x = out[:, 2:-1] + _log(np.maximum(model.shares, 1e-300))
        top = x.max(1, keepdims=True)
        total = top[:, 0] + np.log10(np.power(10.0, x - top).sum(1))
        cols = [rows.column("doc_id"), rows.column("held"), sizes, out[:, 0].round().astype(np.int64), np.full(len(sizes), model.totals[0][0]), out[:, 1], total, out[:, -1]]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in cols], names=RESULT_NAMES)

    # A task for each block, or so.
    many = n_blocks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = lambda df: (df.repartition(n_blocks, "block") if many else df).groupBy("block")
    return by(told).cogroup(by(blocks.select("block", "doc_id", "held", "k", "text"))).applyInArrow(scored, RESULT)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"
RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))

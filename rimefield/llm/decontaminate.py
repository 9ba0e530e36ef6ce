"""Benchmark decontamination with a generalised suffix automaton over the normalised words of the test items.

The automaton is built on the driver from distinct items and sent to the tasks; documents stream through it, each
word moving the state, so that the longest match that ends at each word is known. A word inside an occurrence of a
window (10 consecutive item words, or a shorter item as a whole) is hit. decontaminate() cuts the hit spans out of
the text and drops documents whose hit share exceeds the coverage limit.

The automaton's size is bounded by `max_words` item words; larger benchmarks are split into several automata (items
stay whole) and the documents pass through one after the other, with a table written in between.

Null and empty texts and items have no words. Repeated items count once per id; repeated documents get equal rows.
Items without an id hit and are cut like others, but have no name: n_items and items_sha256 leave them out.
An empty benchmark hits nothing, an empty document table gives no rows. Texts of any length are matched whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: MAX_WORDS: about 150 MB on the driver and in each Python worker.
WINDOW, COVERAGE, MAX_WORDS = 10, 0.5, 200_000
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Bytes of no word become blanks, A-Z lower case, the rest stays.
NORMAL = bytes(32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b + 32 if 65 <= b < 91 else b for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


class Automaton:
    """Of all items: states with transitions by word number, suffix link, longest length; which items' windows end in a state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in items if ws]
        for _, item in coded:
            last = 0
            for c in item:
                last = self._extend(last, c)
        #: At a state: (length, item) of windows that end there; the item is None where it has no id.
        self.ends: dict[int, set[tuple[int, str | None]]] = {}
        self.least = min([window, *(len(ws) for _, ws in coded)])
        for i, item in coded:
            state, size = 0, min(window, len(item))
            for k, c in enumerate(item):
                state = self.next[state][c]
                if k + 1 >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    self.ends.setdefault(at, set()).add((size, i))
        #: The nearest state on the way of suffix links, itself included, where a window ends; -1: none.
        self.near = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.near[s] = s if s in self.ends else self.near[self.link[s]]

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._state({}, self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, following: dict[int, int], length: int) -> int:
        self.next.append(following)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def match(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words (end exclusive) inside windows, merged, and the items with an id whose windows occur. Words unknown to the items end a
        match; stretches of known words shorter than any window need no walk."""
        codes = list(map(self.vocabulary.get, found))
        spans: list[tuple[int, int]] = []
        items: set[str | None] = set()
        known = np.fromiter((c is not None for c in codes), dtype=np.int8, count=len(codes))
        edges = np.flatnonzero(np.diff(known, prepend=np.int8(0), append=np.int8(0)))
        starts, stops = edges[0::2], edges[1::2]
        keep = stops - starts >= self.least
        nxt, link, length, near, ends = self.next, self.link, self.length, self.near, self.ends
        for a, b in zip(starts[keep].tolist(), stops[keep].tolist()):
            state = size = 0
            for k in range(a, b):
                c = codes[k]
                while state and c not in nxt[state]:
                    state = link[state]
                    size = length[state]
                if c in nxt[state]:
                    state, size = nxt[state][c], size + 1
                if size >= self.least:
                    at, longest = near[state], 0
                    while at > 0:
                        for n, item in ends[at]:
                            if n <= size:
                                items.add(item)
                                longest = max(longest, n)
                        at = near[link[at]]
                    if longest:
                        if spans and k + 1 - longest <= spans[-1][1]:
                            first = min(spans[-1][0], k + 1 - longest)
                            spans[-1] = (first, k + 1)
                        else:
                            spans.append((k + 1 - longest, k + 1))
        return merge(spans), items - {None}


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> Iterator[Automaton]:
    """Items stream to the driver, a part of at most max_words words (or one item) at a time."""
    part, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).distinct().toLocalIterator():
        ws = words(bytes(r[1]) if r[1] is not None else None)
        if part and size + len(ws) > max_words:
            yield Automaton(part, window)
            part, size = [], 0
        part.append((r[0], ws))
        size += len(ws)
    yield Automaton(part, window)


def mark(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """row (a struct of keep), text (binary), n (words), spans (flat list of starts and ends in words), items, for each row of docs."""
    spark = docs.sparkSession
    d = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("binary").alias("text"), F.lit(0).cast("long").alias("n"), F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = d.schema
    for k, machine in enumerate(automata(benchmark, window, max_words)):
        sent = spark.sparkContext.broadcast(machine)

        def rows(batches, sent=sent):
            machine = sent.value
            for b in batches:
                n, spans, items = [], [], []
                for t, old, had in zip(b.column("text"), b.column("spans"), b.column("items"), strict=True):
                    ws = words(t.as_py())
                    s, i = machine.match(ws)
                    if len(old):
                        flat = old.as_py()
                        s = merge([*s, *zip(flat[0::2], flat[1::2])])
                    n.append(len(ws))
                    spans.append([x for pair in s for x in pair])
                    items.append(sorted({*i, *had.as_py()}) if i or len(had) else [])
                yield pa.record_batch([b.column("row"), b.column("text"), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], schema.names)

        d = (d if k == 0 else materialize(d)).mapInArrow(rows, schema)
    return d


def cut(text: bytes, spans: list[int]) -> bytes:
    """The text without the bytes from each span's first word to its last."""
    at = [(m.start(), m.end()) for m in WORD.finditer(text.lower())]
    out, last = [], 0
    for a, b in zip(spans[0::2], spans[1::2]):
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The documents without hit spans; those with a hit share over the coverage limit go. Other columns stay, n_chars follows."""

    def cleaned(batches):
        for b in batches:
            spans, n, old = b.column("spans").to_pylist(), b.column("n").to_pylist(), b.column("text")
            stay = [i for i, s in enumerate(spans) if sum(s[1::2]) - sum(s[0::2]) <= coverage * max(1, n[i])]
            texts = [cut(old[i].as_py(), spans[i]).decode("utf-8", "replace") if spans[i] else None for i in stay]
            yield pa.record_batch([b.column("row").take(pa.array(stay, pa.int64())), pa.array(texts, pa.string())], ["row", "cut"])

    d = mark(docs, benchmark, docs.columns, window)
    d = d.mapInArrow(cleaned, d.select("row", F.lit(None).cast("string").alias("cut")).schema)
    old = lambda c: F.col("row").getField(c)
    new = {"text": lambda t: F.coalesce("cut", old("text").cast("string")), "n_chars": lambda t: F.coalesce(F.length("cut").cast(t), old("n_chars"))}
    return d.select(*((new[c](t) if c in new else old(c)).alias(c) for c, t in docs.dtypes))


DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _digest(batches):
    for b in batches:
        hits, items, shas = [], [], []
        for s, i in zip(b.column("spans"), b.column("items"), strict=True):
            flat, names = s.as_py(), i.as_py()
            hits.append(sum(flat[1::2]) - sum(flat[0::2]))
            items.append(len(names))
            shas.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.record_batch([b.column("doc_id").cast(pa.int64()), b.column("n"), pa.array(hits, pa.int64()), pa.array(items, pa.int64()), pa.array(shas), pa.array([h > 0 for h in hits])], [c.split()[0] for c in DIGEST.split(", ")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return d.select("row.doc_id", "n", "spans", "items").mapInArrow(_digest, DIGEST)


def _sql() -> str:
    """The query in SQL: all windows of all documents, of every size that items have, meet those of the items."""
    ws = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {ws} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {ws} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS n, array_to_string(w[k:k + least({WINDOW}, len(w)) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT rid, k, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT rid, k, n, item FROM dw JOIN iw USING (n, s)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM h) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""


SQL = _sql()

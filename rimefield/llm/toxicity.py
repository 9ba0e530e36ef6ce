"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding takes texts apart first (NFKD: accents and ligatures become letters and marks), drops marks and format
characters such as zero-width spaces, and then maps each character to one: lower case, look-alikes of other scripts to
Latin letters, digits and signs that stand for letters to those letters, i and l to one letter, all else to a blank. The lexicon holds whole
words and word beginnings, weighted by their log odds in toxic against other labelled rows; exception phrases (a
lexicon word with the word before or after it) are those that other rows hold and toxic ones hardly do. Weights of the matches, in all and
per 100 words, go into a logistic function fitted on the same rows.

An entry is learned from five toxic rows on, whatever their share, if a log-likelihood ratio test of its rows by class
passes. Learning reads at most about `sample` labelled training rows, chosen by a hash of doc_id (a documented bound);
this also bounds the entries and exceptions, which have no limit of their own.

Null and empty texts have no matches and get the score of a text without matches. Repeated rows score alike; equal
texts count once in learning. Without labels of both classes all scores are the share of toxic labels (0 if none).
A document with two labels counts as toxic if one says so. Labels of null count as none. Empty tables give no rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, remainder, table

#: SURE: the test's chi-square of one degree at 1e-4.
SAMPLE, SUPPORT, SURE, ODDS, STEMS = 20_000, 5, 15.137, 2.5, range(4, 9)
#: Look-alikes, and digits and signs for letters.
LOOK_ALIKES = dict(zip("аеорсухіѕјԁһӏкмтнвοαεικνρτυχ", "aeopcyxisjdhlkmthboaeikvptux", strict=True))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i"}


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        if unicodedata.category(c) in ("Mn", "Mc", "Me", "Cf"):
            self[code] = ""
        else:
            c = c.lower()[:1]
            c = LOOK_ALIKES.get(c, c)
            c = SUBSTITUTES.get(c, c)
            self[code] = c if c.isalpha() else " "
        return self[code]


FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words with one blank around each."""
    return f" {' '.join(unicodedata.normalize('NFKD', text or '').translate(FOLD).split())} "


@dataclass
class Lexicon:
    #: Weights by entry: " word " or " beginning".
    entries: dict[str, float]
    #: Phrases, " word word ", in which a match doesn't count.
    exceptions: set[str] = field(default_factory=set)
    #: Intercept and coefficients of log(1 + weight) and log(1 + weight per 100 words).
    line: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for e, w in self.entries.items():
            a.add_word(e, (len(e), w))
        if self.entries:
            a.make_automaton()
        return a

    def weigh(self, automaton, folded: str) -> tuple[float, float]:
        """Weight of all matches, each word once by its heaviest entry, and per 100 words."""
        best: dict[int, float] = {}
        if self.entries:
            for end, (n, w) in automaton.iter(folded):
                at = end - n + 1
                if w > best.get(at, 0.0):
                    best[at] = w
        if best and self.exceptions:
            best = {at: w for at, w in best.items() if not any(p in self.exceptions for p in phrases(folded, at))}
        total = sum(best.values())
        return total, 100 * total / max(1, folded.count(" ") - 1)

    def score(self, automaton, folded: str) -> float:
        total, per = self.weigh(automaton, folded)
        z = self.line[0] + self.line[1] * math.log1p(total) + self.line[2] * math.log1p(per)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def phrases(folded: str, at: int) -> list[str]:
    """The word that starts after the blank `at`, with the word before, and with the word after."""
    end = folded.index(" ", at + 1)
    before, after = folded.rfind(" ", 0, at), folded.find(" ", end + 1)
    return ([folded[before : end + 1]] if before >= 0 else []) + ([folded[at : after + 1]] if after >= 0 else [])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: tuple[Counter, Counter] = (Counter(), Counter())

    def out():
        names = list(count[0].keys() | count[1].keys())
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([count[1][x] for x in names], pa.int64()), pa.array([count[0][x] for x in names], pa.int64())], ["entry", "toxic", "other"])

    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            ws = set(fold(text).split())
            count[toxic].update({f" {w} " for w in ws} | {f" {w[:n]}" for w in ws for n in STEMS if n < len(w)})
        if len(count[0]) + len(count[1]) > 500_000:
            yield from out()
            count[0].clear(), count[1].clear()
    yield from out()


def ratio(a: Column, b: Column, toxic: int, other: int) -> Column:
    """Log-likelihood ratio (G squared) of a of the toxic and b of the other rows, against one share in both."""
    part = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    n = toxic + other
    cells = part(a) + part(b) + part(toxic - a) + part(other - b)
    return 2 * (cells - part(a + b) - part(n - a - b) - toxic * math.log(toxic) - other * math.log(other) + n * math.log(n))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """docs, labels: rows to learn from, joined by doc_id."""
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, sample / max(1, marked.count()))
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # Bounded by the sample size.
    rows = materialize(docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic").groupBy("text").agg(F.max("toxic").alias("toxic")))
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    toxic, other = n.get(1, 0), n.get(0, 0)
    if not toxic or not other:
        p = toxic / max(1, toxic + other)
        return Lexicon({}, set(), (math.log(max(p, 1e-9) / max(1 - p, 1e-9)), 0.0, 0.0))
    counts = rows.mapInArrow(_features, "entry string, toxic long, other long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("other") + 0.5) / (other + 1.0))
    best = counts.withColumn("odds", odds).where((F.col("toxic") >= SUPPORT) & (F.col("odds") >= ODDS) & (ratio(F.col("toxic"), F.col("other"), toxic, other) >= SURE)).collect()
    found = {r.entry: r.odds for r in best}
    # A longer entry goes where a beginning of it tells as much.
    lexicon = Lexicon({e: w for e, w in found.items() if not any(found.get(e[:n], 0) >= w - 0.5 for n in range(5, len(e)))})

    def seen(batches):
        automaton, pairs = lexicon.automaton(), Counter()
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                folded = fold(text)
                at = {end - n + 1 for end, (n, _) in automaton.iter(folded)} if lexicon.entries else ()
                pairs.update({(p, label) for x in at for p in phrases(folded, x)})
        yield pa.record_batch([pa.array([p for p, _ in pairs], pa.string()), pa.array([n * t for (_, t), n in pairs.items()], pa.int64()), pa.array([n * (1 - t) for (_, t), n in pairs.items()], pa.int64())], ["phrase", "toxic", "other"])

    spared = rows.mapInArrow(seen, "phrase string, toxic long, other long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    lexicon.exceptions = {r[0] for r in spared.where("other >= 3 AND toxic * 10 <= other").select("phrase").collect()}

    def weights(batches):
        automaton = lexicon.automaton()
        for b in batches:
            w = [lexicon.weigh(automaton, fold(t)) for t in b.column("text").to_pylist()]
            yield pa.record_batch([pa.array([x for x, _ in w], pa.float64()), pa.array([x for _, x in w], pa.float64()), b.column("toxic")], ["total", "per", "toxic"])

    # Three numbers for each row of the sample.
    got = rows.mapInArrow(weights, "total double, per double, toxic int").toPandas().to_numpy(float)
    lexicon.line = logistic(np.log1p(got[:, :2]), got[:, 2])
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if abs(step).max() < 1e-8:
            break
    return tuple(b)


def _scored(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """row (a struct of keep) and score for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def rows(batches):
        lexicon = sent.value
        automaton = lexicon.automaton()
        for b in batches:
            score = pa.array([lexicon.score(automaton, fold(t.as_py())) for t in b.column("text")], pa.float64())
            yield pa.record_batch([b.column("row"), score], ["row", "score"])

    d = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(rows, d.select("row", F.lit(None).cast("double").alias("score")).schema)


def apply(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """keep, and _score for each row."""
    return _scored(docs, lexicon, keep).select(*(F.col("row").getField(c).alias(c) for c in keep), F.col("score").alias("_score"))


def reject(docs: DataFrame, lexicon: Lexicon, limit: float = 0.5) -> DataFrame:
    """The documents that score below the limit, with all their columns."""
    d = _scored(docs, lexicon, docs.columns).where(F.col("score") < limit)
    return d.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def train_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    held = lambda d: d.where(remainder(F.col("doc_id"), 5) != 0)
    return table(spark, sf_dir, "documents").select("doc_id", "text"), held(table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = learn(*train_rows(spark, sf_dir))
    d = apply(table(spark, sf_dir, "documents"), lexicon, ["doc_id"])
    return d.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))

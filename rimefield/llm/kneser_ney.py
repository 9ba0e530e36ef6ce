"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

An n-gram is four UTF-16 units of the lower-case text (three start marks before, one end mark after; the marks are
surrogates without their other half, so no text holds their n-grams), packed exactly into a long: context and suffix
are bit operations. Counts of the trusted rows are summed by n-gram; lower orders count distinct left neighbours; each
order has discounts D1, D2, D3+ from its counts of counts. Joins of these tables, sharded by n-gram, context and
suffix, give the probability of each n-gram seen and the weight that each context leaves to shorter ones.

Documents are scored without being moved: where the model's tables hold at most `most` rows (measured, 16 bytes each)
they are sent to all tasks, packed and sorted, in one array per order. A greater model stays sharded: each block of
documents asks for its distinct n-grams, joins of the same tables answer, and the block is scored with the answers.
Both ways give the same perplexities.

A document is kept if its perplexity is at most the threshold of its language: a high quantile of the perplexities of
held-out trusted documents of that language, times a margin. A language with under 50 of them takes all its trusted
documents, and with under 50 of those the held-out ones of all languages.

Trusted rows are those with a label of quality 1. A fifth of them, by a hash of doc_id, is held out for the thresholds;
the model is trained on all others, whatever their number, so each trusted row counts for the model or the thresholds.
A caller may bound the rows trained on (`fitted`); those left over then count for the thresholds. Ids of training rows
are sent to all tasks while there are at most `sent` of them, else joined by a shuffle of the texts, without sorting
them; both ways count the same. If none is held out at all, the training rows give the thresholds. Null and empty texts are one end mark;
they are scored like others. Null languages are one language. Repeated rows get equal results; rows without an id are
not trusted. Without trusted rows perplexities are null and all rows are kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

HELD, QUANTILE, MARGIN, LEAST, BLOCK_BYTES, CHUNK, MOST, SENT = 0.2, 0.999, 1.05, 50, 24 << 20, 1 << 21, 4_000_000, 1_000_000
START, END = 0xD800, 0xDC00


def grams(text: bytes | None) -> np.ndarray:
    """The packed n-grams of a text, one for each unit and one for the end."""
    units = np.frombuffer((text or b"").decode("utf-8", "replace").lower().encode("utf-16-le", "surrogatepass"), "<u2").astype(np.int64)
    x = np.concatenate([[START] * 3, units, [END]]).astype(np.int64)
    return x[:-3] << 48 | x[1:-2] << 32 | x[2:-1] << 16 | x[3:]


def _chunks(texts) -> Iterator[np.ndarray]:
    part, size = [], 0
    for t in texts:
        g = grams(t.as_py())
        for a in range(0, len(g), CHUNK):
            part.append(g[a : a + CHUNK])
            size += len(part[-1])
            if size > CHUNK:
                yield np.concatenate(part)
                part, size = [], 0
    if part:
        yield np.concatenate(part)


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, c): n-grams of the texts (binary)."""

    def count(batches):
        for b in batches:
            for chunk in _chunks(b.column("text")):
                codes, u = pd.factorize(chunk)
                yield pa.record_batch([pa.array(u), pa.array(np.bincount(codes, minlength=len(u)).astype(np.int64))], ["gram", "c"])

    return texts.select("text").mapInArrow(count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def _context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, 16)


def _suffix(gram: Column, order: int) -> Column:
    """Without the first of `order` units."""
    return gram.bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))


class Tables:
    """By order n: seen[n] (gram, p) of n-grams seen, left[n] (context, weight) for shorter ones; floor: the share of each unit never seen."""

    def __init__(self, counts: DataFrame):
        orders = {4: counts}
        for n in (3, 2, 1):
            orders[n] = materialize(orders[n + 1].groupBy(_suffix(F.col("gram"), n + 1).alias("gram")).agg(F.count("*").alias("c")))
        self.seen: dict[int, DataFrame] = {}
        self.left: dict[int, DataFrame] = {}
        self.rows = 0
        for n in (1, 2, 3, 4):
            c = orders[n]
            row = c.agg(*(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)), F.sum("c").alias("total"), F.count("*").alias("types")).first()
            n1, n2, n3, n4 = (row[f"n{k}"] for k in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
            d = [min(k, max(0.0, k - (k + 1) * y * b / a)) if a else y for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
            d = [x if x > 0 else 0.1 for x in d]
            discount = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
            self.rows += row["types"]
            if n == 1:
                mass = c.agg(F.sum(discount)).first()[0] or 1.0
                total = float(row["total"] or 1)
                self.floor = mass / (row["types"] + 1.0) / total
                self.seen[1] = materialize(c.select("gram", ((F.col("c") - discount) / total + F.lit(self.floor)).alias("p")))
                continue
            stats = materialize(c.groupBy(_context(F.col("gram")).alias("context")).agg(F.sum("c").alias("total"), F.sum(discount).alias("mass")))
            self.rows += stats.count()
            self.left[n] = stats.select("context", (F.col("mass") / F.col("total")).alias("weight"))
            w = c.select("gram", _context(F.col("gram")).alias("context"), _suffix(F.col("gram"), n).alias("suffix"), (F.col("c") - discount).alias("kept"))
            w = w.join(stats, "context").join(self.seen[n - 1].select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
            self.seen[n] = materialize(w.select("gram", ((F.col("kept") + F.col("mass") * F.col("lower")) / F.col("total")).alias("p")))

    def of(self, asked: DataFrame) -> DataFrame:
        """(gram) of order 4 to (gram, logp), by joins from the lowest order up."""
        wanted = {4: asked.select("gram")}
        for n in (3, 2, 1):
            wanted[n] = wanted[n + 1].select(_suffix(F.col("gram"), n + 1).alias("gram")).distinct()
        below = materialize(wanted[1].join(self.seen[1], "gram", "left").select("gram", F.coalesce("p", F.lit(self.floor)).alias("p")))
        for n in (2, 3, 4):
            w = wanted[n].withColumn("context", _context(F.col("gram"))).withColumn("suffix", _suffix(F.col("gram"), n))
            w = w.join(self.seen[n], "gram", "left").join(self.left[n], "context", "left").join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
            below = materialize(w.select("gram", F.coalesce("p", F.coalesce("weight", F.lit(1.0)) * F.col("lower")).alias("p")))
        return below.select("gram", F.log("p").alias("logp"))

    def packed(self) -> "Packed":
        """The tables on the driver; only where `rows` is within a bound."""

        def arrays(df, key, value):
            t = df.select(key, value).toArrow()
            k, v = t.column(0).to_numpy(), t.column(1).to_numpy()
            order = np.argsort(k)
            return k[order], v[order]

        return Packed({n: arrays(df, "gram", "p") for n, df in self.seen.items()}, {n: arrays(df, "context", "weight") for n, df in self.left.items()}, self.floor)


class Packed:
    """Sorted arrays of keys and values for each order."""

    def __init__(self, seen: dict, left: dict, floor: float):
        self.seen, self.left, self.floor = seen, left, floor

    @staticmethod
    def _find(table, x: np.ndarray, other) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not len(keys):
            return np.zeros(len(x), bool), np.broadcast_to(np.asarray(other, float), len(x)).copy()
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        hit = keys[at] == x
        return hit, np.where(hit, values[at], other)

    def logp(self, g: np.ndarray) -> np.ndarray:
        p = self._find(self.seen[1], g & 0xFFFF, self.floor)[1]
        for n in (2, 3, 4):
            own = g if n == 4 else g & ((1 << 16 * n) - 1)
            context = (own >> 16) & ((1 << 16 * (n - 1)) - 1)
            weight = self._find(self.left[n], context, 1.0)[1]
            p = self._find(self.seen[n], own, weight * p)[1]
        return np.log(p)


SCORED = "doc_id long, lang string, n_units long, perplexity double"


def _means(ids, langs, texts, logp) -> pa.RecordBatch:
    """Perplexities; logp gives the logarithms for an array of n-grams. Short texts go together, long ones in chunks."""
    n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    part, rows, size = [], [], 0

    def flush():
        nonlocal part, rows, size
        if part:
            codes, u = pd.factorize(np.concatenate(part))
            x = logp(u)[codes]
            np.add.at(total, rows, np.add.reduceat(x, np.cumsum([0, *map(len, part[:-1])])))
        part, rows, size = [], [], 0

    for i, t in enumerate(texts):
        g = grams(t.as_py())
        n[i] = len(g)
        for a in range(0, len(g), CHUNK):
            part.append(g[a : a + CHUNK])
            rows.append(i)
            size += len(part[-1])
            if size > CHUNK:
                flush()
    flush()
    with np.errstate(over="ignore"):
        return pa.record_batch([ids, langs, pa.array(n), pa.array(np.exp(-total / np.maximum(n, 1)))], [c.split()[0] for c in SCORED.split(", ")])


def score_sent(docs: DataFrame, model: Packed) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for b in batches:
            yield _means(b.column("doc_id"), b.column("lang"), b.column("text"), sent.value.logp)

    return docs.mapInArrow(rows, SCORED)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams by block; a block may be told in parts."""
    for b in batches:
        blocks = b.column("block").to_numpy()
        for block in np.unique(blocks):
            for chunk in _chunks(b.filter(pa.array(blocks == block)).column("text")):
                u = pd.unique(chunk)
                yield pa.record_batch([pa.array(np.full(len(u), block)), pa.array(u)], ["block", "gram"])


def _score_block(asked: pa.Table, rows: pa.Table) -> pa.Table:
    index = pd.Index(asked.column("gram").to_numpy())
    first = ~index.duplicated()
    index, logp = index[first], asked.column("logp").to_numpy()[first]
    rows = rows.combine_chunks()
    one = lambda c: rows.column(c).chunk(0) if rows.num_rows else rows.column(c).combine_chunks()
    return pa.Table.from_batches([_means(one("doc_id"), one("lang"), one("text"), lambda u: logp[index.get_indexer(u)])])


def score_joined(docs: DataFrame, tables: Tables, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks are dealt by a hash of id and text, so rows without an id or of one id are dealt too."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, int(size // block_bytes) + 1)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block")
    # Both uses of `dealt` take the same columns, so that Spark writes one exchange of the texts and reads it twice.
    asked = materialize(dealt.mapInArrow(_asked, "block long, gram long").distinct())
    told = asked.join(tables.of(asked.select("gram").distinct()), "gram").select("block", "gram", "logp")
    return told.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(_score_block, SCORED)


def _units(batches):
    for b in batches:
        n = pa.array([len(grams(t.as_py())) for t in b.column("text")], pa.int64())
        yield pa.record_batch([b.column("doc_id"), b.column("lang"), n, pa.nulls(b.num_rows, pa.float64())], [c.split()[0] for c in SCORED.split(", ")])


def trusted_rows(labels: DataFrame, fitted: int | None = None, held: float = HELD) -> DataFrame:
    """(doc_id, trains): rows of quality 1; the model learns from all but the share `held`, or, on demand, from about `fitted` at most."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    share = 1.0 - held if fitted is None else min(1.0 - held, fitted / max(1, good.count()))
    return good.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).alias("trains"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, fitted: int | None = None, held: float = HELD, most: int = MOST, sent: int = SENT) -> DataFrame:
    """doc_id, lang, n_units, perplexity, threshold, keep for each row of docs."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"))
    good = materialize(trusted_rows(labels, fitted, held))
    learned = good.where("trains").select("doc_id")
    # At most `sent` longs go through the driver.
    learned = F.broadcast(learned) if learned.count() <= sent else learned.hint("shuffle_hash")
    counts = materialize(count_grams(d.join(learned, "doc_id", "left_semi")))
    if counts.isEmpty():
        return d.mapInArrow(_units, SCORED).select("*", F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("keep"))
    tables = Tables(counts)
    scored = materialize(score_sent(d, tables.packed()) if tables.rows <= most else score_joined(d, tables))
    marked = scored.join(good, "doc_id")
    q = lambda c: F.percentile_approx(c, F.lit(quantile), F.lit(10000))
    outside = F.when(~F.col("trains"), F.col("perplexity"))
    whole = marked.agg(F.coalesce(q(outside), q(F.col("perplexity")))).first()[0]
    of = marked.groupBy("lang").agg(q(outside).alias("held"), F.count(outside).alias("n_held"), q(F.col("perplexity")).alias("all"), F.count("*").alias("n"))
    own = F.when(F.col("n_held") >= LEAST, F.col("held")).when(F.col("n") >= LEAST, F.col("all")).otherwise(F.lit(whole))
    limits = of.select(F.col("lang").alias("_lang"), (own * margin).alias("limit"))
    out = scored.join(limits, scored["lang"].eqNullSafe(limits["_lang"]), "left").withColumn("threshold", F.coalesce("limit", F.lit(None if whole is None else whole * margin).cast("double")))
    return out.select("doc_id", "lang", "n_units", "perplexity", "threshold", (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))).alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

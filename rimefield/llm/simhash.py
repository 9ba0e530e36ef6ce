"""SimHash near-duplicates with pigeonring filtering.

A fingerprint bit is set if it is set in over half of the XXH64 hashes (seed 42) of the text's word shingles.
Fingerprints link at `limit` = 3 or fewer differing bits of 64. The bits form a ring of 8 segments of 8 bits. By the
pigeonring principle a linked pair has a segment from which every chain of n consecutive segments differs in at most
floor(n * 3 / 8) bits: chains of 1 and 2 are equal, chains of 3, 4 and 5 differ in one bit at most. So two segments
and two of the next three are equal, which gives 8 * 3 join keys of 32 bits; candidates from these keys must keep all
chain budgets, and then the full Hamming distance is checked. No linked pair is lost.

Equal fingerprints are one row from the start. Where more than BUCKET fingerprints share a key, no pairs are made:
each member sends itself to all points at distance 2 or less; at a point, one member at distance 1 or less is linked
to all others there. That is exact too (1 + 2 = 3) and grows with the members, not with their square.

Null and empty texts have the fingerprint zero and link like any other. Texts of fewer words than a shingle are one
shingle. A null doc_id gets its fingerprint; it is a component id only where the group has no other id.
Repeated rows give repeated rows. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SHINGLE, SEED, LIMIT, BUCKET = 3, 42, 3, 400


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(words) - shingle])]
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])], dtype=">u8")
    total, count = np.zeros(64, dtype=np.int64), len(h)
    for i in range(0, count, 1 << 16):
        total += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > count).view(">u8")[0])


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
        yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_hash_batches, "doc_id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * (i % 8)).bitwiseAND(F.lit(255))


def keys(fp: Column) -> Column:
    """24 keys: rotation and masked segment in the upper bits, four segments below."""
    out = []
    for i in range(8):
        for masked in (2, 3, 4):
            key = F.lit(i * 3 + masked - 2).cast("long")
            for j in (0, 1, 2, 3, 4):
                if j != masked:
                    key = F.shiftleft(key, 8).bitwiseOR(_segment(fp, i + j))
            out.append(key)
    return F.array(*out)


def _chains(x: Column, rotation: Column, limit: int = LIMIT) -> Column:
    """Whether the difference x keeps the budget of every chain that starts at the rotation."""
    turned = F.expr("0L")
    for i in range(8):
        turn = x if i == 0 else F.shiftrightunsigned(x, 8 * i).bitwiseOR(F.shiftleft(x, 64 - 8 * i))
        turned = F.when(rotation == i, turn).otherwise(turned)
    good = F.lit(True)
    for n in range(1, 9):
        part = turned if n == 8 else turned.bitwiseAND(F.lit((1 << 8 * n) - 1))
        good = good & (F.bit_count(part) <= n * limit // 8)
    return good


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: links that connect all distinct fingerprints which differ in 3 or fewer bits."""
    keyed = fps.select("fp", F.explode(keys(F.col("fp"))).alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = materialize(keyed.join(full, "key"))
    small = keyed.where(F.col("n") <= bucket).select("key", "fp")
    x = F.col("a").bitwiseXOR(F.col("b"))
    rotation = (F.shiftright("key", 32) / 3).cast("int")
    pairs = small.withColumnRenamed("fp", "a").join(small.withColumnRenamed("fp", "b"), "key").where(F.col("a") < F.col("b"))
    pairs = pairs.where(_chains(x, rotation)).where(F.bit_count(x) <= LIMIT).select("a", "b")
    large = keyed.where(F.col("n") > bucket).select("fp").distinct()
    points = large.withColumn("i", F.explode(F.sequence(F.lit(-1), F.lit(62)))).withColumn("j", F.explode(F.sequence(F.when(F.col("i") < 0, -1).otherwise(F.col("i") + 1), F.lit(63))))
    bit = lambda c: F.when(F.col(c) < 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftleft(1L, {c})"))
    points = points.select(F.col("fp").bitwiseXOR(bit("i")).bitwiseXOR(bit("j")).alias("point"), "fp", F.when(F.col("i") < 0, 1).otherwise(2).alias("r"))
    near = points.groupBy("point").agg(F.min(F.when(F.col("r") == 1, F.col("fp"))).alias("hub"), F.count("*").alias("n")).where("hub IS NOT NULL AND n > 1").select("point", "hub")
    spokes = points.join(near, "point").where("fp <> hub").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))
    return pairs.unionByName(spokes).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of (a, b): root is the smallest node of the component.

    Large-star and small-star steps in turn, each a group-by of the links; the state is written to the shared folder
    after each round, and rounds number about the logarithm of the longest path."""
    e = materialize(edges.select("a", "b"))
    before = None
    while True:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b")
        small = small.select(F.col("m").alias("a"), "b").unionByName(small.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        e = materialize(small)
        now = e.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.count_distinct("b")).first()
        if now == before and now[0] == now[2]:
            break
        before = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("root"))


def grouped(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    marked = materialize(fingerprints(docs))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), bucket))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(ids, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One document of each group stays, that of the smallest id, once; rows without an id stay all."""
    names = docs.columns
    groups = grouped(docs, bucket).where("doc_id IS NOT NULL AND doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(groups, docs["doc_id"] == groups["gone"], "left_anti").select(*(docs[c] for c in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(table(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Mixing sources to target weights, in DataFrame functions only.

Tokens are summed per source; each source gets a share of the budget by its weight, at most `cap` times its size
(the rest goes to the others by weight); target / size is the source's repetition rate. A document is emitted
floor(rate) times, and once more if a uniform number hashed from its id and the seed is below the fraction.

Nulls: a null text has size 0; null is a source of its own, last in order. Sources without words have target 0 and
rate 0. Repeated rows are decided alike, since the draw depends on the id alone. An empty table gives no rows.
Columns beyond those used don't matter for plan(); mix() keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import count_words, materialize, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP, SEED, SENT = 1.5, 2.0, "mix-1", 200_000


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the md5 of id and seed; the same in every run and engine."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target, rate).

    The level at which the shares of the sources below their caps use up the budget is found in one pass over the
    sources sorted by cap / weight: running sums give the level for each number of capped sources; the first that is within its source's reach holds. This table has
    one row per source, whatever the number of documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))
    s = sources.withColumn("n", F.row_number().over(order) - 1).withColumn("w", cycle).withColumn("most", F.lit(cap) * F.col("source_size"))
    by = Window.orderBy("reach", "n")
    up_to, everything = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("reach", F.col("most") / F.col("w"))
    s = s.withColumns({
        "left": F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(up_to), F.lit(0.0)),
        "open": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(up_to), F.lit(0.0)),
    })
    level = F.col("left") / F.col("open")
    s = s.withColumn("level", F.min(F.when(level <= F.col("reach"), F.struct("reach", "n", level.alias("level")))).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("w")))
    return s.select("source", "source_size", target.alias("target")).withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))


def plan(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP, seed=SEED, keep: list[str] | None = None) -> DataFrame:
    """Each row with size, source_size, target and copies. keep: the input's columns to carry besides."""
    keep = ["doc_id", "source"] if keep is None else keep
    names = ["_size", "_total", "_target", "_rate"]
    sized = docs.select(*keep, count_words(F.col("text")).alias(names[0]))
    by_source = docs.groupBy("source").agg(F.sum(count_words(F.col("text"))).alias("source_size"))
    t = targets(by_source, weights, share, cap).select(F.col("source").alias("_source"), F.col("source_size").alias(names[1]), F.col("target").alias(names[2]), F.col("rate").alias(names[3]))
    # One row per source. Sent to all tasks where they are few: else every text would be shuffled by its source.
    t = materialize(t)
    t = F.broadcast(t) if t.count() <= SENT else t
    joined = sized.join(t, sized["source"].eqNullSafe(t["_source"]), "left")
    rate = F.col("_rate")
    copies = F.floor(rate) + F.when(uniform(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.select(*keep, *names[:3], copies.cast("int").alias("_copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with the input's columns."""
    d = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text")
    d = plan(d, keep=["row", "doc_id", "source"], **options).where("_copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return d.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(table(spark, sf_dir, "documents"))
    return p.select("doc_id", F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).cast("long").alias("taken"))


def mix_sql(source: str, columns: str = "doc_id, size, source_size, target, taken", tail: str = "") -> str:
    return f"""
WITH sized AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM {source}),
tot AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
             row_number() OVER (ORDER BY source NULLS LAST) AS n FROM tot),
r AS (SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / w AS reach FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY reach, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY reach, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev FROM r),
t AS (SELECT source, source_size, least(most, coalesce((SELECT lev FROM l WHERE lev <= reach ORDER BY reach, n LIMIT 1), 1e300) * w) AS target FROM l),
m AS (SELECT s.*, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) AS rate,
             ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, 'null') || '|{SEED}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM sized s LEFT JOIN t ON s.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::INT AS copies, (size * copies)::BIGINT AS taken FROM m)
SELECT {columns} FROM c {tail}
"""


SQL = mix_sql("documents")

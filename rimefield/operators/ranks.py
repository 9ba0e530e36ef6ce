"""Exact percentiles of groups of any size, a single group of all rows included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_percentiles(df: DataFrame, keys: list[str], value: str, qs: list[float], parts: int = 64) -> DataFrame:
    """keys, n, q0, q1, ...: interpolated percentiles of a column, as F.percentile gives them.

    No task holds a group: values are cut into `parts` ranges (at approximate quantiles of all rows, which only steer the
    work), ranges are counted per group, and only the ranges that hold a wanted rank are looked into, by running counts
    of their distinct values. df is read three times; write it to a table first where it is dear.
    """
    d = df.where(F.col(value).isNotNull()).select(*(F.col(k) for k in keys), F.col(value).cast("double").alias("_v"))
    cuts = sorted(set(d.approxQuantile("_v", [i / parts for i in range(1, parts)], 0.5 / parts))) if parts > 1 else []
    d = d.withColumn("_part", _range(F.col("_v"), cuts))
    w = Window.partitionBy(*keys)
    counts = d.groupBy(*keys, "_part").agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_c").over(w))
    at = F.array(*(F.struct(F.lit(i).alias("q"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("at")) for i, q in enumerate(qs)))
    ranks = counts.select("*", F.explode(at).alias("_q")).select("*", F.explode(F.array(F.struct(F.floor("_q.at").alias("rank"), F.lit(0).alias("up")), F.struct(F.ceil("_q.at").alias("rank"), F.lit(1).alias("up")))).alias("_r"))
    ranks = ranks.where((F.col("_r.rank") >= F.col("_before")) & (F.col("_r.rank") < F.col("_before") + F.col("_c")))
    ranks = ranks.select(*keys, "_part", "_n", "_before", F.col("_q.q").alias("_i"), F.col("_q.at").alias("_at"), F.col("_r.rank").alias("_rank"), F.col("_r.up").alias("_up"))
    runs = d.join(ranks.select(*keys, "_part").distinct(), [*keys, "_part"], "left_semi")
    runs = runs.groupBy(*keys, "_part", "_v").agg(F.count("*").alias("_c"))
    runs = runs.withColumn("_to", F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    hit = runs.join(ranks, [*keys, "_part"]).where((F.col("_rank") - F.col("_before") < F.col("_to")) & (F.col("_rank") - F.col("_before") >= F.col("_to") - F.col("_c")))
    frac = F.col("_at") - F.floor("_at")
    part = F.when(F.col("_up") == 1, frac).otherwise(1 - frac) * F.col("_v")
    return hit.groupBy(*keys).agg(F.first("_n").alias("n"), *(F.sum(F.when(F.col("_i") == i, part)).alias(f"q{i}") for i in range(len(qs))))


def _range(v, cuts: list[float]):
    """The number of cuts at or below v, by binary choice."""

    def choose(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v < cuts[mid], choose(lo, mid)).otherwise(choose(mid + 1, hi))

    return choose(0, len(cuts))

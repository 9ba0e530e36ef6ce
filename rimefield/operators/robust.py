"""Robust statistics as DataFrame functions; group keys are lists of column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD_SCALE = 0.6745


def finite(c: Column) -> Column:
    """NaN and infinities become NULL, so that aggregates skip them."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def mad_filter(df: DataFrame, keys: list[str], value: str, k: float, min_n: int) -> DataFrame:
    """Drop rows further than k scaled MADs from the group's median, in groups of min_n or more with MAD > 0."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_med", F.median(value).over(w)).withColumn("_n", F.count(value).over(w))
    d = d.withColumn("_dev", F.abs(F.col(value) - F.col("_med"))).withColumn("_mad", F.median("_dev").over(w))
    keep = (F.col("_n") < min_n) | (F.col("_mad") <= 0) | (F.col("_dev") <= k * F.col("_mad") / MAD_SCALE)
    return d.where(keep).drop("_med", "_n", "_dev", "_mad")


def mad_filter_asymmetric(df: DataFrame, keys: list[str], value: str, low: float = 1.0, high: float = 2.0) -> DataFrame:
    """Keep med - low*MAD/.6745 <= v <= med + high*MAD/.6745; with MAD 0 only the median itself stays."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_med", F.median(value).over(w)).withColumn("_mad", F.median(F.abs(F.col(value) - F.col("_med"))).over(w))
    s = F.col("_mad") / MAD_SCALE
    return d.where(F.col(value).between(F.col("_med") - low * s, F.col("_med") + high * s)).drop("_med", "_mad")


def node_medians(df: DataFrame, keys: list[str], value: str, k: float = 5.0, min_n: int = 8) -> DataFrame:
    """Median and count per node after the MAD filter, for nodes with min_n values left."""
    d = mad_filter(df, keys, value, k, min_n)
    return d.groupBy(*keys).agg(F.median(value).alias("node_median"), F.count(value).alias("n_obs")).where(F.col("n_obs") >= min_n)


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, out: str) -> DataFrame:
    """Lower weighted median: the first sorted value at which the running weight reaches half of the total."""
    w = Window.partitionBy(*keys)
    run = w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_cw", F.sum(weight).over(run)).withColumn("_w", F.sum(weight).over(w))
    return d.where((F.col("_w") > 0) & (F.col("_cw") >= F.col("_w") / 2)).groupBy(*keys).agg(F.min(value).alias(out))


def pair_slopes(df: DataFrame, keys: list[str], t: str, y: str, min_dt: float) -> DataFrame:
    """Slopes of all pairs of a group that are min_dt apart or more (more than 0 apart where min_dt is 0); groups hold
    collapsed passes, a few dozen rows."""
    d = df.select(*keys, F.col(t).alias("_t"), F.col(y).alias("_y"))
    a, b = d.withColumnsRenamed({"_t": "_ta", "_y": "_ya"}), d.withColumnsRenamed({"_t": "_tb", "_y": "_yb"})
    dt = F.col("_tb") - F.col("_ta")
    return a.join(b, keys).where((F.col("_ta") < F.col("_tb")) & (dt >= min_dt)).select(*keys, ((F.col("_yb") - F.col("_ya")) / dt).alias("slope"))


def theil_sen(df: DataFrame, keys: list[str], t: str, y: str, min_dt: float = 0.08, min_n: int = 3) -> DataFrame:
    """Median pair slope, and sigma = median |slope - median| / .6745 / sqrt(pairs)."""
    s = pair_slopes(df, keys, t, y, min_dt)
    w = Window.partitionBy(*keys)
    s = s.withColumn("_m", F.median("slope").over(w)).withColumn("_d", F.abs(F.col("slope") - F.col("_m")))
    s = s.groupBy(*keys).agg(F.first("_m").alias("trend"), (F.median("_d") / MAD_SCALE / F.sqrt(F.count("*"))).alias("trend_sigma"), F.count("*").alias("n_pairs"))
    n = df.groupBy(*keys).agg(F.count(y).alias("n_obs")).where(F.col("n_obs") >= min_n)
    return s.join(n, keys)


def bisquare_mean(df: DataFrame, keys: list[str], value: str, k: float = 4.685) -> DataFrame:
    """Mean with bisquare weights around the median, and its standard error."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_r", F.col(value) - F.median(value).over(w)).withColumn("_mad", F.median(F.abs("_r")).over(w))
    u = F.try_divide(F.col("_r"), k * F.col("_mad") / MAD_SCALE)
    d = d.withColumn("_w", F.when(F.col("_mad") <= 0, 1.0).when(F.abs(u) < 1, F.pow(1 - u * u, F.lit(2.0))).otherwise(0.0))
    d = d.withColumn("_sw", F.sum("_w").over(w)).withColumn("_m", F.try_divide(F.sum(F.col("_w") * F.col(value)).over(w), F.col("_sw")))
    var = F.try_divide(F.sum(F.col("_w") * F.pow(F.col(value) - F.col("_m"), F.lit(2.0))), F.sum("_w"))
    n_eff = F.try_divide(F.pow(F.sum("_w"), F.lit(2.0)), F.sum(F.col("_w") * F.col("_w")))
    return d.groupBy(*keys).agg(F.first("_m").alias("mean"), F.sqrt(var / F.greatest(n_eff, F.lit(1.0))).alias("sigma"), F.count(value).alias("n"))


def pass_ids(df: DataFrame, keys: list[str], time: str, tie: str, gap_seconds: int = 3600) -> DataFrame:
    """Number of the pass within its key: a new pass starts when the gap is over gap_seconds."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    us = F.unix_micros(F.col(time).cast("timestamp"))
    d = df.withColumn("_us", us)
    new = F.when(F.col("_us") - F.lag("_us").over(w) > gap_seconds * 1_000_000, 1).otherwise(0)
    return d.withColumn("_new", new).withColumn("pass_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_us", "_new")


def band_of(c: Column, edges=((0, 1000, "low"), (1000, 1500, "middle"), (1500, 9999, "high"))) -> Column:
    """Half-open elevation band, NULL outside."""
    out = F.lit(None).cast("string")
    for lo, hi, name in edges:
        out = F.when((c >= lo) & (c < hi), name).otherwise(out)
    return out


def spearman(df: DataFrame, keys: list[str], x: str, y: str, min_n: int = 10) -> DataFrame:
    """Correlation of average ranks."""
    def ranked(c):
        w = Window.partitionBy(*keys)
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2.0

    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.withColumn("_rx", ranked(x)).withColumn("_ry", ranked(y))
    return d.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n")).where(F.col("n") >= min_n)

"""Anomalies of cell series: seasonally equalised z-scores, monthly series, bootstrap intervals, climate z-scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .robust import MAD_SCALE, mad_filter


def order_key(seed: int, ident: Column) -> Column:
    """Hash that orders a sample; the same in every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), ident.cast("string")).cast("binary"))


def capped(df: DataFrame, keys: list[str], ident: str, cap: int, seed: int = 42) -> DataFrame:
    """At most cap rows of each key, by hash order (the sampling that the z-score is defined by)."""
    w = Window.partitionBy(*keys).orderBy(order_key(seed, F.col(ident)), ident)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def _z(target: DataFrame, base: DataFrame, keys: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    b = base.withColumn("_m", F.median(value).over(w)).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    b = b.groupBy(*keys).agg(F.first("_m").alias("base_median"), F.median("_d").alias("_mad"), F.stddev_samp(value).alias("_sd"), F.count(value).alias("n_base"))
    sigma = F.when(F.col("_mad") > 0, F.col("_mad") / MAD_SCALE).otherwise(F.col("_sd"))
    j = target.join(b, keys).withColumn("_s", sigma).where((F.col("n_base") >= 3) & (F.col("_s") > 0))
    return j.withColumn("z", (F.col("target_median") - F.col("base_median")) / F.col("_s")).drop("_mad", "_sd", "_s")


def zscore_window(df: DataFrame, keys: list[str], time: str, value: str, ident: str, year: int, months: list[int], min_target: int = 30, cap: int = 30) -> DataFrame:
    """z of the target months of a year against the other observations, at most cap of each calendar month."""
    d = mad_filter(df, keys, value, 3.0, 30).withColumn("_month", F.month(time))
    hit = (F.year(time) == year) & F.month(time).isin(months)
    t = d.where(hit).groupBy(*keys).agg(F.median(value).alias("target_median"), F.count(value).alias("n_target")).where(F.col("n_target") >= min_target)
    return _z(t, capped(d.where(~hit), [*keys, "_month"], ident, cap), keys, value)


def monthly_z(df: DataFrame, keys: list[str], time: str, value: str, ident: str, min_target: int = 10, cap: int = 30) -> DataFrame:
    """z of every month with min_target observations, sub-sampled to as many, against the other months' observations (capped by calendar month).

    Observations are ranked once, by hash within key and calendar month. For a target month the other eleven calendar
    months give their first `cap` of that order, the same for all targets: they are one list of 12 * cap values per key.
    Only the target's own calendar month depends on the target: its first cap + (rows of the month) hold what is drawn."""
    d = mad_filter(df, keys, value, 3.0, 30).withColumn("month", F.date_trunc("month", F.col(time).cast("timestamp"))).withColumn("_cal", F.month(time))
    order = [order_key(42, F.col(ident)), ident]
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_cal").orderBy(*order))).withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "_cal", "month")))
    t = capped(d.where(F.col("_n") >= min_target), [*keys, "month"], ident, min_target)
    t = t.groupBy(*keys, "month").agg(F.median(value).alias("target_median"), F.count("*").alias("n_target"), F.first("_cal").alias("_cal"), F.first("_n").alias("_size"))
    pool = d.where(F.col("_r") <= cap).groupBy(*keys).agg(F.collect_list(F.struct("_cal", F.col(value).cast("double").alias("v"))).alias("_pool"))
    near = d.select(*keys, "_cal", F.col("month").alias("_m"), "_r", F.col(value).cast("double").alias("_v"))
    own = t.select(*keys, "_cal", "month", "_size").join(near, [*keys, "_cal"]).where((F.col("_r") <= cap + F.col("_size")) & (F.col("_m") != F.col("month")))
    own = own.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "month").orderBy("_r"))).where(F.col("_r") <= cap)
    own = own.groupBy(*keys, "month").agg(F.collect_list("_v").alias("_own"))
    j = t.join(own, [*keys, "month"], "left").join(pool, keys)
    others = F.transform(F.filter("_pool", lambda p: p["_cal"] != F.col("_cal")), lambda p: p["v"])
    base = F.sort_array(F.concat(others, F.coalesce("_own", F.array().cast("array<double>"))))
    j = j.select(*keys, "month", "target_median", "n_target", _let(base, _spread).alias("_b"))
    # The explode of one element keeps the statistics from being computed anew in each place that names them.
    j = j.select(*keys, "month", "target_median", "n_target", F.explode(F.array("_b")).alias("_b")).where((F.col("_b.n") >= 3) & (F.col("_b.s") > 0))
    return j.select(*keys, "month", "target_median", "n_target", F.col("_b.middle").alias("base_median"), F.col("_b.n").alias("n_base"), ((F.col("target_median") - F.col("_b.middle")) / F.col("_b.s")).alias("z"))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _spread(b: Column) -> Column:
    """Of a sorted array: n, middle and s, the scaled MAD or, where that is 0, the sample deviation."""
    n = F.size(b)
    mean = F.aggregate(b, F.lit(0.0), lambda a, v: a + v) / n

    def rest(x):
        mad = _let(F.sort_array(F.transform(b, lambda v: F.abs(v - x["middle"]))), _middle)
        sd = F.sqrt(F.aggregate(b, F.lit(0.0), lambda a, v: a + (v - x["mean"]) * (v - x["mean"])) / F.greatest(n - 1, F.lit(1)))
        return _let(mad, lambda m: F.struct(n.cast("long").alias("n"), x["middle"].alias("middle"), F.when(m > 0, m / MAD_SCALE).otherwise(sd).alias("s")))

    return F.when(n >= 3, _let(F.struct(_middle(b).alias("middle"), mean.alias("mean")), rest))


def _middle(ordered: Column) -> Column:
    """Median of a sorted array that isn't empty."""
    n = F.size(ordered)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def climate_z(df: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """z of each year's value against the median over all years; MAD / .6745, or the sample deviation where MAD is 0."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_m", F.median(value).over(w)).withColumn("_mad", F.median(F.abs(F.col(value) - F.col("_m"))).over(w)).withColumn("_sd", F.stddev_samp(value).over(w))
    s = F.when(F.col("_mad") > 0, F.col("_mad") / MAD_SCALE).otherwise(F.col("_sd"))
    return d.select(*keys, year, value, F.when(s > 0, (F.col(value) - F.col("_m")) / s).alias("z"))


def block_bootstrap(df: DataFrame, keys: list[str], block: str, value: str, draws: int = 500, seed: int = 42) -> DataFrame:
    """2.5 and 97.5 % of the median over blocks drawn with replacement; quartiles of the values for keys of under 3 blocks."""
    blocks = df.select(*keys, block).distinct().withColumn("_slot", F.row_number().over(Window.partitionBy(*keys).orderBy(block)) - 1)
    n = blocks.groupBy(*keys).agg(F.count("*").alias("_n"))
    d = n.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_rep").cast("string"), F.col("_k").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    d = d.withColumn("_slot", (h % F.col("_n")).cast("int")).join(blocks, [*keys, "_slot"]).join(df.select(*keys, block, value), [*keys, block])
    m = d.groupBy(*keys, "_rep").agg(F.median(value).alias("_m")).groupBy(*keys).agg(F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975))).alias("_ci"))
    q = df.groupBy(*keys).agg(F.median(value).alias("median"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_iqr"))
    j = q.join(m, keys).join(n, keys)
    pick = lambda i: F.when(F.col("_n") < 3, F.col("_iqr")[i]).otherwise(F.col("_ci")[i])
    return j.select(*keys, "median", pick(0).alias("ci_low"), pick(1).alias("ci_high"), F.col("_n").alias("n_blocks"))


def median_series(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, quartiles and count across cells, per band and month or whatever the keys."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    return df.groupBy(*keys).agg(F.median(value).alias("median"), q.alias("_q"), F.count(value).alias("n")).select(*keys, "median", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p75"), "n")


def blocks(ix: Column, iy: Column, size: int = 10) -> Column:
    """The spatial block of a cell: size x size cells."""
    return F.concat_ws("_", F.floor(ix / size).cast("string"), F.floor(iy / size).cast("string"))


def exceedance(df: DataFrame, keys: list[str], value: str, limit: float) -> DataFrame:
    """Count and percent of the values above a limit."""
    over = F.count_if(F.col(value) > limit)
    return df.groupBy(*keys).agg(F.count(value).alias("n"), over.alias("n_over")).withColumn("pct_over", F.try_divide(F.col("n_over") * 100.0, F.col("n")))


def selected_months(df: DataFrame, keys: list[str], month: str, value: str, months: list[int], fill: float = 1e10) -> DataFrame:
    """Mean over selected months; values above the fill limit are missing."""
    return df.where(F.col(month).isin(months)).groupBy(*keys).agg(F.avg(F.when(F.col(value) <= fill, F.col(value))).alias("mean"))


EVENTS = {"summer_2019": ("2019-06-01", "2019-08-31"), "summer_2023": ("2023-06-01", "2023-08-31")}


def event_of(time: Column, events: dict[str, tuple[str, str]] = EVENTS) -> Column:
    """Name of the event interval that holds a time, both days included."""
    out = F.lit(None).cast("string")
    for name, (first, last) in events.items():
        out = F.when(F.to_date(time).between(F.lit(first).cast("date"), F.lit(last).cast("date")), name).otherwise(out)
    return out

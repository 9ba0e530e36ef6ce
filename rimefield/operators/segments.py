"""Along-track segment kernel: adaptive confidence, windows, smoothing, resampling, detrending, variogram."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .robust import mad_filter_asymmetric
from .spatial import azimuth


def adaptive_level(df: DataFrame, keys: list[str], x: str, level: str, min_span: float = 160.0, spacing: float = 0.7, max_gap: float = 7.0, levels=(4, 3, 2, 1)) -> DataFrame:
    """Per key the highest confidence level whose points (level and above) are dense: 2 or more, span, count and greatest gap."""
    d = df.withColumn("_lev", F.explode(F.array(*map(F.lit, levels)))).where(F.col(level) >= F.col("_lev"))
    w = Window.partitionBy(*keys, "_lev").orderBy(x)
    d = d.withColumn("_gap", F.col(x) - F.lag(x).over(w))
    s = d.groupBy(*keys, "_lev").agg(F.count("*").alias("n"), (F.max(x) - F.min(x)).alias("_span"), F.max("_gap").alias("_max"))
    ok = s.where((F.col("n") >= 2) & (F.col("_span") >= min_span) & (F.col("n") >= F.col("_span") / spacing) & (F.col("_max") <= max_gap))
    best = ok.groupBy(*keys).agg(F.max("_lev").alias("level"), F.max_by("n", "_lev").alias("n_used"))
    return best.withColumn("cnf_used", F.when(F.col("level") == levels[0], F.lit(str(levels[0]))).otherwise(F.concat(F.lit(f"{levels[0]}+"), F.col("level").cast("string"))))


def moving_filter(df: DataFrame, keys: list[str], x: str, y: str, width: float = 10.0) -> DataFrame:
    """Asymmetric MAD filter in windows of the distance from the group's start; a point at the very end of a whole number of windows goes."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_x0", F.min(x).over(w)).withColumn("_x1", F.max(x).over(w))
    d = d.withColumn("window_no", F.floor((F.col(x) - F.col("_x0")) / width)).where(F.col("_x0") + F.col("window_no") * width < F.col("_x1"))
    return mad_filter_asymmetric(d, [*keys, "window_no"], y).drop("_x0", "_x1")


def kernel_smooth(df: DataFrame, keys: list[str], x: str, y: str, bandwidth: float) -> DataFrame:
    """Gaussian weights of the neighbours within one bandwidth."""
    by = ", ".join(f"`{k}`" for k in keys)  # bounds with fractions need SQL
    near = F.expr(f"collect_list(struct(`{x}` AS x, `{y}` AS y)) OVER (PARTITION BY {by} ORDER BY `{x}` RANGE BETWEEN {float(bandwidth)}D PRECEDING AND {float(bandwidth)}D FOLLOWING)")
    d = df.withColumn("_near", near)
    weight = lambda p: F.exp(-0.5 * F.pow((p["x"] - F.col(x)) / bandwidth, F.lit(2.0)))
    top = F.aggregate("_near", F.lit(0.0), lambda a, p: a + weight(p) * p["y"])
    low = F.aggregate("_near", F.lit(0.0), lambda a, p: a + weight(p))
    return d.withColumn("smooth", top / low).drop("_near")


def resample(df: DataFrame, keys: list[str], x: str, y: str, step: float) -> DataFrame:
    """Linear interpolation on the lattice min, min + step, ... below max. x is distinct within keys."""
    w = Window.partitionBy(*keys).orderBy(x)
    d = df.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), F.min(x).over(Window.partitionBy(*keys)).alias("_x0"))
    w = Window.partitionBy(*keys).orderBy("_x")
    d = d.withColumn("_xn", F.lead("_x").over(w)).withColumn("_yn", F.lead("_y").over(w)).where("_xn IS NOT NULL")
    first, last = F.ceil((F.col("_x") - F.col("_x0")) / step), F.ceil((F.col("_xn") - F.col("_x0")) / step) - 1
    d = d.where(last >= first).withColumn("i", F.explode(F.sequence(first, last)))
    at = F.col("_x0") + F.col("i") * step
    return d.select(*keys, "i", (F.col("_y") + (F.col("_yn") - F.col("_y")) * (at - F.col("_x")) / (F.col("_xn") - F.col("_x"))).alias("y"))


def detrend_rms(df: DataFrame, keys: list[str], x: str, y: str, min_n: int = 10) -> DataFrame:
    """Standard deviation of the residuals of the least-squares line."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_mx", F.avg(x).over(w)).withColumn("_my", F.avg(y).over(w))
    d = d.withColumn("_cx", F.col(x) - F.col("_mx")).withColumn("_cy", F.col(y) - F.col("_my"))
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("_cx") * F.col("_cx")).alias("_sxx"), F.sum(F.col("_cx") * F.col("_cy")).alias("_sxy"), F.sum(F.col("_cy") * F.col("_cy")).alias("_syy"))
    slope = F.coalesce(F.try_divide("_sxy", "_sxx"), F.lit(0.0))
    rms = F.sqrt(F.greatest((F.col("_syy") - slope * F.col("_sxy")) / F.col("n"), F.lit(0.0)))
    return g.where(F.col("n") >= min_n).select(*keys, "n", slope.alias("slope"), rms.alias("rms"))


def subsegment_rms(df: DataFrame, keys: list[str], x: str, y: str, parts: int = 4, min_n: int = 30) -> DataFrame:
    """Median of the detrended RMS of equal parts of the span; the greatest x belongs to none."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_x0", F.min(x).over(w)).withColumn("_x1", F.max(x).over(w))
    d = d.withColumn("part", F.floor((F.col(x) - F.col("_x0")) * parts / F.nullif(F.col("_x1") - F.col("_x0"), F.lit(0.0)))).where(F.col("part") < parts)
    return detrend_rms(d, [*keys, "part"], x, y, min_n).groupBy(*keys).agg(F.median("rms").alias("rms_sub_median"), F.count("*").alias("n_valid"))


def variogram(df: DataFrame, keys: list[str], i: str, y: str, max_lag: int) -> DataFrame:
    """Half the mean square difference per lag of a regular lattice: an equi-join on the lattice number."""
    a = df.select(*keys, F.col(i).alias("_i"), F.col(y).alias("_a"))
    b = df.select(*keys, F.col(i).alias("_j"), F.col(y).alias("_b"))
    a = a.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag)))).withColumn("_j", F.col("_i") + F.col("lag"))
    return a.join(b, [*keys, "_j"]).groupBy(*keys, "lag").agg((F.avg(F.pow(F.col("_a") - F.col("_b"), F.lit(2.0))) / 2).alias("gamma"), F.count("*").alias("n"))


def semivariogram(df: DataFrame, keys: list[str], x: str, y: str, n_lags: int = 20, first: float = 0.1, min_n: int = 10) -> DataFrame:
    """(keys, bin, lag, gamma, n, extent) from points: half the mean square difference of the pairs in n_lags equal bins of distance from
    `first` to a third of the extent. Groups of under min_n points have none. Pairs come from an equi-join on buckets of a third of the extent."""
    d = df.where(F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    w = Window.partitionBy(*keys)
    d = d.withColumn("_n", F.count("*").over(w)).withColumn("_x0", F.min("_x").over(w)).withColumn("extent", F.max("_x").over(w) - F.col("_x0"))
    d = d.withColumn("_reach", F.col("extent") / 3).where((F.col("_n") >= min_n) & (F.col("_reach") > first)).withColumn("_b", F.floor((F.col("_x") - F.col("_x0")) / F.col("_reach")))
    a = d.select(*keys, "extent", "_reach", F.col("_x").alias("_xa"), F.col("_y").alias("_ya"), F.explode(F.array(F.col("_b"), F.col("_b") + 1)).alias("_b"))
    j = a.join(d.select(*keys, "_b", F.col("_x").alias("_xb"), F.col("_y").alias("_yb")), [*keys, "_b"]).withColumn("_h", F.col("_xb") - F.col("_xa"))
    width = (F.col("_reach") - first) / n_lags
    j = j.where((F.col("_h") >= first) & (F.col("_h") < F.col("_reach"))).withColumn("bin", F.least(F.floor((F.col("_h") - first) / width), F.lit(n_lags - 1)).cast("int"))
    g = j.groupBy(*keys, "bin").agg((F.avg(F.pow(F.col("_ya") - F.col("_yb"), F.lit(2.0))) / 2).alias("gamma"), F.count("*").alias("n"), F.first("extent").alias("extent"))
    return g.withColumn("lag", first + (F.col("bin") + 0.5) * (F.col("extent") / 3 - first) / n_lags)


def fit_gaussian(lag: np.ndarray, gamma: np.ndarray) -> tuple[float, float, float]:
    """(nugget, variance, length) of nugget + var * (1 - exp(-pi/4 * (h / length)**2)), nugget and variance not negative.

    Linear in the first two, so only the length is searched: the least squares of all lengths of a grid are solved at once
    in closed form, and the grid is drawn closer around the best one."""
    n, sy = len(lag), gamma.sum()
    grid = np.geomspace(max(lag.min() / 4, 1e-9), lag.max() * 4, 60)
    best = (np.inf, np.nan, np.nan, np.nan)
    for _ in range(4):
        f = 1 - np.exp(-np.pi / 4 * (lag[None, :] / grid[:, None]) ** 2)
        sf, sff, sfy = f.sum(1), (f * f).sum(1), f @ gamma
        det = n * sff - sf * sf
        with np.errstate(divide="ignore", invalid="ignore"):
            var = np.where(det > 1e-12, (n * sfy - sf * sy) / det, 0.0)
            nugget = (sy - var * sf) / n
            through = np.where(sff > 0, np.maximum(sfy / sff, 0.0), 0.0)
        var, nugget = np.where(nugget < 0, through, var), np.maximum(nugget, 0.0)
        nugget, var = np.where(var < 0, max(sy / n, 0.0), nugget), np.maximum(var, 0.0)
        err = ((nugget[:, None] + var[:, None] * f - gamma[None, :]) ** 2).sum(1)
        k = int(np.argmin(err))
        if err[k] < best[0]:
            best = (err[k], nugget[k], var[k], grid[k])
        grid = np.linspace(best[3] * 0.85, best[3] * 1.15, 41)
    return float(best[1]), float(best[2]), float(best[3])


def variogram_fit(df: DataFrame, keys: list[str], extent: str | None = None) -> DataFrame:
    """Gaussian model per key from (lag, gamma); plausible: 1 <= length <= half the extent (a column; else three times the greatest lag),
    in the unit of the lags. Keys of under 3 bins have none. A key's bins are one short list; many lists are fitted in a batch."""
    size = F.col(extent) if extent else F.lit(None).cast("double")
    g = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("lag").cast("double").alias("lag"), F.col("gamma").cast("double").alias("gamma")))).alias("_bins"), F.max(size).cast("double").alias("_extent"))

    def fit(parts):
        for p in parts:
            rows = []
            for bins, reach in zip(p["_bins"], p["_extent"], strict=True):
                if len(bins) < 3:
                    rows.append((np.nan, np.nan, np.nan, False))
                    continue
                lag, gamma = np.array([b["lag"] for b in bins]), np.array([b["gamma"] for b in bins])
                n, v, length = fit_gaussian(lag, gamma)
                rows.append((n, v, length, bool(1 <= length <= (reach if reach == reach and reach is not None else 3 * lag.max()) / 2)))
            yield p[keys].assign(**{c: [r[i] for r in rows] for i, c in enumerate(("nugget", "variance", "length", "plausible"))})

    schema = df.select(*keys).schema
    for c in ("nugget", "variance", "length"):
        schema = schema.add(c, "double")
    out = g.mapInPandas(fit, schema.add("plausible", "boolean"))
    return out.select(*keys, *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("nugget", "variance", "length")), "plausible")


def roughness(df: DataFrame, keys: list[str], x: str, y: str, level: str, time: str, lon: str, lat: str, min_photons: int = 200, min_span: float = 160.0, spacing: float = 0.7, max_gap: float = 7.0,
              window: float = 10.0, bandwidth: float = 2.0, step: float = 0.5, min_n: int = 10, sub_n: int = 30) -> DataFrame:
    """Photons to one roughness record per segment (the keys): confidence by density, moving filter, kernel surface, resampled lattice,
    detrended RMS, sub-segment RMS, semivariogram range, first-to-last azimuth and centroid. Segments with under min_photons points, no
    dense level, or under min_n points after a step have no record."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_all", F.count("*").over(w)).where(F.col("_all") >= min_photons).drop("_all")
    dense = adaptive_level(d, keys, x, level, min_span, spacing, max_gap).select(*keys, F.col("level").alias("_level"), "cnf_used")
    d = d.join(dense, keys)
    # The centroid and the ends are those of all photons of the segment.
    ends = d.groupBy(*keys).agg(F.min(time).alias("time"), F.avg(lat).alias("lat_centroid"), F.avg(lon).alias("lon_centroid"), F.first("cnf_used").alias("cnf_used"),
                                F.min_by(F.struct(lon, lat), F.struct(time, x)).alias("_a"), F.max_by(F.struct(lon, lat), F.struct(time, x)).alias("_b"))
    kept = moving_filter(d.where(F.col(level) >= F.col("_level")).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")), keys, "_x", "_y", window)
    n = kept.groupBy(*keys).agg(F.count("*").alias("n_photons_filtered")).where(F.col("n_photons_filtered") >= min_n)
    smooth = kernel_smooth(kept, keys, "_x", "_y", bandwidth).groupBy(*keys, "_x").agg(F.avg("smooth").alias("_s"))
    s = resample(smooth, keys, "_x", "_s", step).withColumn("_x", F.col("i") * step)
    fit = detrend_rms(s, keys, "_x", "y", min_n).select(*keys, F.col("n").alias("n_surface"), "slope", F.col("rms").alias("RMS"))
    sub = subsegment_rms(s, keys, "_x", "y", 4, sub_n).select(*keys, "rms_sub_median", F.col("n_valid").alias("n_valid_subsegments"))
    mean = s.groupBy(*keys).agg(F.avg("y").alias("mean_surface"), F.avg("_x").alias("_mx"))
    flat = s.join(fit.select(*keys, "slope"), keys).join(mean, keys).select(*keys, "_x", (F.col("y") - F.col("mean_surface") - F.col("slope") * (F.col("_x") - F.col("_mx"))).alias("_y"))
    reach = variogram_fit(semivariogram(flat, keys, "_x", "_y", min_n=min_n), keys, "extent").select(*keys, F.col("length").alias("semivariogram_range"), F.col("plausible").alias("semivariogram_valid"))
    out = ends.join(n, keys).join(fit, keys).join(mean.drop("_mx"), keys).join(sub, keys, "left").join(reach, keys, "left")
    out = out.withColumn("azimuth", azimuth(F.col("_a")[lon], F.col("_a")[lat], F.col("_b")[lon], F.col("_b")[lat]))
    return out.withColumn("n_valid_subsegments", F.coalesce("n_valid_subsegments", F.lit(0))).drop("_a", "_b")

"""Noise model from crossover pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import exact_percentiles

#: Reaches along an axis of a tile; positions along an axis within a tile (its reaches, its margins and one more at each
#: end); rows and candidates that are handled at once.
TILE, SIDE, ROWS, CANDIDATES = 16, 24, 100_000, 1_000_000


def crossover_pairs(df: DataFrame, keys: list[str], ident: str, day: str, value: str, min_days: int = 1, max_days: int = 30, x: str | None = None, y: str | None = None, radius: float = 0.0) -> DataFrame:
    """Unordered pairs within keys whose whole days are min_days to max_days apart and, where x and y are given, at most radius apart.

    Rows are dealt to tiles of keys and TILE reaches along each axis (max_days, radius); only those within reach of an
    edge are copied to the tile beyond it, so little more than the rows themselves is moved, once. Within its tile a row
    is held against the neighbouring cells of one reach, so the work grows with the pairs, not with the square of a key's
    history. A pair is told in the tile of its earlier row. Rows with a null key, id, day or place, or a place of NaN, are in no pair."""
    d = tiled(df, keys, ident, day, value, max_days, x, y, radius)
    groups, kinds = [*keys, *(c for c in d.columns if c.startswith("_g"))], dict(d.dtypes)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, wanted = [], ROWS
        for b in batches:
            rest.append(b)
            if sum(r.num_rows for r in rest) < wanted:
                continue
            t = pa.Table.from_batches(rest).combine_chunks()
            cut = int(np.flatnonzero(_starts(t, groups))[-1])
            if cut:
                yield from _near(t.slice(0, cut), groups, min_days, max_days, radius)
            rest, wanted = t.slice(cut).to_batches(), max(ROWS, 2 * (t.num_rows - cut))
        if rest:
            yield from _near(pa.Table.from_batches(rest), groups, min_days, max_days, radius)

    dealt = d.repartition(*groups).sortWithinPartitions(*groups)
    j = dealt.mapInArrow(sweep, f"_ai {kinds['_i']}, _bi {kinds['_i']}, _av {kinds['_v']}, _bv {kinds['_v']}")
    return j.select(F.col("_ai").alias("ia"), F.col("_bi").alias("ib"), F.abs(F.col("_av") - F.col("_bv")).alias("diff"), ((F.col("_av") + F.col("_bv")) / 2).alias("mean_rms"))


def tiled(df: DataFrame, keys: list[str], ident: str, day: str, value: str, max_days: int, x: str | None, y: str | None, radius: float) -> DataFrame:
    """keys, _i, _d, _v, _x, _y, the tile by _gt, _gx, _gy, and _home: whether the row itself lies there."""
    step, width = max(1, max_days), radius * 1.001  # wider than the radius by more than divisions are rounded
    carry = {ident: "_i", day: "_d", value: "_v"} | ({x: "_x", y: "_y"} if x else {})
    d = df.select(*keys, *(F.col(c).alias(n) for c, n in carry.items())).where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, *(n for n in carry.values() if n != "_v")]))
    d = d.withColumns({"_d": F.col("_d").cast("long")} | {n: F.col(n).cast("double") for n in ("_x", "_y") if x})
    if x:
        d = d.where(~F.isnan("_x") & ~F.isnan("_y"))
    tile = lambda v: F.floor(v / (TILE * width) + 0.5)  # noqa: E731  middles at multiples: places near zero are far from an edge
    axes = [("_gt", F.floor((F.col("_d") - max_days) / (TILE * step)), F.floor(F.col("_d") / (TILE * step)), F.floor(F.col("_d") / (TILE * step)))]
    axes += [(f"_g{n}", tile(F.col(f"_{n}") - width), tile(F.col(f"_{n}") + width), tile(F.col(f"_{n}"))) for n in ("x", "y") if x]
    for g, low, high, _ in axes:
        d = d.withColumn(g, F.explode(F.sequence(low, high)))
    home = F.lit(True)
    for g, _, _, own in axes:
        home = home & (F.col(g) == own)
    return d.withColumn("_home", home)


def _starts(t: pa.Table, groups: list[str]) -> np.ndarray:
    """Whether each row differs in its group from the one before."""
    out = np.zeros(t.num_rows, bool)
    out[:1] = True
    for c in groups:
        a = t.column(c)
        out[1:] |= pc.not_equal(a.slice(1), a.slice(0, t.num_rows - 1)).to_numpy()
    return out


def _near(t: pa.Table, groups: list[str], min_days: int, max_days: int, radius: float) -> Iterator[pa.RecordBatch]:
    """The pairs of whole tiles: rows are ordered by cell, and each meets those behind it in its own and the following cells."""
    t = t.combine_chunks()
    step, width, axes = max(1, max_days), radius * 1.001, [n for n in ("x", "y") if f"_{n}" in t.column_names]
    of = {c: t.column(c).to_numpy() for c in t.column_names if c in ("_d", "_x", "_y", "_gt", "_gx", "_gy")}
    cell = [of["_d"] // step - TILE * of["_gt"] + 1]
    for n in ("x", "y"):
        if n not in axes:
            cell.append(np.ones(t.num_rows, np.int64))
            continue
        cell.append(np.clip(np.floor(of[f"_{n}"] / width) - TILE * of[f"_g{n}"].astype(float) + TILE // 2 + 2, 1, SIDE - 2).astype(np.int64))
    group = np.cumsum(_starts(t, groups))
    code = ((group * SIDE + cell[0]) * SIDE + cell[1]) * SIDE + cell[2]
    order = np.argsort(code, kind="stable")
    home = t.column("_home").to_numpy()
    code, group, home, place = code[order], group[order], home[order], {c: of[f"_{c}"][order] for c in ("d", *axes)}
    ident, value = t.column("_i").chunk(0), t.column("_v").chunk(0)
    for dt, dx in ((0, 0), (1, 0), *(((0, 1), (1, -1), (1, 1)) if axes else ())):
        to = code + (dt * SIDE + dx) * SIDE
        low = np.searchsorted(code, to - 1) if (dt, dx) != (0, 0) else np.arange(1, len(code) + 1)
        many = np.searchsorted(code, to + 1, "right") - low
        rows = np.flatnonzero(many > 0)
        ends = np.cumsum(many[rows])
        for part in np.split(rows, np.flatnonzero(np.diff(ends // CANDIDATES)) + 1):
            if not len(part):
                continue
            n = many[part]
            a = np.repeat(part, n)
            b = np.arange(len(a)) + np.repeat(low[part] - np.cumsum(n) + n, n)
            days = np.abs(place["d"][a] - place["d"][b])
            ok = (group[a] == group[b]) & (days >= min_days) & (days <= max_days)
            if axes:
                a, b = a[ok], b[ok]
                ok = np.sqrt((place["x"][a] - place["x"][b]) ** 2 + (place["y"][a] - place["y"][b]) ** 2) <= radius
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            ia, ib = ident.take(pa.array(order[a])), ident.take(pa.array(order[b]))
            less, more = (f(ia, ib).to_numpy(zero_copy_only=False) for f in (pc.less, pc.greater))
            da, db = place["d"][a], place["d"][b]
            ok = (less | more) & np.where((da < db) | ((da == db) & less), home[a], home[b])
            first, last = (pa.array(order[np.where(less, p, q)[ok]]) for p, q in ((a, b), (b, a)))
            yield pa.record_batch([ident.take(first), ident.take(last), value.take(first), value.take(last)], ["_ai", "_bi", "_av", "_bv"])


def sigma68(pairs: DataFrame, x: str, diff: str, width: float, n_bins: int, min_n: int = 30) -> DataFrame:
    """68.27th percentile of |diff| in bins of x; the upper edge of the last bin belongs to none."""
    b = pairs.select(F.floor(F.col(x) / width).alias("bin"), F.abs(diff).alias("_d")).where(F.col("bin").between(0, n_bins - 1))
    g = exact_percentiles(b, ["bin"], "_d", [0.6827]).where(F.col("n") >= min_n).select("bin", F.col("q0").alias("sigma"), "n")
    return g.withColumn("center", (F.col("bin") + 0.5) * width)


def fit_line(bins: DataFrame, zero_intercept: bool = False) -> DataFrame:
    """sigma = m*center + c weighted by n with m, c >= 0 (c = 0 on demand), closed form: one row (m, c, rmse, n_bins, m_error, c_error).

    Errors are those of the free parameters, from the inverse of the normal matrix scaled by the weighted residuals over
    the degrees of freedom; null where none are left. With the intercept forced to zero its error is 0."""
    w, x, y = F.col("n").cast("double"), F.col("center"), F.col("sigma")
    s = bins.agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy"), F.sum(w * y * y).alias("wyy"),
                 F.count("*").alias("n_bins"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"))
    through = F.greatest(F.try_divide("wxy", "wxx"), F.lit(0.0))
    if zero_intercept:
        s = s.withColumn("m", through).withColumn("c", F.lit(0.0))
    else:
        m0 = F.try_divide(F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy"), F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx"))
        s = s.withColumn("m0", m0).withColumn("c0", (F.col("wy") - F.col("m0") * F.col("wx")) / F.col("w"))
        s = s.withColumn("m", F.when(F.col("m0") < 0, 0.0).when(F.col("c0") < 0, through).otherwise(F.col("m0")))
        s = s.withColumn("c", F.when(F.col("m0") < 0, F.greatest(F.col("wy") / F.col("w"), F.lit(0.0))).when(F.col("c0") < 0, 0.0).otherwise(F.col("c0")))
    m, c, n = F.col("m"), F.col("c"), F.col("n_bins")
    square = F.col("syy") + m * m * F.col("sxx") + n * c * c + 2 * m * c * F.col("sx") - 2 * m * F.col("sxy") - 2 * c * F.col("sy")
    weighted = F.greatest(F.col("wyy") + m * m * F.col("wxx") + F.col("w") * c * c + 2 * m * c * F.col("wx") - 2 * m * F.col("wxy") - 2 * c * F.col("wy"), F.lit(0.0))
    free = n - (1 if zero_intercept else 2)
    scale = F.when(free > 0, weighted / free)
    det = F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")
    errors = (F.sqrt(F.try_divide(scale, F.col("wxx"))), F.lit(0.0)) if zero_intercept else (F.sqrt(F.try_divide(scale * F.col("w"), det)), F.sqrt(F.try_divide(scale * F.col("wxx"), det)))
    return s.select("m", "c", F.sqrt(F.greatest(square / n, F.lit(0.0))).alias("rmse"), "n_bins", errors[0].alias("m_error"), errors[1].alias("c_error"))


def fit_band(fit: DataFrame, x: Column) -> DataFrame:
    """The fit's rows with the band of one standard error at x: low (never below 0) and high."""
    m, c, dm, dc = (F.col(k) for k in ("m", "c", "m_error", "c_error"))
    low = F.greatest((m - dm) * x + F.greatest(c - dc, F.lit(0.0)), F.lit(0.0))
    return fit.withColumns({"x": x, "sigma": m * x + c, "low": low, "high": (m + dm) * x + (c + dc)})


def mdc_table(fit: DataFrame, low: float, high: float, rows: int = 12) -> DataFrame:
    """Smallest change that counts, 1.96 * sigma * sqrt(2), at evenly spaced x."""
    d = fit.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    d = d.withColumn("x", low + F.col("row") * (high - low) / (rows - 1)).withColumn("sigma", F.col("m") * F.col("x") + F.col("c"))
    return d.select("row", "x", "sigma", (F.col("sigma") * (1.96 * 2**0.5)).alias("mdc"))

"""Queries by name on the driver's tables, and the SQL that gives the same rows.

Roles: lineitem holds observations (time l_shipdate, value l_extendedprice, spot l_linenumber, node l_suppkey, cell the
supplier's nation), events an along-track profile (x in hours, y the value), part a field of points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimefield.functions import scalars as S
from rimefield.operators import anomaly as A
from rimefield.operators import noise as N
from rimefield.operators import robust as R
from rimefield.operators import segments as G
from rimefield.operators import spatial as P
from rimefield.operators.ranks import exact_percentiles
from rimefield.sources.readers import table, undone

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def obs(spark: SparkSession, d: str) -> DataFrame:
    """node, spot, time, value, id"""
    ident = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"), F.round("l_extendedprice", 2).cast("decimal(18,2)").cast("string"))
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_linenumber").alias("spot"), F.col("l_shipdate").alias("time"), F.col("l_extendedprice").alias("value"), ident.alias("id"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("cell"), F.col("s_acctbal").alias("elevation"))


def profile(spark: SparkSession, d: str) -> DataFrame:
    """seg, x (hours), y, cnf, event_id"""
    us = F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000
    return table(spark, d, "events").select(F.col("user_id").alias("seg"), (us / 3600e6).alias("x"), F.col("value").alias("y"), (F.get_json_object("props", "$.k").cast("int") % 5).alias("cnf"), "event_id", "ts")


OBS = "o AS (SELECT l_suppkey AS node, l_linenumber AS spot, l_shipdate AS time, l_extendedprice AS value, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), round(l_extendedprice, 2)::DECIMAL(18,2)::VARCHAR) AS id FROM lineitem)"
CELLS = "c AS (SELECT s_suppkey AS node, s_nationkey AS cell, s_acctbal AS elevation FROM supplier)"
PROFILE = "p AS (SELECT user_id AS seg, (epoch_us(ts) - 1704067200000000) / 3600e6::DOUBLE AS x, value AS y, (json_extract_string(props, '$.k')::INT % 5) AS cnf, event_id, ts FROM events)"


def mad_sql(source: str, keys: str, k: float, least: int, out: str) -> str:
    return f"""{out}_a AS (SELECT *, median(value) OVER (PARTITION BY {keys}) AS md, count(value) OVER (PARTITION BY {keys}) AS nn FROM {source}),
{out}_b AS (SELECT *, median(abs(value - md)) OVER (PARTITION BY {keys}) AS mad FROM {out}_a),
{out} AS (SELECT * EXCLUDE (md, nn, mad) FROM {out}_b WHERE nn < {least} OR mad <= 0 OR abs(value - md) <= {k}::DOUBLE * mad / 0.6745::DOUBLE)"""


NODE = f"{OBS}, {mad_sql('o', 'node', 5, 8, 'f')}, nm AS (SELECT node, median(value) AS node_median, count(value) AS n_obs FROM f GROUP BY node HAVING count(value) >= 8)"


@query("""SELECT l_orderkey, l_linenumber, year(l_shipdate)::INT AS year, month(l_shipdate)::INT AS month,
round((year(l_shipdate) + (dayofyear(l_shipdate) - 1) / 365.25::DOUBLE)::FLOAT::DOUBLE, 3) AS dec_year, round(greatest(l_discount * 0.41844::DOUBLE - 0.005::DOUBLE, 0.0001::DOUBLE), 6) AS sigma
FROM lineitem WHERE l_extendedprice > 0 AND l_extendedprice <= 50000 AND l_quantity >= 15 AND l_linenumber IN (1, 3, 5) AND month(l_shipdate) IN (6, 7, 8) AND year(l_shipdate) IN (1996, 1997, 1998)""")
def q_obs_filter(spark, d):
    t, when = table(spark, d, "lineitem"), F.col("l_shipdate")
    t = t.where((F.col("l_extendedprice") > 0) & (F.col("l_extendedprice") <= 50000) & (F.col("l_quantity") >= 15) & F.col("l_linenumber").isin(1, 3, 5) & F.month(when).isin(S.SUMMER) & F.year(when).isin(1996, 1997, 1998))
    return t.select("l_orderkey", "l_linenumber", F.year(when).alias("year"), F.month(when).alias("month"), F.round(S.decimal_year(when).cast("double"), 3).alias("dec_year"), F.round(S.obs_sigma(F.col("l_discount")), 6).alias("sigma"))


@query("SELECT p_partkey, (floor((p_retailprice - 1500) / 100) * 100 + 50)::INT AS x_node, (floor(p_size / 7.0::DOUBLE) * 7 + 3)::INT AS y_node, floor((p_retailprice - 1500) / 250)::INT AS ix FROM part")
def q_node_snap(spark, d):
    x = F.col("p_retailprice") - 1500
    return table(spark, d, "part").select("p_partkey", P.snap(x, 100).alias("x_node"), P.snap(F.col("p_size"), 7).alias("y_node"), P.cell_index(x, 250).alias("ix"))


@query(f"WITH {NODE} SELECT node, round(node_median, 6) AS node_median, n_obs FROM nm")
def q_node_median(spark, d):
    return rounded(R.node_medians(obs(spark, d), ["node"], "value"))


@query(f"WITH {NODE}, {CELLS} SELECT cell, round(median(node_median), 6) AS cell_median, count(*) AS n_nodes FROM nm JOIN c USING (node) GROUP BY cell")
def q_cell_median(spark, d):
    n = R.node_medians(obs(spark, d), ["node"], "value").join(cells(spark, d), "node")
    return rounded(n.groupBy("cell").agg(F.median("node_median").alias("cell_median"), F.count("*").alias("n_nodes")))


PASS = "l AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000 THEN 1 ELSE 0 END AS nw FROM events), ps AS (SELECT *, (sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS pass_id FROM l)"


@query(f"WITH {PASS} SELECT event_id, user_id, pass_id FROM ps")
def q_pass_ids(spark, d):
    return R.pass_ids(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("event_id", "user_id", "pass_id")


@query(f"WITH {PASS} SELECT user_id, pass_id, round(median(value), 6) AS value, median(epoch_us(ts))::BIGINT AS time_us, count(*) AS n FROM ps GROUP BY ALL")
def q_node_pass(spark, d):
    p = R.pass_ids(table(spark, d, "events"), ["user_id"], "ts", "event_id")
    return p.groupBy("user_id", "pass_id").agg(F.round(F.median("value"), 6).alias("value"), F.rint(F.median(F.unix_micros(F.col("ts").cast("timestamp")))).cast("long").alias("time_us"), F.count("*").alias("n"))


@query(f"""WITH {PROFILE}, w AS (SELECT *, min(x) OVER (PARTITION BY seg) AS x0, max(x) OVER (PARTITION BY seg) AS x1 FROM p),
v AS (SELECT *, floor((x - x0) / 10)::BIGINT AS wn FROM w), u AS (SELECT *, median(y) OVER (PARTITION BY seg, wn) AS md FROM v WHERE x0 + wn * 10 < x1),
t AS (SELECT *, median(abs(y - md)) OVER (PARTITION BY seg, wn) / 0.6745::DOUBLE AS s FROM u)
SELECT event_id, seg, wn AS window_no FROM t WHERE y BETWEEN md - s AND md + 2 * s""")
def q_mad_asymmetric(spark, d):
    return G.moving_filter(profile(spark, d), ["seg"], "x", "y").select("event_id", "seg", F.col("window_no").cast("long").alias("window_no"))


MONTHS = f"{OBS}, m AS (SELECT node, year(time) + (month(time) - 1) / 12.0::DOUBLE AS t, median(value) AS y FROM o GROUP BY ALL)"
TREND = f"""{MONTHS}, sl AS (SELECT a.node, (b.y - a.y) / (b.t - a.t) AS s FROM m a JOIN m b ON a.node = b.node AND a.t < b.t AND b.t - a.t >= 0.08),
sm AS (SELECT *, median(s) OVER (PARTITION BY node) AS md FROM sl), th AS (SELECT node, any_value(md) AS trend, median(abs(s - md)) / 0.6745::DOUBLE / sqrt(count(*)) AS trend_sigma, count(*) AS n_pairs FROM sm GROUP BY node),
tr AS (SELECT * FROM th JOIN (SELECT node, count(y) AS n_obs FROM m GROUP BY node HAVING count(y) >= 3) USING (node))"""


def trends(spark, d):
    o = obs(spark, d)
    m = o.groupBy("node", (F.year("time") + (F.month("time") - 1) / F.lit(12.0)).alias("t")).agg(F.median("value").alias("y"))
    return R.theil_sen(m, ["node"], "t", "y")


@query(f"WITH {TREND} SELECT node, round(trend, 4) AS trend, round(trend_sigma, 4) AS trend_sigma, n_pairs, n_obs FROM tr")
def q_theil_sen(spark, d):
    return rounded(trends(spark, d), 4)


WEIGHT = f"""{TREND}, {CELLS}, k AS (SELECT cell, trend, CASE WHEN trend_sigma > 0 THEN 1 / (trend_sigma * trend_sigma) ELSE 0 END AS w FROM tr JOIN c USING (node)),
kk AS (SELECT *, sum(w) OVER (PARTITION BY cell ORDER BY trend RANGE UNBOUNDED PRECEDING) AS cw, sum(w) OVER (PARTITION BY cell) AS tw FROM k),
ct AS (SELECT cell, min(trend) AS cell_trend FROM kk WHERE tw > 0 AND cw >= tw / 2 GROUP BY cell),
dv AS (SELECT cell, cell_trend, abs(trend - cell_trend) AS dev, w FROM k JOIN ct USING (cell)),
dw AS (SELECT *, sum(w) OVER (PARTITION BY cell ORDER BY dev RANGE UNBOUNDED PRECEDING) AS cw, sum(w) OVER (PARTITION BY cell) AS tw, count(*) OVER (PARTITION BY cell) AS nn FROM dv),
cs AS (SELECT cell, any_value(cell_trend) AS cell_trend, min(dev) FILTER (WHERE cw >= tw / 2) / 0.6745::DOUBLE / sqrt(any_value(nn)) AS sigma, any_value(nn) AS n FROM dw GROUP BY cell)"""


def cell_trends(spark, d):
    t = trends(spark, d).join(cells(spark, d), "node").withColumn("w", F.when(F.col("trend_sigma") > 0, 1 / (F.col("trend_sigma") * F.col("trend_sigma"))).otherwise(0.0))
    c = R.weighted_median(t, ["cell"], "trend", "w", "cell_trend")
    dev = t.join(c, "cell").withColumn("dev", F.abs(F.col("trend") - F.col("cell_trend")))
    n = dev.groupBy("cell").agg(F.first("cell_trend").alias("cell_trend"), F.count("*").alias("n"))
    return n.join(R.weighted_median(dev, ["cell"], "dev", "w", "mad"), "cell").select("cell", "cell_trend", (F.col("mad") / R.MAD_SCALE / F.sqrt("n")).alias("sigma"), "n")


@query(f"WITH {WEIGHT} SELECT cell, round(cell_trend, 4) AS cell_trend, round(sigma, 4) AS sigma, n FROM cs")
def q_weighted_median(spark, d):
    return rounded(cell_trends(spark, d), 4)


@query(f"""WITH {WEIGHT}, g AS (SELECT *, CASE WHEN sigma > 0 THEN abs(cell_trend) / sigma >= 1.5 AND n >= 3 ELSE n >= 3 END AS conf FROM cs)
SELECT count(*) FILTER (WHERE conf)::BIGINT AS n_confident, count(*) AS n_total, round(count(*) FILTER (WHERE conf AND cell_trend > 0) * 100.0::DOUBLE / greatest(count(*) FILTER (WHERE conf), 1), 6) AS pct_pos,
round(count(*) FILTER (WHERE conf AND cell_trend < 0) * 100.0::DOUBLE / greatest(count(*) FILTER (WHERE conf), 1), 6) AS pct_neg FROM g""")
def q_significant_share(spark, d):
    c = cell_trends(spark, d)
    c = c.withColumn("conf", F.when(F.col("sigma") > 0, (F.abs("cell_trend") / F.col("sigma") >= 1.5) & (F.col("n") >= 3)).otherwise(F.col("n") >= 3))
    share = lambda x: F.round(F.count_if(F.col("conf") & x) * 100.0 / F.greatest(F.count_if("conf"), F.lit(1)), 6)
    return c.agg(F.count_if("conf").alias("n_confident"), F.count("*").alias("n_total"), share(F.col("cell_trend") > 0).alias("pct_pos"), share(F.col("cell_trend") < 0).alias("pct_neg"))


@query(f"""WITH {OBS}, {CELLS}, {mad_sql("(SELECT cell, CASE WHEN month(time) IN (6,7,8) THEN 'summer' ELSE 'winter' END AS season, value FROM o JOIN c USING (node) WHERE month(time) IN (6,7,8,12,1,2))", 'cell', 2.5, 10, 'f')},
r AS (SELECT *, value - median(value) OVER (PARTITION BY cell, season) AS r FROM f), q AS (SELECT *, median(abs(r)) OVER (PARTITION BY cell, season) AS mad FROM r),
u AS (SELECT *, r / nullif(4.685::DOUBLE * mad / 0.6745::DOUBLE, 0) AS u FROM q), b AS (SELECT *, CASE WHEN mad <= 0 THEN 1.0 WHEN abs(u) < 1 THEN pow(1 - u * u, 2) ELSE 0.0 END AS w FROM u),
e AS (SELECT *, sum(w * value) OVER (PARTITION BY cell, season) / sum(w) OVER (PARTITION BY cell, season) AS m FROM b),
s AS (SELECT cell, season, any_value(m) AS mean, sqrt(sum(w * (value - m) * (value - m)) / sum(w) / greatest(pow(sum(w), 2) / sum(w * w), 1)) AS sigma, count(*) AS n FROM e GROUP BY ALL)
SELECT a.cell, round(a.mean - b.mean, 3) AS contrast, round(abs(a.mean - b.mean) / sqrt(a.sigma * a.sigma + b.sigma * b.sigma), 3) AS snr, a.n AS n_summer, b.n AS n_winter
FROM s a JOIN s b ON a.cell = b.cell AND a.season = 'summer' AND b.season = 'winter' WHERE a.n >= 2 AND b.n >= 2""")
def q_seasonal_contrast(spark, d):
    o = obs(spark, d).join(cells(spark, d), "node").withColumn("season", S.season(F.col("time"))).where("season IS NOT NULL").select("cell", "season", "value")
    s = R.bisquare_mean(R.mad_filter(o, ["cell"], "value", 2.5, 10), ["cell", "season"], "value").where("n >= 2")
    of = lambda x: s.where(F.col("season") == x).select("cell", F.col("mean").alias(f"m_{x}"), F.col("sigma").alias(f"s_{x}"), F.col("n").alias(f"n_{x}"))
    j, dif = of("summer").join(of("winter"), "cell"), F.col("m_summer") - F.col("m_winter")
    return j.select("cell", F.round(dif, 3).alias("contrast"), F.round(F.abs(dif) / F.sqrt(F.col("s_summer") * F.col("s_summer") + F.col("s_winter") * F.col("s_winter")), 3).alias("snr"), "n_summer", "n_winter")


@query("SELECT a.p_partkey AS id_a, b.p_partkey AS id_b, round(sqrt(pow(a.p_retailprice - b.p_retailprice, 2) + pow(a.p_size - b.p_size, 2)), 6) AS distance FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND sqrt(pow(a.p_retailprice - b.p_retailprice, 2) + pow(a.p_size - b.p_size, 2)) <= 5")
def q_radius_pairs(spark, d):
    return P.radius_pairs(table(spark, d, "part"), [], "p_partkey", "p_retailprice", "p_size", 5.0, digits=6)


PAIRS = "pr AS (SELECT abs(a.value - b.value) AS diff, (a.value + b.value) / 2 AS mean_rms FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id AND abs(date_diff('day', a.ts::DATE, b.ts::DATE)) BETWEEN 1 AND 30)"


def crossover(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", F.unix_date(F.to_date("ts")).alias("day"), "value")
    return N.crossover_pairs(e, ["user_id", "event_type"], "event_id", "day", "value")


@query("SELECT a.event_id AS ia, b.event_id AS ib, round(abs(a.value - b.value), 6) AS diff, round((a.value + b.value) / 2, 6) AS mean_rms FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id AND abs(date_diff('day', a.ts::DATE, b.ts::DATE)) BETWEEN 1 AND 30")
def q_temporal_pairs(spark, d):
    return rounded(crossover(spark, d))


BINS = f"{PAIRS}, bn AS (SELECT floor(mean_rms / 5)::BIGINT AS bin, quantile_cont(diff, 0.6827) AS sigma, count(*) AS n, (floor(mean_rms / 5) + 0.5) * 5 AS center FROM pr WHERE floor(mean_rms / 5) BETWEEN 0 AND 39 GROUP BY 1, 4 HAVING count(*) >= 30)"


def bins(spark, d):
    return N.sigma68(crossover(spark, d), "mean_rms", "diff", 5.0, 40)


@query(f"WITH {BINS} SELECT bin, round(sigma, 6) AS sigma, n, round(center, 6) AS center FROM bn")
def q_sigma68_bins(spark, d):
    return rounded(bins(spark, d)).withColumn("bin", F.col("bin").cast("long"))


FIT = f"""{BINS}, s AS (SELECT sum(n)::DOUBLE AS w, sum(n * center) AS wx, sum(n * sigma) AS wy, sum(n * center * center) AS wxx, sum(n * center * sigma) AS wxy FROM bn),
f0 AS (SELECT *, (w * wxy - wx * wy) / nullif(w * wxx - wx * wx, 0) AS m0 FROM s), f1 AS (SELECT *, (wy - m0 * wx) / w AS c0 FROM f0),
ft AS (SELECT CASE WHEN m0 < 0 THEN 0.0 WHEN c0 < 0 THEN greatest(wxy / wxx, 0) ELSE m0 END AS m, CASE WHEN m0 < 0 THEN greatest(wy / w, 0) WHEN c0 < 0 THEN 0.0 ELSE c0 END AS c FROM f1)"""


@query(f"WITH {FIT} SELECT round(any_value(m), 6) AS m, round(any_value(c), 6) AS c, round(sqrt(avg(pow(m * center + c - sigma, 2))), 5) AS rmse, count(*) AS n_bins FROM ft, bn")
def q_noise_fit(spark, d):
    return N.fit_line(bins(spark, d)).select(F.round("m", 6).alias("m"), F.round("c", 6).alias("c"), F.round("rmse", 5).alias("rmse"), "n_bins")


@query(f"WITH {FIT} SELECT i::INT AS row, round(10 + i * 90 / 11.0::DOUBLE, 5) AS x, round(m * (10 + i * 90 / 11.0::DOUBLE) + c, 5) AS sigma, round((m * (10 + i * 90 / 11.0::DOUBLE) + c) * 1.96::DOUBLE * sqrt(2), 5) AS mdc FROM ft, range(12) r(i)")
def q_mdc_table(spark, d):
    return rounded(N.mdc_table(N.fit_line(bins(spark, d)), 10.0, 100.0), 5)


@query(f"WITH {PAIRS} SELECT q::DOUBLE AS percentile, round(v, 6) AS value FROM (SELECT unnest([0.5, 0.75, 0.9, 0.95, 0.99, 1.0]) AS q, unnest(quantile_cont(mean_rms, [0.5, 0.75, 0.9, 0.95, 0.99, 1.0])) AS v FROM pr)")
def q_percentile_profile(spark, d):
    qs = [0.5, 0.75, 0.9, 0.95, 0.99, 1.0]
    p = exact_percentiles(crossover(spark, d).select("mean_rms"), [], "mean_rms", qs)
    rows = F.array(*(F.struct(F.lit(q).alias("percentile"), F.round(f"q{i}", 6).alias("value")) for i, q in enumerate(qs)))
    return p.select(F.explode(rows).alias("r")).select("r.percentile", "r.value")


@query(f"""WITH {PROFILE}, lv AS (SELECT seg, l AS lev, x, x - lag(x) OVER (PARTITION BY seg, l ORDER BY x) AS gap FROM p, unnest([4, 3, 2, 1]) t(l) WHERE cnf >= l),
ok AS (SELECT seg, lev, count(*) AS n FROM lv GROUP BY ALL HAVING count(*) >= 2 AND max(x) - min(x) >= 600 AND count(*) >= (max(x) - min(x)) / 25.0::DOUBLE AND max(gap) <= 90)
SELECT seg, max(lev)::INT AS level, arg_max(n, lev) AS n_used, CASE WHEN max(lev) = 4 THEN '4' ELSE '4+' || max(lev) END AS cnf_used FROM ok GROUP BY seg""")
def q_density_adaptive(spark, d):
    return G.adaptive_level(profile(spark, d), ["seg"], "x", "cnf", min_span=600.0, spacing=25.0, max_gap=90.0)


@query(f"WITH {PROFILE} SELECT a.event_id, round(sum(exp(-0.5 * pow((b.x - a.x) / 2, 2)) * b.y) / sum(exp(-0.5 * pow((b.x - a.x) / 2, 2))), 6) AS smooth FROM p a JOIN p b ON a.seg = b.seg AND b.x BETWEEN a.x - 2 AND a.x + 2 GROUP BY a.event_id")
def q_kernel_smooth(spark, d):
    return rounded(G.kernel_smooth(profile(spark, d), ["seg"], "x", "y", 2.0).select("event_id", "smooth"))


LATTICE = f"""{PROFILE}, g AS (SELECT seg, x, avg(y) AS y FROM p GROUP BY ALL), h AS (SELECT *, min(x) OVER (PARTITION BY seg) AS x0, lead(x) OVER (PARTITION BY seg ORDER BY x) AS xn, lead(y) OVER (PARTITION BY seg ORDER BY x) AS yn FROM g),
e AS (SELECT *, unnest(range(ceil((x - x0) / 24)::BIGINT, ceil((xn - x0) / 24)::BIGINT)) AS i FROM h WHERE xn IS NOT NULL), rs AS (SELECT seg, i, y + (yn - y) * (x0 + i * 24 - x) / (xn - x) AS y FROM e)"""


def lattice(spark, d):
    g = profile(spark, d).groupBy("seg", "x").agg(F.avg("y").alias("y"))
    return G.resample(g, ["seg"], "x", "y", 24.0)


@query(f"WITH {LATTICE} SELECT seg, i, round(y, 5) AS y FROM rs")
def q_resample_interp(spark, d):
    return rounded(lattice(spark, d), 5)


@query(f"WITH {PROFILE} SELECT seg, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(sqrt(greatest(var_pop(y) - coalesce(regr_slope(y, x), 0) * covar_pop(x, y), 0)), 5) AS rms FROM p GROUP BY seg HAVING count(*) >= 10")
def q_detrend_rms(spark, d):
    r = G.detrend_rms(profile(spark, d), ["seg"], "x", "y")
    return r.select("seg", "n", F.round("slope", 6).alias("slope"), F.round("rms", 5).alias("rms"))


@query(f"""WITH {PROFILE}, w AS (SELECT *, min(x) OVER (PARTITION BY seg) AS x0, max(x) OVER (PARTITION BY seg) AS x1 FROM p), b AS (SELECT *, floor((x - x0) * 4 / nullif(x1 - x0, 0)) AS part FROM w),
r AS (SELECT seg, part, sqrt(greatest(var_pop(y) - coalesce(regr_slope(y, x), 0) * covar_pop(x, y), 0)) AS rms FROM b WHERE part < 4 GROUP BY ALL HAVING count(*) >= 10)
SELECT seg, round(median(rms), 5) AS rms_sub_median, count(*) AS n_valid FROM r GROUP BY seg""")
def q_subsegment_rms(spark, d):
    return rounded(G.subsegment_rms(profile(spark, d), ["seg"], "x", "y", 4, 10), 5)


@query(f"WITH {LATTICE} SELECT a.seg, (b.i - a.i)::INT AS lag, round(avg(pow(a.y - b.y, 2)) / 2, 4) AS gamma, count(*) AS n FROM rs a JOIN rs b ON a.seg = b.seg AND b.i - a.i BETWEEN 1 AND 10 GROUP BY ALL")
def q_variogram(spark, d):
    return rounded(G.variogram(lattice(spark, d), ["seg"], "i", "y", 10), 4)


@query()
def q_variogram_fit(spark, d):
    return G.variogram_fit(G.variogram(lattice(spark, d), ["seg"], "i", "y", 10), ["seg"])


GRID = "gr AS (SELECT floor((p_retailprice - 900) / 40)::INT AS ix, floor(p_size / 2.0::DOUBLE)::INT AS iy, median(p_retailprice * p_size) AS v FROM part GROUP BY ALL)"


def grid(spark, d):
    t = table(spark, d, "part")
    return t.groupBy(P.cell_index(F.col("p_retailprice") - 900, 40).alias("ix"), P.cell_index(F.col("p_size"), 2).alias("iy")).agg(F.median(F.col("p_retailprice") * F.col("p_size")).alias("v"))


@query(f"""WITH {GRID}, tg AS (SELECT DISTINCT floor((p_retailprice - 900) / 40)::INT AS ix, floor(p_size / 2.0::DOUBLE)::INT AS iy FROM part),
j AS (SELECT t.ix, t.iy, g.v, sqrt(pow(t.ix - g.ix, 2) + pow(t.iy - g.iy, 2)) AS dd, row_number() OVER (PARTITION BY t.ix, t.iy ORDER BY sqrt(pow(t.ix - g.ix, 2) + pow(t.iy - g.iy, 2)), g.ix, g.iy) AS r
FROM tg t JOIN gr g ON pow(t.ix - g.ix, 2) + pow(t.iy - g.iy, 2) <= 100)
SELECT ix, iy, round(sum(v / pow(greatest(dd, 1e-10), 2)) / sum(1 / pow(greatest(dd, 1e-10), 2)), 4) AS filled, count(*) AS n_near FROM j WHERE r <= 5 GROUP BY ALL""")
def q_idw_fill(spark, d):
    targets = table(spark, d, "part").select(P.cell_index(F.col("p_retailprice") - 900, 40).alias("ix"), P.cell_index(F.col("p_size"), 2).alias("iy")).distinct()
    return rounded(P.idw_fill(targets, grid(spark, d), "v"), 4)


@query(f"""WITH {GRID}, ks AS (SELECT o, exp(-0.5 * o * o) / (SELECT sum(exp(-0.5 * o * o)) FROM range(-4, 5) q(o)) AS w FROM range(-4, 5) q(o)),
tx AS (SELECT DISTINCT t.i AS ix, s.o AS sx FROM range(0, 61) t(i), range(-4, 65) s(o)),
mx AS (SELECT i AS ix, CASE WHEN i + o < 0 THEN -1 - (i + o) WHEN i + o >= 61 THEN 121 - (i + o) ELSE i + o END AS sx, w FROM range(0, 61) t(i), ks),
my AS (SELECT i AS iy, CASE WHEN i + o < 0 THEN -1 - (i + o) WHEN i + o >= 26 THEN 51 - (i + o) ELSE i + o END AS sy, w FROM range(0, 26) t(i), ks),
hx AS (SELECT mx.ix, gr.iy, sum(w * v) AS a, sum(w) AS b FROM mx JOIN gr ON gr.ix = sx GROUP BY ALL), hy AS (SELECT hx.ix, my.iy, sum(w * a) AS a, sum(w * b) AS b FROM my JOIN hx ON hx.iy = sy GROUP BY ALL)
SELECT ix::INT AS ix, iy::INT AS iy, round(a / b, 4) AS smooth FROM hy JOIN (SELECT ix, iy FROM gr) USING (ix, iy)""")
def q_gauss_smooth(spark, d):
    return rounded(P.gauss_smooth(grid(spark, d), "v", (0, 60, 0, 25)), 4)


@query(f"""WITH {GRID}, q AS (SELECT p_partkey, (p_retailprice - 900) / 40 AS fx, p_size / 2.0::DOUBLE AS fy FROM part), k AS (SELECT *, floor(fx)::INT AS ix, floor(fy)::INT AS iy, fx - floor(fx) AS u, fy - floor(fy) AS w FROM q)
SELECT p_partkey, round((1-u)*(1-w)*a.v + (1-u)*w*b.v + u*(1-w)*c.v + u*w*e.v, 9) AS interpolated FROM k LEFT JOIN gr a ON a.ix = k.ix AND a.iy = k.iy LEFT JOIN gr b ON b.ix = k.ix AND b.iy = k.iy + 1
LEFT JOIN gr c ON c.ix = k.ix + 1 AND c.iy = k.iy LEFT JOIN gr e ON e.ix = k.ix + 1 AND e.iy = k.iy + 1""")
def q_bilinear(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") - 900).alias("x"), (F.col("p_size") * 20.0).alias("y"))
    return rounded(P.bilinear(p, "p_partkey", "x", "y", grid(spark, d), "v", 40.0), 9)


RING = [(1000.0, 5.0), (1600.0, 10.0), (1900.0, 45.0), (1400.0, 25.0), (950.0, 48.0)]
CASES = " + ".join(f"(CASE WHEN p_size >= {min(a[1], b[1])} AND p_size < {max(a[1], b[1])} AND p_retailprice < {a[0]}::DOUBLE + (p_size - {a[1]}::DOUBLE) * ({b[0] - a[0]}::DOUBLE / {b[1] - a[1]}::DOUBLE) THEN 1 ELSE 0 END)" for a, b in zip(RING, RING[1:] + RING[:1]))


@query(f"SELECT p_partkey FROM part WHERE ({CASES}) % 2 = 1")
def q_point_in_polygon(spark, d):
    edges = spark.createDataFrame([(*a, *b) for a, b in zip(RING, RING[1:] + RING[:1])], "x1 double, y1 double, x2 double, y2 double")
    return P.inside_edges(table(spark, d, "part"), "p_partkey", "p_retailprice", "p_size", edges, 10.0).select("p_partkey")


@query(f"""WITH {NODE}, {CELLS}, b AS (SELECT CASE WHEN elevation >= 0 AND elevation < 1000 THEN 'low' WHEN elevation >= 1000 AND elevation < 1500 THEN 'middle' WHEN elevation >= 1500 AND elevation < 9999 THEN 'high' END AS band,
CASE WHEN (SELECT median(node_median) FROM nm) > 0 THEN node_median / (SELECT median(node_median) FROM nm) * 100 END AS pct FROM nm JOIN c USING (node))
SELECT coalesce(band, 'All bands') AS band, count(pct) AS n, round(avg(pct), 4) AS mean, round(median(pct), 4) AS median, round(stddev_pop(pct), 4) AS std, round(quantile_cont(pct, 0.05), 4) AS p5, round(quantile_cont(pct, 0.95), 4) AS p95
FROM b WHERE band IS NOT NULL GROUP BY ROLLUP (band)""")
def q_band_stats(spark, d):
    n = R.node_medians(obs(spark, d), ["node"], "value").join(cells(spark, d), "node")
    whole = n.agg(F.median("node_median").alias("med"))
    b = n.join(F.broadcast(whole)).withColumn("band", R.band_of(F.col("elevation"))).withColumn("pct", S.percent_of_median(F.col("node_median"), F.col("med"))).where("band IS NOT NULL")
    q = lambda p: F.percentile("pct", F.lit(p))
    return rounded(b.rollup("band").agg(F.count("pct").alias("n"), F.avg("pct").alias("mean"), F.median("pct").alias("median"), F.stddev_pop("pct").alias("std"), q(0.05).alias("p5"), q(0.95).alias("p95")), 4).withColumn("band", F.coalesce("band", F.lit("All bands")))


CELLOBS = f"{OBS}, {CELLS}, co AS (SELECT cell, time, value, id FROM o JOIN c USING (node)), {mad_sql('co', 'cell', 3, 30, 'f')}"


def cell_obs(spark, d):
    return obs(spark, d).join(cells(spark, d).select("node", "cell"), "node").select("cell", "time", "value", "id")


def z_sql(keys, target, base):
    k = ", ".join(keys)
    return f"""tm AS ({target}), bs AS ({base}), bm AS (SELECT *, median(value) OVER (PARTITION BY {k}) AS md FROM bs),
bz AS (SELECT {k}, any_value(md) AS base_median, median(abs(value - md)) AS mad, stddev_samp(value) AS sd, count(value) AS n_base FROM bm GROUP BY {k}),
z AS (SELECT *, CASE WHEN mad > 0 THEN mad / 0.6745::DOUBLE ELSE sd END AS s FROM tm JOIN bz USING ({k})), zz AS (SELECT {k}, target_median, n_target, base_median, n_base, (target_median - base_median) / s AS z FROM z WHERE n_base >= 3 AND s > 0)"""


ZWIN = z_sql(["cell"], "SELECT cell, median(value) AS target_median, count(value) AS n_target FROM f WHERE year(time) = 1998 AND month(time) IN (7,8,9) GROUP BY cell HAVING count(value) >= 30",
             "SELECT cell, value FROM (SELECT *, row_number() OVER (PARTITION BY cell, month(time) ORDER BY md5('42|' || id), id) AS r FROM f WHERE NOT (year(time) = 1998 AND month(time) IN (7,8,9))) WHERE r <= 30")


@query(f"WITH {CELLOBS}, {ZWIN} SELECT cell, round(target_median, 4) AS target_median, n_target, round(base_median, 4) AS base_median, n_base, round(z, 5) AS z FROM zz")
def q_zscore_window(spark, d):
    z = A.zscore_window(cell_obs(spark, d), ["cell"], "time", "value", "id", 1998, [7, 8, 9])
    return z.select("cell", F.round("target_median", 4).alias("target_median"), "n_target", F.round("base_median", 4).alias("base_median"), "n_base", F.round("z", 5).alias("z"))


MONTHLY = "fm AS (SELECT *, date_trunc('month', time)::TIMESTAMP AS mo FROM f), mm AS (SELECT cell, mo AS month FROM fm GROUP BY ALL HAVING count(*) >= 10), " + z_sql(["cell", "month"],
    "SELECT cell, month, median(value) AS target_median, count(*) AS n_target FROM (SELECT fm.cell, mm.month, value, row_number() OVER (PARTITION BY fm.cell, mm.month ORDER BY md5('42|' || id), id) AS r FROM fm JOIN mm ON fm.cell = mm.cell AND fm.mo = mm.month) WHERE r <= 10 GROUP BY ALL",
    "SELECT cell, month, value FROM (SELECT fm.cell, mm.month, value, row_number() OVER (PARTITION BY fm.cell, mm.month, month(time) ORDER BY md5('42|' || id), id) AS r FROM fm JOIN mm ON fm.cell = mm.cell AND fm.mo <> mm.month) WHERE r <= 30")


@query(f"WITH {CELLOBS}, {MONTHLY} SELECT cell, strftime(month, '%Y-%m') AS month, n_target, n_base, round(z, 4) AS z FROM zz")
def q_monthly_z(spark, d):
    m = A.monthly_z(cell_obs(spark, d), ["cell"], "time", "value", "id")
    return m.select("cell", F.date_format("month", "yyyy-MM").alias("month"), "n_target", "n_base", F.round("z", 4).alias("z"))


@query(f"""WITH {CELLOBS}, mo AS (SELECT date_trunc('month', time) AS m, median(value) AS v, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM f GROUP BY ALL)
SELECT month(m)::INT AS month, round(avg(v), 4) AS climatology, round(avg(a), 4) AS p25, round(avg(b), 4) AS p75, count(*) AS n_years FROM mo GROUP BY ALL""")
def q_climatology(spark, d):
    f = R.mad_filter(cell_obs(spark, d), ["cell"], "value", 3.0, 30)
    m = exact_percentiles(f.select(F.trunc("time", "month").alias("m"), "value"), ["m"], "value", [0.5, 0.25, 0.75]).withColumnsRenamed({"q0": "v", "q1": "a", "q2": "b"})
    return rounded(m.groupBy(F.month("m").alias("month")).agg(F.avg("v").alias("climatology"), F.avg("a").alias("p25"), F.avg("b").alias("p75"), F.count("*").alias("n_years")), 4)


@query(f"""WITH {OBS}, {CELLS}, cv AS (SELECT n_regionkey AS block, year(time)::INT AS year, cell, median(value) AS v FROM o JOIN c USING (node) JOIN nation ON n_nationkey = cell GROUP BY ALL),
bl AS (SELECT year, block, row_number() OVER (PARTITION BY year ORDER BY block) - 1 AS slot, count(*) OVER (PARTITION BY year) AS nb FROM (SELECT DISTINCT year, block FROM cv)),
dr AS (SELECT n.year, rep, k, ('0x' || substr(md5('42|' || rep || '|' || k), 1, 8))::BIGINT % n.nb AS slot FROM (SELECT DISTINCT year, nb FROM bl) n, range(500) a(rep), range(n.nb) b(k)),
bm AS (SELECT dr.year, rep, median(v) AS m FROM dr JOIN bl ON bl.year = dr.year AND bl.slot = dr.slot JOIN cv ON cv.year = dr.year AND cv.block = bl.block GROUP BY ALL),
ci AS (SELECT year, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm GROUP BY year)
SELECT year, round(median(v), 4) AS median, round(CASE WHEN any_value(nb) < 3 THEN quantile_cont(v, 0.25) ELSE any_value(lo) END, 4) AS ci_low, round(CASE WHEN any_value(nb) < 3 THEN quantile_cont(v, 0.75) ELSE any_value(hi) END, 4) AS ci_high, any_value(nb) AS n_blocks
FROM cv JOIN ci USING (year) JOIN (SELECT DISTINCT year, nb FROM bl) USING (year) GROUP BY year""")
def q_block_bootstrap(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("cell"), F.col("n_regionkey").alias("block"))
    v = cell_obs(spark, d).join(n, "cell").groupBy("block", F.year("time").alias("year"), "cell").agg(F.median("value").alias("v"))
    return rounded(A.block_bootstrap(v, ["year"], "block", "v"), 4)


CLIM = "cl AS (SELECT c_nationkey AS cell, year(o_orderdate)::INT AS year, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / count(*) / 100 AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), cm AS (SELECT *, median(v) OVER (PARTITION BY cell) AS md, stddev_samp(v) OVER (PARTITION BY cell) AS sd FROM cl), cz0 AS (SELECT *, median(abs(v - md)) OVER (PARTITION BY cell) / 0.6745::DOUBLE AS ms FROM cm), cz AS (SELECT cell, year, v, (v - md) / nullif(CASE WHEN ms > 0 THEN ms ELSE sd END, 0) AS z FROM cz0)"


def climate(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return A.climate_z(o.groupBy(F.col("c_nationkey").alias("cell"), F.year("o_orderdate").alias("year")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / F.count("*") / 100).alias("v")), ["cell"], "year", "v")


@query(f"WITH {CLIM} SELECT cell, year, v, round(z, 4) AS z FROM cz")
def q_climate_z(spark, d):
    # v is a sum of whole cents over a count: the same double in any order of rows.
    return climate(spark, d).withColumn("z", F.round("z", 4))


@query(f"""WITH {CLIM}, {OBS}, {CELLS}, rg AS (SELECT cell, year(time)::INT AS year, median(value) AS r FROM o JOIN c USING (node) GROUP BY ALL), j AS (SELECT year, round(z, 9) AS z, r FROM cz JOIN rg USING (cell, year)),
k AS (SELECT year, rank() OVER (PARTITION BY year ORDER BY z) + (count(*) OVER (PARTITION BY year, z) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY year ORDER BY r) + (count(*) OVER (PARTITION BY year, r) - 1) / 2.0::DOUBLE AS b FROM j)
SELECT year, round(corr(a, b), 6) AS rho, count(*) AS n FROM k GROUP BY year HAVING count(*) >= 10""")
def q_spearman(spark, d):
    r = cell_obs(spark, d).groupBy("cell", F.year("time").alias("year")).agg(F.median("value").alias("r"))
    return rounded(R.spearman(climate(spark, d).withColumn("z", F.round("z", 9)).join(r, ["cell", "year"]), ["year"], "z", "r"))


@query("SELECT l_suppkey, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_shipdate, l_quantity FROM lineitem) GROUP BY l_suppkey")
def q_dedupe(spark, d):
    return table(spark, d, "lineitem").dropDuplicates(["l_suppkey", "l_shipdate", "l_quantity"]).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS k, c_nationkey AS cell, 'customer' AS tile FROM customer UNION ALL SELECT s_suppkey, s_nationkey, 'supplier' FROM supplier")
def q_union_tiles(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("cell"), F.lit("customer").alias("tile"))
    return a.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("cell"), F.lit("supplier").alias("tile")))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def q_anti_done(spark, d):
    done = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return undone(table(spark, d, "customer"), done, "c_custkey").select("c_custkey")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


from rimefield.plans import studies  # noqa: E402, F401  registers its queries here

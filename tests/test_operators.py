import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rimefield.functions import scalars
from rimefield.operators import noise, robust, segments, spatial
from rimefield.sources import readers, writers
from rimefield.streaming import ingest


def test_theil_sen_finds_exact_slope(spark):
    df = spark.createDataFrame([("a", 0.1 * i, 3.0 * 0.1 * i + 1) for i in range(12)] + [("b", 0.0, 1.0), ("b", 1.0, 2.0)], "k string, t double, y double")
    r = robust.theil_sen(df, ["k"], "t", "y").collect()
    assert len(r) == 1 and r[0].k == "a" and r[0].trend == pytest.approx(3.0) and r[0].trend_sigma == pytest.approx(0, abs=1e-9)


def test_mad_filter_thresholds(spark):
    rows = [("n7", float(v)) for v in [1, 2, 3, 4, 5, 6, 900]] + [("n8", float(v)) for v in [1, 2, 3, 4, 5, 6, 7, 900]] + [("z", 1.0)] * 8 + [("z", 50.0)]
    got = robust.mad_filter(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", 5, 8).groupBy("k").agg(F.max("v").alias("m")).collect()
    assert {r.k: r.m for r in got} == {"n7": 900.0, "n8": 7.0, "z": 50.0}


def test_weighted_median_and_bisquare(spark):
    df = spark.createDataFrame([("a", v, w) for v, w in [(1.0, 1.0), (2.0, 1.0), (3.0, 2.0)]], "k string, v double, w double")
    assert robust.weighted_median(df, ["k"], "v", "w", "m").first().m == 2.0  # the tie at half the weight
    rng = np.random.default_rng(0)
    v = np.append(rng.normal(5, 1, 50), 500.0)
    r = robust.bisquare_mean(spark.createDataFrame([("a", float(x)) for x in v], "k string, v double"), ["k"], "v").first()
    d = v - np.median(v)
    u = d / (4.685 * np.median(abs(d)) / 0.6745)
    w = np.where(abs(u) < 1, (1 - u**2) ** 2, 0)
    m = (w * v).sum() / w.sum()
    assert r["mean"] == pytest.approx(m) and r.sigma == pytest.approx(math.sqrt((w * (v - m) ** 2).sum() / w.sum() / max(w.sum() ** 2 / (w**2).sum(), 1)))


def test_pass_gap_at_one_hour(spark):
    df = spark.createDataFrame([(1, "2020-01-01 00:00:00"), (2, "2020-01-01 01:00:00"), (3, "2020-01-01 02:00:00.000001")], "id int, t string").withColumn("t", F.to_timestamp("t")).withColumn("k", F.lit(1))
    assert [r.pass_id for r in robust.pass_ids(df, ["k"], "t", "id").orderBy("id").collect()] == [0, 0, 1]


def test_projection_known_points(spark):
    df = spark.createDataFrame([(-45.0, 70.0), (0.0, 90.0), (168.35, 30.98)], "lon double, lat double")
    x, y = spatial.polar_stereographic(F.col("lon"), F.col("lat"))
    a, p, c = df.select(x.alias("x"), y.alias("y")).collect()
    assert (a.x, a.y) == pytest.approx((0, -2187927.649), abs=0.01) and (p.x, p.y) == pytest.approx((0, 0), abs=1e-6)
    assert (c.x, c.y) == pytest.approx((-3849992.5, 5849922.0), abs=1)


def test_radius_pairs_brute_force(spark):
    rng = random.Random(2)
    pts = [(i, i % 3, rng.uniform(-20, 20), rng.uniform(-20, 20)) for i in range(300)] + [(900, 0, 0.0, 0.0), (901, 0, 3.0, 4.0)]
    got = {(r.id_a, r.id_b) for r in spatial.radius_pairs(spark.createDataFrame(pts, "id int, tile int, x double, y double"), ["tile"], "id", "x", "y", 5.0).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and a[1] == b[1] and math.hypot(a[2] - b[2], a[3] - b[3]) <= 5}


def test_grid_operators_keep_constants(spark):
    g = spark.createDataFrame([(x, y, 7.0) for x in range(6) for y in range(5) if (x + y) % 2], "ix int, iy int, v double")
    assert all(r.smooth == pytest.approx(7) for r in spatial.gauss_smooth(g, "v", (0, 5, 0, 4)).collect())
    t = spark.createDataFrame([(0, 0), (40, 40)], "ix int, iy int")
    assert [(r.ix, r.filled) for r in spatial.idw_fill(t, g, "v").collect()] == [(0, pytest.approx(7))]


def test_inside_agrees_with_edges(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 4.0), (0.0, 10.0)]
    pts = spark.createDataFrame([(i, random.Random(i).uniform(-2, 12), random.Random(-i - 1).uniform(-2, 12)) for i in range(200)], "id int, x double, y double")
    edges = spark.createDataFrame([(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1])], "x1 double, y1 double, x2 double, y2 double")
    a = {r.id for r in pts.where(spatial.inside(F.col("x"), F.col("y"), ring)).collect()}
    assert a == {r.id for r in spatial.inside_edges(pts, "id", "x", "y", edges, 3.0).collect()} and a


def test_roughness_of_a_sinusoid(spark):
    x = np.arange(0, 200, 0.1)
    df = spark.createDataFrame([(1, float(a), float(2 + 0.5 * a + 0.3 * math.sin(2 * math.pi * a / 10))) for a in x], "k int, x double, y double")
    assert segments.detrend_rms(df, ["k"], "x", "y").first().rms == pytest.approx(0.3 / math.sqrt(2), rel=0.02)
    assert segments.subsegment_rms(df, ["k"], "x", "y").first().n_valid == 4
    flat = df.withColumn("y", F.lit(3.0))
    assert all(r.smooth == pytest.approx(3) for r in segments.kernel_smooth(flat, ["k"], "x", "y", 2.0).take(20))
    assert segments.moving_filter(flat, ["k"], "x", "y").count() > 0


def test_variogram_model():
    h = np.linspace(1, 60, 20)
    n, v, length = segments.fit_gaussian(h, 0.1 + 2 * (1 - np.exp(-np.pi / 4 * (h / 15) ** 2)))
    assert (n, v, length) == pytest.approx((0.1, 2, 15), rel=0.02)


def test_noise_line_bounds(spark):
    def fit(rows):
        return noise.fit_line(spark.createDataFrame(rows, "center double, sigma double, n long")).first()

    assert (lambda r: (r.m, r.c))(fit([(1.0, 2.5, 40), (2.0, 4.5, 60), (3.0, 6.5, 30)])) == pytest.approx((2, 0.5))
    assert fit([(1.0, 1.0, 40), (2.0, 4.0, 60)]).c == 0
    r = fit([(1.0, 4.0, 40), (2.0, 1.0, 60)])
    assert r.m == 0 and r.c == pytest.approx(2.2)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv/tile_7.csv").write_text(",".join(c.split()[0] for c in readers.SEGMENTS.split(", ")) + "\n1,2020-01-02 03:04:05,70,-45,NaN,0.1,4,12,359,100,4+3,250,g1\n")
    r = readers.segments(spark, f"{tmp_path}/csv").first()
    assert r.tile == "tile_7" and r.RMS is None and r.cnf_used == "4+3"
    ring = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    (tmp_path / "region_005.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    assert readers.ring_edges(readers.regions(spark, f"{tmp_path}/region_005.geojson")).count() == 4
    grid = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0)], "ix int, iy int, v double")
    writers.ascii_grid(grid, f"{tmp_path}/grid", "v", 10.0)
    lines = [x for r in spark.read.text(f"{tmp_path}/grid").collect() for x in r.value.split("\n")]
    assert "ncols 2" in lines and "-9999.0 2.0" in lines and "1.0 -9999.0" in lines
    writers.write_once(grid, f"{tmp_path}/once")
    writers.write_once(grid.limit(0), f"{tmp_path}/once")
    assert spark.read.parquet(f"{tmp_path}/once").count() == 2


def test_incremental_ingest(spark, tmp_path):
    a = spark.range(5).withColumn("t", F.timestamp_seconds(F.col("id") * 3000))
    a.write.parquet(f"{tmp_path}/in")
    for want in (5, 5, 8):
        if want == 8:
            a.limit(3).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.ingest(spark, f"{tmp_path}/in", a.schema, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == want
    assert ingest.sessions(a.withColumn("k", F.lit(1)), "k", "t").first().n == 5


def test_scalars(spark):
    assert scalars.config_hash({"b": 1, "a": 2}) == scalars.config_hash({"a": 2, "b": 1})
    r = spark.createDataFrame([("MAR-2019.nc",), ("x",)], "n string").select(scalars.year_from_name(F.col("n")).alias("y")).collect()
    assert [x.y for x in r] == [2019, None]

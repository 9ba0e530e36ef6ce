import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from rimefield.operators import spatial, trends
from rimefield.sources import readers


def test_geopackage_rings(spark, tmp_path):
    square, hole = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]
    wkb = struct.pack("<BII", 1, 3, 2) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in (square, hole))
    db = sqlite3.connect(tmp_path / "mask.gpkg")
    db.execute("CREATE TABLE mask (geom BLOB)")
    db.execute("INSERT INTO mask VALUES (?), (NULL)", (b"GP\0\1" + struct.pack("<i", 3413) + wkb,))
    db.commit()
    db.close()
    edges = readers.geopackage_edges(spark, f"{tmp_path}/mask.gpkg", "mask")
    assert edges.count() == 7
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.8, 1.2), (3, 3.0, 3.0), (4, 5.0, 1.0)], "id int, x double, y double")
    assert sorted(r.id for r in spatial.inside_edges(points, "id", "x", "y", edges, 2.0).collect()) == [1, 3]
    assert [r.id for r in spatial.eroded(points, "id", "x", "y", edges, 2.0, 0.6).collect()] == [3]


def test_caches_and_tables(spark, tmp_path):
    root = f"{tmp_path}/t"
    assert readers.optional(spark, root) is None and readers.merged(spark, root, ["a"]) == (None, ["a"])
    assert readers.cached(spark, root, lambda: spark.range(3)).count() == 3
    assert readers.cached(spark, root, lambda: spark.range(9)).count() == 3
    assert readers.cached(spark, root, lambda: spark.range(9), force=True).count() == 9
    chunks = f"{tmp_path}/chunks"
    spark.createDataFrame([("a", 1), ("b", 2)], "region string, v int").write.partitionBy("region").parquet(chunks)
    merged, missing = readers.merged(spark, chunks, ["a", "b", "c"])
    assert merged.count() == 2 and missing == ["c"]
    spark.createDataFrame([("AL", 2019, 6, 0.0, 0.0, 0.5), ("AL", 2019, 7, 0.0, 0.0, 9e36), ("AL", 2020, 6, 0.0, 0.0, 1.0)], "var string, year int, month int, y double, x double, value double").write.partitionBy("var", "year").parquet(f"{tmp_path}/climate")
    assert [r.value for r in readers.climate(spark, f"{tmp_path}/climate", "AL", 2019).orderBy("month").collect()] == [0.5, None]
    calls = []

    def action():
        calls.append(1)
        if len(calls) < 2:
            raise ValueError("service is busy")
        return "done"

    assert readers.attempt(action, ("busy",), wait=0) == "done"
    with pytest.raises(ValueError):
        readers.attempt(lambda: (_ for _ in ()).throw(ValueError("other")), ("busy",), wait=0)


def test_gates(spark):
    d = spark.createDataFrame([(2.0, 1.0, 10), (2.0, 1.0, 9), (None, 0.0, 10), (1.0, 1.0, 99)], "snr double, sigma double, n int")
    assert [r[0] for r in d.select(trends.trend_gate(F.col("snr"), F.col("sigma"), F.col("n"))).collect()] == [True, False, True, False]
    assert [r[0] for r in d.select(trends.season_gate(F.col("snr"), F.col("sigma"))).collect()] == [True, True, True, False]
    x, y = spatial.polar_stereographic(F.lit(-30.0), F.lit(72.5))
    lon, lat = spatial.geographic(x, y)
    assert tuple(spark.range(1).select(lon, lat).first()) == pytest.approx((-30.0, 72.5), abs=1e-6)

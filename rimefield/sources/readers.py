"""Sources: segment files, polygons, parquet tables, finished work."""

from __future__ import annotations

import sqlite3
import struct
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimefield.operators.robust import finite
from rimefield.operators.spatial import inside

SEGMENTS = "spot_num int, time timestamp, lat_centroid double, lon_centroid double, RMS double, rms_sub_median double, n_valid_subsegments int, semivariogram_range double, azimuth int, mean_surface double, cnf_used string, n_photons_filtered int, source_granule string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """All CSV tiles of a folder; the file's stem is the tile; NaN becomes NULL."""
    d = spark.read.schema(SEGMENTS).option("header", True).option("enforceSchema", False).csv(path)
    d = d.withColumn("tile", F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)\.csv$", 1))
    return d.withColumns({c: finite(F.col(c)) for c, t in d.dtypes if t == "double"})


def regions(spark: SparkSession, path: str) -> DataFrame:
    """(region, ring): all rings of the polygons and multi-polygons of GeoJSON files, holes too, as arrays of (x, y). By the even-odd rule
    of the point tests, holes are outside."""
    flat, deep = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    d = spark.read.schema("features array<struct<geometry: struct<type: string, coordinates: string>>>").option("multiLine", True).json(path).withColumn("region", F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)\.geojson$", 1))
    d = d.select("region", F.explode("features.geometry").alias("g"))
    many = F.when(F.col("g.type") == "MultiPolygon", F.flatten(F.from_json("g.coordinates", deep))).otherwise(F.from_json("g.coordinates", flat))
    d = d.select("region", F.explode(many).alias("r"))
    return d.select("region", F.transform("r", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"))


def geopackage_edges(spark: SparkSession, path: str, layer: str, geometry: str = "geom") -> DataFrame:
    """(x1, y1, x2, y2) of all polygon rings of a GeoPackage layer. The file, a mask or a coastline, is read by Spark and parsed on the
    driver, where SQLite opens it from memory."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    db = sqlite3.connect(":memory:")
    db.deserialize(bytes(content))
    rows = []
    for (blob,) in db.execute(f'SELECT "{geometry}" FROM "{layer}"'):
        for ring in _rings(blob):
            rows += [(*a, *b) for a, b in zip(ring, ring[1:])]
    db.close()
    return spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double")


def _rings(blob: bytes | None) -> list[list[tuple[float, float]]]:
    """Rings of a GeoPackage geometry: a head with an envelope, then WKB."""
    if not blob:
        return []
    at, out = 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7], []

    def read(fmt):
        nonlocal at
        got = struct.unpack_from(fmt, blob, at)
        at += struct.calcsize(fmt)
        return got

    def polygon():
        order = "<" if read("B")[0] else ">"
        kind = read(f"{order}I")[0]
        axes = 2 + (kind // 1000 in (1, 2, 3)) + (kind // 1000 == 3)
        for _ in range(read(f"{order}I")[0]):
            if kind % 1000 == 3:
                points = read(f"{order}I")[0]
                flat = read(f"{order}{points * axes}d")
                out.append([(flat[i], flat[i + 1]) for i in range(0, len(flat), axes)])
            else:
                polygon()

    polygon()
    return out


def ring_edges(rings: DataFrame) -> DataFrame:
    """(region, x1, y1, x2, y2) of closed rings."""
    pairs = F.arrays_zip(F.slice("ring", 1, F.size("ring") - 1).alias("a"), F.slice("ring", 2, F.size("ring") - 1).alias("b"))
    return rings.select("region", F.explode(pairs).alias("e")).select("region", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def catalog(granules: DataFrame, start: str, end: str, ring: list[tuple[float, float]] | None = None, version: str | None = None) -> DataFrame:
    """Granules of a time range, of a version, and whose box meets the ring's box, from a table of them; all of it is pushed to the scan."""
    g = granules.where(F.col("time_end") >= F.lit(start).cast("timestamp")).where(F.col("time_start") <= F.lit(end).cast("timestamp"))
    if version is not None:
        g = g.where(F.col("version") == version)
    if ring:
        xs, ys = zip(*ring)
        g = g.where((F.col("lon_max") >= min(xs)) & (F.col("lon_min") <= max(xs)) & (F.col("lat_max") >= min(ys)) & (F.col("lat_min") <= max(ys)))
    return g


CONFIDENCE = ("atl03_cnf", "quality_ph", "cnf")


def photons(spark: SparkSession, path: str, granules: DataFrame, ring: list[tuple[float, float]] | None = None, least: int = 1, length: float = 200.0) -> DataFrame:
    """Photons of the granules with a confidence of `least` or more inside the ring, with segment_id. Files are partitioned by granule, so
    only those of the granules are read; damaged files are passed over. The confidence is the first column of CONFIDENCE that is there, else 4."""
    d = spark.read.option("ignoreCorruptFiles", True).parquet(path)
    name = next((c for c in CONFIDENCE if c in d.columns), None)
    d = d.withColumn("cnf_ph", F.col(name).cast("int") if name else F.lit(4)).where(F.col("cnf_ph") >= least)
    if ring:
        d = d.where(inside(F.col("lon"), F.col("lat"), ring))
    return d.join(granules.select("granule"), "granule", "left_semi").withColumn("segment_id", F.floor(F.col("x_atc") / length))


def attempt(action, transient: tuple[str, ...], tries: int = 2, wait: float = 1.0):
    """What the action returns; tried again after 2**n waits if its error's text holds one of the transient ones, else the error goes on."""
    for n in range(tries):
        try:
            return action()
        except Exception as e:  # noqa: BLE001  other errors go on below
            if n + 1 == tries or not any(t in str(e) for t in transient):
                raise
            time.sleep(wait * 2**n)


def is_there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, build, force: bool = False) -> DataFrame:
    """The table at a path, built and written where it is not there or `force` says so: pairs, geometries (by path and margin)."""
    if force or not is_there(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def optional(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The first of the tables that is there, such as an elevation lookup and its fallback; None if none is."""
    return next((spark.read.parquet(p) for p in paths if is_there(spark, p)), None)


def with_elevation(cells: DataFrame, elevation: DataFrame | None, keys: list[str]) -> DataFrame:
    """Cells with their elevation, null where the lookup has none or isn't there."""
    if elevation is None:
        return cells.withColumn("elevation", F.lit(None).cast("double"))
    return cells.join(elevation.select(*keys, "elevation"), keys, "left")


def series(spark: SparkSession, path: str) -> DataFrame:
    """(tile, ix, iy, time, value) of all tiles; the partition folder tells the tile."""
    return spark.read.parquet(path).select("tile", "ix", "iy", F.col("time"), finite(F.col("value")).alias("value"))


def climate(spark: SparkSession, path: str, var: str, year: int | None = None, fill: float = 1e10) -> DataFrame:
    """(month, y, x, value) of a variable, of one year where one is given, from a table partitioned by var and year; fill values are null."""
    d = spark.read.parquet(path).where(F.col("var") == var)
    d = d if year is None else d.where(F.col("year") == year)
    return d.withColumn("value", F.when(F.col("value") <= fill, F.col("value")))


def merged(spark: SparkSession, root: str, expected: list[str], by: str = "region") -> tuple[DataFrame | None, list[str]]:
    """All chunks of a folder partitioned by region as one table, and the expected ones that are missing; None if there is none."""
    if not is_there(spark, root):
        return None, sorted(expected)
    d = spark.read.parquet(root)
    had = {str(r[0]) for r in d.select(by).distinct().where(F.col(by).cast("string").isin(expected)).collect()}
    return (d if had else None), sorted(set(expected) - had)


def undone(work: DataFrame, done: DataFrame, key: str = "source_granule") -> DataFrame:
    return work.join(done.select(key).distinct(), key, "left_anti")

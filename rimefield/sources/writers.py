"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_records(df: DataFrame, path: str, by: str = "region") -> None:
    df.write.mode("append").partitionBy(by).parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """Leaves a table that exists as it is."""
    df.write.mode("ignore").parquet(path)


def ascii_grid(df: DataFrame, path: str, value: str, cell: float, nodata: float = -9999.0) -> None:
    """A folder of lines of an ESRI ASCII grid, north up, written by the tasks; the head is the file of line -1. Rows are one line each."""
    x0, x1, y0, y1 = df.agg(F.min("ix"), F.max("ix"), F.min("iy"), F.max("iy")).first()
    n = x1 - x0 + 1
    axis = F.sequence(F.lit(x0), F.lit(x1))
    lines = df.groupBy("iy").agg(F.map_from_entries(F.collect_list(F.struct("ix", F.col(value).cast("double")))).alias("m"))
    all_rows = df.sparkSession.range(y0, y1 + 1).select(F.col("id").cast("int").alias("iy")).join(lines, "iy", "left")
    cellwise = F.transform(axis, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(nodata)).cast("string"))
    body = all_rows.select((F.lit(y1) - F.col("iy")).alias("line"), F.array_join(cellwise, " ").alias("value"))
    head = f"ncols {n}\nnrows {y1 - y0 + 1}\nxllcorner {x0 * cell}\nyllcorner {y0 * cell}\ncellsize {cell}\nNODATA_value {nodata}"
    top = df.sparkSession.createDataFrame([(-1, head)], "line int, value string")
    top.unionByName(body).repartitionByRange("line").sortWithinPartitions("line").select("value").write.mode("overwrite").text(path)

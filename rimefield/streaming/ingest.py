"""Incremental ingest and sessions on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str) -> StreamingQuery:
    """Append what is new in a folder of parquet files, then stop; a second run skips the files that are done."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(stream: DataFrame, key: str, time: str, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Gap sessions per key; rows older than the watermark are late and dropped."""
    return stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("pass")).agg(F.count("*").alias("n")).select(key, F.col("pass.start").alias("start"), F.col("pass.end").alias("end"), "n")

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of the token definition.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder, in local mode only:
    on a cluster each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir is unset: on {master} it must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='rimefield-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _tables(spark: SparkSession):
    """Path and file system of this application's tables."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it again. Its files outlive lost executors and go when the
    application ends."""
    spark = df.sparkSession
    folder, fs = _tables(spark)
    fs.deleteOnExit(folder)
    path = f"{folder.toString()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_tables(spark: SparkSession) -> None:
    """Remove what materialize() has written in this application, once its results are no longer read."""
    path, fs = _tables(spark)
    fs.delete(path, True)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: Catalyst may write a column's expression anew into each place of a lambda."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32(doc_id as text) mod by; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def count_words(text: Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")

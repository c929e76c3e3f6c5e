"""Files in an object store, through Spark's own connector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.functions.paths import basename, has_suffix, is_directory_marker


def object_url(bucket: str, prefix: str = "") -> str:
    if not bucket:
        raise ValueError("no bucket given")
    return f"s3a://{bucket}/{prefix}"


def list_objects(spark: SparkSession, url: str, suffixes=None) -> DataFrame:
    """original_path, filename, size_bytes, modified_time, content (read only if used)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(url).where(~is_directory_marker(F.col("path")))
    rows = raw.select(F.col("path").alias("original_path"), basename(F.col("path")).alias("filename"), F.col("length").alias("size_bytes"), F.col("modificationTime").cast("timestamp_ntz").alias("modified_time"), "content")
    return rows if suffixes is None else rows.where(has_suffix(F.col("filename"), suffixes))


def list_with_content(spark: SparkSession, url: str, suffixes=None) -> DataFrame:
    """A source for ``index`` alone: the rows of ``list_objects`` as file rows, with the bytes that ``decode`` reads."""
    rows = list_objects(spark, url, suffixes)
    return rows.withColumns({"norm_path": F.col("original_path"), "error": F.lit(None).cast("string")})


def list_as_files(spark: SparkSession, url: str, suffixes=None) -> DataFrame:
    """A source for ``index`` and ``sync``: file rows of objects, whose bytes tasks read by their URI when they need them."""
    return list_with_content(spark, url, suffixes).drop("content")

"""Counts over a library or an indexing run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def total(library: DataFrame) -> DataFrame:
    return library.agg(F.count("*").alias("n"))


def by_mime(library: DataFrame) -> DataFrame:
    return library.groupBy(F.col("file_info.mime_type").alias("mime_type")).agg(F.count("*").alias("n"), F.sum("file_info.size_bytes").alias("bytes"))


def by_error(rows: DataFrame, column: str = "error_type") -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def run_totals(rows: DataFrame, seconds: float | None) -> DataFrame:
    """discovered, processed, errors, bytes, images_per_minute (0 while the run is not over)."""
    failed = F.col("error_type").isNotNull()
    one = rows.agg(F.count("*").alias("discovered"), F.count_if(~failed).alias("processed"), F.count_if(failed).alias("errors"), F.coalesce(F.sum(F.when(~failed, F.col("size_bytes"))), F.lit(0)).cast("long").alias("bytes"))
    rate = F.col("processed") / (seconds / 60) if seconds else F.lit(0.0)
    return one.withColumn("images_per_minute", rate)


def outcomes(rows: DataFrame) -> DataFrame:
    """(state, error_type, n) of decoded files; a null error is a success."""
    return rows.groupBy("state", "error_type").agg(F.count("*").alias("n"))

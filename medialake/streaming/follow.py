"""A library that follows a directory tree: new, edited, renamed and deleted files, as a stream."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from medialake.functions.paths import IMAGE_SUFFIXES
from medialake.operators import diff
from medialake.plans.library import Library
from medialake.plans.pipelines import Extractor, dealt, library_rows
from medialake.sources.decode import decode
from medialake.sources.tree_changes import TreeChanges
from medialake.sources.walk import FAILED


def changes(spark: SparkSession, root: str, state: str, suffixes=IMAGE_SUFFIXES, partitions: int | None = None) -> DataFrame:
    """Stream of the changes below ``root``; ``state`` is a folder that all executors see."""
    spark.dataSource.register(TreeChanges)
    rows = spark.readStream.format("tree_changes").option("state", state).option("partitions", str(partitions or 4 * spark.sparkContext.defaultParallelism)).load(root)
    return rows.where(F.col("kind").isin(*sorted({s.lower() for s in suffixes}), FAILED))


def apply_changes(library: Library, batch: DataFrame, extractor: Extractor = decode, added_at: datetime.datetime | None = None) -> int:
    """One new version of the library from a batch of changes; a batch applied twice leaves what one does.

    A path that a file came to gives up its former contents; a path that is
    gone gives up its rows, unless the same batch saved one there.
    """
    try:
        told = library.scratch(batch)
        failed = told.where("state = 'ERROR'")
        if failed.head(1):
            library.record_errors(failed.select(F.col("original_path").alias("path"), F.lit(None).cast("string").alias("state"), "error", F.lit("OSError").alias("error_type")))
        came = told.where("state in ('NEW', 'MODIFIED')")
        last = diff.last_by(came.select("norm_path", "original_path", "filename", "size_bytes", "modified_time", "error"), "norm_path", "original_path")
        decoded = library.scratch(extractor(dealt(last, keep=library.scratch)))
        good, bad = decoded.where("decode_error is null"), decoded.where("decode_error is not null")
        if bad.head(1):
            library.record_errors(bad.select(F.col("norm_path").alias("path"), F.lit(None).cast("string").alias("state"), F.col("decode_error").alias("error"), "error_type"))
        former = library.paths().select("norm_path", "file_hash").join(library.dealt_by_path(good.select("norm_path", F.col("file_hash").alias("_now"))), "norm_path")
        retired = library.scratch(former.where("file_hash <> _now").select("norm_path", "file_hash"))
        gone = told.where("state = 'DELETED'").select("norm_path").distinct().join(good.select("norm_path"), "norm_path", "left_anti")
        return library.change(library_rows(good, added_at or datetime.datetime.now()), retired, gone)
    finally:
        library.clear()


def follow(spark: SparkSession, root: str, library: Library, state: str, checkpoint: str, suffixes=IMAGE_SUFFIXES, every: str | None = None, extractor: Extractor = decode) -> StreamingQuery:
    """Start a query that keeps ``library`` in step with ``root``: once, or ``every`` such interval."""
    writer = changes(spark, root, state, suffixes).writeStream.foreachBatch(lambda batch, _: apply_changes(library, batch, extractor)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

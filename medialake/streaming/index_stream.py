"""Indexing as a stream: new files enter the library as they arrive."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from medialake.functions.paths import IMAGE_SUFFIXES, basename, has_suffix
from medialake.plans.library import Library
from medialake.plans.pipelines import library_rows, numbered
from medialake.sources.decode import decode

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_index(spark: SparkSession, folder: str, library: Library, checkpoint: str, suffixes=IMAGE_SUFFIXES, available_now: bool = True) -> StreamingQuery:
    """Start a query that saves new image files; a file stream sees neither edits nor deletions.

    Each batch is one upsert keyed by content, so a batch that runs twice
    leaves the library as one run does.
    """
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(folder)
    rows = files.select(F.regexp_replace("path", "^file:/*", "/").alias("original_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").cast("timestamp_ntz").alias("modified_time"))
    named = rows.withColumn("filename", basename(F.col("original_path"))).where(has_suffix(F.col("filename"), suffixes)).withColumn("norm_path", F.col("original_path"))

    def save(batch: DataFrame, batch_id: int) -> None:
        good = decode(numbered(batch)).where("decode_error is null")
        library.save(library_rows(good, datetime.datetime.now()))

    writer = named.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


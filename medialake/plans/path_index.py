"""Index of a library by path: slim rows in buckets of the path, a generation for each version.

A generation says what its version changed: rows that came to a path, and rows
that left one.  The latest word on a (path, hash) holds.  All generations are
dealt to the same buckets by the same hash as a join deals its rows, so a join
by path shuffles the other side only.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "norm_path STRING, file_hash STRING, size_bytes BIGINT, doc_id BIGINT, modified_time TIMESTAMP_NTZ, live BOOLEAN"
_TRACKED = "spark.sql.hive.manageFilesourcePartitions"
#: With more generations than this, a writer merges all into one.
MOST = 8


class PathIndex:
    def __init__(self, spark: SparkSession, folder: str, buckets: int):
        self.spark, self.folder, self.buckets = spark, f"{folder.rstrip('/')}/paths", buckets
        self.table = "medialake_paths_" + hashlib.md5(f"{self.folder} {buckets}".encode()).hexdigest()

    def _table(self, name: str, place: str, columns: str, partitioned: str = "") -> str:
        """An external table of a folder, whose files Spark lists itself."""
        if not self.spark.catalog.tableExists(name):
            before = self.spark.conf.get(_TRACKED)
            self.spark.conf.set(_TRACKED, "false")
            try:
                quoted = place.replace("'", "\\'")
                self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {partitioned} CLUSTERED BY (norm_path) SORTED BY (norm_path) INTO {self.buckets} BUCKETS LOCATION '{quoted}'")
            finally:
                self.spark.conf.set(_TRACKED, before)
        return name

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with norm_path) in the index's own partitions, so that a join with it moves no more."""
        return rows.repartition(self.buckets, "norm_path")

    def rows(self, generations) -> DataFrame:
        """norm_path, file_hash, size_bytes, doc_id, modified_time of the library's rows, in buckets."""
        if not generations:
            return self.dealt(self.spark.createDataFrame([], "norm_path string, file_hash string, size_bytes long, doc_id long, modified_time timestamp_ntz"))
        table = self._table(self.table, self.folder, f"{COLUMNS}, gen STRING", "PARTITIONED BY (gen)")
        self.spark.catalog.refreshTable(table)
        told = self.spark.table(table).where(F.col("gen").isin(*generations))
        last = told.groupBy("norm_path", "file_hash").agg(F.max_by(F.struct("live", "size_bytes", "doc_id", "modified_time"), "gen").alias("_r"))
        return last.where("_r.live").select("norm_path", "file_hash", "_r.size_bytes", "_r.doc_id", "_r.modified_time")

    def add(self, changes: DataFrame, generation: str) -> None:
        """Write a generation: norm_path, file_hash, size_bytes, doc_id, modified_time, live."""
        # a table of its own, so that writers side by side share no folder
        own = self._table(f"{self.table}_{uuid.uuid4().hex}", f"{self.folder}/gen={generation}", COLUMNS)
        try:
            self.dealt(changes).select("norm_path", "file_hash", "size_bytes", "doc_id", "modified_time", "live").write.mode("append").insertInto(own)
        finally:
            self.spark.sql(f"DROP TABLE {own}")  # an external one: the files stay

    @staticmethod
    def changes(before: DataFrame, after: DataFrame) -> DataFrame:
        """What a generation has to say of rows (norm_path, file_hash, size_bytes, doc_id, modified_time) that were and are."""
        own = F.struct("norm_path", "size_bytes", "doc_id", "modified_time")
        met = before.select("file_hash", own.alias("_was")).join(after.select("file_hash", own.alias("_now")), "file_hash", "full").where(~F.col("_was").eqNullSafe(F.col("_now")))
        moved = F.col("_was").isNotNull() & (F.col("_now").isNull() | ~F.col("_was.norm_path").eqNullSafe(F.col("_now.norm_path")))
        came = F.when(F.col("_now").isNotNull(), F.struct("_now.norm_path", "_now.size_bytes", "_now.doc_id", "_now.modified_time", F.lit(True).alias("live")))
        left = F.when(moved, F.struct("_was.norm_path", "_was.size_bytes", "_was.doc_id", "_was.modified_time", F.lit(False).alias("live")))
        return met.select("file_hash", F.explode(F.array_compact(F.array(came, left))).alias("_c")).select("_c.norm_path", "file_hash", "_c.size_bytes", "_c.doc_id", "_c.modified_time", "_c.live")

"""A library: rows in buckets of their content hash, and a log of manifests.

A change reads and writes the buckets that hold its keys only; the files of the
others stay as they are.  It becomes visible by a manifest made only if its
version has none yet; a writer who comes second starts again from the new
state, so no row of either is lost.  Readers hold the files of one version.

* Files are sorted by the cell of the place, and carry Bloom filters of hash
  and paths: a search reads the files and row groups whose cells meet its
  circle, and a lookup of a key that is not there reads none.
* A second, slim table (``path_index``) is dealt by path, for the daily join
  with a listing.
* Each manifest holds the sums of each file, so counts read no data.

Only the lists of files and their sums reach the driver.  A bucket is written by
one task, so the number of buckets follows the rows: a new library is dealt by
those of its first change, and dealt anew when it has grown to four times that.
"""

from __future__ import annotations

import datetime
import time
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass, replace
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.functions.cells import among, cell, cover
from medialake.operators import search as searching
from medialake.operators import store
from medialake.plans.manifest import DataFile, Log, Manifest
from medialake.plans.path_index import MOST, PathIndex
from medialake.schemas import LIBRARY_SCHEMA

#: What files hold beside the library's columns: the file's time when it was read, and the cell of the place.
_STORED = f"{LIBRARY_SCHEMA}, modified_time timestamp_ntz, cell long"
_INNER = ("modified_time", "cell")
_SLIM = ("norm_path", "file_hash", "file_info.size_bytes", "doc_id", "modified_time")
_ERRORS = "path string, state string, error string, error_type string, told_at timestamp_ntz"
_BLOOM = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("file_hash", "norm_path", "file_info.path")}
#: Rows that a bucket is meant for, and the least number of buckets, where the caller gives none.
ROWS_PER_BUCKET, LEAST_BUCKETS = 1_000_000, 16
#: Beyond this many paths a lookup joins instead of listing them in a condition.
_LISTED = 1000


class Conflict(RuntimeError):
    """Other writers were first in each of the attempts."""


@dataclass(frozen=True)
class LibraryStats:
    rows: int
    bytes: int
    kinds: dict[str, tuple[int, int]]  # media type to (rows, bytes)
    files: int
    version: int


class Library:
    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, rows_per_file: int = 1_000_000, attempts: int = 20):
        """``buckets``: of a new library, which then keeps them; by default they follow the rows."""
        self.spark, self.path, self.buckets, self.rows_per_file, self.attempts = spark, path.rstrip("/"), buckets, rows_per_file, attempts
        self.log = Log(spark, self.path)
        self._scratch: list[str] = []

    # --- state ------------------------------------------------------------------
    def manifest(self) -> Manifest:
        """The current one; an empty one only where there is no library at all.

        Data without a log cannot be named, so it raises: the next change must
        not pass for the whole library.
        """
        found = self.log.latest()
        if found is None:
            if any(f.endswith(".parquet") and not f.startswith(("staging/", "errors/")) for f in self.log.folder.files()):
                raise RuntimeError(f"{self.path} has data but no log: restore the log, or remove the folder")
            return Manifest(buckets=self.buckets or LEAST_BUCKETS)
        return found

    def _rows(self, files: list[DataFile] | tuple[DataFile, ...]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], _STORED)
        return self.spark.read.schema(_STORED).parquet(*(f"{self.path}/{f.path}" for f in files))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows (``list_all``), of the current version or an older one that is still kept."""
        return self._rows((self.manifest() if version is None else self.log.at(version)).files).drop(*_INNER)

    def paths(self) -> DataFrame:
        """norm_path, file_hash, size_bytes, doc_id, modified_time of all rows, in buckets of the path."""
        m = self.manifest()
        return self._index(m).rows(m.generations)

    def dealt_by_path(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with norm_path) dealt as ``paths`` is."""
        return self._index(self.manifest()).dealt(rows)

    def _index(self, m: Manifest) -> PathIndex:
        return PathIndex(self.spark, f"{self.path}/by-path-{m.buckets}", m.buckets)

    # --- changes ------------------------------------------------------------------
    def scratch(self, rows: DataFrame) -> DataFrame:
        """``rows`` written below the library and read back: they are not made again, whatever executors are lost.  ``clear`` removes them."""
        name = f"staging/{_stamp()}"
        rows.write.parquet(f"{self.path}/{name}")
        self._scratch.append(name)
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def clear(self) -> None:
        while self._scratch:
            for f in self.log.folder.files(self._scratch.pop()):
                self.log.folder.remove(f)

    def save(self, rows: DataFrame, order: str = "seq", keep: tuple[str, ...] = ()) -> int:
        """Upsert by content hash: the last row of a hash wins, its number and the columns ``keep`` stay; returns the version."""
        try:
            return self.change(saved=self.scratch(rows), order=order, keep=keep)
        finally:
            self.clear()

    def change(self, saved: DataFrame | None = None, retired: DataFrame | None = None, gone: DataFrame | None = None, order: str = "seq", keep: tuple[str, ...] = ()) -> int:
        """One new version: drop the rows ``retired`` (norm_path, file_hash), upsert ``saved``, drop what is then left of the paths ``gone`` (norm_path).

        The tables are read several times, so they must give the same rows each time.
        """
        if saved is not None and "modified_time" not in saved.columns:
            saved = saved.withColumn("modified_time", F.lit(None).cast("timestamp_ntz"))
        if saved is not None and self.buckets is None and self.log.latest() is None:
            self._begun(saved.count())

        def plan(m: Manifest):
            known, lost = self._index(m).rows(m.generations), None
            if gone is not None:
                lost = self.scratch(known.join(gone.select("norm_path").distinct(), "norm_path", "left_semi").select("norm_path", "file_hash"))
            keys = [df.select("file_hash") for df in (saved, retired, lost) if df is not None]
            touched = set().union(*({r[0] for r in k.select(_bucket(F.col("file_hash"), m.buckets)).distinct().collect()} for k in keys))
            rows = self._rows(m.within(touched)).drop("cell")
            if retired is not None:
                rows = _without_pairs(rows, retired)
            if saved is not None:
                rows = store.upsert(rows, saved, order=order, top=m.top, keep=keep)
            return touched, rows if lost is None else _without_pairs(rows, lost)

        return self._commit(plan)

    def commit(self, rows: DataFrame) -> int:
        """Make ``rows`` the whole current state; returns its version."""
        rows = rows if "modified_time" in rows.columns else rows.withColumn("modified_time", F.lit(None).cast("timestamp_ntz"))
        return self._commit(lambda m: (set(range(m.buckets)), rows))

    def rebucket(self, buckets: int) -> int:
        """Rewrite the library in so many buckets."""
        return self._commit(lambda m: (set(range(max(m.buckets, buckets))), self._rows(m.files).drop("cell")), buckets)

    def _commit(self, plan: Callable[[Manifest], tuple[set[int], DataFrame]], buckets: int | None = None) -> int:
        self._begun(0)
        for _ in range(self.attempts):
            m = self.manifest()
            touched, rows = plan(m)
            if not touched:
                return m.version
            n = buckets or m.buckets
            made = self._write(rows, n)
            kept = tuple(f for f in m.files if f.bucket not in touched)
            following = replace(m, version=m.version + 1, buckets=n, top=max([m.top, *(f.top for f in made)]), files=kept + tuple(made))
            if self.log.create(replace(following, generations=self._indexed(m, following, touched, made))):
                if self.buckets is None and following.count() > 4 * ROWS_PER_BUCKET * n:
                    return self.rebucket(_buckets_for(following.count()))
                return following.version
        raise Conflict(f"{self.attempts} attempts to change {self.path} came second")

    def _begun(self, rows: int) -> None:
        """Write the empty version of a new library, so that a reader never sees data before a log."""
        if not self.manifest().version:
            self.log.create(Manifest(buckets=self.buckets or _buckets_for(rows)))

    def _write(self, rows: DataFrame, buckets: int) -> list[DataFile]:
        """Write rows as files of their buckets, and sum them up."""
        place, folder = F.col("exif.location"), f"data/{_stamp()}"
        out = rows.withColumns({"cell": cell(place["latitude"], place["longitude"]), "bucket": _bucket(F.col("file_hash"), buckets)})
        ordered = out.repartition("bucket").sortWithinPartitions("bucket", "cell", "file_hash")
        ordered.write.options(**_BLOOM, maxRecordsPerFile=self.rows_per_file).partitionBy("bucket").parquet(f"{self.path}/{folder}")
        if not self.log.folder.files(folder):
            return []
        size, taken = F.col("file_info.size_bytes"), F.col("exif.captured_at").cast("string")
        found = self.spark.read.schema(f"{_STORED}, bucket int").parquet(f"{self.path}/{folder}").groupBy(F.col("_metadata.file_path").alias("file"), "bucket", F.col("file_info.mime_type").alias("kind"))
        sums = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.max("doc_id").alias("top"), *(f(c).alias(name) for c, a, b in (("cell", "low", "high"), (taken, "first", "last")) for f, name in ((F.min, a), (F.max, b))))
        files: dict[tuple[str, int], list] = {}
        for r in sums.collect():
            files.setdefault((r.file, r.bucket), []).append(r)
        bounds = lambda rs, a, b: (min(v), max(w)) if (v := [r[a] for r in rs if r[a] is not None]) and (w := [r[b] for r in rs if r[b] is not None]) else None
        return [
            DataFile(f"{folder}/" + unquote(name).rpartition(f"/{folder}/")[2], bucket, sum(r.n for r in rs), max([-1, *(r.top for r in rs if r.top is not None)]), bounds(rs, "low", "high"), bounds(rs, "first", "last"), {r.kind or "": (r.n, r.bytes) for r in rs})
            for (name, bucket), rs in sorted(files.items())
        ]

    def _indexed(self, m: Manifest, following: Manifest, touched: set[int], made: list[DataFile]) -> tuple[str, ...]:
        """Write what the index has to say of a change; the generations that hold then."""
        index, generation = self._index(following), f"{following.version:020d}-{uuid.uuid4().hex[:8]}"
        slim = lambda files: self._rows(files).select(*_SLIM)
        if m.buckets != following.buckets:
            index.add(slim(made).withColumn("live", F.lit(True)), generation)
            return (generation,)
        index.add(PathIndex.changes(slim(m.within(touched)), slim(made)), generation)
        told = (*m.generations, generation)
        if len(told) <= MOST:
            return told
        merged = generation + "-merged"
        index.add(index.rows(told).withColumn("live", F.lit(True)), merged)
        return (merged,)

    def vacuum(self, keep: int = 2, grace_seconds: float = 24 * 3600) -> int:
        """Remove manifests but for the last ``keep``, and files that none of these names; how many went.

        What was begun within ``grace_seconds`` stays, as a writer may be about to name it.
        """
        versions = self.log.versions()
        named, folder, gone = set(), self.log.folder, 0
        for v in versions[-max(1, keep) :]:
            m = self.log.at(v)
            named |= {f.path for f in m.files}
            named |= {f for g in m.generations for f in folder.files(f"by-path-{m.buckets}/paths/gen={g}")}
        for v in versions[: -max(1, keep)]:
            self.log.forget(v)
            gone += 1
        for f in [*folder.files("data"), *folder.files("staging"), *(x for x in folder.files() if x.startswith("by-path-"))]:
            if f not in named and folder.age(f) >= grace_seconds:
                folder.remove(f)
                gone += 1
        return gone

    def record_errors(self, errors: DataFrame) -> None:
        """Add to the table of all errors: path, state, error, error_type."""
        told = errors.withColumn("told_at", F.lit(datetime.datetime.now()).cast("timestamp_ntz"))
        told.select("path", "state", "error", "error_type", "told_at").write.parquet(f"{self.path}/errors/{_stamp()}")

    def errors(self) -> DataFrame:
        """Everything that went wrong in indexing and syncing: path, state, error, error_type, told_at."""
        if not self.log.folder.files("errors"):
            return self.spark.createDataFrame([], _ERRORS)
        return self.spark.read.schema(_ERRORS).option("recursiveFileLookup", "true").parquet(f"{self.path}/errors")

    # --- lookups --------------------------------------------------------------------
    def get_by_filehash(self, file_hash: str) -> DataFrame:
        m = self.manifest()
        return store.first_where(self._rows(m.within([zlib.crc32(file_hash.encode()) % m.buckets])).drop(*_INNER), "file_hash", file_hash)

    def get_by_path(self, path: str) -> DataFrame:
        return store.first_where(self.read(), "file_info.path", path)

    def find_by_paths(self, paths: list[str]) -> DataFrame:
        if len(paths) <= _LISTED:
            return self.read().where(F.col("file_info.path").isin(*paths)) if paths else self.read().limit(0)
        return store.with_paths(self.read(), self.spark.createDataFrame([(p,) for p in paths], "path string"))

    def search(self, date_from: str | None = None, date_to: str | None = None, camera: str | None = None, location: tuple[float, float, float] | None = None, tags: list[str] | None = None, match: str = "any") -> DataFrame:
        """``operators.search`` over the files that can hold a hit."""
        files, near = self.manifest().files, cover(*location) if location else None
        if near is not None:
            files = [f for f in files if f.cells and any(low <= f.cells[1] and high >= f.cells[0] for low, high in near)]
        if date_from or date_to:  # times as texts compare as times
            files = [f for f in files if f.times and (not date_from or f.times[1][:10] >= date_from) and (not date_to or f.times[0][:10] <= date_to)]
        rows = self._rows(files)
        if near is not None:
            rows = rows.where(among(F.col("cell"), near))
        return searching.search(rows.drop(*_INNER), date_from, date_to, camera, location, tags, match)

    def stats(self) -> LibraryStats:
        """Counts from the sums in the manifest; no data file is read."""
        m = self.manifest()
        kinds = m.kinds()
        return LibraryStats(m.count(), sum(b for _, b in kinds.values()), kinds, len(m.files), m.version)

    def count(self) -> int:
        return self.manifest().count()

    def _remove(self, hit: DataFrame) -> bool:
        try:
            pairs = self.scratch(hit.select("norm_path", "file_hash"))
            if not pairs.head(1):
                return False
            self.change(retired=pairs)
            return True
        finally:
            self.clear()

    def delete(self, file_hash: str) -> bool:
        m = self.manifest()
        return self._remove(self._rows(m.within([zlib.crc32(file_hash.encode()) % m.buckets])).where(F.col("file_hash") == F.lit(file_hash)))

    def delete_by_path(self, path: str) -> bool:
        return self._remove(self.read().where(F.col("file_info.path") == F.lit(path)))

    def close(self) -> None:
        """Nothing is held open."""


def _bucket(file_hash: Column, buckets: int) -> Column:
    return (F.crc32(file_hash.cast("binary")) % buckets).cast("int")


def _buckets_for(rows: int) -> int:
    """The least power of two at which a bucket has no more rows than it is meant for."""
    return max(LEAST_BUCKETS, 1 << max(0, -(-rows // ROWS_PER_BUCKET) - 1).bit_length())


def _stamp() -> str:
    """Name of a folder that no other writer has."""
    return f"{int(time.time() * 1000)}-{uuid.uuid4().hex[:12]}"


def _without_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rows`` but for those at a path with a hash of ``pairs``."""
    gone = pairs.select(F.col("norm_path").alias("_path"), F.col("file_hash").alias("_hash")).distinct()
    return rows.join(gone, F.col("norm_path").eqNullSafe(F.col("_path")) & (F.col("file_hash") == F.col("_hash")), "left_anti")

"""Indexing a folder, and keeping a library in step with it."""

from __future__ import annotations

import contextlib
import datetime
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from medialake.functions.exif import exif_struct
from medialake.functions.paths import IMAGE_SUFFIXES, mime_type
from medialake.operators import diff, stats
from medialake.plans.library import Library
from medialake.plans.progress import Progress
from medialake.sources.decode import decode, hashed
from medialake.sources.walk import list_files

#: (session, folder, suffixes) -> file rows; file rows -> file rows with the DECODED columns.
Source = Callable[[SparkSession, str, object], DataFrame]
Extractor = Callable[[DataFrame], DataFrame]
#: Writes or persists a table and gives it back.
Keep = Callable[[DataFrame], DataFrame]


@dataclass
class SyncResult:
    new_files: int = 0
    modified_files: int = 0
    deleted_entries: int = 0
    unchanged_files: int = 0
    errors: list[str] = field(default_factory=list)
    error_count: int = 0
    duration_seconds: float = 0.0

    @property
    def total_changes(self) -> int:
        return self.new_files + self.modified_files + self.deleted_entries


@dataclass
class IndexResult:
    discovered: int
    processed: int
    errors: int
    bytes: int
    images_per_minute: float
    error_types: dict[str, int]
    mime_types: dict[str, int]


def library_rows(decoded: DataFrame, added_at: datetime.datetime) -> DataFrame:
    """Library columns (without doc_id, with ``seq`` and modified_time) of decoded files."""
    return decoded.select(
        "file_hash", "norm_path", F.struct(F.col("filename").alias("name"), F.col("original_path").alias("path"), F.col("size_bytes"), mime_type(F.col("filename")).alias("mime_type")).alias("file_info"),
        F.struct("width", "height").alias("dimensions"), exif_struct(F.col("tags"), F.col("numbers"), F.col("modified_time")).alias("exif"),
        F.array().cast("array<string>").alias("labels"), F.lit(added_at).cast("timestamp_ntz").alias("added_at"), "modified_time", "seq",
    )


def _persisted(rows: DataFrame) -> DataFrame:
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def _placed(files: DataFrame, parts: int, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """(files in ranges of their path with ``_at``, first place and bytes before each range).

    What reaches the driver is a row for each range.
    """
    spark = files.sparkSession
    ranged = files.repartitionByRange(max(parts, 4 * spark.sparkContext.defaultParallelism), "original_path").sortWithinPartitions("original_path")
    kept = keep(ranged.withColumn("_at", F.monotonically_increasing_id()))
    size = _cost() if "size_bytes" in files.columns else F.lit(0)
    before, weight, offsets = 0, 0, []
    for p, n, w in sorted(map(tuple, kept.groupBy(_part().alias("p")).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).collect())):
        offsets.append((p, before, weight))
        before, weight = before + n, weight + w
    return kept, F.broadcast(spark.createDataFrame(offsets, "_part long, _before long, _weight long")).withColumn("_total", F.lit(weight))


def _part():
    return F.shiftright("_at", 33)


def _cost():
    """Work of a file: its bytes, and as much for opening it as for reading 64 KiB."""
    return F.coalesce(F.col("size_bytes"), F.lit(0)) + 65536


def numbered(files: DataFrame, parts: int = 0, keep: Keep = _persisted) -> DataFrame:
    """Files with ``seq``, their place by path, from 0.

    ``keep`` writes or persists the files in their ranges, so that numbers do
    not change; ``parts`` is the least number of ranges (by default four a core).
    """
    kept, offsets = _placed(files, parts, keep)
    return kept.join(offsets, _part() == F.col("_part")).withColumn("seq", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before", "_weight", "_total")


def dealt(files: DataFrame, parts: int = 0, keep: Keep = _persisted) -> DataFrame:
    """``numbered`` files in tasks of near equal bytes: a task has at most its share and one file more.

    Files come in the order of their paths, so a task reads neighbours.
    """
    kept, offsets = _placed(files, parts, keep)
    n = max(parts, 4 * files.sparkSession.sparkContext.defaultParallelism)
    running = F.sum(_cost()).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    share = F.col("_total") / n
    task = F.least(F.floor((F.col("_weight") + F.coalesce(running, F.lit(0))) / share), F.lit(n - 1)).cast("int")
    found = kept.join(offsets, _part() == F.col("_part")).withColumns({"seq": F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)), "_task": task})
    return found.repartitionById(n, "_task").drop("_at", "_part", "_before", "_weight", "_total", "_task")


def _decoded(library: Library, listing: DataFrame, extractor: Extractor, workers: int, seen: Progress | None) -> DataFrame:
    """Decoded files with ``seq``, written in the library's folder.

    Files that come with their bytes are decoded where they are listed, so no
    byte is shuffled or stored; others are dealt to tasks by their size.
    """
    with seen or contextlib.nullcontext():
        if "content" in listing.columns:
            return numbered(library.scratch(extractor(listing)), workers, library.scratch)
        return library.scratch(extractor(dealt(listing, workers, library.scratch)))


def index(spark: SparkSession, folder: str, library: Library, workers: int = 4, fail_fast: bool = False, suffixes=IMAGE_SUFFIXES, added_at: datetime.datetime | None = None, source: Source = list_files, extractor: Extractor = decode, progress: Callable[[dict], None] | None = None, every: float = 1.0, preserve_labels: bool = False) -> IndexResult:
    """Scan, decode and save all images below ``folder``.

    Files that cannot be read are counted, told in ``library.errors`` and left
    out; with ``fail_fast`` the first one raises and nothing is saved.
    ``source`` lists files (FILE_SCHEMA, and ``content`` if it has the bytes),
    ``extractor`` adds the DECODED columns; ``workers`` is the least number of
    tasks.  ``progress`` is told the counts so far ``every`` so many seconds
    while files are decoded, and once at the end.  ``preserve_labels`` keeps the
    labels of contents that are known.
    """
    began = time.monotonic()
    seen = Progress(spark, progress, every) if progress else None
    try:
        decoded = _decoded(library, source(spark, folder, suffixes), (lambda files: seen.counted(extractor(files))) if seen else extractor, workers, seen)
        failed, good = decoded.where("decode_error is not null"), decoded.where("decode_error is null")
        bad = failed.select("decode_error").first()
        if bad:
            library.record_errors(failed.select(F.col("original_path").alias("path"), F.lit(None).cast("string").alias("state"), F.col("decode_error").alias("error"), "error_type"))
        if fail_fast and bad:
            raise OSError(bad[0])
        library.change(saved=library_rows(good, added_at or datetime.datetime.now()), keep=("labels",) if preserve_labels else ())
        t = stats.run_totals(decoded, time.monotonic() - began).first()
        kinds = {r[0]: r[1] for r in good.groupBy(mime_type(F.col("filename"))).count().collect()}
        return IndexResult(t.discovered, t.processed, t.errors, t.bytes, t.images_per_minute, {r[0]: r[1] for r in stats.by_error(decoded).collect()}, kinds)
    finally:
        library.clear()


def sync(spark: SparkSession, folder: str, library: Library, cleanup_deleted: bool = False, reprocess_modified: bool = True, index_new: bool = True, dry_run: bool = False, suffixes=IMAGE_SUFFIXES, keep_superseded: bool = False, scope_to_path: bool = False, added_at: datetime.datetime | None = None, source: Source = list_files, extractor: Extractor = decode, hashes=hashed, analyzer=diff.file_states, max_errors: int = 1000, fingerprint: str = "size", preserve_labels: bool = False) -> SyncResult:
    """Bring ``library`` in step with the files below ``folder``.

    New and modified files are saved first; then, with ``cleanup_deleted``, the
    rows whose own path is gone are dropped, so the row of a renamed file
    stays.  A modified file retires the row of its former content at the same
    path, unless ``keep_superseded``.  What lies in a folder, or behind a file,
    that could not be read is not deleted.  ``errors`` holds ``max_errors``
    messages at most, ``error_count`` counts all, ``library.errors`` has all.
    ``fingerprint`` is ``size`` or ``size+mtime``.  ``source``, ``extractor``,
    ``hashes`` and ``analyzer`` replace the own listing, decoding, hashing and
    change analysis.

    The listing, the states and the decoded files are written in the library's
    folder, so what is counted is what is done, whatever executors are lost.
    The library's side of the join is read in its buckets of the path, so only
    the listing is shuffled.
    """
    began = time.monotonic()
    try:
        listing = source(spark, folder, suffixes)
        scanned = library.scratch(listing.drop("content"))
        unread = scanned.where("error is not null")
        errors, n_errors = [r[0] for r in unread.select("error").limit(max_errors).collect()], unread.count()
        if n_errors:
            library.record_errors(unread.select(F.col("original_path").alias("path"), F.lit(None).cast("string").alias("state"), "error", F.lit("OSError").alias("error_type")))
        files = numbered(scanned.where("error is null"), keep=library.scratch)
        db = library.paths().withColumnRenamed("doc_id", "ord")
        if scope_to_path:
            db = db.where(F.startswith("norm_path", F.lit(folder.rstrip("/") + "/")))
        if n_errors:
            hidden = diff.below(db.select("norm_path").distinct(), "norm_path", unread, "original_path")
            db = db.join(hidden, "norm_path", "left_anti")
        more = {} if fingerprint == "size" else {"fingerprint": fingerprint}
        states = library.scratch(analyzer(library.dealt_by_path(files.withColumnRenamed("seq", "ord")), db, hashes, **more))
        plan = diff.planned(states, cleanup_deleted, reprocess_modified, index_new).first()
        result = SyncResult(plan.new_files, plan.modified_files, plan.deleted_entries, plan.unchanged_files, errors, n_errors)
        if not dry_run and plan.total_changes:
            _apply(states, files, library, result, cleanup_deleted, reprocess_modified, index_new, keep_superseded, added_at or datetime.datetime.now(), extractor, max_errors, ("labels",) if preserve_labels else ())
        result.duration_seconds = time.monotonic() - began
        return result
    finally:
        library.clear()


def _apply(states, files, library, result, cleanup_deleted, reprocess_modified, index_new, keep_superseded, added_at, extractor, max_errors, keep) -> None:
    wanted = [s for s, on in (("NEW", index_new), ("MODIFIED", reprocess_modified)) if on]
    todo = states.where(F.col("state").isin(*wanted)).select(F.col("file_path").alias("norm_path"), "state", "previous_hash")
    # files reached under several names are read once, by their resolved path, as rows name it
    paths = files.groupBy("norm_path").agg(F.max_by(F.struct("modified_time", "size_bytes", F.col("seq").alias("place")), "seq").alias("f")).select("norm_path", "f.*")
    work = todo.join(paths, "norm_path").withColumn("original_path", F.col("norm_path")).withColumn("filename", F.element_at(F.split("norm_path", "/"), -1)).withColumn("error", F.lit(None).cast("string"))
    decoded = library.scratch(extractor(dealt(work, keep=library.scratch).withColumn("seq", F.col("place"))))
    failed, good = decoded.where("decode_error is not null"), decoded.where("decode_error is null")
    lost = {r.state: r.n for r in stats.outcomes(failed).groupBy("state").agg(F.sum("n").alias("n")).collect()}
    if lost:
        # Fixed value: wording of a file that could not be decoded.
        vanished = F.col("error_type") == "FileNotFoundError"
        told = F.when(vanished, F.col("decode_error")).otherwise(F.format_string("extract error [%s]: %s: %s", "state", "norm_path", "decode_error"))
        messages = failed.select(F.col("norm_path").alias("path"), "state", told.alias("error"), "error_type")
        library.record_errors(messages)
        result.errors += [r[0] for r in messages.select("error").limit(max(0, max_errors - len(result.errors))).collect()]
    result.error_count += sum(lost.values())
    result.new_files -= lost.get("NEW", 0)
    result.modified_files -= lost.get("MODIFIED", 0)
    retired = None if keep_superseded else good.where("state = 'MODIFIED'").select("norm_path", F.col("previous_hash").alias("file_hash")).distinct()
    gone = states.where("state = 'DELETED'").select(F.col("file_path").alias("norm_path")) if cleanup_deleted else None
    library.change(library_rows(good, added_at), retired, gone, keep=keep)

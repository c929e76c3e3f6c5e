"""Change analysis: what is new, modified, unchanged or deleted on disk."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.schemas import STATES


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last by ``order``."""
    rest = [c for c in rows.columns if c != key]
    kept = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return kept.select(key, "_r.*").select(*rows.columns)


def file_states(disk: DataFrame, db: DataFrame, hashes: Callable[[DataFrame], DataFrame] | DataFrame, fingerprint: str = "size") -> DataFrame:
    """States of all paths.

    ``disk``: norm_path, size_bytes, modified_time, ord.  ``db``: norm_path,
    size_bytes, file_hash, ord.  ``hashes``: a table (norm_path, current_hash,
    hash_error), or a function that adds these two columns to the rows that
    need a hash.  Only rows that are new or of another size are hashed: equal
    sizes count as unchanged.  With the ``fingerprint`` ``size+mtime``, ``db``
    has modified_time too, and files of another time are hashed as well; a row
    whose time is not known counts by its size.  A known file that cannot be
    hashed is left out.
    Rows that need no hash and those that do part after one join and meet in a
    union; both sides read the same shuffle.
    """
    if fingerprint not in ("size", "size+mtime"):
        raise ValueError(f"no fingerprint {fingerprint}")
    timed = fingerprint == "size+mtime"
    d = last_by(disk.select("norm_path", "size_bytes", "modified_time", "ord"), "norm_path", "ord").drop("ord")
    b = last_by(db.select("norm_path", F.col("size_bytes").alias("db_size"), F.col("file_hash").alias("db_hash"), *([F.col("modified_time").alias("db_time")] if timed else []), "ord"), "norm_path", "ord").drop("ord")
    joined = d.withColumn("on_disk", F.lit(True)).join(b.withColumn("in_db", F.lit(True)), "norm_path", "full")
    disk_only, db_only = F.col("in_db").isNull(), F.col("on_disk").isNull()
    same_size = F.coalesce(F.col("size_bytes") == F.col("db_size"), F.lit(False))
    if timed:
        same_size &= F.coalesce(F.col("modified_time") == F.col("db_time"), F.lit(True))
    asks = ~db_only & (disk_only | ~same_size)
    needed, none = joined.where(asks), F.lit(None).cast("string")
    found = hashes(needed) if callable(hashes) else needed.join(hashes.select("norm_path", "current_hash", "hash_error"), "norm_path", "left")
    full = joined.where(~asks).withColumns({"current_hash": none, "hash_error": none}).unionByName(found.select(*joined.columns, "current_hash", "hash_error"))
    state = F.when(db_only, "DELETED").when(disk_only, "NEW").when(same_size | (F.col("current_hash") == F.col("db_hash")), "UNCHANGED").otherwise("MODIFIED")
    known = F.when(db_only | (~disk_only & same_size), F.col("db_hash")).otherwise(F.col("current_hash"))
    unreadable = ~disk_only & ~db_only & ~same_size & F.col("current_hash").isNull()
    states = full.where(~F.coalesce(unreadable, F.lit(False))).withColumn("state", state).withColumn("file_hash", known)
    return states.select(
        F.col("norm_path").alias("file_path"), "state", "file_hash", F.when(~db_only, F.col("size_bytes")).alias("size_bytes"), F.col("modified_time").alias("last_modified"),
        F.when(F.col("state") == "MODIFIED", F.col("db_hash")).alias("previous_hash"),
    )


def below(rows: DataFrame, column: str, folders: DataFrame, folder: str) -> DataFrame:
    """``rows`` whose path in ``column`` is one of ``folders[folder]``, or lies below one."""
    parts = F.split(column, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hit = rows.select(column, F.explode(above).alias("_above")).join(folders.select(F.col(folder).alias("_above")).distinct(), "_above", "left_semi")
    return rows.join(hit.select(column).distinct(), column, "left_semi")


def state_counts(states: DataFrame) -> DataFrame:
    """One row (state, n) for each of the four states, zeros included."""
    one = states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("n")) for s in STATES])).alias("x")).select("x.*")


def planned_by_flags(states: DataFrame) -> DataFrame:
    """``planned`` for each setting of the three flags; the states are counted once."""
    counts = states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])
    names = ("cleanup_deleted", "reprocess_modified", "index_new")
    settings = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(names, flags))) for flags in itertools.product((False, True), repeat=3)))
    each = counts.select(*STATES, F.explode(settings).alias("_s")).select(*STATES, "_s.*")
    gated = lambda s, flag: F.when(F.col(flag), F.col(s)).otherwise(F.lit(0)).cast("long")
    out = each.select(*names, gated("NEW", "index_new").alias("new_files"), gated("MODIFIED", "reprocess_modified").alias("modified_files"), gated("DELETED", "cleanup_deleted").alias("deleted_entries"), F.col("UNCHANGED").alias("unchanged_files"))
    return out.withColumn("total_changes", F.col("new_files") + F.col("modified_files") + F.col("deleted_entries"))


def planned(states: DataFrame, cleanup_deleted: bool = False, reprocess_modified: bool = True, index_new: bool = True) -> DataFrame:
    """One row: what a sync with these flags would do."""
    gate = {"new_files": ("NEW", index_new), "modified_files": ("MODIFIED", reprocess_modified), "deleted_entries": ("DELETED", cleanup_deleted), "unchanged_files": ("UNCHANGED", True)}
    one = states.agg(*[(F.count_if(F.col("state") == s) if on else F.lit(0).cast("long")).alias(name) for name, (s, on) in gate.items()])
    return one.withColumn("total_changes", F.col("new_files") + F.col("modified_files") + F.col("deleted_entries"))

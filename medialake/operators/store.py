"""Keyed operations on a library table, as DataFrame transformations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str = "file_hash", order: str = "seq", ordinal: str = "doc_id", top: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new``: the last row of a key wins whole, the key's first ordinal stays.

    ``new`` has the columns of ``old`` but ``ordinal``, and ``order``.  New keys
    are numbered after the greatest ordinal (``top``, if ``old`` is only a part
    of the table), by their first ``order``.  Columns ``keep`` keep the value
    that a known key has.
    """
    body = [c for c in old.columns if c not in (key, ordinal)]
    # maps cannot be compared, so the row travels beside its order
    last = new.groupBy(key).agg(F.max_by(F.struct(*body), order).alias("_r"), F.min(order).alias("_first"))
    start = old.agg(F.coalesce(F.max(ordinal), F.lit(-1)).alias("_top")).first()[0] if top is None else top
    known = old.select(key, F.struct(F.col(ordinal).alias("_ordinal"), *keep).alias("_known"))
    placed = last.join(known, key, "left")
    own = lambda c: F.when(F.col("_known").isNotNull(), F.col(f"_known.{c}")).otherwise(F.col(f"_r.{c}")) if c in keep else F.col(f"_r.{c}")
    merged = placed.select(key, F.coalesce("_known._ordinal", F.col("_first") + start + 1).alias(ordinal), *[own(c).alias(c) for c in body])
    return old.join(last.select(key), key, "left_anti").select(*old.columns).unionByName(merged.select(*old.columns))


def without(rows: DataFrame, keys: DataFrame, column: str, key: str) -> DataFrame:
    """``rows`` whose ``column`` is not among ``keys[key]`` (rows with a null stay)."""
    gone = keys.select(F.col(key).alias("_gone")).distinct()
    return rows.join(gone, F.col(column) == F.col("_gone"), "left_anti")


def with_paths(rows: DataFrame, paths: DataFrame, column: str = "file_info.path") -> DataFrame:
    """``rows`` at the exact paths of ``paths.path``; each row once."""
    wanted = paths.select(F.col("path").alias("_wanted")).distinct()
    return rows.join(wanted, F.col(column) == F.col("_wanted"), "left_semi")


def first_where(rows: DataFrame, column: str, value: str, order: str = "doc_id") -> DataFrame:
    """The first row by ``order`` whose ``column`` equals ``value``; none if there is none."""
    return rows.where(F.col(column) == F.lit(value)).orderBy(order).limit(1)


def unique_contents(files: DataFrame, order: str = "seq") -> DataFrame:
    """(file_hash, path, copies): one row a content, with the path that came last."""
    return files.groupBy("file_hash").agg(F.max_by("path", order).alias("path"), F.count("*").alias("copies"))

"""Places of rows in an order, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from medialake.llm.common import materialise


def part(at: str = "_at") -> Column:
    """The range that wrote a row, from what ``monotonically_increasing_id`` gave it."""
    return F.shiftright(at, 33)


def range_sorted(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """``rows`` dealt to ranges of ``keys``, sorted there and written, with ``_at``, which ascends with them.

    Rows that are equal in all keys must be alike for the caller, as their order
    is arbitrary; a row number behind the keys lets a range end among them.
    """
    told = rows.withColumn("_copy", F.monotonically_increasing_id())
    ranged = told.repartitionByRange(*keys, "_copy").sortWithinPartitions(*keys, "_copy").drop("_copy")
    return materialise(ranged.withColumn("_at", F.monotonically_increasing_id()))


def numbered(rows: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with ``_i``, the place in the group by ``order`` (from 0), and ``_n``, the group's rows.

    A group is cut wherever a range ends, so one that holds most rows is sorted
    by many tasks.  What is counted of each range, a row for each group in it,
    is joined by range and group; Spark broadcasts it only while its written
    size is small.
    """
    placed = range_sorted(rows, [*map(F.col, groups), *order])
    runs = placed.groupBy(part().alias("_part"), *groups).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    group = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_rows").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = materialise(runs.select("_part", *(F.col(g).alias(f"_run_{g}") for g in groups), "_first", before.alias("_before"), F.sum("_rows").over(group).alias("_n")))
    same = part() == F.col("_part")
    for g in groups:
        same &= placed[g].eqNullSafe(F.col(f"_run_{g}"))
    return placed.join(runs, same).select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("_i"), "_n")

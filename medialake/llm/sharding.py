"""Shards of near equal size by sampled splitters (DataFrame functions only).

Records are ordered by (hash of the text, hash of id and row number), so copies
of a text lie side by side and a group of copies, equal rows included, can
still be cut anywhere.
1. One pass writes the records with these keys and each record's size; the row
   numbers are part of what is written, so every later read sees the same ones.
2. A size-weighted sample of the keys gives quantile splitters for many ranges.
3. Exact bytes and rows are summed by range; ranges that hold more than twice
   their share are sampled again and subdivided, until none is left.
4. The few ranges in which a shard must end are read in order, which gives the
   exact key at which it ends; these keys become splitters too.
5. Each range now lies in one shard, and its first slot is known, so one window
   per range numbers the records.
No step needs all rows of a shard in one task.  A range holds about
``range_bytes``, or a 65,536th (``max_ranges``) of all bytes where that is more
(1.5 GB at 100 TB, of which only keys are sorted before the last step);
splitters and range sums on the driver are bounded by ``max_ranges``.

Law: ``bytes``.  A shard differs from the mean by about one record.

Defined cases: a null text has size 1 and the checksum of an empty one; rows
that repeat id and text, or have no id, are told apart by their row number and
spread like others, in arbitrary order; with fewer records than shards some
shards are empty; an empty table gives an empty result; other columns are kept
whatever their names, but those named like the new ones give way.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from medialake.llm.common import materialise

_CELL_BITS = 48  # of 60 bits of the hash: the first 12 bits find the few ranges to compare
Key = tuple[int, int]
_LEAST: Key = (-1, -1)
_MOST: Key = (1 << 60, 0)


def _hash60(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (all columns), _h, _t, size, text_crc32; to be written before use, as ``_t`` holds a row number."""
    text = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    own = F.concat_ws("\x00", F.monotonically_increasing_id().cast("string"), docs[id_col].cast("string"))
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), _hash60(text).alias("_h"), _hash60(own.cast("binary")).alias("_t"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))


def _uniform() -> Column:
    return F.pmod(F.xxhash64("_h", "_t", F.lit(99)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _range_tables(spark: SparkSession, cuts: list[Key], only=None, extra: list[tuple] | None = None, names: str = "") -> tuple[DataFrame, DataFrame]:
    """(wide, deep): rows of ranges [cut, next cut), or of those in ``only``; the first starts below all keys.

    A range within one text hash is deep and found by that hash and a cell of
    the second part; the others are wide and found by a cell of the first, so
    the many ranges of a hot text meet only its own records.
    """
    bounds = [_LEAST, *cuts, _MOST]
    wide, deep = [], []
    for r, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        if only is not None and r not in only:
            continue
        more = (r, *(extra[r] if extra else ()))
        if lo[0] == hi[0]:
            deep += [(lo[0], cell, lo[1], hi[1], *more) for cell in range(max(0, lo[1] >> _CELL_BITS), min(4095, hi[1] >> _CELL_BITS) + 1)]
        else:
            wide += [(cell, *lo, *hi, *more) for cell in range(max(0, lo[0] >> _CELL_BITS), min(4095, hi[0] >> _CELL_BITS) + 1)]
    of = lambda rows, columns: spark.createDataFrame(rows, f"{columns}, _range int{names}")
    return of(wide, "_cell long, _lo_h long, _lo_t long, _hi_h long, _hi_t long"), of(deep, "_at long, _deep_cell long, _from long, _to long")


def _in_ranges(keyed: DataFrame, ranges: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``keyed`` with the columns of its range; both range tables are bounded by ``max_ranges``."""
    wide, deep = ranges
    own = [c for c in wide.columns if c not in ("_cell", "_lo_h", "_lo_t", "_hi_h", "_hi_t")]
    h, t = F.col("_h"), F.col("_t")
    inner = deep.select("_at", "_deep_cell", "_from", "_to", F.struct(*own).alias("_inner"))
    outer = wide.select("_cell", "_lo_h", "_lo_t", "_hi_h", "_hi_t", F.struct(*own).alias("_outer"))
    first = keyed.join(F.broadcast(inner), (h == F.col("_at")) & (F.shiftrightunsigned("_t", _CELL_BITS) == F.col("_deep_cell")) & (t >= F.col("_from")) & (t < F.col("_to")), "left")
    above = (h > F.col("_lo_h")) | ((h == F.col("_lo_h")) & (t >= F.col("_lo_t")))
    below = (h < F.col("_hi_h")) | ((h == F.col("_hi_h")) & (t < F.col("_hi_t")))
    both = first.join(F.broadcast(outer), (F.shiftrightunsigned("_h", _CELL_BITS) == F.col("_cell")) & above & below, "left")
    found = F.coalesce("_inner", "_outer")
    return both.where(found.isNotNull()).select(*keyed.columns, *(found[c].alias(c) for c in own))


def _quantiles(sample: list[Key], pieces: int) -> list[Key]:
    sample = sorted(sample)
    return [sample[len(sample) * i // pieces] for i in range(1, pieces)] if sample else []


def _stats(keys: DataFrame, cuts: list[Key]) -> list[tuple[int, int]]:
    """(rows, bytes) of each range."""
    found = {r[0]: (r[1], r[2]) for r in _in_ranges(keys, _range_tables(keys.sparkSession, cuts)).groupBy("_range").agg(F.count("*"), F.sum("size")).collect()}
    return [found.get(i, (0, 0)) for i in range(len(cuts) + 1)]


def splitters(keys: DataFrame, total: int, pieces: int, oversample: int = 32) -> list[Key]:
    """Cut keys for about ``pieces`` ranges of equal bytes, none with two records or more and over twice that."""
    rate = oversample * pieces / total
    cuts = sorted(set(_quantiles([tuple(r) for r in keys.where(_uniform() < F.col("size") * rate).select("_h", "_t").collect()], pieces)))
    while True:
        stats = _stats(keys, cuts)
        over = {r: -(-b * pieces // total) for r, (n, b) in enumerate(stats) if n > 1 and b * pieces > 2 * total}
        if not over:
            return cuts
        inside = _in_ranges(keys, _range_tables(keys.sparkSession, cuts, over))
        rate *= 4  # a cut is missed only where no record was drawn; at last all are
        sample: dict[int, list[Key]] = {}
        for h, t, r in inside.where(_uniform() < F.col("size") * rate).select("_h", "_t", "_range").collect():
            sample.setdefault(r, []).append((h, t))
        more = sorted(set(cuts).union(*(_quantiles(s, over[r]) for r, s in sample.items())))
        if more == cuts and rate >= 1:
            return cuts  # what is left are single records as large as a range, beside small ones
        cuts = more


def _shard_ends(keys: DataFrame, cuts: list[Key], total: int, shards: int) -> list[Key | None]:
    """The key at which each shard but the first starts; None where no record is left."""
    stats = _stats(keys, cuts)
    before = [0]
    for _, b in stats:
        before.append(before[-1] + b)
    wanted: dict[int, list[tuple[int, int]]] = {}
    for k in range(1, shards):
        goal = total * k // shards
        wanted.setdefault(min(len(stats) - 1, bisect.bisect_right(before, goal) - 1), []).append((k, goal))
    spark = keys.sparkSession
    ranges = _range_tables(spark, cuts, wanted)
    goals = spark.createDataFrame([(r, k, goal - before[r]) for r, x in wanted.items() for k, goal in x], "_range int, k int, goal long")
    inside = _in_ranges(keys, ranges)
    order = Window.partitionBy("_range").orderBy("_h", "_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = inside.withColumn("_sum", F.sum("size").over(order))
    # a record starts the shard if the larger part of it lies beyond the goal
    found = placed.join(F.broadcast(goals), "_range").where("2 * _sum - size >= 2 * goal").groupBy("k").agg(F.min(F.struct("_h", "_t")).alias("x"))
    ends: list[Key | None] = [None] * (shards - 1)
    for k, x in found.collect():
        ends[k - 1] = tuple(x)
    for r, x in wanted.items():
        for k, _ in x:
            if ends[k - 1] is None and r < len(cuts):  # the next range starts it
                ends[k - 1] = cuts[r]
    return ends


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 16 << 20, max_ranges: int = 65_536) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard (0 to shards - 1) and slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    plain = docs.drop("size", "text_crc32", "law", "shard", "slot")
    keyed = materialise(with_keys(plain, id_col, text_col))
    keys = keyed.select("_h", "_t", "size")
    total = keys.agg(F.sum("size")).first()[0] or 0
    cuts: list[Key] = []
    ends: list[Key | None] = [None] * (shards - 1)
    if total:
        cuts = splitters(keys, total, min(max_ranges, max(16 * shards, -(-total // range_bytes))))
        ends = _shard_ends(keys, cuts, total, shards)
        cuts = sorted({*cuts, *(e for e in ends if e)})
    starts = sorted(e for e in ends if e)
    seen, extra, last = 0, [], 0
    for (rows, _), lo in zip(_stats(keys, cuts), [_LEAST, *cuts]):
        number = bisect.bisect_right(starts, lo)
        seen, last = (seen if number == last else 0), number
        extra.append((number, seen))
        seen += rows
    ranges = _range_tables(spark, cuts, None, extra, ", shard int, _first long")
    within = Window.partitionBy("_range").orderBy("_h", "_t")
    placed = _in_ranges(keyed, ranges).withColumn("slot", F.col("_first") + F.row_number().over(within) - 1)
    return placed.select("row.*", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot")

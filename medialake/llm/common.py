"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_WRITTEN: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (tests) may leave it unset: a temporary folder is set
    then.  On a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="medialake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, so that a lost executor never makes an earlier step run
    again, and later readers do not repeat the work.  Shuffle files of the write
    go with it, as nothing needs them any more; ``release`` removes the tables
    once nothing reads them.  ``compression`` is that of Spark's session unless given.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/medialake-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """Number of tables that ``materialise`` has written and ``release`` not removed."""
    return len(_WRITTEN)


def release(spark: SparkSession, oldest: int = 0, newest: int = 0) -> int:
    """Delete the tables ``materialise`` has written, but for the ``oldest`` and the ``newest``; how many went.

    Call it only when every DataFrame built on them has been written or read.
    """
    end = len(_WRITTEN) - newest
    gone = _WRITTEN[oldest:end]
    del _WRITTEN[oldest:end]
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(gone)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(-1))


def decoded(text: bytes | None) -> str | None:
    """Text of UTF-8 bytes; what is not UTF-8 becomes U+FFFD."""
    return None if text is None else text.decode("utf-8", "replace")


def join_spread(rows: DataFrame, other: DataFrame, key: str, weight: str, total: int, parts: int = 64) -> DataFrame:
    """``rows`` joined with ``other``, which has one row a key, without a task that gets a whole hot key.

    ``weight`` is the number of rows of each key.  Keys with more than one in
    ``parts`` of the ``total`` rows, of which there are fewer than ``parts``,
    are broadcast; the others are shuffled.
    """
    hot = F.broadcast(other.where(F.col(weight) * parts > total))
    cold = other.where(F.col(weight) * parts <= total)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def lowest(rows: DataFrame, class_col: str, draw_col: str, per_class: int, max_rows: int) -> DataFrame:
    """Of each class the ``per_class`` rows with the least draws and some more, about twice as many, however many rows and tasks there are.

    Rows are counted by class and by the number of leading zeros of their draw
    (64 counts a class, summed within tasks first); a class keeps the rows from
    the number on that still leaves it ``per_class``.  These bounds are
    broadcast for at most ``max_rows`` classes, the largest; a class beyond
    them has fewer than one in ``max_rows`` of all rows and keeps its own.
    """
    zeros = 64 - F.length(F.bin(F.col(draw_col).bitwiseXOR(F.lit(-(1 << 63)))))
    counted = rows.select(F.col(class_col).alias("_of"), zeros.alias("_zeros")).groupBy("_of", "_zeros").count()
    left = F.sum("count").over(Window.partitionBy("_of").orderBy(F.desc("_zeros")))
    bounds = counted.withColumn("_left", left).where(F.col("_left") >= per_class).groupBy("_of").agg(F.max("_zeros").alias("_from"))
    bounds = bounds.where(F.col("_from") > 0).orderBy(F.desc("_from"), "_of").limit(max_rows)
    return rows.join(F.broadcast(bounds), F.col(class_col) == F.col("_of"), "left").where(zeros >= F.coalesce("_from", F.lit(0))).select(*rows.columns)


def bounded_sample(docs: DataFrame, id_col: str, class_col: str | None, per_class: int, max_chars: int, text_col: str, labels: DataFrame | None = None, max_rows: int = 10_000) -> list:
    """At most ``per_class`` whole rows of each class, and ``max_rows`` in all, picked by a hash of the id.

    The class is a column of ``docs``, or of ``labels`` (id and class); with
    None all rows are one class, of which each task keeps its own first.  Slim
    keys are ranked first, of which ``lowest`` leaves few; the texts of those
    picked are fetched by another scan.  Rows longer than ``max_chars`` are passed over, so that the driver
    holds ``max_rows * max_chars`` characters at most.  Beyond ``max_rows``
    every class keeps its first rows before any keeps one more.
    """
    keyed = docs.where(F.length(text_col) <= max_chars).withColumns({"_hash": F.xxhash64(text_col), "_draw": F.xxhash64(F.col(id_col), F.lit(17))})
    if class_col is None:
        class_col, slim = "_all", keyed.select(id_col, "_hash", "_draw").orderBy("_draw", "_hash").limit(per_class).withColumn("_all", F.lit("all"))
    else:
        slim = keyed.select(id_col, "_hash", "_draw", *([] if labels is not None else [class_col]))
    if labels is not None:
        slim = slim.join(labels.select(id_col, class_col), id_col)
    slim = slim.where(F.col(class_col).isNotNull())
    if class_col != "_all":
        slim = lowest(slim, class_col, "_draw", per_class, max_rows)
    order = Window.partitionBy(class_col).orderBy("_draw", "_hash")
    first = slim.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_class)
    picks = first.orderBy("_n", "_draw", "_hash", class_col).limit(max_rows).select(F.col(id_col).alias("_id"), F.col("_hash").alias("_h"), F.col(class_col).alias("_class")).distinct()
    texts = keyed.select(F.col(id_col), F.col(text_col).cast("binary").alias("_bytes"), "_hash", "_draw")
    found = texts.join(F.broadcast(picks), (F.col("_hash") == F.col("_h")) & F.col(id_col).eqNullSafe(F.col("_id")))
    rows = found.dropDuplicates(["_id", "_h", "_class"]).select(F.col(id_col), F.col("_bytes").alias(text_col), F.col("_class").alias(class_col), "_draw", "_h").collect()
    return sorted(((decoded(bytes(r[1])), r[2]) for r in sorted(rows, key=lambda r: (r["_draw"], r["_h"]))), key=lambda r: str(r[1]))


def summed(rows: DataFrame, part, size: int, tasks: int = 4) -> np.ndarray:
    """Sum over all rows of ``part(batch)``, ``size`` whole numbers: in tasks first, then in a few, then here."""

    def add(batches, of):
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            total += of(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def together(parts):
        return sum((np.frombuffer(x, np.int64) for x in parts), np.zeros(size, dtype=np.int64))

    each = rows.mapInArrow(lambda batches: add(batches, part), "sums binary")
    few = each.repartition(tasks).mapInArrow(lambda batches: add(batches, lambda b: together(b.column(0).to_pylist())), "sums binary")
    return together(bytes(r.sums) for r in few.collect())


def filter_by_text(docs: DataFrame, text_col: str, prepare) -> DataFrame:
    """The rows for which ``prepare()``, called once a task, says true of their text (bytes or None).

    Strings travel as bytes, as Arrow takes none that is not UTF-8.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        judge = prepare()
        for b in batches:
            yield b.filter(pa.array(judge(b.column(at).to_pylist()), pa.bool_()))

    def carried(f):
        return docs[f.name].cast("binary").alias(f.name) if f.dataType.typeName() == "string" else docs[f.name]

    packed = docs.select(*map(carried, docs.schema.fields))
    kept = packed.mapInArrow(run, packed.schema)
    return kept.select(*(kept[f.name].cast(f.dataType).alias(f.name) for f in docs.schema.fields))

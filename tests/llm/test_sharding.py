import zlib

from pyspark.sql import functions as F

from medialake.llm import sharding
from tests.llm.cases import awkward, empty


def check(rows, shards, n):
    assert len(rows) == n
    slots, sizes = {}, [0] * shards
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r.size
        assert r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode()) and r.law == "bytes"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max((r.size for r in rows), default=0)
    assert all(abs(s - sum(sizes) / shards) <= largest + 1 for s in sizes)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(sharding.shard(docs).collect(), 8, 1000)
    check(sharding.shard(docs, 3, range_bytes=20_000).collect(), 3, 1000)


def test_one_text_is_a_third_of_all_rows(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the hot text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    rows = sharding.shard(docs, 4, range_bytes=300).collect()
    check(rows, 4, 900)
    assert len({r.shard for r in rows if r.text == "the hot text"}) >= 2


def test_overfull_ranges_are_subdivided(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    keys = sharding.materialise(sharding.with_keys(docs, "doc_id", "text")).select("_h", "_t", "size")
    cuts = sharding.splitters(keys, 4000, 50)
    assert max(b for _, b in sharding._stats(keys, cuts)) <= 2 * 4000 / 50 + 2


def test_repeated_rows_are_spread(spark):
    equal = spark.range(800).selectExpr("7L as doc_id", "'the same row' as text")
    none = spark.range(800).selectExpr("cast(null as long) as doc_id", "'' as text")
    both = equal.unionByName(none)
    for docs, n in ((equal, 800), (none, 800), (both, 1600)):
        for kw in ({}, {"range_bytes": 100}):
            rows = sharding.shard(docs, 8, **kw).collect()
            check(rows, 8, n)
            held = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
            assert max(held) - min(held) <= 2 * max(r.size for r in rows)


def test_shards_by_brute_force(spark):
    """The cuts of the written order at the multiples of the mean, as plain running sums find them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    keyed = sharding.materialise(sharding.with_keys(docs, "doc_id", "text"))
    rows = sorted((r._h, r._t, r.size) for r in keyed.collect())
    total, done, want = sum(r[2] for r in rows), 0, []
    for h, t, size in rows:
        want.append(sum(2 * (done + size) - size >= 2 * (total * k // 5) for k in range(1, 5)))
        done += size
    keys = keyed.select("_h", "_t", "size")
    for pieces in (1, 7, 60):
        cuts = sharding.splitters(keys, total, pieces)
        ends = sharding._shard_ends(keys, cuts, total, 5)
        assert [sum((h, t) >= e for e in ends if e) for h, t, _ in rows] == want


def test_columns_of_any_name(spark):
    docs = spark.range(50).selectExpr("id as doc_id", "concat('t', id) as text", "1 as _h", "2 as _range", "3 as row", "4 as slot", "5 as _first")
    out = sharding.shard(docs, 3)
    assert out.columns == ["doc_id", "text", "_h", "_range", "row", "_first", "size", "text_crc32", "law", "shard", "slot"]
    assert {(r._h, r._range, r.row, r._first) for r in out.collect()} == {(1, 2, 3, 5)}


def test_cases(spark):
    rows = sharding.shard(awkward(spark), 4).collect()
    assert len(rows) == 11 and {r.shard for r in rows} <= set(range(4))
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard(awkward(spark), 4).columns.count("shard") == 1
    assert sharding.shard(empty(spark)).count() == 0

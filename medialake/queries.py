"""Queries over the test tables for the media operators, and their SQL.

The tables hold no photos, so the operators run over views derived from them:
``files`` (documents as files with suffixes), ``prev_index`` (an older state of
them), cameras from ``part``, times from ``orders``, places from ``customer``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from medialake.functions import camera, cells, exif, paths
from medialake.operators import diff, search, stats, store
from medialake.plans.library import Library
from medialake.schemas import EXIF

SUFFIXES = [".jpg", ".JPEG", ".png", ".txt", ".heic", ".raw", "", ".NEF"]
MAKES = ["Canon", "NIKON", "Sony", "Apple", " samsung ", "GoPro", "Epson", "Leica", "", "DJI"]
MODELS = ["EOS 5D", "EOS R5", "Z8", "Film Scanner", "A7 IV", "X100"]


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def files(spark, sf_dir):
    """seq, path, filename, size_bytes, file_hash of documents taken as files."""
    d = _t(spark, sf_dir, "documents")
    content = F.encode("text", "UTF-8")
    name = F.concat(F.col("doc_id").cast("string"), _pick(SUFFIXES, F.col("doc_id")))
    return d.select(F.col("doc_id").alias("seq"), F.concat(F.lit("/lib/"), "source", F.lit("/"), name).alias("path"), name.alias("filename"), F.octet_length(content).cast("long").alias("size_bytes"), F.sha2(content, 256).alias("file_hash"))


def prev_index(spark, sf_dir):
    f = files(spark, sf_dir).where("seq % 10 <> 0")
    k = F.col("seq") % 10
    other = F.sha2(F.concat(F.col("file_hash"), F.lit("old")), 256)
    return f.select("seq", F.when(k == 1, F.concat(F.lit("/gone"), "path")).otherwise(F.col("path")).alias("path"), (F.col("size_bytes") + F.when(k.isin(2, 3), 1).otherwise(0)).alias("size_bytes"), F.when(k.isin(2, 4), other).otherwise(F.col("file_hash")).alias("file_hash"))


FILES_SQL = """
files AS (SELECT doc_id AS seq, '/lib/' || source || '/' || doc_id || (['.jpg', '.JPEG', '.png', '.txt', '.heic', '.raw', '', '.NEF'])[doc_id % 8 + 1] AS path,
  doc_id || (['.jpg', '.JPEG', '.png', '.txt', '.heic', '.raw', '', '.NEF'])[doc_id % 8 + 1] AS filename, octet_length(encode(text))::BIGINT AS size_bytes, sha256(text) AS file_hash FROM documents),
prev_index AS (SELECT seq, CASE WHEN seq % 10 = 1 THEN '/gone' || path ELSE path END AS path, size_bytes + CASE WHEN seq % 10 IN (2, 3) THEN 1 ELSE 0 END AS size_bytes,
  CASE WHEN seq % 10 IN (2, 4) THEN sha256(file_hash || 'old') ELSE file_hash END AS file_hash FROM files WHERE seq % 10 <> 0)"""
STATES_SQL = f"""{FILES_SQL},
states AS (SELECT coalesce(f.path, p.path) AS file_path,
  CASE WHEN f.path IS NULL THEN 'DELETED' WHEN p.path IS NULL THEN 'NEW' WHEN f.size_bytes = p.size_bytes OR f.file_hash = p.file_hash THEN 'UNCHANGED' ELSE 'MODIFIED' END AS state,
  CASE WHEN f.path IS NULL OR f.size_bytes = p.size_bytes THEN p.file_hash ELSE f.file_hash END AS file_hash, f.size_bytes AS size_bytes,
  CASE WHEN f.size_bytes <> p.size_bytes AND f.file_hash <> p.file_hash THEN p.file_hash END AS previous_hash
  FROM files f FULL OUTER JOIN prev_index p ON f.path = p.path)"""


# --- scans, filters, hashes ---------------------------------------------------
def file_fingerprint(spark, sf_dir):
    return files(spark, sf_dir).select("seq", "path", "size_bytes", "file_hash")


def extension_filter(spark, sf_dir):
    return files(spark, sf_dir).where(paths.has_suffix(F.col("filename"), paths.IMAGE_SUFFIXES)).select("seq", "filename", paths.suffix(F.col("filename")).alias("suffix"))


def directory_markers(spark, sf_dir):
    keys = files(spark, sf_dir).select("seq", F.when(F.col("seq") % 9 == 0, F.concat("path", F.lit("/"))).otherwise(F.col("path")).alias("key"))
    return keys.where(~paths.is_directory_marker(F.col("key"))).select("seq", "key", paths.basename(F.col("key")).alias("name"))


def content_dedup(spark, sf_dir):
    return store.unique_contents(files(spark, sf_dir))


def mime_counts(spark, sf_dir):
    return stats.by_mime(files(spark, sf_dir).select(F.struct(paths.mime_type(F.col("filename")).alias("mime_type"), "size_bytes").alias("file_info")))


def ext_rollup(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("suffix", paths.suffix(F.col("filename")))
    return f.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.max("size_bytes").alias("largest"))


# --- change analysis ----------------------------------------------------------
def _states(spark, sf_dir):
    f = files(spark, sf_dir)
    disk = f.select(F.col("path").alias("norm_path"), "size_bytes", F.lit(None).cast("timestamp_ntz").alias("modified_time"), F.col("seq").alias("ord"))
    db = prev_index(spark, sf_dir).select(F.col("path").alias("norm_path"), "size_bytes", "file_hash", F.col("seq").alias("ord"))
    current = f.select(F.col("path").alias("norm_path"), F.col("file_hash").alias("current_hash"), F.lit(None).cast("string").alias("hash_error"))
    return diff.file_states(disk, db, lambda needed: needed.join(current, "norm_path"))


def sync_states(spark, sf_dir):
    return _states(spark, sf_dir).drop("last_modified")


def sync_counts(spark, sf_dir):
    return diff.state_counts(_states(spark, sf_dir))


def sync_plan_flags(spark, sf_dir):
    """What a dry run reports, one row for each setting of the three flags, from one count of the states."""
    return diff.planned_by_flags(_states(spark, sf_dir))


def orphaned_paths(spark, sf_dir):
    """Known paths that are no longer on disk (anti join)."""
    return prev_index(spark, sf_dir).join(files(spark, sf_dir).select("path"), "path", "left_anti").select("path", "file_hash")


# --- the store ------------------------------------------------------------------
def _old_rows(spark, sf_dir):
    rows = prev_index(spark, sf_dir).groupBy("file_hash").agg(F.min("seq").alias("doc_id"), F.max_by(F.struct("path", "size_bytes"), "seq").alias("r"))
    return rows.select("file_hash", "doc_id", "r.path", "r.size_bytes")


_OLD_SQL = "old AS (SELECT file_hash, min(seq) AS doc_id, arg_max(path, seq) AS path, arg_max(size_bytes, seq) AS size_bytes FROM prev_index GROUP BY file_hash)"


def upsert_snapshot(spark, sf_dir):
    return store.upsert(_old_rows(spark, sf_dir), files(spark, sf_dir).select("file_hash", "path", "size_bytes", "seq"))


def delete_by_hash(spark, sf_dir):
    gone = files(spark, sf_dir).where("size_bytes % 3 = 0").select("file_hash")
    return store.without(_old_rows(spark, sf_dir), gone, "file_hash", "file_hash")


def delete_by_path(spark, sf_dir):
    gone = files(spark, sf_dir).where("size_bytes % 3 = 1").select("path")
    return store.without(_old_rows(spark, sf_dir), gone, "path", "path")


def find_paths(spark, sf_dir):
    wanted = prev_index(spark, sf_dir).where("size_bytes % 5 = 2").select("path")
    return store.with_paths(files(spark, sf_dir), wanted, "path").select("seq", "path", "file_hash")


def lookup_hash(spark, sf_dir):
    """First file with the greatest content hash."""
    f = files(spark, sf_dir)
    return store.first_where(f, "file_hash", f.agg(F.max("file_hash")).first()[0], "seq").select("seq", "path", "file_hash")


def lookup_path(spark, sf_dir):
    return store.first_where(files(spark, sf_dir), "path", "/lib/src2/22.heic", "seq").unionByName(store.first_where(files(spark, sf_dir), "path", "/lib/src1/1.JPEG", "seq")).select("seq", "path", "file_hash")


def library_count(spark, sf_dir):
    return stats.total(_old_rows(spark, sf_dir))


# --- the library ------------------------------------------------------------------
def _new_library(spark):
    """An empty library in the folder that driver and executors share (a temporary one in local sessions without it)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="medialake-")
    return Library(spark, f"{shared.rstrip('/')}/library-{uuid.uuid4().hex}", buckets=4)


def _as_library(rows):
    """Library rows (with ``seq``) of (seq, path, size_bytes, file_hash)."""
    info = F.struct(paths.basename(F.col("path")).alias("name"), "path", "size_bytes", paths.mime_type(paths.basename(F.col("path"))).alias("mime_type"))
    blank = F.lit(None)
    return rows.select("file_hash", F.col("path").alias("norm_path"), info.alias("file_info"), F.struct(F.lit(0).alias("width"), F.lit(0).alias("height")).alias("dimensions"), blank.cast(EXIF).alias("exif"), F.array().cast("array<string>").alias("labels"), blank.cast("timestamp_ntz").alias("added_at"), "seq")


def _changed_library(spark, sf_dir):
    """The older state saved, the present one saved over it, and the rows of some paths dropped: three versions."""
    library, now = _new_library(spark), files(spark, sf_dir)
    library.save(_as_library(prev_index(spark, sf_dir)))
    library.save(_as_library(now.where("seq % 4 = 1")))
    library.change(gone=now.where("seq % 12 = 5").select(F.col("path").alias("norm_path")))
    library.clear()
    return library


def library_rows(spark, sf_dir):
    """Rows of a library after an upsert and deletions that rewrote the buckets concerned."""
    return _changed_library(spark, sf_dir).read().select("file_hash", "doc_id", "norm_path", "file_info.size_bytes")


def library_kinds(spark, sf_dir):
    """Counts of the same library from its manifest."""
    kinds = _changed_library(spark, sf_dir).stats().kinds
    return spark.createDataFrame([(k, n, b) for k, (n, b) in kinds.items()], "mime_type string, n long, bytes long")


def library_states(spark, sf_dir):
    """Change analysis of the present files against the same library's index of paths."""
    library, f = _changed_library(spark, sf_dir), files(spark, sf_dir)
    disk = f.select(F.col("path").alias("norm_path"), "size_bytes", F.lit(None).cast("timestamp_ntz").alias("modified_time"), F.col("seq").alias("ord"))
    current = f.select(F.col("path").alias("norm_path"), F.col("file_hash").alias("current_hash"), F.lit(None).cast("string").alias("hash_error"))
    states = diff.file_states(library.dealt_by_path(disk), library.paths().withColumnRenamed("doc_id", "ord"), lambda needed: needed.join(current, "norm_path"))
    return states.drop("last_modified")


def search_cells(spark, sf_dir):
    """Places around a point near the date line, found by intervals of cells."""
    lat, lon = F.col("exif.location.latitude"), F.col("exif.location.longitude")
    near = _photos(spark, sf_dir).withColumn("cell", cells.cell(lat, lon)).where(cells.among(F.col("cell"), cells.cover(-17.5, 178.5, 2500.0, most=8)))
    return search.search(near, location=(-17.5, 178.5, 2500.0)).select("c_custkey", "cell", F.round(search.distance_km(lat, lon, -17.5, 178.5), 6).alias("km"))


# --- photo fields -----------------------------------------------------------------
def camera_profile(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", _pick(MAKES, F.col("p_partkey")).alias("make"), _pick(MODELS, F.col("p_partkey")).alias("model"), (F.col("p_size") % 2 == 0).alias("has_lens"))
    return p.withColumn("profile", camera.camera_profile(F.col("make"), F.col("model"), F.col("has_lens")))


def _times(spark, sf_dir):
    k = F.col("o_orderkey")
    plain = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    d = F.when(k % 7 == 0, F.lit("invalid")).when(k % 5 == 0, F.date_format("o_orderdate", "yyyy:MM:dd HH: mm: ss")).otherwise(plain)
    return _t(spark, sf_dir, "orders").select(k, "o_orderdate", d.alias("d"))


_TIMES_SQL = "t AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 7 = 0 THEN 'invalid' WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y:%m:%d %H: %M: %S') ELSE strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') END AS d FROM orders)"


def exif_datetime(spark, sf_dir):
    return _times(spark, sf_dir).select("o_orderkey", exif.exif_datetime(F.col("d")).alias("captured_at"))


def captured_fallback(spark, sf_dir):
    """An invalid original goes straight to the file's time, not to the digitized one."""
    k = F.col("o_orderkey")
    t = _times(spark, sf_dir)
    original = F.when(k % 3 == 0, F.lit("  ")).when(k % 3 == 1, F.col("d"))
    return t.select(k, exif.captured_at(original, F.lit("2001:02:03 04:05:06"), F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("captured_at"))


def gps_decimal(spark, sf_dir):
    k = F.col("c_custkey")
    dms = lambda m: F.array((k % m).cast("double"), (k % 60).cast("double"), ((k % 6000) / 100.0).cast("double"))
    place = exif.gps(dms(95), F.when(k % 2 == 0, "S").when(k % 11 != 0, "N"), dms(185), F.when(k % 3 == 0, "W").otherwise("E"), F.array((k % 100).cast("double")))
    return _t(spark, sf_dir, "customer").select(k, place.alias("p")).select(k, "p.latitude", "p.longitude", "p.altitude", "p.datum")


def exposure_format(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", exif.exposure_text(F.col("value") / 4).alias("long_exposure"), exif.exposure_text(F.col("value") / 1000).alias("short_exposure"))


def focal_format(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", exif.focal_text(F.col("p_retailprice") / 10).alias("focal_length"))


def aspect_ratio(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", exif.aspect_ratio(F.col("p_size"), F.col("p_size") % 5).alias("ratio"))


def flash_flag(spark, sf_dir):
    kind = F.col("event_type")
    text = F.when(kind == "click", "Flash Fired").when(kind == "view", F.lit(None)).when(kind == "purchase", "Flash did not fire").otherwise("fired, auto")
    return _t(spark, sf_dir, "events").select("event_id", exif.flash_fired(text).alias("flash_fired"))


def raw_tag_filter(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    tags = F.create_map(F.lit("Image Make"), F.col("p_brand"), F.lit("EXIF LensModel"), F.col("p_type"), F.lit("EXIF FNumber"), F.col("p_size").cast("string"), F.lit("EXIF CustomTag"), F.col("p_name"))
    kept = F.array_sort(F.transform(F.map_entries(exif.raw_tags(tags)), lambda e: F.concat(e.key, F.lit("="), e.value)))
    return p.select("p_partkey", F.array_join(kept, "|").alias("raw_tags"))


# --- counts and search --------------------------------------------------------------
def error_counts(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("error_type"))
    return stats.by_error(e)


def index_stats(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", F.lit("OSError")).alias("error_type"), F.floor("value").cast("long").alias("size_bytes"))
    return stats.run_totals(e, 90.0)


def _photos(spark, sf_dir):
    k = F.col("c_custkey")
    place = F.struct(((k * 37) % 181 - 90).cast("double").alias("latitude"), ((k * 73) % 361 - 180).cast("double").alias("longitude"))
    rows = _t(spark, sf_dir, "customer").select(
        k, F.sha2(F.col("c_name"), 256).alias("file_hash"), F.array(F.lower("c_mktsegment"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("labels"),
        F.struct(F.timestamp_add("DAY", (k % 700).cast("int"), F.lit("2020-01-01 10:00:00").cast("timestamp_ntz")).alias("captured_at"), _pick(MODELS, k).alias("camera_model"), F.when(k % 7 != 0, place).alias("location")).alias("exif"),
    )
    return rows


_PHOTOS_SQL = "photos AS (SELECT c_custkey, sha256(c_name) AS file_hash, [lower(c_mktsegment), 'n' || c_nationkey] AS labels, TIMESTAMP '2020-01-01 10:00:00' + to_days((c_custkey % 700)::INT) AS captured_at, (['EOS 5D', 'EOS R5', 'Z8', 'Film Scanner', 'A7 IV', 'X100'])[c_custkey % 6 + 1] AS camera_model, CASE WHEN c_custkey % 7 <> 0 THEN ((c_custkey * 37) % 181 - 90)::DOUBLE END AS lat, CASE WHEN c_custkey % 7 <> 0 THEN ((c_custkey * 73) % 361 - 180)::DOUBLE END AS lon FROM customer)"


def search_radius(spark, sf_dir):
    p = _photos(spark, sf_dir)
    lat, lon = F.col("exif.location.latitude"), F.col("exif.location.longitude")
    hit = search.search(p, location=(48.5, 11.25, 6000.0))
    return hit.select("c_custkey", F.round(search.distance_km(lat, lon, 48.5, 11.25), 6).alias("km"))


def search_date_camera(spark, sf_dir):
    return search.search(_photos(spark, sf_dir), "2020-03-01", "2020-09-30", "eos").select("c_custkey", "exif.captured_at", "exif.camera_model")


def search_tags(spark, sf_dir):
    p = _photos(spark, sf_dir)
    some = search.search(p, tags=["building", "n3"]).select("c_custkey", F.lit("any").alias("match"))
    both = search.search(p, tags=["building", "n3"], match="all").select("c_custkey", F.lit("all").alias("match"))
    return some.unionByName(both)


_EXPOSURE_SQL = "CASE WHEN {v} = 0 THEN '0' WHEN {v} >= 1 THEN printf('%.1f', {v}) || '\"' WHEN abs(1 / ({v}) - round_even(1 / ({v}), 0)) < 0.01 THEN '1/' || round_even(1 / ({v}), 0)::BIGINT ELSE printf('%.4f', {v}) || 's' END"
_PROFILE_SQL = """CASE WHEN make IS NULL OR make = '' THEN 'unknown' WHEN upper(trim(make)) IN ('APPLE', 'SAMSUNG', 'XIAOMI', 'HUAWEI', 'GOOGLE', 'ONEPLUS', 'OPPO', 'VIVO') THEN 'mobile'
  WHEN upper(trim(make)) IN ('GOPRO', 'DJI', 'INSTA360') THEN 'action_cam' WHEN regexp_matches(upper(model), 'SCANNER|FILM') THEN 'film_scanner'
  WHEN regexp_matches(upper(model), 'EOS R|Z5|Z6|Z7|Z8|Z9|A7|A6|S5|S1|X-T|X-H') THEN 'mirrorless'
  WHEN upper(trim(make)) IN ('SONY', 'CANON', 'NIKON', 'PENTAX', 'FUJIFILM') THEN CASE WHEN has_lens THEN 'dslr' ELSE 'mirrorless' END ELSE 'unknown' END"""
_MIME_SQL = "CASE lower(regexp_extract(filename, '^.+(\\.[^.]+)$', 1)) WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png' WHEN '.heic' THEN 'image/heic' WHEN '.nef' THEN 'image/x-nikon-nef' WHEN '.txt' THEN 'text/plain' ELSE 'application/octet-stream' END"
_KM_SQL = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(lat - 48.5) / 2), 2) + cos(radians(lat)) * cos(radians(48.5)) * pow(sin(radians(lon - 11.25) / 2), 2))))"

_CHANGED_SQL = f"""{_OLD_SQL}, top AS (SELECT max(doc_id) AS t FROM old),
new AS (SELECT file_hash, arg_max(path, seq) AS path, arg_max(size_bytes, seq) AS size_bytes, min(seq) AS first FROM files WHERE seq % 4 = 1 GROUP BY file_hash),
merged AS (SELECT * FROM old WHERE file_hash NOT IN (SELECT file_hash FROM new) UNION ALL SELECT new.file_hash, coalesce(old.doc_id, new.first + 1 + t), new.path, new.size_bytes FROM new CROSS JOIN top LEFT JOIN old USING (file_hash)),
held AS (SELECT file_hash, doc_id, path, size_bytes FROM merged WHERE path NOT IN (SELECT path FROM files WHERE seq % 12 = 5))"""
_BITS_SQL = lambda v: " + ".join(f"((({v}) >> {i}) & 1) * {1 << (2 * i)}" for i in range(16))
_CELL_SQL = f"(2 * ({_BITS_SQL('y')}) + {_BITS_SQL('x')})::BIGINT"
_FIJI_SQL = _KM_SQL.replace("48.5", "-17.5").replace("11.25", "178.5").replace("lat - -17.5", "lat + 17.5")

ORACLE_SQL = {
    "library_rows": f"WITH {FILES_SQL}, {_CHANGED_SQL} SELECT file_hash, doc_id, path AS norm_path, size_bytes FROM held",
    "library_kinds": f"WITH {FILES_SQL}, {_CHANGED_SQL} SELECT {_MIME_SQL.replace('filename', 'path')} AS mime_type, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM held GROUP BY 1",
    "library_states": f"""WITH {FILES_SQL}, {_CHANGED_SQL}, known AS (SELECT path, arg_max(file_hash, doc_id) AS file_hash, arg_max(size_bytes, doc_id) AS size_bytes FROM held GROUP BY path)
SELECT coalesce(f.path, p.path) AS file_path, CASE WHEN f.path IS NULL THEN 'DELETED' WHEN p.path IS NULL THEN 'NEW' WHEN f.size_bytes = p.size_bytes OR f.file_hash = p.file_hash THEN 'UNCHANGED' ELSE 'MODIFIED' END AS state,
  CASE WHEN f.path IS NULL OR f.size_bytes = p.size_bytes THEN p.file_hash ELSE f.file_hash END AS file_hash, f.size_bytes AS size_bytes, CASE WHEN f.size_bytes <> p.size_bytes AND f.file_hash <> p.file_hash THEN p.file_hash END AS previous_hash
FROM files f FULL OUTER JOIN known p ON f.path = p.path""",
    "search_cells": f"WITH {_PHOTOS_SQL}, c AS (SELECT *, least(65535, floor((lat + 90) / 180 * 65536))::BIGINT AS y, least(65535, floor((lon + 180) / 360 * 65536))::BIGINT AS x FROM photos) SELECT c_custkey, {_CELL_SQL} AS cell, round({_FIJI_SQL}, 6) AS km FROM c WHERE {_FIJI_SQL} <= 2500",
    "file_fingerprint": f"WITH {FILES_SQL} SELECT seq, path, size_bytes, file_hash FROM files",
    "extension_filter": f"WITH {FILES_SQL} SELECT seq, filename, lower(regexp_extract(filename, '^.+(\\.[^.]+)$', 1)) AS suffix FROM files WHERE lower(regexp_extract(filename, '^.+(\\.[^.]+)$', 1)) IN {paths.IMAGE_SUFFIXES}",
    "directory_markers": f"WITH {FILES_SQL} SELECT seq, path AS key, filename AS name FROM files WHERE seq % 9 <> 0",
    "content_dedup": f"WITH {FILES_SQL} SELECT file_hash, arg_max(path, seq) AS path, count(*) AS copies FROM files GROUP BY file_hash",
    "mime_counts": f"WITH {FILES_SQL} SELECT {_MIME_SQL} AS mime_type, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY 1",
    "ext_rollup": f"WITH {FILES_SQL} SELECT lower(regexp_extract(filename, '^.+(\\.[^.]+)$', 1)) AS suffix, count(*) AS n, sum(size_bytes)::BIGINT AS bytes, max(size_bytes) AS largest FROM files GROUP BY 1",
    "sync_states": f"WITH {STATES_SQL} SELECT * FROM states",
    "sync_counts": f"WITH {STATES_SQL} SELECT s AS state, count(state) AS n FROM (VALUES ('NEW'), ('MODIFIED'), ('UNCHANGED'), ('DELETED')) v(s) LEFT JOIN states ON s = state GROUP BY s",
    "sync_plan_flags": f"""WITH {STATES_SQL}, c AS (SELECT count(*) FILTER (state = 'NEW') AS n, count(*) FILTER (state = 'MODIFIED') AS m, count(*) FILTER (state = 'DELETED') AS d, count(*) FILTER (state = 'UNCHANGED') AS u FROM states)
SELECT cleanup_deleted, reprocess_modified, index_new, CASE WHEN index_new THEN n ELSE 0 END AS new_files, CASE WHEN reprocess_modified THEN m ELSE 0 END AS modified_files, CASE WHEN cleanup_deleted THEN d ELSE 0 END AS deleted_entries, u AS unchanged_files,
  CASE WHEN index_new THEN n ELSE 0 END + CASE WHEN reprocess_modified THEN m ELSE 0 END + CASE WHEN cleanup_deleted THEN d ELSE 0 END AS total_changes
FROM c, (VALUES (false), (true)) a(cleanup_deleted), (VALUES (false), (true)) b(reprocess_modified), (VALUES (false), (true)) e(index_new)""",
    "orphaned_paths": f"WITH {FILES_SQL} SELECT path, file_hash FROM prev_index WHERE path NOT IN (SELECT path FROM files)",
    "upsert_snapshot": f"""WITH {FILES_SQL}, {_OLD_SQL}, new AS (SELECT file_hash, arg_max(path, seq) AS path, arg_max(size_bytes, seq) AS size_bytes, min(seq) AS first FROM files GROUP BY file_hash)
SELECT file_hash, doc_id, path, size_bytes FROM old WHERE file_hash NOT IN (SELECT file_hash FROM new)
UNION ALL SELECT new.file_hash, coalesce(old.doc_id, new.first + 1 + (SELECT max(doc_id) FROM old)), new.path, new.size_bytes FROM new LEFT JOIN old USING (file_hash)""",
    "delete_by_hash": f"WITH {FILES_SQL}, {_OLD_SQL} SELECT * FROM old WHERE file_hash NOT IN (SELECT file_hash FROM files WHERE size_bytes % 3 = 0)",
    "delete_by_path": f"WITH {FILES_SQL}, {_OLD_SQL} SELECT * FROM old WHERE path NOT IN (SELECT path FROM files WHERE size_bytes % 3 = 1)",
    "find_paths": f"WITH {FILES_SQL} SELECT seq, path, file_hash FROM files WHERE path IN (SELECT path FROM prev_index WHERE size_bytes % 5 = 2)",
    "lookup_hash": f"WITH {FILES_SQL} SELECT seq, path, file_hash FROM files WHERE file_hash = (SELECT max(file_hash) FROM files) ORDER BY seq LIMIT 1",
    "lookup_path": f"WITH {FILES_SQL} SELECT seq, path, file_hash FROM files WHERE path IN ('/lib/src2/22.heic', '/lib/src1/1.JPEG')",
    "library_count": f"WITH {FILES_SQL}, {_OLD_SQL} SELECT count(*) AS n FROM old",
    "camera_profile": f"""WITH c AS (SELECT p_partkey, (['Canon', 'NIKON', 'Sony', 'Apple', ' samsung ', 'GoPro', 'Epson', 'Leica', '', 'DJI'])[p_partkey % 10 + 1] AS make, (['EOS 5D', 'EOS R5', 'Z8', 'Film Scanner', 'A7 IV', 'X100'])[p_partkey % 6 + 1] AS model, p_size % 2 = 0 AS has_lens FROM part)
SELECT *, {_PROFILE_SQL} AS profile FROM c""",
    "exif_datetime": f"WITH {_TIMES_SQL} SELECT o_orderkey, try_strptime(replace(d, ': ', ':'), '%Y:%m:%d %H:%M:%S')::TIMESTAMP AS captured_at FROM t",
    "captured_fallback": f"""WITH {_TIMES_SQL}, o AS (SELECT *, CASE WHEN o_orderkey % 3 = 1 THEN d ELSE '2001:02:03 04:05:06' END AS s FROM t)
SELECT o_orderkey, coalesce(try_strptime(replace(s, ': ', ':'), '%Y:%m:%d %H:%M:%S')::TIMESTAMP, o_orderdate + INTERVAL 1 DAY) AS captured_at FROM o""",
    "gps_decimal": """WITH g AS (SELECT c_custkey, c_custkey % 2 = 0 OR c_custkey % 11 <> 0 AS ok, (c_custkey % 95)::DOUBLE + (c_custkey % 60)::DOUBLE / 60 + ((c_custkey % 6000) / 100.0::DOUBLE) / 3600 AS a, (c_custkey % 185)::DOUBLE + (c_custkey % 60)::DOUBLE / 60 + ((c_custkey % 6000) / 100.0::DOUBLE) / 3600 AS o FROM customer)
SELECT c_custkey, CASE WHEN ok AND a <= 90 AND o <= 180 THEN CASE WHEN c_custkey % 2 = 0 THEN -a ELSE a END END AS latitude, CASE WHEN ok AND a <= 90 AND o <= 180 THEN CASE WHEN c_custkey % 3 = 0 THEN -o ELSE o END END AS longitude,
  CASE WHEN ok AND a <= 90 AND o <= 180 THEN (c_custkey % 100)::DOUBLE END AS altitude, CASE WHEN ok AND a <= 90 AND o <= 180 THEN 'WGS84' END AS datum FROM g""",
    "exposure_format": f"SELECT event_id, {_EXPOSURE_SQL.format(v='(value / 4)')} AS long_exposure, {_EXPOSURE_SQL.format(v='(value / 1000)')} AS short_exposure FROM events",
    "focal_format": "SELECT p_partkey, CASE WHEN p_retailprice / 10 = trunc(p_retailprice / 10) THEN (p_retailprice / 10)::BIGINT || 'mm' ELSE printf('%.1f', p_retailprice / 10) || 'mm' END AS focal_length FROM part",
    "aspect_ratio": "SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN p_size::DOUBLE / (p_size % 5) ELSE 0.0::DOUBLE END AS ratio FROM part",
    "flash_flag": "SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'purchase' THEN false ELSE true END AS flash_fired FROM events",
    "raw_tag_filter": "SELECT p_partkey, 'EXIF CustomTag=' || p_name || '|EXIF LensModel=' || p_type AS raw_tags FROM part",
    "error_counts": "SELECT event_type AS error_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1",
    "index_stats": "SELECT count(*) AS discovered, count(*) FILTER (event_type <> 'error') AS processed, count(*) FILTER (event_type = 'error') AS errors, coalesce(sum(CASE WHEN event_type <> 'error' THEN floor(value)::BIGINT END), 0)::BIGINT AS bytes, count(*) FILTER (event_type <> 'error') / 1.5::DOUBLE AS images_per_minute FROM events",
    "search_radius": f"WITH {_PHOTOS_SQL} SELECT c_custkey, round({_KM_SQL}, 6) AS km FROM photos WHERE {_KM_SQL} <= 6000",
    "search_date_camera": f"WITH {_PHOTOS_SQL} SELECT c_custkey, captured_at, camera_model FROM photos WHERE captured_at >= '2020-03-01' AND captured_at < '2020-10-01' AND contains(lower(camera_model), 'eos')",
    "search_tags": f"WITH {_PHOTOS_SQL} SELECT c_custkey, 'any' AS match FROM photos WHERE list_has_any(labels, ['building', 'n3']) UNION ALL SELECT c_custkey, 'all' FROM photos WHERE list_has_all(labels, ['building', 'n3'])",
}

QUERIES = {name: globals()[name] for name in ORACLE_SQL}

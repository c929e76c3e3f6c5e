"""The library: buckets, manifests, writers side by side, lookups, index by path, search by cells, counts, clean-up."""

import datetime
import hashlib
import math
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from medialake.functions import cells
from medialake.operators import diff
from medialake.operators import search as searching
from medialake.plans import library as module
from medialake.plans.library import Conflict, Library
from medialake.plans.pipelines import sync
from medialake.schemas import LIBRARY_SCHEMA
from medialake.sources.folder import Folder

T0 = datetime.datetime(2024, 1, 1)


def rows(spark, ids, place=None, path="/p/{}", size=None, labels=(), days=0):
    """Library rows with ``seq``; hash, path and size follow from the id."""
    told = []
    for i in ids:
        lat, lon = place(i) if place else (None, None)
        exif = {"camera_model": f"M{i % 3}", "captured_at": T0 + datetime.timedelta(days=i % 100 if days else 0), "location": {"latitude": lat, "longitude": lon, "altitude": None, "datum": "WGS84"} if lat is not None else None}
        told.append((hashlib.sha256(str(i).encode()).hexdigest(), None, path.format(i), (f"{i}.jpg", path.format(i), (size or (lambda i: i))(i), "image/png" if i % 4 else "image/jpeg"), (1, 2), exif, list(labels), T0, i))
    return spark.createDataFrame(told, f"{LIBRARY_SCHEMA}, seq long").drop("doc_id")


@pytest.fixture
def library(spark, tmp_path):
    return Library(spark, str(tmp_path / "lib"), buckets=8)


def read_rows(df):
    """Rows that the scans of a query gave, by its own metrics."""
    df.collect()
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if name.startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


# --- writing --------------------------------------------------------------------
def test_a_save_rewrites_only_the_buckets_of_its_keys(spark, library):
    library.save(rows(spark, range(800)))
    before = {f.path: f.bucket for f in library.manifest().files}
    assert set(before.values()) == set(range(8)) and library.count() == 800
    library.save(rows(spark, range(3), path="/moved/{}"))
    after = {f.path: f.bucket for f in library.manifest().files}
    changed = {b for p, b in before.items() if p not in after}
    assert changed == {b for p, b in after.items() if p not in before} and 1 <= len(changed) <= 3
    assert library.count() == 800 and library.read().where("norm_path like '/moved/%'").count() == 3
    times = {p: os.stat(f"{library.path}/{p}").st_mtime_ns for p in before}
    library.save(rows(spark, [5]))
    assert times == {p: os.stat(f"{library.path}/{p}").st_mtime_ns for p in before}  # no file is ever written over


def test_numbers_stay_and_new_ones_follow_the_greatest(spark, library):
    library.save(rows(spark, range(10)))
    library.delete(hashlib.sha256(b"9").hexdigest())
    library.save(rows(spark, [3, 20, 21], path="/b/{}"))
    got = {r.norm_path: r.doc_id for r in library.read().collect()}
    assert got["/b/3"] == 3 and got["/p/4"] == 4 and min(got["/b/20"], got["/b/21"]) > 9 and len(set(got.values())) == 11


def test_the_second_writer_starts_again(spark, library, monkeypatch):
    library.save(rows(spark, range(20)))
    other, create, interposed = Library(spark, library.path), library.log.create, []

    def late(manifest):
        if not interposed:
            interposed.append(other.save(rows(spark, range(100, 120))))
        return create(manifest)

    monkeypatch.setattr(library.log, "create", late)
    assert library.save(rows(spark, range(200, 220))) == interposed[0] + 1 == 3
    assert {int(r.norm_path[3:]) for r in library.read().collect()} == {*range(20), *range(100, 120), *range(200, 220)}
    assert len({r.doc_id for r in library.read().collect()}) == 60  # numbers given by both are not the same
    monkeypatch.setattr(library.log, "create", lambda m: False)
    library.attempts = 2
    with pytest.raises(Conflict):
        library.save(rows(spark, [999]))


def test_writers_side_by_side_lose_nothing(spark, library):
    parts, failed = [range(k * 50, k * 50 + 50) for k in range(3)], []

    def work(ids):
        try:
            Library(spark, library.path, buckets=8).save(rows(spark, ids))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(p,)) for p in parts]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and library.count() == 150 and library.read().count() == 150 and library.manifest().version == 3
    assert library.paths().count() == 150


def test_create_if_absent(spark, tmp_path):
    f = Folder(spark, str(tmp_path))
    made = []
    threads = [threading.Thread(target=lambda i=i: made.append((f.create("log/1", f"text {i}"), i))) for i in range(20)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    (winner,) = [i for ok, i in made if ok]
    assert f.read("log/1") == f"text {winner}" and f.files("log") == ["log/1"]


def test_old_versions_and_clean_up(spark, library):
    library.save(rows(spark, range(40)))
    library.save(rows(spark, range(40, 50)))
    library.delete(hashlib.sha256(b"1").hexdigest())
    assert library.read(1).count() == 40 and library.read(2).count() == 50 and library.read().count() == 49
    assert library.vacuum(keep=1) == 3  # the manifests; young files may belong to a writer
    files = lambda: {f for f in library.log.folder.files("data")}
    assert files() > {f.path for f in library.manifest().files}
    library.vacuum(keep=1, grace_seconds=0)
    assert files() == {f.path for f in library.manifest().files} and library.read().count() == 49 and library.paths().count() == 49
    assert library.rebucket(3) == 4 and library.read().count() == 49 and {f.bucket for f in library.manifest().files} == {0, 1, 2}
    library.save(rows(spark, [77]))
    assert library.paths().count() == library.count() == 50


def test_buckets_follow_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "ROWS_PER_BUCKET", 10)
    monkeypatch.setattr(module, "LEAST_BUCKETS", 2)
    assert [module._buckets_for(n) for n in (0, 10, 20, 21, 81, 160)] == [2, 2, 2, 4, 16, 16]
    library = Library(spark, str(tmp_path / "grows"))
    library.save(rows(spark, range(30)))
    assert library.manifest().buckets == 4
    library.save(rows(spark, range(20, 170)))
    assert library.manifest().buckets == 32 and library.count() == library.read().count() == library.paths().count() == 170
    library.save(rows(spark, range(180)))
    assert library.manifest().buckets == 32 and library.count() == 180


def test_kept_labels(spark, library):
    library.save(rows(spark, [1, 2], labels=["mine"]))
    library.save(rows(spark, [2, 3], path="/b/{}"), keep=("labels",))
    assert {r.norm_path: r.labels for r in library.read().collect()} == {"/p/1": ["mine"], "/b/2": ["mine"], "/b/3": []}
    library.save(rows(spark, [1]))
    assert library.get_by_path("/p/1").first().labels == []


# --- lookups ----------------------------------------------------------------------
def test_an_absent_key_reads_no_row(spark, library):
    library.save(rows(spark, range(2000)))
    known, none = hashlib.sha256(b"77").hexdigest(), hashlib.sha256(b"none").hexdigest()
    assert library.get_by_filehash(known).first().norm_path == "/p/77"
    # within the least and the greatest of its bucket, so that only the Bloom filter can tell
    assert read_rows(library.get_by_filehash(none)) == 0
    assert read_rows(library.get_by_path("/p/77b")) == 0 and read_rows(library.find_by_paths(["/p/1x", "/p/5x"])) == 0
    assert 0 < read_rows(library.get_by_path("/p/77")) < 2000
    assert {r.norm_path for r in library.find_by_paths(["/p/3", "/p/4", "/nowhere"]).collect()} == {"/p/3", "/p/4"}
    assert library.find_by_paths([]).count() == 0
    many = [f"/p/{i}" for i in range(0, 1500)]
    assert library.find_by_paths(many).count() == 1500  # more than a condition should list


# --- index by path ------------------------------------------------------------------
def index_of(library):
    return {(r.norm_path, r.file_hash, r.size_bytes, r.doc_id) for r in library.paths().collect()}


def held(library):
    return {(r.norm_path, r.file_hash, r.file_info.size_bytes, r.doc_id) for r in library.read().collect()}


def test_the_index_follows_every_change(spark, library, monkeypatch):
    monkeypatch.setattr(module, "MOST", 4)
    rng = random.Random(4)
    for step in range(6):  # more than are kept before they are merged
        ids = rng.sample(range(60), 8)
        if step % 3 == 2:
            library.delete(hashlib.sha256(str(ids[0]).encode()).hexdigest())
            library.delete_by_path(f"/s{step - 1}/{ids[1]}")
        library.save(rows(spark, ids, path=f"/s{step}/{{}}", size=lambda i, step=step: i + step))
        assert index_of(library) == held(library)
    assert len(library.manifest().generations) <= 4
    library.change(gone=spark.createDataFrame([(r[0],) for r in held(library)][:5], "norm_path string"))
    library.clear()
    assert index_of(library) == held(library)


def test_the_join_with_a_listing_moves_only_the_listing(spark, library):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are not small
    try:
        moves_only_the_listing(spark, library)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def moves_only_the_listing(spark, library):
    library.save(rows(spark, range(100)))
    library.save(rows(spark, range(50, 130), path="/q/{}"))
    listing = rows(spark, range(90)).select("norm_path", F.col("file_info.size_bytes").alias("size_bytes"), F.lit(T0).alias("modified_time"), F.col("seq").alias("ord"))
    hashes = spark.createDataFrame([], "norm_path string, current_hash string, hash_error string")
    states = diff.file_states(library.dealt_by_path(listing), library.paths().withColumnRenamed("doc_id", "ord"), lambda needed: needed.join(F.broadcast(hashes), "norm_path", "left"))
    assert {r.state: r["count"] for r in states.groupBy("state").count().collect()} == {"UNCHANGED": 50, "NEW": 40, "DELETED": 80}
    lines = states._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    scans = [i for i, line in enumerate(lines) if "FileScan parquet" in line]
    assert scans and "Bucketed: true" in lines[scans[0]]
    for i in scans:  # no node above the library's scan deals rows out
        level = depth(lines[i])
        for line in reversed(lines[:i]):
            if depth(line) < level:
                level = depth(line)
                assert "Exchange" not in line, line


# --- search by cells ------------------------------------------------------------------
def km(a, b):
    (p, q), (r, s) = (map(math.radians, a), map(math.radians, b))
    h = math.sin((p - r) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((q - s) / 2) ** 2
    return 2 * cells.EARTH_KM * math.asin(min(1, math.sqrt(h)))


def number(lat, lon):
    """Cell of a place, bit by bit."""
    y, x = (max(0, min((1 << 16) - 1, math.floor((v + span / 2) / span * (1 << 16)))) for v, span in ((lat, 180), (lon, 360)))
    return sum(((y >> i & 1) << (2 * i + 1)) | ((x >> i & 1) << (2 * i)) for i in range(16))


def test_cells_and_covers(spark):
    rng = random.Random(8)
    places = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(3000)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0), (90.0, 0.0), (12.0, 180.0), (12.0, -180.0)]
    got = spark.createDataFrame(places, "a double, b double").select(cells.cell(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [number(*p) for p in places]
    centres = [(0, 0), (12, 179.9), (-12, -179.9), (89.5, 30), (-89.9, 0), (45, 10), (90, 0), (60, -179.99)] + places[:40]
    for centre in centres:
        for radius in (0.5, 30, 400, 3000, 12000, 20100):
            near = cells.cover(*centre, radius)
            assert len(near) <= 64 and all(a[1] + 1 < b[0] for a, b in zip(near, near[1:]))
            for p in places:
                if km(centre, p) <= radius:
                    assert any(low <= number(*p) <= high for low, high in near), (centre, radius, p)


def test_search_equals_a_scan_and_reads_less(spark, tmp_path):
    rng = random.Random(9)
    spots = {i: (rng.uniform(-85, 85), rng.uniform(-180, 180)) for i in range(2000)}
    library = Library(spark, str(tmp_path / "places"), buckets=2, rows_per_file=100)
    library.save(rows(spark, spots, place=lambda i: spots[i] if i % 10 else (None, None), days=1))
    read = []
    for centre in ((10.0, 20.0), (-40.0, 179.9), (84.0, -60.0)):
        for radius in (20000.0, 3000.0, 300.0, 5.0):
            found = library.search(location=(*centre, radius))
            assert [r.file_hash for r in found.collect()] == [r.file_hash for r in searching.search(library.read(), location=(*centre, radius)).collect()]
            read.append(len(found.inputFiles()))
        assert read[-4] >= read[-3] > read[-2] >= read[-1] and read[-1] <= 4
    some = library.search("2024-02-01", "2024-02-03", "m1", (0.0, 0.0, 9000.0))
    assert [r.file_hash for r in some.collect()] == [r.file_hash for r in searching.search(library.read(), "2024-02-01", "2024-02-03", "m1", (0.0, 0.0, 9000.0)).collect()] != []
    assert library.search("2031-01-01").inputFiles() == [] and library.search(location=(0.0, 0.0, 1.0)).count() == 0


# --- counts ---------------------------------------------------------------------------
def test_counts_come_from_the_manifest(spark, library):
    for step in range(3):
        library.save(rows(spark, range(step * 30, step * 30 + 50)))
    library.delete_by_path("/p/7")
    full = {r.k: (r.n, r.b) for r in library.read().groupBy(F.col("file_info.mime_type").alias("k")).agg(F.count("*").alias("n"), F.sum("file_info.size_bytes").alias("b")).collect()}
    for f in library.log.folder.files("data"):
        os.rename(f"{library.path}/{f}", f"{library.path}/{f}.away")  # no data file can be read
    s = library.stats()
    assert s.kinds == full and s.rows == library.count() == sum(n for n, _ in full.values()) and s.bytes == sum(b for _, b in full.values())


# --- sync ---------------------------------------------------------------------------
def test_size_and_time(spark, tmp_path):
    root, library = tmp_path / "r", Library(spark, str(tmp_path / "lib"), buckets=2)
    root.mkdir()
    for n in "abc":
        (root / f"{n}.jpg").write_bytes(n.encode() * 5)
    go = lambda **kw: (lambda r: (r.new_files, r.modified_files, r.unchanged_files))(sync(spark, str(root), library, **kw))
    assert go() == (3, 0, 0)
    (root / "a.jpg").write_bytes(b"AAAAA")  # as many bytes
    later = time.time() + 100
    os.utime(root / "a.jpg", (later, later))
    os.utime(root / "b.jpg", (later, later))  # touched only
    assert go() == (0, 0, 3)
    assert go(fingerprint="size+mtime") == (0, 1, 2) and library.count() == 3
    assert go(fingerprint="size+mtime") == (0, 0, 3)
    with pytest.raises(ValueError):
        go(fingerprint="mood")


def test_all_errors_are_kept(spark, tmp_path):
    root, library = tmp_path / "r", Library(spark, str(tmp_path / "lib"), buckets=2)
    root.mkdir()
    (root / "good.jpg").write_bytes(b"x")
    (root / "bad.jpg").symlink_to("/proc/self/mem")
    r = sync(spark, str(root), library, max_errors=0)
    assert r.errors == [] and r.error_count == 1 and r.new_files == 1
    (told,) = library.errors().collect()
    assert told.state == "NEW" and "mem" in told.path and told.error.startswith("extract error [NEW]")


def test_a_folder_in_another_store(spark, tmp_path):
    """The way through Hadoop's file systems, here over the local one."""
    f = Folder(spark, f"file://{tmp_path}/store")
    f.local = None
    assert f.files("log") == [] and f.create("log/1", "one ü") and not f.create("log/1", "other") and f.create("log/2", "two")
    assert f.files("log") == ["log/1", "log/2"] == f.files() and f.read("log/1") == "one ü" and 0 <= f.age("log/2") < 60
    f.remove("log/1")
    assert f.files() == ["log/2"]
    library = Library(spark, f"file://{tmp_path}/lib", buckets=2)
    library.log.folder.local = None
    library.save(rows(spark, range(10)))
    library.save(rows(spark, range(5, 15)))
    assert library.count() == library.read().count() == library.paths().count() == 15
    assert library.vacuum(keep=1, grace_seconds=0) > 0 and library.read().count() == 15

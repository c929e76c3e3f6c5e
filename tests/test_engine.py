"""Change analysis, store, decoding, sync on real folders, streaming and CLI."""

import datetime
import json
import os
import shutil
import struct

import pytest
from pyspark.sql import functions as F

from medialake import cli
from medialake.operators import diff, store
from medialake.operators.search import search
from medialake.plans.library import Library
from medialake.plans.pipelines import index, numbered, sync
from medialake.schemas import LIBRARY_SCHEMA
from medialake.sources import legacy, objects, walk
from medialake.sources.decode import decode
from medialake.sources.image_bytes import flash_words, read_size, read_tags
from medialake.sources.walk import list_files
from medialake.streaming.index_stream import stream_index

T0 = datetime.datetime(2024, 1, 1)
NAMES = ["harbour.jpg", "meadow.jpg", "tower.jpg"]


# --- change analysis ----------------------------------------------------------
def states(spark, disk, db, hashes, asked=None):
    d = spark.createDataFrame([(p, s, T0, i) for i, (p, s) in enumerate(disk)], "norm_path string, size_bytes long, modified_time timestamp_ntz, ord long")
    b = spark.createDataFrame([(p, s, h, i) for i, (p, s, h) in enumerate(db)], "norm_path string, size_bytes long, file_hash string, ord long")
    table = spark.createDataFrame([(p, h, None if h else "gone") for p, h in hashes.items()], "norm_path string, current_hash string, hash_error string")

    def hashed(needed):
        if asked is not None:
            asked.extend(sorted(r[0] for r in needed.collect()))
        return needed.join(table, "norm_path")

    return {r.file_path: r for r in diff.file_states(d, b, hashed).collect()}


def test_state_table(spark):
    asked = []
    got = states(
        spark,
        [("new", 10), ("newbad", 4), ("same", 1000), ("touched", 800), ("edited", 800), ("lost", 9999)],
        [("same", 1000, "A"), ("touched", 1000, "A"), ("edited", 1000, "A"), ("gone", 1000, "A"), ("lost", 1, "A")],
        {"new": "N", "newbad": None, "touched": "A", "edited": "B", "lost": None},
        asked,
    )
    assert asked == ["edited", "lost", "new", "newbad", "touched"]  # equal sizes are not hashed
    assert {p: (r.state, r.file_hash, r.previous_hash) for p, r in got.items()} == {
        "new": ("NEW", "N", None), "newbad": ("NEW", None, None), "same": ("UNCHANGED", "A", None), "touched": ("UNCHANGED", "A", None), "edited": ("MODIFIED", "B", "A"), "gone": ("DELETED", "A", None),
    }
    assert got["gone"].size_bytes is None and got["new"].last_modified == T0


def test_empty_and_duplicate_paths(spark):
    assert states(spark, [], [], {}) == {}
    got = states(spark, [("a", 5), ("a", 7)], [("a", 7, "old"), ("a", 9, "new")], {"a": "X"})
    assert got["a"].state == "MODIFIED" and got["a"].previous_hash == "new" and got["a"].size_bytes == 7


def test_counts_have_zeros(spark):
    df = spark.createDataFrame([("NEW",)], "state string")
    assert {r.state: r.n for r in diff.state_counts(df).collect()} == {"NEW": 1, "MODIFIED": 0, "UNCHANGED": 0, "DELETED": 0}


# --- store ----------------------------------------------------------------------
def test_upsert_last_row_wins(spark):
    old = spark.createDataFrame([("h1", 0, "a", {"k": "v"}), ("h2", 1, "b", None)], "file_hash string, doc_id long, path string, tags map<string,string>")
    new = spark.createDataFrame([("h2", "c", None, 0), ("h3", "d", None, 1), ("h3", "e", None, 2)], "file_hash string, path string, tags map<string,string>, seq long")
    got = {r.file_hash: (r.doc_id, r.path) for r in store.upsert(old, new).collect()}
    assert got == {"h1": (0, "a"), "h2": (1, "c"), "h3": (3, "e")}


# --- decoding ---------------------------------------------------------------------
def tiff(order="<", make=b"Canon\0", date=b"2022:09:21 19:49:51\0"):
    """A TIFF structure with Image, EXIF and GPS directories."""
    entry = lambda tag, kind, n, v: struct.pack(order + "HHI", tag, kind, n) + v
    u32, u16 = lambda v: struct.pack(order + "I", v), lambda v: struct.pack(order + "HH", v, 0)
    ratio = lambda *x: b"".join(struct.pack(order + "II", a, b) for a, b in x)
    ifd0, exif, gps, data = 8, 80, 220, 320
    blobs, at = b"", data

    def put(b):
        nonlocal blobs, at
        here, blobs, at = at, blobs + b, at + len(b)
        return u32(here)

    a = [entry(0x010F, 2, len(make), put(make)), entry(0x0110, 2, 5, put(b"EOS 5")), entry(0x0112, 3, 1, u16(6)), entry(0x8769, 4, 1, u32(exif)), entry(0x8825, 4, 1, u32(gps))]
    e = [entry(0x829A, 5, 1, put(ratio((1, 160)))), entry(0x829D, 5, 1, put(ratio((28, 10)))), entry(0x8827, 3, 1, u16(800)), entry(0x9003, 2, len(date), put(date)), entry(0x9209, 3, 1, u16(9)), entry(0x920A, 5, 1, put(ratio((35, 1)))), entry(0xA434, 2, 4, b"lens"), entry(0xA403, 3, 1, u16(0)), entry(0x9204, 10, 1, put(ratio((1, 0))))]
    g = [entry(1, 2, 2, b"S\0\0\0"), entry(2, 5, 3, put(ratio((33, 1), (30, 1), (0, 1)))), entry(3, 2, 2, b"E\0\0\0"), entry(4, 5, 3, put(ratio((151, 1), (0, 1), (36, 1))))]
    out = (b"II*\0" if order == "<" else b"MM\0*") + u32(ifd0)
    for base, entries in ((ifd0, a), (exif, e), (gps, g)):
        out = out.ljust(base, b"\0") + struct.pack(order + "H", len(entries)) + b"".join(entries) + u32(0)
    return out.ljust(data, b"\0") + blobs


def jpeg(width=640, height=480, **kw):
    body = b"Exif\0\0" + tiff(**kw)
    sof = struct.pack(">BHHB", 8, height, width, 3) + b"\0" * 9
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xc0" + struct.pack(">H", len(sof) + 2) + sof + b"\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_read_tags(order):
    tags, numbers = read_tags(jpeg(order=order))
    assert tags["Image Make"] == "Canon" and tags["EXIF ExposureTime"] == "1/160" and numbers["EXIF FNumber"] == [2.8]
    assert tags["Image Orientation"] == "Rotated 90 CW" and tags["EXIF WhiteBalance"] == "Auto" and tags["EXIF LensModel"] == "lens"
    assert tags["EXIF Flash"].startswith("Flash fired") and numbers["GPS GPSLatitude"] == [33.0, 30.0, 0.0]
    assert numbers["EXIF ExposureBiasValue"] == [None]  # a zero denominator gives no number


def test_malformed_images():
    good = jpeg()
    for data in (b"", b"\xff\xd8", good[:40], good[:200], b"II*\0\xff\xff\xff\xff", b"RIFF1234WEBPVP8 ", os.urandom(300)):
        read_tags(data), read_size(data)
    loop = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x8769, 4, 1, 8)
    assert "Image ExifOffset" in read_tags(loop)[0]


def test_sizes():
    assert read_size(jpeg(321, 123)) == (321, 123)
    assert read_size(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 7, 9)) == (7, 9)
    assert read_size(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4)
    assert read_size(b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6)) == (5, 6)
    assert read_size(b"not an image") == (0, 0)
    assert flash_words(0) == "Flash did not fire" and flash_words(1) == "Flash fired"


# --- folders ------------------------------------------------------------------------
@pytest.fixture
def photos(tmp_path):
    root = tmp_path / "photos"
    root.mkdir()
    for i in (1, 2, 3):
        (root / NAMES[i - 1]).write_bytes(bytes([i]) * (10 + i))
    return root


@pytest.fixture
def library(spark, tmp_path):
    return Library(spark, str(tmp_path / "lib"), buckets=2)


def test_walk_lists_what_a_plain_walk_lists(spark, tmp_path):
    root, outside = tmp_path / "r", tmp_path / "o"
    for d in (root / "_hid", root / ".dot", outside):
        d.mkdir(parents=True)
    for p in ("a.JPG", ".dot.jpg", "_under.jpg", "_hid/x.jpg", ".dot/y.jpg", "üñ 1.png"):
        (root / p).write_bytes(b"x")
    (root / "empty.jpg").touch()
    (outside / "z.jpg").write_bytes(b"z")
    (root / "link.jpg").symlink_to(root / "a.JPG")
    (root / "linkdir").symlink_to(outside)
    (root / "broken.jpg").symlink_to(root / "nothing")
    for parts in (1, 8):
        got = {r.original_path for r in list_files(spark, str(root), partitions=parts).collect()}
        assert got == {str(p) for p in root.rglob("*") if p.is_file()}
    assert {r.filename for r in list_files(spark, str(root), [".jpg"]).collect()} == {"a.JPG", "_under.jpg", "x.jpg", "y.jpg", "empty.jpg", "link.jpg", ".dot.jpg"}
    with pytest.raises(NotADirectoryError):
        list_files(spark, str(root / "a.JPG"))


def test_index_and_lookups(spark, photos, library):
    (photos / "real.jpg").write_bytes(jpeg())
    (photos / "copy.jpg").write_bytes(jpeg())
    (photos / "notes.txt").write_text("no")
    r = index(spark, str(photos), library)
    assert (r.discovered, r.processed, r.errors) == (5, 5, 0) and r.mime_types == {"image/jpeg": 5} and library.count() == 4  # equal content is one row
    row = library.find_by_paths([str(photos / "real.jpg"), "/nowhere"]).first()
    e = row.exif
    assert (e.camera_make, e.exposure_time, e.f_stop, e.iso, e.focal_length, e.camera_profile, e.flash_fired, e.white_balance_mode) == ("Canon", "1/160", 2.8, 800, "35mm", "dslr", True, "Auto")
    assert e.captured_at == datetime.datetime(2022, 9, 21, 19, 49, 51) and e.location.latitude == -33.5 and e.location.longitude == 151.01
    assert row.dimensions.width == 640 and row.labels == [] and "Image Make" not in e.raw_tags and e.raw_tags["EXIF LensModel"] == "lens"
    assert library.get_by_filehash(row.file_hash).first().file_info.path == str(photos / "real.jpg")  # the last path of a content wins
    assert library.get_by_path("x").first() is None
    assert [x.file_hash for x in search(library.read(), "2022-09-21", "2022-09-21", "eos", (-33.0, 151.0, 100.0)).collect()] == [row.file_hash]
    assert library.delete(row.file_hash) and not library.delete(row.file_hash) and library.count() == 3
    assert library.delete_by_path(str(photos / "harbour.jpg")) and library.count() == 2


def test_sync_scenarios(spark, photos, library):
    go = lambda **kw: sync(spark, str(photos), library, **kw)
    tally = lambda r: (r.new_files, r.modified_files, r.deleted_entries, r.unchanged_files, len(r.errors))
    assert tally(go(dry_run=True)) == (3, 0, 0, 0, 0) and library.count() == 0
    assert tally(go()) == (3, 0, 0, 0, 0) and library.count() == 3
    assert tally(go()) == (0, 0, 0, 3, 0)
    (photos / "bridge.jpg").write_bytes(b"4")
    assert tally(go()) == (1, 0, 0, 3, 0)
    (photos / "meadow.jpg").write_bytes(b"a longer content than before")
    assert tally(go(reprocess_modified=False)) == (0, 0, 0, 3, 0)
    r = go()
    assert tally(r) == (0, 1, 0, 3, 0) and r.total_changes == 1 and library.count() == 4  # the old content is retired
    (photos / "harbour.jpg").unlink()
    assert tally(go()) == (0, 0, 0, 3, 0) and library.count() == 4
    assert tally(go(cleanup_deleted=True)) == (0, 0, 1, 3, 0) and library.count() == 3
    (photos / "tower.jpg").rename(photos / "renamed.jpg")
    assert tally(go(cleanup_deleted=True)) == (1, 0, 1, 2, 0) and library.count() == 3  # the renamed file's row stays
    same = (photos / "renamed.jpg").stat().st_size
    (photos / "renamed.jpg").write_bytes(b"x" * same)
    assert tally(go()) == (0, 0, 0, 3, 0)  # an edit of equal size is not seen
    sub = photos / "sub"
    sub.mkdir()
    assert sync(spark, str(sub), library, cleanup_deleted=True, scope_to_path=True).deleted_entries == 0
    assert sync(spark, str(sub), library, cleanup_deleted=True).deleted_entries == 3 and library.count() == 0


def test_fail_fast_and_unreadable(spark, photos, library, monkeypatch):
    (photos / "broken.jpg").symlink_to("/proc/self/mem")  # a file that cannot be read
    r = index(spark, str(photos), library)
    assert r.errors == 1 and r.processed == 3 and sum(r.error_types.values()) == 1
    with pytest.raises(OSError):
        index(spark, str(photos), Library(spark, library.path + "2"), fail_fast=True)
    assert Library(spark, library.path + "2").count() == 0


def test_sources_extractors_and_progress(spark, photos, library):
    told = []
    r = index(spark, str(photos), library, source=objects.list_with_content, progress=told.append)
    assert (r.discovered, r.processed, r.errors) == (3, 3, 0) and told[-1]["discovered"] == 3 and told[-1]["errors"] == 0
    assert {x.file_info.name for x in library.read().collect()} == set(NAMES)
    assert sorted(x.doc_id for x in library.read().collect()) == [0, 1, 2]

    def fixed(files):
        return decode(files).withColumn("width", F.lit(77))

    other = Library(spark, library.path + "3")
    index(spark, str(photos), other, extractor=fixed)
    assert {x.dimensions.width for x in other.read().collect()} == {77}
    nothing = lambda disk, db, hashes: diff.file_states(disk.limit(0), db.limit(0), hashes)
    assert sync(spark, str(photos), other, analyzer=nothing).total_changes == 0


def test_folders_that_cannot_be_opened_delete_nothing(spark, photos, library, monkeypatch):
    (photos / "closed").mkdir()
    (photos / "closed" / "in.jpg").write_bytes(b"inside")
    index(spark, str(photos), library)

    def partly(spark, root, suffixes):
        found = list_files(spark, root, suffixes).where(~F.contains("original_path", F.lit("/closed/")))
        lost = spark.createDataFrame([(f"{root}/closed", "list error: closed")], "original_path string, error string")
        return found.unionByName(lost, allowMissingColumns=True)

    (photos / "tower.jpg").unlink()
    r = sync(spark, str(photos), library, cleanup_deleted=True, source=partly)
    assert r.deleted_entries == 1 and r.error_count == 1 and {x.file_info.name for x in library.read().collect()} == {"harbour.jpg", "meadow.jpg", "in.jpg"}
    rows = [walk.stat_row(*x) for x in walk.list_folder(str(photos / "nowhere"), False)] + [walk.stat_row(*x) for x in walk.list_folder(str(photos / "nowhere"), True)]
    assert len(rows) == 2 and all(x[5].startswith("list error") and x[1] is None for x in rows)


def test_a_library_without_its_log_is_no_new_library(spark, photos, library):
    index(spark, str(photos), library)
    shutil.rmtree(library.path + "/log")
    with pytest.raises(RuntimeError, match="no log"):
        library.count()
    os.mkdir(library.path + "/log")
    with pytest.raises(RuntimeError, match="no log"):
        library.save(library.spark.createDataFrame([], LIBRARY_SCHEMA).withColumn("seq", F.lit(0)))
    assert Library(spark, library.path + "-none").count() == 0


def test_numbers_are_places_by_path(spark, tmp_path):
    names = [f"/{'abc'[i % 3]}/{i:04d}" for i in range(500)]
    rows = numbered(spark.createDataFrame([(n,) for n in names], "original_path string").repartition(7)).collect()
    assert {r.original_path: r.seq for r in rows} == {n: i for i, n in enumerate(sorted(names))}


def test_legacy_import(spark, tmp_path):
    doc = {"file_hash": "h", "file_info": {"name": "a.jpg", "path": "/a.jpg", "size_bytes": 3, "mime_type": "image/jpeg"}, "dimensions": {"width": 1, "height": 2}, "exif": {"camera_make": "Sony", "captured_at": "2024-01-15T14:30:00", "camera_profile": "odd", "location": {"latitude": 1.5, "longitude": 2.5}, "raw_tags": {"n": 5}}, "added_at": "2024-02-16T10:30:00.123456"}
    bad = json.loads(json.dumps(doc)) | {"file_hash": "x"}
    bad["exif"]["captured_at"] = "never"
    p = tmp_path / "db.json"
    p.write_text(json.dumps({"metadata": {"1": doc, "2": bad}}, indent=2))
    rows = {r.file_hash: r for r in legacy.read_documents(spark, str(p)).collect()}
    r = rows["h"]
    assert r.doc_id == 1 and r.labels == [] and r.exif.location.datum == "WGS84" and r.exif.camera_profile == "unknown" and r.exif.raw_tags == {"n": "5"}
    assert r.exif.captured_at == datetime.datetime(2024, 1, 15, 14, 30) and r.added_at.microsecond == 123456 and rows["x"].exif.captured_at is None
    bad["exif"]["location"]["latitude"] = 91
    p.write_text(json.dumps({"metadata": {"1": bad}}))
    with pytest.raises(Exception, match="out of range"):
        legacy.read_documents(spark, str(p)).collect()


def test_object_listing(spark, photos):
    assert {r.filename for r in objects.list_objects(spark, str(photos), [".jpg"]).select("filename").collect()} == {"harbour.jpg", "meadow.jpg", "tower.jpg"}
    assert objects.object_url("b", "p/") == "s3a://b/p/"
    with pytest.raises(ValueError):
        objects.object_url("")


def test_stream(spark, photos, library, tmp_path):
    for expected in (3, 4):
        stream_index(spark, str(photos), library, str(tmp_path / "cp")).awaitTermination(60)
        assert library.count() == expected
        (photos / "later.jpg").write_bytes(b"later")


def test_cli(spark, photos, tmp_path, capsys):
    db = str(tmp_path / "cli")
    assert cli.main([]) == 0
    assert cli.main(["index", "--path", str(photos), "--db", db]) == 0 and "Indexed 3 of 3" in capsys.readouterr().out
    assert cli.main(["sync", "--path", str(photos), "--db", db, "--dry-run"]) == 0 and "unchanged=3" in capsys.readouterr().out
    assert cli.main(["stats", "--db", db]) == 0 and "3 images" in capsys.readouterr().out
    assert cli.main(["search", "--db", db, "--date-from", "2000-01-01"]) == 0 and "harbour.jpg" in capsys.readouterr().out
    assert cli.main(["index", "--path", "/nowhere", "--db", db]) == 1
    with pytest.raises(SystemExit):
        cli.main(["index"])

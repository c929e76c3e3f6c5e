"""Reading files in parts, HEIF boxes, values without caps, listings with conditions, objects, work by bytes, progress."""

import os
import resource
import struct
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from medialake.plans.library import Library
from medialake.plans.pipelines import dealt, index, sync
from medialake.sources import objects, opening, walk
from medialake.sources.decode import _decode_one, decode
from medialake.sources.image_bytes import read_size, read_tags
from medialake.sources.opening import FileBytes, Part
from medialake.sources.walk import list_files
from tests.test_engine import jpeg, tiff


# --- parts of files -----------------------------------------------------------------
def test_parts_of_a_file_are_its_bytes(tmp_path):
    data = os.urandom(300_000)
    p = tmp_path / "f"
    p.write_bytes(data)
    with opening.open_input(str(p)) as f:
        view = FileBytes(f)
        assert len(view) == len(data) and view[299_999] == data[-1]
        for a, b in ((0, 5), (65_530, 65_540), (1, 200_000), (299_990, 400_000), (5, 5), (7, 3), (0, 300_000)):
            assert view[a:b] == data[a:b]
        part = Part(view, 1000, 250_000)
        assert len(part) == 249_000 and part[3:10] == data[1003:1010] and part[248_000:900_000] == data[249_000:250_000]
        with pytest.raises(IndexError):
            part[249_000]
    assert opening.open_input(f"file:{p}").read() == data == opening.open_input(f"file://{p}").read()
    odd = tmp_path / "a%20b:c"
    odd.write_bytes(b"odd")
    assert opening.open_input(f"file:{odd}").read() == b"odd" == opening.open_input(str(odd)).read()
    with pytest.raises(FileNotFoundError):
        opening.open_input(str(tmp_path / "none"))


def big_tiff(path, size):
    """A sparse TIFF whose directory stands at its end."""
    own = tiff()
    with open(path, "wb") as f:
        f.write(own[:4] + struct.pack("<I", size))
        f.seek(size)
        entries = [struct.pack("<HHII", 0x0100, 4, 1, 640), struct.pack("<HHII", 0x0101, 4, 1, 480), struct.pack("<HHII", 0x010F, 2, 6, size + 100)]
        f.write(struct.pack("<H", 3) + b"".join(entries) + struct.pack("<I", 0))
        f.seek(size + 100)
        f.write(b"Canon\0")


def test_a_large_file_needs_little_memory(tmp_path):
    path = str(tmp_path / "large.tiff")
    big_tiff(path, 2 << 30)
    code = f"import resource; from medialake.sources.decode import _decode_one; r = _decode_one({path!r}); print(r[1], r[2], r[3]['Image Make'], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.getcwd()}, check=True).stdout.split()
    base = subprocess.run([sys.executable, "-c", "import resource; import medialake.sources.decode; print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.getcwd()}, check=True).stdout
    assert out[:3] == ["640", "480", "Canon"] and int(out[3]) - int(base) < 50_000 and resource  # KB


# --- tags -------------------------------------------------------------------------
def directory(entries, blobs=b"", at=8, following=0):
    """A TIFF with one directory; entries are (tag, kind, count, bytes)."""
    data = at + 2 + 12 * len(entries) + 4
    out, tail = struct.pack("<H", len(entries)), b""
    for tag, kind, count, value in entries:
        if len(value) <= 4:
            out += struct.pack("<HHI", tag, kind, count) + value.ljust(4, b"\0")
        else:
            out += struct.pack("<HHII", tag, kind, count, data + len(tail))
            tail += value
    return b"II*\0" + struct.pack("<I", at) + out + struct.pack("<I", following) + tail + blobs


def test_no_value_is_cut():
    tags, numbers = read_tags(directory([(0x010E, 2, 300_001, b"x" * 300_000 + b"\0"), (0x0201, 4, 5000, struct.pack("<5000I", *range(5000))), (0x9000, 7, 200, bytes([200]) * 200)]))
    assert len(tags["Image ImageDescription"]) == 300_000 and numbers["Image Tag 0x0201"] == [float(i) for i in range(5000)]
    assert tags["Image Tag 0x9000"].count("200") == 200
    many = directory([(1000 + i, 3, 1, struct.pack("<H", i)) for i in range(3000)])
    assert len(read_tags(many)[0]) == 3000
    greedy = directory([(i, 2, 100_000, struct.pack("<I", 8)) for i in range(1, 50)])  # claims the same bytes again and again
    assert len(read_tags(greedy + b"y" * 100_000)[0]) <= 2


def test_following_and_lower_directories():
    first = directory([(0x010F, 2, 4, b"Own\0")])
    at = len(first)
    thumb = struct.pack("<H", 1) + struct.pack("<HHI", 0x0103, 3, 1) + struct.pack("<HH", 6, 0) + struct.pack("<I", 8)  # leads back
    data = first[: 8 + 2 + 12] + struct.pack("<I", at) + first[8 + 2 + 12 + 4 :] + thumb
    assert read_tags(data)[0] == {"Image Make": "Own", "Thumbnail Tag 0x0103": "6"}


def box(kind, *body, full=None):
    content = (struct.pack(">I", full) if full is not None else b"") + b"".join(body)
    return struct.pack(">I4s", 8 + len(content), kind) + content


def heif(wide=False, turned=True, inside=False):
    exif = b"\0\0\0\6Exif\0\0" + tiff(">")
    infe = lambda i, kind: box(b"infe", struct.pack(">HH4s", i, 0, kind) + b"\0", full=2 << 24)
    ispe = lambda w, h: box(b"ispe", struct.pack(">II", w, h), full=0)
    links = [(1, [1]), (2, [2, 3] if turned else [2])]
    ipma = box(b"ipma", struct.pack(">I", 2), *(struct.pack(">HB", i, len(p)) + b"".join(struct.pack(">H", 0x8000 | x) if wide else struct.pack(">B", 0x80 | x) for x in p) for i, p in links), full=int(wide))
    parts = lambda at: box(
        b"meta", box(b"hdlr", b"\0" * 20, full=0), box(b"pitm", struct.pack(">H", 2), full=0), box(b"iinf", struct.pack(">H", 3), infe(1, b"hvc1"), infe(2, b"hvc1"), infe(3, b"Exif"), full=0),
        box(b"iprp", box(b"ipco", ispe(160, 120), ispe(4032, 3024), box(b"irot", b"\1")), ipma),
        box(b"iloc", struct.pack(">HHHHHHII", 0x4400, 1, 3, int(inside), 0, 1, at, len(exif)), full=1 << 24) if inside else box(b"iloc", struct.pack(">HHHHHII", 0x4400, 1, 3, 0, 1, at, len(exif)), full=0),
        *([box(b"idat", exif)] if inside else []), full=0,
    )
    head = box(b"ftyp", b"heic\0\0\0\0mif1heic")
    if inside:
        return head + parts(0)
    return head + parts(len(head) + len(parts(0)) + 8) + box(b"mdat", exif)


@pytest.mark.parametrize("kw", [{}, {"wide": True}, {"turned": False}])
def test_heif(kw):
    data = heif(**kw)
    assert read_size(data) == ((4032, 3024) if kw.get("turned") is False else (3024, 4032))
    tags, numbers = read_tags(data)
    assert tags["Image Make"] == "Canon" and numbers["GPS GPSLatitude"] == [33.0, 30.0, 0.0]
    for n in range(0, len(data), 7):  # cut anywhere, nothing fails
        read_tags(data[:n]), read_size(data[:n])


def test_heif_with_large_boxes_and_other_files():
    wide = box(b"ftyp", b"heic\0\0\0\0") + struct.pack(">I4sQ", 1, b"free", 20) + b"abcd" + heif()[24:]
    assert read_size(wide) == (3024, 4032)
    assert read_size(box(b"ftyp", b"isom\0\0\0\0mp41")) == (0, 0) and read_tags(box(b"ftyp", b"heic\0\0\0\0")) == ({}, {})


# --- listings -----------------------------------------------------------------------
def test_conditions_reach_the_listing(spark, tmp_path):
    for p in ("a/x.jpg", "a/deep/y.JPG", "a/z.txt", "ab/w.jpg", "b/v.jpg", "b/c/u.png"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x" * (len(p) * 10))
    found = list_files(spark, str(tmp_path), [".jpg"]).where(F.col("original_path").startswith(f"{tmp_path}/a/") & (F.col("size_bytes") > 75))
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    (pushed,) = [line for line in plan.split("\n") if line.startswith("PushedFilters")]
    assert "In(kind, [!,.jpg])" in pushed and f"StringStartsWith(original_path,{tmp_path}/a/)" in pushed
    assert {r.filename for r in found.collect()} == {"y.JPG"}
    assert {r.filename for r in list_files(spark, str(tmp_path), [".jpg"]).where("size_bytes <= 70").collect()} == {"x.jpg", "v.jpg"}
    with pytest.raises(ValueError):
        list_files(spark, str(tmp_path), [])


def test_folders_without_a_hit_are_not_opened(tmp_path, monkeypatch):
    for p in ("a/in", "b/in", "c"):
        (tmp_path / p).mkdir(parents=True)
        (tmp_path / p / "x.jpg").touch()
    opened, scan = [], os.scandir

    def watched(path):
        opened.append(os.path.relpath(path, tmp_path))
        if "/b" in str(path) or "/c" in str(path):
            raise PermissionError(13, "closed", path)
        return scan(path)

    monkeypatch.setattr(walk.os, "scandir", watched)
    reader = walk._WalkReader({"path": str(tmp_path), "partitions": "2"})
    left = list(reader.pushFilters([walk.StringStartsWith(("original_path",), f"{tmp_path}/a"), walk.In(("kind",), (".jpg", walk.FAILED)), walk.GreaterThan(("norm_path",), "")]))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[0] for r in rows] == [f"{tmp_path}/a/in/x.jpg"] and len(left) == 1
    assert set(opened) <= {".", "a", "a/in"}


def test_suffixes_of_names():
    for name, kind in (("a.JPG", ".jpg"), (".jpg", ""), ("foo.", ""), ("..jpg", ".jpg"), ("a.b.PNG", ".png"), ("plain", "")):
        assert walk.kind_of(name) == kind


# --- objects ------------------------------------------------------------------------
def test_objects_are_indexed_and_synced_without_their_bytes_in_a_shuffle(spark, tmp_path):
    root, library = tmp_path / "store", Library(spark, str(tmp_path / "lib"), buckets=2)
    root.mkdir()
    (root / "one.jpg").write_bytes(jpeg())
    (root / "two.jpg").write_bytes(b"two")
    url = f"file://{root}"
    r = index(spark, url, library, source=objects.list_as_files)
    assert (r.processed, r.errors) == (2, 0) and {x.exif.camera_make for x in library.read().collect()} == {"Canon", None}
    (root / "two.jpg").write_bytes(b"two, longer")
    (root / "three.jpg").write_bytes(b"three")
    r = sync(spark, url, library, source=objects.list_as_files)
    assert (r.new_files, r.modified_files, r.unchanged_files, r.error_count) == (1, 1, 1, 0) and library.count() == 3
    (root / "one.jpg").unlink()
    assert sync(spark, url, library, source=objects.list_as_files, cleanup_deleted=True).deleted_entries == 1


# --- work and progress ----------------------------------------------------------------
def test_tasks_get_near_equal_bytes(spark):
    sizes = [50_000_000 if i < 40 else 1000 for i in range(4000)]  # one folder of large files first
    files = spark.createDataFrame([(f"/{'a' if i < 40 else 'b'}/{i:05d}", n) for i, n in enumerate(sizes)], "original_path string, size_bytes long").repartition(5)
    out = dealt(files, parts=16)
    loads = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.sum(F.col("size_bytes") + 65536).alias("n")).collect()]
    mean = sum(n + 65536 for n in sizes) / 16
    assert max(loads) <= 2 * mean + 50_065_536 and len(loads) == 16
    assert [r.seq for r in out.orderBy("original_path").collect()] == list(range(4000))


def test_progress_is_told_while_the_job_runs(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    for i in range(48):
        (root / f"{i:02d}.jpg").write_bytes(bytes([i]) * 100)
    (root / "bad.jpg").symlink_to("/proc/self/mem")

    def slow(files):
        def wait(batches):
            for b in batches:
                time.sleep(0.02 * len(b))
                yield b

        return decode(files.mapInPandas(wait, files.schema))

    told = []
    r = index(spark, str(root), Library(spark, str(tmp_path / "lib"), buckets=2), workers=48, extractor=slow, progress=told.append, every=0.05)
    early = [t for t in told if not t["over"]]
    assert len(early) >= 3 and early == sorted(early, key=lambda t: t["processed"]) and any(0 < t["processed"] < 48 for t in early)
    assert told[-1]["over"] and (told[-1]["discovered"], told[-1]["processed"], told[-1]["errors"], told[-1]["bytes"]) == (49, 48, 1, 4800) and told[-1]["images_per_minute"] > 0
    assert (r.processed, r.errors) == (48, 1)


def test_one_decoded_file(tmp_path):
    p = tmp_path / "x.jpg"
    p.write_bytes(jpeg(321, 123))
    assert _decode_one(str(p)) == _decode_one("other", p.read_bytes()) and _decode_one(str(p))[1:3] == (321, 123)
    assert _decode_one(str(tmp_path / "no"))[6] == "FileNotFoundError"

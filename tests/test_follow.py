"""The change stream of a tree, and a library that follows it."""

import os
import time

from medialake.plans.library import Library
from medialake.sources import tree_changes
from medialake.streaming.follow import apply_changes, follow


def reader(root, state, **kw):
    return tree_changes._ChangeReader({"path": str(root), "state": str(state), "partitions": "3", **kw})


def batch(r, start, end):
    rows = [x for p in r.partitions({"listing": start}, {"listing": end}) for x in r.read(p)]
    return sorted((x[7], os.path.basename(x[0]), x[2]) for x in rows)


def test_a_batch_is_the_difference_of_two_listings(tmp_path):
    root, r = tmp_path / "r", reader(tmp_path / "r", tmp_path / "s")
    (root / "a" / "b" / "c").mkdir(parents=True)
    for p in ("x.jpg", "a/y.jpg", "a/b/z.jpg", "a/b/c/deep.jpg"):
        (root / p).write_bytes(b"123")
    assert r.initialOffset() == {"listing": 0} and r.latestOffset() == {"listing": 1}
    first = batch(r, 0, 1)
    assert first == [("NEW", n, 3) for n in ("deep.jpg", "x.jpg", "y.jpg", "z.jpg")]
    (root / "x.jpg").write_bytes(b"12345")
    assert batch(r, 0, 1) == first  # a batch that runs again gives the same rows, whatever came since
    assert r.latestOffset() == {"listing": 2}
    (root / "a" / "b" / "c" / "deep.jpg").rename(root / "a" / "moved.jpg")
    (root / "a" / "b" / "z.jpg").unlink()
    (root / "a" / "b" / "c").rmdir()
    (root / "a" / "b").rmdir()
    assert batch(r, 1, 2) == [("DELETED", "deep.jpg", None), ("DELETED", "z.jpg", None), ("MODIFIED", "x.jpg", 5), ("NEW", "moved.jpg", 3)]
    r.commit({"listing": 2})
    assert os.listdir(tmp_path / "s") == ["2"] and r.latestOffset() == {"listing": 3}
    assert batch(r, 2, 3) == []


def test_a_folder_that_cannot_be_opened_loses_nothing(tmp_path, monkeypatch):
    root, r = tmp_path / "r", reader(tmp_path / "r", tmp_path / "s", depth="1")
    (root / "shut" / "in").mkdir(parents=True)
    (root / "shut" / "in" / "x.jpg").write_bytes(b"1")
    (root / "y.jpg").write_bytes(b"1")
    assert len(batch(r, 0, 1)) == 2
    scan = os.scandir

    def closed(path):
        if str(path).endswith("/in"):
            raise PermissionError(13, "closed", path)
        return scan(path)

    with monkeypatch.context() as m:
        m.setattr(os, "scandir", closed)
        assert batch(r, 1, 2) == [("ERROR", "in", None)]
    assert batch(r, 2, 3) == []
    (root / "shut" / "in" / "x.jpg").unlink()
    assert batch(r, 3, 4) == [("DELETED", "x.jpg", None)]


def held(library):
    return {r.file_info.name: r.file_info.size_bytes for r in library.read().collect()}


def test_edits_deletions_and_renames_reach_the_library(spark, tmp_path):
    root, library = tmp_path / "r", Library(spark, str(tmp_path / "lib"), buckets=2)
    (root / "sub").mkdir(parents=True)
    for n, size in (("a", 1), ("b", 2), ("sub/c", 3)):
        (root / f"{n}.jpg").write_bytes(n.encode() * size)
    (root / "notes.txt").write_text("no image")

    def run():  # each start is a restart from the checkpoint
        follow(spark, str(root), library, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination(120)
        return held(library)

    assert run() == {"a.jpg": 1, "b.jpg": 2, "c.jpg": 15}
    (root / "a.jpg").write_bytes(b"edited, longer")
    (root / "b.jpg").unlink()
    assert run() == {"a.jpg": 14, "c.jpg": 15}
    (root / "sub" / "c.jpg").rename(root / "d.jpg")
    assert run() == {"a.jpg": 14, "d.jpg": 15}
    version = library.manifest().version
    assert run() == {"a.jpg": 14, "d.jpg": 15} and library.manifest().version == version  # nothing changed


def test_a_running_query_over_three_batches(spark, tmp_path):
    root, library = tmp_path / "r", Library(spark, str(tmp_path / "lib"), buckets=2)
    root.mkdir()
    (root / "a.jpg").write_bytes(b"1")
    q = follow(spark, str(root), library, str(tmp_path / "state"), str(tmp_path / "cp"), every="1 seconds")
    try:
        for change, want in ((lambda: None, {"a.jpg": 1}), (lambda: (root / "b.jpg").write_bytes(b"22"), {"a.jpg": 1, "b.jpg": 2}), (lambda: (root / "a.jpg").rename(root / "c.jpg"), {"c.jpg": 1, "b.jpg": 2})):
            change()
            end = time.time() + 90
            while held(library) != want and time.time() < end and q.isActive:
                time.sleep(0.5)
            assert held(library) == want, q.exception()
    finally:
        q.stop()


def test_a_batch_applied_twice(spark, tmp_path):
    root, library, r = tmp_path / "r", Library(spark, str(tmp_path / "lib"), buckets=2), reader(tmp_path / "r", tmp_path / "s")
    root.mkdir()
    (root / "a.jpg").write_bytes(b"1")
    rows = [x for p in r.partitions({"listing": 0}, {"listing": 1}) for x in r.read(p)]
    df = spark.createDataFrame(rows, tree_changes.CHANGE_SCHEMA)
    apply_changes(library, df)
    apply_changes(library, df)
    assert held(library) == {"a.jpg": 1} and library.count() == 1

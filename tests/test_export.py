"""Export to a JSON document store and back."""

import json
import os

import pytest
from pyspark.sql import functions as F

from medialake import cli
from medialake.plans.library import Library
from medialake.plans.pipelines import index
from medialake.sources import json_store, legacy
from tests.test_engine import jpeg


@pytest.fixture
def library(spark, tmp_path):
    root = tmp_path / "photos"
    root.mkdir()
    (root / "real.jpg").write_bytes(jpeg())
    (root / "ünï \"q\".png").write_bytes(b"\x89PNG")
    for i in range(7):
        (root / f"{i}.jpg").write_bytes(bytes([i]) * 9)
    found = Library(spark, str(tmp_path / "lib"), buckets=4)
    index(spark, str(root), found)
    return found


def rows(df):
    return sorted((json.dumps(r.asDict(True), default=str, sort_keys=True) for r in df.collect()), key=str)


@pytest.mark.parametrize("single", [False, True])
def test_export_and_import_give_equal_tables(spark, library, tmp_path, single):
    out = str(tmp_path / "out")
    for _ in range(2):  # the second export replaces the first
        json_store.export(library.read(), out, single=single)
    names = [n for n in os.listdir(out) if n.endswith(".json")]
    assert not [n for n in os.listdir(out) if n.startswith(".staging")] and (len(names) == 1 if single else len(names) >= 1)
    assert rows(legacy.read_documents(spark, out)) == rows(library.read())
    told = {}
    for n in names:
        told |= json.load(open(f"{out}/{n}", encoding="utf-8"))["metadata"]
    assert {int(k) for k in told} == set(range(9))
    one = next(d for d in told.values() if d["file_info"]["name"] == "real.jpg")
    assert one["exif"]["captured_at"] == "2022-09-21T19:49:51" and one["exif"]["location"]["datum"] == "WGS84" and one["labels"] == []
    assert all(d["exif"]["location"] is None for d in told.values() if d is not one)


def test_the_layout_is_that_of_an_indented_store(spark, library, tmp_path):
    out = str(tmp_path / "out")
    json_store.export(library.read(), out, single=True)
    (name,) = os.listdir(out)
    text = open(f"{out}/{name}", encoding="utf-8").read()
    assert text == json.dumps(json.loads(text), indent=2) + "\n"


def test_a_failed_task_leaves_no_file(spark, library, tmp_path):
    out = str(tmp_path / "out")
    json_store.export(library.read(), out)
    before = sorted(os.listdir(out))
    bad = json_store.documents(library.read().repartition(3)).withColumn("document", F.when(F.col("number") == 4, "{no json").otherwise(F.col("document")))
    with pytest.raises(Exception):  # noqa: B017
        bad.write.format("json_store").mode("overwrite").save(out)
    assert sorted(os.listdir(out)) == before


def test_empty(spark, tmp_path):
    json_store.export(Library(spark, str(tmp_path / "none")).read(), str(tmp_path / "out"), single=True)
    assert legacy.read_documents(spark, str(tmp_path / "out")).count() == 0


def test_times_as_texts(spark):
    df = spark.sql("select timestamp_ntz'2024-02-16 10:30:00.123456' as a, timestamp_ntz'2024-02-16 10:30:00' as b, cast(null as timestamp_ntz) as c")
    assert tuple(df.select(*(json_store.iso(F.col(c)) for c in "abc")).first()) == ("2024-02-16T10:30:00.123456", "2024-02-16T10:30:00", None)


def test_command(spark, library, tmp_path, capsys):
    assert cli.main(["export", "--db", library.path, "--out", str(tmp_path / "out")]) == 0 and "9 images" in capsys.readouterr().out
    assert legacy.read_documents(spark, str(tmp_path / "out")).count() == 9

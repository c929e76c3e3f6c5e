"""Field functions against plain Python and fixed cases."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from medialake.functions import camera, exif, numbers, paths
from medialake.operators import search


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_fixed_matches_python_formatting(spark):
    rng = random.Random(3)
    xs = [rng.uniform(0, 500) for _ in range(3000)] + [i / 20 for i in range(1, 2000)] + [i / 80 for i in range(500)] + [0.25, 2.25, 1.05, 4.55, 0.05, 0.15, 0.35, -4.55, -0.04, 1e9 + 0.05, 0.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)
    got = df.select(numbers.fixed(F.col("x"), 1), numbers.fixed(F.col("x"), 4)).collect()
    assert [tuple(r) for r in got] == [(f"{x:.1f}", f"{x:.4f}") for x in xs]


@pytest.mark.parametrize(("v", "text"), [(0.00625, "1/160"), (0.01, "1/100"), (0.5, "1/2"), (1.0, '1.0"'), (2.0, '2.0"'), (0.0, "0"), (0.003, "0.0030s"), (4.55, '4.5"'), (2.25, '2.2"')])
def test_exposure(spark, v, text):
    assert values(spark, [(v,)], "v double", exif.exposure_text(F.col("v"))) == [text]


def test_focal(spark):
    assert values(spark, [(35.0,), (50.5,), (3.9,), (None,)], "v double", exif.focal_text(F.col("v"))) == ["35mm", "50.5mm", "3.9mm", None]


def test_datetime(spark):
    day = datetime.datetime
    cases = {
        "2022:09:21 19:49:51": day(2022, 9, 21, 19, 49, 51), "2019:01:15 12: 59: 32": day(2019, 1, 15, 12, 59, 32), "2022:9:1 9:4:5": day(2022, 9, 1, 9, 4, 5), "2022:03:13 02:30:00": day(2022, 3, 13, 2, 30),
        "invalid": None, "": None, "2022:02:30 10:00:00": None, "2022:01:01 10:00:60": None, "2024": None, "22:1:1 0:0:0": None,
    }
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert values(spark, [(k,) for k in cases], "s string", exif.exif_datetime(F.col("s"))) == list(cases.values())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_invalid_original_skips_digitized(spark):
    t = datetime.datetime(2020, 1, 2)
    rows = [("bad", "2001:01:01 00:00:00", t), (None, "2001:01:01 00:00:00", t), ("  ", None, t)]
    got = values(spark, rows, "o string, d string, m timestamp_ntz", exif.captured_at(F.col("o"), F.col("d"), F.col("m")))
    assert got == [t, datetime.datetime(2001, 1, 1), t]


def test_gps(spark):
    rows = [
        ([40.0, 26.0, 46.0], "N", [79.0, 58.0, 56.0], "W", [12.5]), ([10.0, 0.0, 0.0], "S", [20.0, 30.0, 0.0], "E", None), ([90.0, 0.0, 0.0], "N", [180.0, 0.0, 0.0], "E", []),
        ([91.0, 0.0, 0.0], "N", [0.0, 0.0, 0.0], "E", None), (None, "N", [0.0, 0.0, 0.0], "E", None), ([1.0, 0.0], "N", [0.0, 0.0, 0.0], "E", None), ([1.0, 0.0, 0.0], "", [0.0, 0.0, 0.0], "E", None),
    ]
    got = values(spark, rows, "a array<double>, ar string, o array<double>, r string, h array<double>", exif.gps(*(F.col(c) for c in ("a", "ar", "o", "r", "h"))))
    assert got[0].latitude == 40 + 26 / 60 + 46 / 3600 and got[0].longitude == -(79 + 58 / 60 + 56 / 3600) and got[0].altitude == 12.5
    assert got[1].latitude == -10 and got[1].altitude is None and got[1].datum == "WGS84"
    assert got[2].latitude == 90 and got[3:] == [None] * 4


CAMERAS = [
    ("Sony", "SLT-A37", True, "dslr"), ("Canon", "EOS 5D Mark IV", True, "dslr"), ("NIKON", "D850", True, "dslr"), ("Apple", "iPhone 14 Pro", False, "mobile"), ("XIAOMI", "MI4", False, "mobile"), ("  Apple  ", " iPhone 14 ", False, "mobile"),
    ("Canon", "Canon EOS R5", True, "mirrorless"), ("Sony", "ILCE-A7M4", True, "mirrorless"), ("Nikon", "Z8", True, "mirrorless"), ("Sony", "DSC-RX100", False, "mirrorless"), ("GoPro", "HERO11 Black", False, "action_cam"), ("DJI", "Osmo Action 4", False, "action_cam"),
    ("Epson", "Perfection V600 Film Scanner", False, "film_scanner"), (None, None, False, "unknown"), ("", "Unknown Model", False, "unknown"), ("Leica", "M11", True, "unknown"), ("NIKON CORPORATION", "D850", True, "unknown"), ("   ", "Z8", False, "mirrorless"),
]


def test_camera_profile(spark):
    got = values(spark, [c[:3] for c in CAMERAS], "make string, model string, lens boolean", camera.camera_profile(F.col("make"), F.col("model"), F.col("lens")))
    assert got == [c[3] for c in CAMERAS]


def test_tags(spark):
    rows = [({"Image Make": "Canon ", "EXIF LensModel": "x", "EXIF CustomTag": "y", "EXIF ISOSpeedRatings": "100", "EXIF Blank": "  "}, {"EXIF ISOSpeedRatings": [100.7]})]
    df = spark.createDataFrame(rows, "t map<string,string>, n map<string,array<double>>")
    t, n = F.col("t"), F.col("n")
    r = df.select(exif.tag_text(t, "Image Make"), exif.tag_text(t, "EXIF Blank"), exif.tag_int(t, n, "EXIF ISOSpeedRatings"), exif.tag_double(t, n, "Nothing"), F.map_keys(exif.raw_tags(t))).first()
    assert r[0] == "Canon" and r[1] is None and r[2] == 100 and r[3] is None and sorted(r[4]) == ["EXIF Blank", "EXIF CustomTag", "EXIF LensModel"]


def test_flash_and_ratio(spark):
    assert values(spark, [("Flash Fired, auto",), ("off",), (None,), ("  ",)], "s string", exif.flash_fired(F.col("s"))) == [True, False, None, None]
    assert values(spark, [(1920, 1080), (5, 0)], "w int, h int", exif.aspect_ratio(F.col("w"), F.col("h"))) == [1920 / 1080, 0.0]


def test_suffix(spark):
    names = {"a.b.JPG": ".jpg", ".jpg": "", "foo.": "", "..jpg": ".jpg", "x": "", "a.png": ".png"}
    assert values(spark, [(n,) for n in names], "n string", paths.suffix(F.col("n"))) == list(names.values())
    with pytest.raises(ValueError):
        paths.has_suffix(F.col("n"), [])


def test_distance(spark):
    km = values(spark, [(48.8566, 2.3522)], "a double, o double", search.distance_km(F.col("a"), F.col("o"), 51.5074, -0.1278))[0]
    assert abs(km - 343.56) < 0.5


def test_large_numbers_have_a_text(spark):
    values = [1e12, -2.5e12, 123456789012345.0, 1e15, float("inf"), float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(numbers.fixed(F.col("x"), 1)).collect()]
    assert got == [*(f"{v:.1f}" for v in values[:4]), None, None, None]

"""Photo metadata fields as column expressions over decoded tags.

``tags`` maps a tag's name to its printable text, ``numbers`` to its values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from medialake.functions.numbers import fixed

# Tags that have fields of their own.
MAPPED_TAGS = (
    "Image Make", "Image Model", "EXIF ISOSpeedRatings", "EXIF FNumber", "EXIF ExposureTime", "EXIF FocalLength", "EXIF DateTimeOriginal", "EXIF DateTimeDigitized", "EXIF WhiteBalance", "EXIF ExposureProgram",
    "EXIF MeteringMode", "EXIF Flash", "EXIF FocalLengthIn35mmFilm", "Image Orientation", "GPS GPSLatitude", "GPS GPSLatitudeRef", "GPS GPSLongitude", "GPS GPSLongitudeRef", "GPS GPSAltitude", "GPS GPSAltitudeRef",
)


def strip(x: Column) -> Column:
    """Without outer white space of any kind; null if nothing is left."""
    return F.nullif(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit(""))


def tag_text(tags: Column, name: str) -> Column:
    return strip(F.try_element_at(tags, F.lit(name)))


def tag_double(tags: Column, numbers: Column, name: str) -> Column:
    """First value of the tag, else its text as a number, else null."""
    return F.coalesce(F.try_element_at(F.try_element_at(numbers, F.lit(name)), F.lit(1)), strip(F.try_element_at(tags, F.lit(name))).try_cast("double"))


def tag_int(tags: Column, numbers: Column, name: str) -> Column:
    first = F.try_element_at(F.try_element_at(numbers, F.lit(name)), F.lit(1))
    return F.coalesce(first.try_cast("int"), strip(F.try_element_at(tags, F.lit(name))).try_cast("int"))


def exposure_text(v: Column) -> Column:
    """Seconds as ``0``, ``2.0"``, ``1/160`` or ``0.0030s``."""
    inverse = F.when(v != 0, F.lit(1.0) / v)
    near = F.abs(inverse - F.rint(inverse)) < 0.01
    return F.when(v == 0, "0").when(v >= 1, F.concat(fixed(v, 1), F.lit('"'))).when(near, F.concat(F.lit("1/"), F.rint(inverse).try_cast("bigint").cast("string"))).otherwise(F.concat(fixed(v, 4), F.lit("s")))


def focal_text(v: Column) -> Column:
    """Millimetres as ``35mm`` or ``50.5mm``."""
    whole = v.try_cast("bigint")
    return F.concat(F.when(v == whole, whole.cast("string")).otherwise(fixed(v, 1)), F.lit("mm"))


def exif_datetime(s: Column) -> Column:
    """``2022:09:21 19:49:51`` as a time without zone; a blank after a colon is allowed; null if not a time."""
    plain = F.regexp_replace(F.replace(s, F.lit(": "), F.lit(":")), r"^\s+|\s+$", "")
    shaped = F.regexp_like(plain, F.lit(r"^\d{4}:\d{1,2}:\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$"))
    iso = F.regexp_replace(plain, r"^(\d{4}):(\d{1,2}):(\d{1,2})\s+(.*)$", "$1-$2-$3 $4")
    return F.when(shaped, iso.try_cast("timestamp_ntz"))


def captured_at(original: Column, digitized: Column, modified: Column) -> Column:
    """The first of the two texts that is there, parsed; else the file's time."""
    return F.coalesce(exif_datetime(F.coalesce(strip(original), strip(digitized))), modified)


def degrees(dms: Column, ref: Column, negative: str) -> Column:
    at = lambda i: F.try_element_at(dms, F.lit(i))
    value = at(1) + at(2) / 60 + at(3) / 3600
    return F.when(ref == negative, -value).otherwise(value)


def gps(lat: Column, lat_ref: Column, lon: Column, lon_ref: Column, altitude: Column) -> Column:
    """Location struct; null if a part is missing or out of range."""
    y, x = degrees(lat, lat_ref, "S"), degrees(lon, lon_ref, "W")
    there = lat_ref.isNotNull() & lon_ref.isNotNull() & (lat_ref != "") & (lon_ref != "")
    ok = there & y.between(-90, 90) & x.between(-180, 180)
    return F.when(ok, F.struct(y.alias("latitude"), x.alias("longitude"), F.try_element_at(altitude, F.lit(1)).alias("altitude"), F.lit("WGS84").alias("datum")))


def flash_fired(flash: Column) -> Column:
    return F.contains(F.lower(strip(flash)), F.lit("fired"))


def raw_tags(tags: Column) -> Column:
    return F.map_filter(tags, lambda k, v: ~k.isin(*MAPPED_TAGS))


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(height > 0, width / height).otherwise(F.lit(0.0))


def exif_struct(tags: Column, numbers: Column, modified: Column) -> Column:
    """All photo fields of the library's ``exif`` column."""
    from medialake.functions.camera import camera_profile

    text = lambda n: tag_text(tags, n)
    values = lambda n: F.try_element_at(numbers, F.lit(n))
    make, model = text("Image Make"), text("Image Model")
    plain = lambda n: F.try_element_at(tags, F.lit(n))
    return F.struct(
        make.alias("camera_make"), model.alias("camera_model"), tag_double(tags, numbers, "EXIF FNumber").alias("f_stop"),
        exposure_text(tag_double(tags, numbers, "EXIF ExposureTime")).alias("exposure_time"), tag_int(tags, numbers, "EXIF ISOSpeedRatings").alias("iso"),
        focal_text(tag_double(tags, numbers, "EXIF FocalLength")).alias("focal_length"),
        captured_at(plain("EXIF DateTimeOriginal"), plain("EXIF DateTimeDigitized"), modified).alias("captured_at"),
        camera_profile(make, model, F.map_contains_key(tags, F.lit("EXIF LensModel"))).alias("camera_profile"),
        gps(values("GPS GPSLatitude"), plain("GPS GPSLatitudeRef"), values("GPS GPSLongitude"), plain("GPS GPSLongitudeRef"), values("GPS GPSAltitude")).alias("location"),
        flash_fired(plain("EXIF Flash")).alias("flash_fired"), focal_text(tag_double(tags, numbers, "EXIF FocalLengthIn35mmFilm")).alias("focal_length_35mm"),
        text("EXIF WhiteBalance").alias("white_balance_mode"), text("EXIF ExposureProgram").alias("exposure_program"), text("EXIF MeteringMode").alias("metering_mode"),
        tag_int(tags, numbers, "Image Orientation").alias("orientation"), raw_tags(tags).alias("raw_tags"),
    )

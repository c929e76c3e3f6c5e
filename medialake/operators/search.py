"""Search by date, camera, place and labels.

Our own semantics: dates are inclusive whole days of ``captured_at``; camera
is a part of the model's name, in any case; place is within a radius on a
sphere; labels match any (or all) of those given; all conditions hold at once;
results come by time, then hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def distance_km(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Great-circle distance (haversine)."""
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), 2) + F.cos(F.radians(lat)) * math.cos(math.radians(lat0)) * F.pow(F.sin(F.radians(lon - lon0) / 2), 2)
    return F.asin(F.least(F.lit(1.0), F.sqrt(a))) * (2 * EARTH_KM)


def within(lat: Column, lon: Column, lat0: float, lon0: float, radius_km: float) -> Column:
    """At most ``radius_km`` away; a band of latitudes first, which scans can use."""
    band = math.degrees(radius_km / EARTH_KM) + 1e-6
    return lat.between(lat0 - band, lat0 + band) & (distance_km(lat, lon, lat0, lon0) <= radius_km)


def between_days(t: Column, first: str | None, last: str | None) -> Column:
    out = F.lit(True)
    if first:
        out &= t >= F.lit(first).cast("date").cast("timestamp_ntz")
    if last:
        out &= t < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")
    return out


def search(library: DataFrame, date_from: str | None = None, date_to: str | None = None, camera: str | None = None, location: tuple[float, float, float] | None = None, tags: list[str] | None = None, match: str = "any") -> DataFrame:
    out = library
    if date_from or date_to:
        out = out.where(between_days(F.col("exif.captured_at"), date_from, date_to))
    if camera:
        out = out.where(F.contains(F.lower("exif.camera_model"), F.lower(F.lit(camera))))
    if location:
        out = out.where(within(F.col("exif.location.latitude"), F.col("exif.location.longitude"), *location))
    if tags:
        wanted = F.array(*map(F.lit, tags))
        hit = F.arrays_overlap("labels", wanted) if match == "any" else F.size(F.array_except(wanted, F.col("labels"))) == 0
        out = out.where(hit)
    return out.orderBy("exif.captured_at", "file_hash")

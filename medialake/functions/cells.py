"""Places as cells on a Z-order curve, and circles as intervals of cells.

A cell's number takes turns between the bits of latitude and longitude, so rows
sorted by it lie near their neighbours, and a quarter of a quarter ... of the
world is one interval of numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 16  # of each coordinate: cells of about 300 m by 600 m at most
EARTH_KM = 6371.0088

# Shifts and masks that put a zero bit before each bit of 16.
_SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _spread(x: Column) -> Column:
    for shift, mask in _SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _step(degrees: Column, span: float) -> Column:
    """0 to 2^BITS - 1 over a span of degrees that starts at its negative half."""
    return F.least(F.greatest(F.floor((degrees + span / 2) / span * (1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")


def cell(lat: Column, lon: Column) -> Column:
    """Cell of a place; null without one."""
    return F.shiftleft(_spread(_step(lat, 180.0)), 1).bitwiseOR(_spread(_step(lon, 360.0)))


def boxes(lat: float, lon: float, radius_km: float) -> list[tuple[float, float, float, float]]:
    """(south, north, west, east) of boxes that hold a circle; all longitudes where it reaches a pole, two boxes across the date line."""
    r = radius_km / EARTH_KM + 1e-9
    south, north = lat - math.degrees(r), lat + math.degrees(r)
    if south <= -90 or north >= 90 or r >= math.pi / 2:
        return [(max(south, -90.0), min(north, 90.0), -180.0, 180.0)]
    half = math.degrees(math.asin(min(1.0, math.sin(r) / math.cos(math.radians(lat))))) + 1e-6
    west, east = lon - half, lon + half
    if half >= 180:
        return [(south, north, -180.0, 180.0)]
    if west < -180:
        return [(south, north, -180.0, east), (south, north, west + 360, 180.0)]
    if east > 180:
        return [(south, north, west, 180.0), (south, north, -180.0, east - 360)]
    return [(south, north, west, east)]


def cover(lat: float, lon: float, radius_km: float, most: int = 64) -> list[tuple[int, int]]:
    """Intervals of cells, both ends included, that hold all places of the circle; ``most`` or a few more.

    Squares are quartered, those that meet the circle's boxes kept, until more
    would be too many.
    """
    wanted = boxes(lat, lon, radius_km)

    def meets(y: int, x: int, level: int) -> bool:
        high, wide = 180 / (1 << level), 360 / (1 << level)
        s, w = y * high - 90, x * wide - 180
        return any(s <= north and s + high >= south and w <= east and w + wide >= west for south, north, west, east in wanted)

    squares, level = [(0, 0, 0)], 0  # y, x, number
    while level < BITS:
        finer = [(2 * y + a, 2 * x + b, 4 * z + 2 * a + b) for y, x, z in squares for a in (0, 1) for b in (0, 1)]
        finer = [q for q in finer if meets(q[0], q[1], level + 1)]
        if len(finer) > most:
            break
        squares, level = finer, level + 1
    size = 1 << 2 * (BITS - level)
    out: list[tuple[int, int]] = []
    for z in sorted(q[2] for q in squares):
        if out and out[-1][1] + 1 == z * size:
            out[-1] = out[-1][0], (z + 1) * size - 1
        else:
            out.append((z * size, (z + 1) * size - 1))
    return out


def among(cells: Column, intervals: list[tuple[int, int]]) -> Column:
    """Whether a cell lies in one of the intervals; each is a condition that a scan can use."""
    hit = F.lit(False)
    for low, high in intervals:
        hit |= cells.between(low, high)
    return hit

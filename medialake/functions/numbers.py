"""Exact fixed-point text of doubles, in built-in column arithmetic.

``format_string('%.1f')`` rounds the shortest decimal half up; here the binary
value itself is rounded, ties to even.  The product of the value and a small
integer is split into a rounded part and its exact error (Dekker), so a value
just off a tie is told from a true tie.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _scaled(x: Column, factor: int) -> tuple[Column, Column]:
    """(rounded product, its error): their sum is exactly ``x * factor``."""
    product = x * F.lit(float(factor))
    spread = x * F.lit(134217729.0)
    high = spread - (spread - x)
    error = (high * F.lit(float(factor)) - product) + (x - high) * F.lit(float(factor))
    return product, error


def rounded(x: Column, digits: int) -> Column:
    """``x * 10**digits`` rounded to the nearest integer, ties to even, as a double."""
    product, error = _scaled(x, 2 * 10**digits)
    half = product / 2
    tie = half - F.floor(half) == 0.5
    return F.when(tie & (error > 0), F.ceil(half).cast("double")).when(tie & (error < 0), F.floor(half).cast("double")).otherwise(F.rint(half))


def fixed(x: Column, digits: int) -> Column:
    """Text of ``x`` with ``digits`` decimals; null for null, nan and infinities.

    From 10**12 on, where doubles have no more decimals to round than a few, by
    ``format_string``.
    """
    n = rounded(F.abs(x), digits).cast("long")
    unit = 10**digits
    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
    text = F.concat(sign, F.floor(n / unit).cast("long").cast("string"), F.lit("."), F.lpad((n % unit).cast("string"), digits, "0"))
    return F.when(F.abs(x) < 1e12, text).when(F.abs(x) < float("inf"), F.format_string(f"%.{digits}f", x))

"""Names, suffixes and media types of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes indexed by default.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".tiff", ".tif", ".bmp", ".gif", ".webp", ".heic", ".heif", ".raw", ".cr2", ".nef", ".arw", ".dng")

#: Media types by suffix; others are octet streams.
MIME_TYPES = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".tiff": "image/tiff", ".tif": "image/tiff", ".bmp": "image/bmp", ".gif": "image/gif", ".webp": "image/webp",
    ".heic": "image/heic", ".heif": "image/heif", ".cr2": "image/x-canon-cr2", ".nef": "image/x-nikon-nef", ".txt": "text/plain",
}
DEFAULT_MIME = "application/octet-stream"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(filename: Column) -> Column:
    """Lower-case suffix with its dot; empty for ``.hidden``, ``name.`` and names without one."""
    return F.lower(F.regexp_extract(filename, r"(?s)^.+(\.[^.]+)$", 1))


def has_suffix(filename: Column, suffixes) -> Column:
    wanted = sorted({s.lower() for s in suffixes})
    if not wanted:
        raise ValueError("no suffixes given")
    return suffix(filename).isin(*wanted)


def mime_type(filename: Column) -> Column:
    out = F.lit(DEFAULT_MIME)
    for s, kind in MIME_TYPES.items():
        out = F.when(suffix(filename) == s, kind).otherwise(out)
    return out


def is_directory_marker(key: Column) -> Column:
    return F.endswith(key, F.lit("/"))

"""Decoding stage: files to hashes, tags and sizes; errors become columns."""

from __future__ import annotations

import hashlib
import io

import pandas as pd
from pyspark.sql import DataFrame

from medialake.schemas import DECODED
from medialake.sources.image_bytes import read_size, read_tags
from medialake.sources.opening import FileBytes, open_input

CHUNK = 64 * 1024


def hash_stream(file) -> str:
    """SHA-256 of an open file, read in chunks."""
    digest = hashlib.sha256()
    while block := file.read(CHUNK):
        digest.update(block)
    return digest.hexdigest()


def hash_file(path: str) -> str:
    """SHA-256 of a file on a disk or in an object store."""
    with open_input(path) as f:
        return hash_stream(f)


def _decode_one(path: str, data: bytes | None = None):
    """DECODED values; of a file, its bytes pass by once for the hash, and the pages with tags are sought."""
    try:
        with open_input(path) if data is None else io.BytesIO(data) as f:
            found = hash_stream(f)
            view = FileBytes(f)
            tags, numbers = read_tags(view)
            width, height = read_size(view)
        return found, width, height, tags, numbers, None, None
    # Fixed value: wording of a file that went meanwhile.
    except FileNotFoundError as e:
        return None, 0, 0, {}, {}, f"race-condition (file disappeared): {path}", type(e).__name__
    except OSError as e:
        return None, 0, 0, {}, {}, str(e), type(e).__name__


def decode(files: DataFrame, path_col: str = "original_path") -> DataFrame:
    """``files`` with the DECODED columns; no file is held in memory: a few pages of it are.

    A column ``content``, as listings of object stores have it, is read instead
    of the file, and left out of the result.
    """
    names = [c.split()[0] for c in DECODED.split(", ")]

    def run(batches):
        for pdf in batches:
            data = pdf.pop("content") if "content" in pdf else [None] * len(pdf)
            rows = pd.DataFrame([_decode_one(p, x) for p, x in zip(pdf[path_col], data)], columns=names, index=pdf.index)
            yield pd.concat([pdf, rows], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != "content")
    return files.mapInPandas(run, f"{schema}, {DECODED}")


def hashed(rows: DataFrame, path_col: str = "norm_path") -> DataFrame:
    """``rows`` with current_hash and hash_error of their files, read in chunks."""

    def run(batches):
        for pdf in batches:
            found = []
            for p in pdf[path_col]:
                try:
                    found.append((hash_file(p), None))
                except OSError as e:
                    found.append((None, str(e)))
            yield pd.concat([pdf, pd.DataFrame(found, columns=["current_hash", "hash_error"], index=pdf.index)], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, current_hash string, hash_error string")

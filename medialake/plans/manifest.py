"""Log of a library: one manifest for each version, which names its files and sums up each.

A manifest is a small text made only if its version has none yet, so of two
writers who start from the same version one comes first and the other starts
again from the new state.  It grows with the number of files, not of rows.
"""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from medialake.sources.folder import Folder

_LOG = "log"


@dataclass(frozen=True)
class DataFile:
    """A data file: rows of one bucket, and what lets a reader pass over it or count without it.

    ``cells`` and ``times`` are the least and the greatest, None if no row has
    one; ``kinds`` maps a media type to (rows, bytes of the images).
    """

    path: str
    bucket: int
    rows: int
    top: int
    cells: tuple[int, int] | None
    times: tuple[str, str] | None
    kinds: dict[str, tuple[int, int]]


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    buckets: int = 16
    top: int = -1  # the greatest number that any row has ever had
    files: tuple[DataFile, ...] = ()
    generations: tuple[str, ...] = field(default=())  # of the index of paths, oldest first

    def within(self, buckets) -> list[DataFile]:
        wanted = set(buckets)
        return [f for f in self.files if f.bucket in wanted]

    def count(self) -> int:
        return sum(f.rows for f in self.files)

    def kinds(self) -> dict[str, tuple[int, int]]:
        out: dict[str, tuple[int, int]] = {}
        for f in self.files:
            for kind, (n, size) in f.kinds.items():
                rows, total = out.get(kind, (0, 0))
                out[kind] = rows + n, total + size
        return out

    def text(self) -> str:
        return json.dumps(dataclasses.asdict(self))


def parsed(text: str) -> Manifest:
    raw = json.loads(text)
    pair = lambda x: tuple(x) if x is not None else None
    files = tuple(DataFile(**f | {"cells": pair(f["cells"]), "times": pair(f["times"]), "kinds": {k: tuple(v) for k, v in f["kinds"].items()}}) for f in raw["files"])
    return Manifest(**raw | {"files": files, "generations": tuple(raw["generations"])})


class Log:
    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def versions(self) -> list[int]:
        return sorted(int(f.rpartition("/")[2].removesuffix(".json")) for f in self.folder.files(_LOG) if f.endswith(".json"))

    def at(self, version: int) -> Manifest:
        return parsed(self.folder.read(f"{_LOG}/{version:020d}.json"))

    def latest(self) -> Manifest | None:
        found = self.versions()
        return self.at(found[-1]) if found else None

    def create(self, manifest: Manifest) -> bool:
        """False if another writer made this version."""
        return self.folder.create(f"{_LOG}/{manifest.version:020d}.json", manifest.text())

    def forget(self, version: int) -> None:
        self.folder.remove(f"{_LOG}/{version:020d}.json")

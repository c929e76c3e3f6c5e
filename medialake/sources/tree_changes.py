"""Streaming source of what changes in a directory tree: new, edited and deleted files.

An offset is the number of a *listing*.  A micro-batch from listing 3 to 4 is
the difference of the two.  Tasks make listings: each lists some subtrees,
compares them with what listing 3 has of them, emits what differs, and writes
its part of listing 4 in the state folder before it emits.  A batch that runs
again finds that part and emits the same rows, whatever has happened on disk
meanwhile; what came later is left to listing 5.  Listings before the last
committed one are removed.

The tree is cut at a fixed depth: folders above it are listed alone, those at
it with all that lies below, so a subtree has the same name in each listing.
The driver opens the folders above that depth only.  The state folder must be
one that the driver and all executors see, as the tree itself must be.

A file is new, or edited if its size or time differs; a renamed one is one
deleted and one new.  What lies in a folder that cannot be opened is taken to
be as it was, and an error row tells of the folder.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import uuid

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from medialake.schemas import FILE_SCHEMA
from medialake.sources.walk import FAILED, kind_of, list_folder, stat_row

CHANGE_SCHEMA = f"{FILE_SCHEMA}, kind string, state string, listing long"
_SUBTREES = "subtrees.json"


def _write(path: str, value) -> None:
    """Make a file whole or not at all."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "w", encoding="utf-8", errors="surrogateescape") as f:
        json.dump(value, f)
    os.replace(draft, path)


def _read(path: str):
    with open(path, encoding="utf-8", errors="surrogateescape") as f:
        return json.load(f)


def subtrees(root: str, depth: int) -> list[tuple[str, bool]]:
    """(folder, whether with all below it): folders above ``depth`` alone, those at it whole."""
    out, level = [], [root]
    for _ in range(depth):
        out += [(f, False) for f in level]
        below = []
        for folder in level:
            with contextlib.suppress(OSError), os.scandir(folder) as found:
                below += [e.path for e in found if e.is_dir(follow_symlinks=False)]
        level = sorted(below)
    return out + [(f, True) for f in level]


class Span(InputPartition):
    def __init__(self, start: int, end: int, folders: list[tuple[str, bool]]):
        self.start, self.end, self.folders = start, end, folders


class _ChangeReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.state = options["path"], options["state"]
        self.parts, self.depth = int(options.get("partitions", "8")), int(options.get("depth", "2"))

    # --- listings -----------------------------------------------------------------
    def _part(self, listing: int, folder: str, down: bool) -> str:
        name = hashlib.sha256(f"{int(down)}{folder}".encode("utf-8", "surrogateescape")).hexdigest()
        return os.path.join(self.state, str(listing), f"{name}.json")

    def _listings(self) -> list[int]:
        with contextlib.suppress(FileNotFoundError):
            return sorted(int(n) for n in os.listdir(self.state) if n.isdigit())
        return []

    def initialOffset(self):
        return {"listing": 0}

    def latestOffset(self):
        return {"listing": max(self._listings(), default=0) + 1}

    def partitions(self, start, end):
        """Subtrees that are there now or were in the listing before; those of a batch that runs again are the same."""
        plan = os.path.join(self.state, str(end["listing"]), _SUBTREES)
        if not os.path.exists(plan):
            known = []
            with contextlib.suppress(FileNotFoundError):
                known = [tuple(x) for x in _read(os.path.join(self.state, str(start["listing"]), _SUBTREES))]
            _write(plan, sorted({*subtrees(self.root, self.depth), *known}))
        work = [tuple(x) for x in _read(plan)]
        n = max(1, min(self.parts, len(work)))
        return [Span(start["listing"], end["listing"], work[i::n]) for i in range(n)]

    def _listed(self, folder: str, down: bool, before: dict[str, list]) -> dict[str, list]:
        """Path to its FILE_SCHEMA values and kind (times as text), of a subtree as it is; failures under the folder's path and a null byte."""
        found, lost = {}, []
        if not os.path.lexists(folder):
            return found
        for path, name in list_folder(folder, down):
            row = stat_row(path, name)
            if row is None:
                continue
            if row[5] is not None:
                lost.append(path)
                found[path + "\0"] = [*row[:3], None, row[4], row[5], FAILED]
            else:
                found[path] = [*row[:3], row[3].isoformat(), row[4], None, kind_of(name)]
        for path, old in before.items():
            if path not in found and any(path == x or path.startswith(x.rstrip("/") + "/") for x in lost):
                found[path] = old
        return found

    def _listing(self, at: int, folder: str, down: bool) -> dict[str, list]:
        try:
            return _read(self._part(at, folder, down))
        except FileNotFoundError:
            return {}

    def read(self, partition):
        import datetime

        for folder, down in partition.folders:
            before = {p: v for p, v in self._listing(partition.start, folder, down).items() if not p.endswith("\0")}
            place = self._part(partition.end, folder, down)
            if not os.path.exists(place):
                _write(place, self._listed(folder, down, before))
            now = _read(place)
            for path, row in now.items():
                old = before.get(path)
                if row[5] is not None:
                    state = "ERROR"
                elif old is None:
                    state = "NEW"
                elif old[2:4] != row[2:4]:
                    state = "MODIFIED"
                else:
                    continue
                time = datetime.datetime.fromisoformat(row[3]) if row[3] else None
                yield row[0], row[1], row[2], time, row[4], row[5], row[6], state, partition.end
            for path in before.keys() - now.keys():
                old = before[path]
                yield path, old[1], None, None, old[4], None, old[6], "DELETED", partition.end

    def commit(self, end):
        for n in self._listings():
            if n < end["listing"]:
                folder = os.path.join(self.state, str(n))
                for name in os.listdir(folder):
                    os.unlink(os.path.join(folder, name))
                os.rmdir(folder)


class TreeChanges(DataSource):
    """``spark.readStream.format("tree_changes").option("state", folder).load(root)``; options partitions and depth."""

    @classmethod
    def name(cls):
        return "tree_changes"

    def schema(self):
        return CHANGE_SCHEMA

    def streamReader(self, schema):
        return _ChangeReader(self.options)

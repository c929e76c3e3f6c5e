"""Data source that lists a directory tree.

Hidden and empty files are listed, links to files too; links to directories
are not followed.  The driver opens only enough directories to deal subtrees
to tasks; the tasks list and stat the files.

Conditions on suffix, on the start of the path and on the size are pushed into
the listing: folders that cannot hold a hit are never opened, and files of
other suffixes never looked at.
"""

from __future__ import annotations

import contextlib
import datetime
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from medialake.schemas import FILE_SCHEMA

#: A file's suffix in lower case with its dot, ``FAILED`` for what could not be listed.
WALK_SCHEMA = f"{FILE_SCHEMA}, kind string"
FAILED = "!"
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Subtree(InputPartition):
    def __init__(self, folders: list[tuple[str, bool]]):
        self.folders = folders  # (folder, whether to go down)


@dataclass
class Wanted:
    """What a reader was asked for; None for all."""

    kinds: frozenset[str] | None = None
    prefixes: tuple[str, ...] = ()
    least: int | None = None
    most: int | None = None

    def folder(self, folder: str) -> bool:
        """Whether what lies below ``folder`` may start with each prefix."""
        inside = folder.rstrip("/") + "/"
        return all(inside.startswith(p) or p.startswith(inside) for p in self.prefixes)

    def path(self, path: str) -> bool:
        return all(path.startswith(p) for p in self.prefixes)

    def kind(self, kind: str) -> bool:
        return self.kinds is None or kind in self.kinds

    def size(self, size: int) -> bool:
        return (self.least is None or size >= self.least) and (self.most is None or size <= self.most)


def kind_of(name: str) -> str:
    """Suffix of a name as ``functions.paths.suffix`` gives it."""
    stem, dot, end = name.rpartition(".")
    return f".{end}".lower() if stem and dot and end else ""


def deal(root: str, parts: int, wanted: Wanted = Wanted()) -> list[Subtree]:  # noqa: B008
    """Folders to list alone, and subtrees, dealt to about ``parts`` partitions."""
    flat, deep = [], [root] if wanted.folder(root) else []
    while deep and len(deep) < 4 * parts:
        level = []
        for folder in deep:
            flat.append((folder, False))  # if it cannot be opened, the task says so
            with contextlib.suppress(OSError), os.scandir(folder) as found:
                level += [e.path for e in found if e.is_dir(follow_symlinks=False) and wanted.folder(e.path)]
        deep = sorted(level)
    work = flat + [(f, True) for f in deep]
    parts = max(1, min(parts, len(work)))
    return [Subtree(work[i::parts]) for i in range(parts)]


def list_folder(folder: str, down: bool, wanted: Wanted = Wanted()):  # noqa: B008
    """(path, name) of what is no folder; (folder, the error) of a folder that cannot be opened."""
    failed: list[OSError] = []
    if down:
        for top, below, names in os.walk(folder, followlinks=False, onerror=failed.append):
            below[:] = [d for d in below if wanted.folder(os.path.join(top, d))]
            for n in names:
                yield os.path.join(top, n), n
    else:
        try:
            with os.scandir(folder) as found:
                for e in found:
                    if not e.is_dir(follow_symlinks=True):
                        yield e.path, e.name
        except OSError as e:
            failed.append(e)
    for e in failed:
        yield e.filename or folder, e


def stat_row(path: str, name: str | OSError):
    """One FILE_SCHEMA row; None for what is not a file."""
    if isinstance(name, OSError):
        return path, None, None, None, None, f"list error: {path}: {name}"
    try:
        if not os.path.isfile(path):
            return None
        s = os.stat(path)
        return path, name, s.st_size, datetime.datetime.fromtimestamp(s.st_mtime), os.path.realpath(path), None
    except OSError as e:
        return path, name, None, None, None, f"stat error: {path}: {e}"


class _WalkReader(DataSourceReader):
    def __init__(self, options):
        self.root = options.get("path")
        self.parts = int(options.get("partitions", "8"))
        self.wanted = Wanted()

    def pushFilters(self, filters):
        """Takes what the listing can use; sizes are left to Spark too, as a row that failed has none."""
        w = self.wanted
        for f in filters:
            match f:
                case In(("kind",), values) if w.kinds is None:
                    w.kinds = frozenset(values)
                    continue
                case EqualTo(("kind",), value) if w.kinds is None:
                    w.kinds = frozenset([value])
                    continue
                case StringStartsWith(("original_path",), value):
                    w.prefixes += (value,)
                    continue
                case GreaterThan(("size_bytes",), n) | GreaterThanOrEqual(("size_bytes",), n):
                    w.least = n if w.least is None else max(n, w.least)
                case LessThan(("size_bytes",), n) | LessThanOrEqual(("size_bytes",), n):
                    w.most = n if w.most is None else min(n, w.most)
            yield f

    def partitions(self):
        return deal(self.root, self.parts, self.wanted)

    def read(self, partition):
        w = self.wanted
        for folder, down in partition.folders:
            for path, name in list_folder(folder, down, w):
                kind = FAILED if isinstance(name, OSError) else kind_of(name)
                if w.kind(kind) and w.path(path):
                    row = stat_row(path, name)
                    if row and (row[2] is None or w.size(row[2])):
                        yield *row, kind


class WalkSource(DataSource):
    @classmethod
    def name(cls):
        return "file_walk"

    def schema(self):
        return WALK_SCHEMA

    def reader(self, schema):
        return _WalkReader(self.options)


def list_files(spark: SparkSession, root: str, suffixes=None, partitions: int | None = None) -> DataFrame:
    """FILE_SCHEMA rows of the files below ``root``, of the given suffixes if any, and of folders that cannot be opened.

    ``partitions``: by default four for each core of the cluster.  Conditions
    that a caller adds on the start of ``original_path`` and on ``size_bytes``
    reach the listing as well.
    """
    if not root or not os.path.isdir(root):
        raise NotADirectoryError(str(root))
    spark.dataSource.register(WalkSource)
    spark.conf.set(_PUSHDOWN, "true")
    files = spark.read.format("file_walk").option("partitions", str(partitions or 4 * spark.sparkContext.defaultParallelism)).load(root)
    if suffixes is not None:
        kinds = sorted({x.lower() for x in suffixes})
        if not kinds:
            raise ValueError("no suffixes given")
        files = files.where(files.kind.isin(*kinds, FAILED))
    return files.drop("kind")

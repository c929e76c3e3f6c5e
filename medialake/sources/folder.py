"""Small files of a folder on a local disk or in any store that Hadoop knows: names, texts, removal.

``create`` makes a file only if there is none of that name, and whole or not at
all: on a local disk by a hard link, elsewhere by the store's rename, which
refuses a name that exists (HDFS; object stores need a committer that does).
"""

from __future__ import annotations

import contextlib
import os
import time
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def local_path(path: str) -> str | None:
    """Path on a local disk; None for another store."""
    parsed = urlparse(path)
    return parsed.path if parsed.scheme == "file" else None if parsed.scheme else path


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.local = spark, path.rstrip("/"), local_path(path.rstrip("/"))

    def _hadoop(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def files(self, name: str = "") -> list[str]:
        """Files below folder ``name``, relative to this one, without hidden ones; none if it does not exist."""
        if self.local is not None:
            found = [os.path.relpath(os.path.join(d, f), self.local) for d, _, names in os.walk(os.path.join(self.local, name)) for f in names]
        else:
            fs, place = self._hadoop(name)
            found = []
            if fs.exists(place):
                each, root = fs.listFiles(place, True), fs.makeQualified(self._hadoop("")[1]).toString()
                while each.hasNext():
                    found.append(each.next().getPath().toString().removeprefix(root + "/"))
        return sorted(f for f in found if not os.path.basename(f).startswith((".", "_")))

    def read(self, name: str) -> str:
        if self.local is not None:
            with open(os.path.join(self.local, name), encoding="utf-8") as f:
                return f.read()
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]

    def create(self, name: str, text: str) -> bool:
        """False if there is a file ``name`` already."""
        if self.local is not None:
            target = os.path.join(self.local, name)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            draft = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}")
            with open(draft, "x", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(draft, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        head, _, tail = name.rpartition("/")
        (fs, target), (_, draft) = self._hadoop(name), self._hadoop(f"{head}/.{tail}-{uuid.uuid4().hex}")
        if fs.exists(target):
            return False
        out = fs.create(draft, False)
        out.write(text.encode())
        out.close()
        if fs.rename(draft, target):
            return True
        fs.delete(draft, False)
        return False

    def age(self, name: str) -> float:
        """Seconds since a file was written."""
        if self.local is not None:
            return time.time() - os.stat(os.path.join(self.local, name)).st_mtime
        fs, place = self._hadoop(name)
        return time.time() - fs.getFileStatus(place).getModificationTime() / 1000

    def remove(self, name: str) -> None:
        if self.local is not None:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(os.path.join(self.local, name))
            with contextlib.suppress(FileNotFoundError):
                os.unlink(os.path.join(self.local, os.path.dirname(name), f".{os.path.basename(name)}.crc"))
        else:
            fs, place = self._hadoop(name)
            fs.delete(place, False)

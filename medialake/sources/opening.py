"""Opening files on disks and in object stores, and reading parts of them as if they were bytes."""

from __future__ import annotations

import os
from collections import OrderedDict
from urllib.parse import unquote

PAGE, PAGES = 1 << 16, 64


def open_input(path: str):
    """A seekable file; of an object store by its URI, through Arrow's own clients.

    Raises OSError (FileNotFoundError where there is no such file).
    """
    scheme, colon, rest = path.partition(":")
    if not colon or len(scheme) < 2 or not scheme.isalnum() or not rest.startswith("/"):  # a plain path
        return open(path, "rb")
    if scheme == "file":
        plain = "/" + rest.lstrip("/")
        return open(plain if os.path.exists(plain) else unquote(plain), "rb")
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else path)
    return store.open_input_file(place)


class FileBytes:
    """Bytes of a seekable file, by index and slice; a few pages are held at a time."""

    def __init__(self, file):
        self.file, self.pages = file, OrderedDict()
        file.seek(0, os.SEEK_END)
        self.size = file.tell()

    def __len__(self) -> int:
        return self.size

    def _page(self, k: int) -> bytes:
        if k not in self.pages:
            self.file.seek(k * PAGE)
            self.pages[k] = self.file.read(PAGE)
            if len(self.pages) > PAGES:
                self.pages.popitem(last=False)
        self.pages.move_to_end(k)
        return self.pages[k]

    def __getitem__(self, key):
        if isinstance(key, int):
            if key >= self.size:
                raise IndexError(key)
            return self._page(key // PAGE)[key % PAGE]
        start, stop, _ = key.indices(self.size)
        if stop - start > PAGE:  # no page is worth keeping
            self.file.seek(start)
            return self.file.read(stop - start)
        parts, at = [], start
        while at < stop:
            page = self._page(at // PAGE)
            take = page[at % PAGE : at % PAGE + stop - at]
            if not take:
                break
            parts.append(take)
            at += len(take)
        return b"".join(parts)


class Part:
    """A stretch of bytes of another object, none of which is read before it is asked for."""

    def __init__(self, data, start: int, stop: int):
        self.data, self.start, self.size = data, start, max(0, min(stop, len(data)) - start)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, key):
        if isinstance(key, int):
            if key >= self.size:
                raise IndexError(key)
            return self.data[self.start + key]
        start, stop, _ = key.indices(self.size)
        return self.data[self.start + start : self.start + max(start, stop)]

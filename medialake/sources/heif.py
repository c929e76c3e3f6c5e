"""Size and tags of HEIC and HEIF files from their boxes."""

from __future__ import annotations

from medialake.sources.opening import Part

# Brands of files with still pictures.
BRANDS = {b"heic", b"heix", b"heim", b"heis", b"hevc", b"hevx", b"mif1", b"msf1", b"heif", b"avif"}


def is_heif(data) -> bool:
    return data[4:8] == b"ftyp" and bool({data[8:12], *(data[i : i + 4] for i in range(16, min(_int(data[:4]), 256), 4))} & BRANDS)


def _int(raw: bytes) -> int:
    return int.from_bytes(raw, "big")


def boxes(data, at: int = 0):
    """(type, content) of the boxes that follow each other from ``at`` on."""
    while at + 8 <= len(data):
        size, kind, head = _int(data[at : at + 4]), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = _int(data[at + 8 : at + 16]), 16
        size = size or len(data) - at  # 0: up to the end
        if size < head:
            return
        yield kind, Part(data, at + head, at + size)
        at += size


def _first(data, kind: bytes, at: int = 0):
    return next((b for k, b in boxes(data, at) if k == kind), None)


class _Numbers:
    """Reads numbers of given lengths one after the other."""

    def __init__(self, data, at: int = 0):
        self.data, self.at = data, at

    def take(self, size: int) -> int:
        if self.at + size > len(self.data):
            raise ValueError("box ends early")
        self.at += size
        return _int(self.data[self.at - size : self.at])


def _exif_item(meta) -> int | None:
    """Number of the item that holds the tags."""
    info = _first(meta, b"iinf", 4)
    if info is None:
        return None
    for kind, item in boxes(info, 6 if info[0] == 0 else 8):
        if kind == b"infe" and item[0] >= 2:
            wide = 2 if item[0] == 2 else 4
            if item[4 + wide + 2 : 4 + wide + 6] == b"Exif":
                return _int(item[4 : 4 + wide])
    return None


def _content(data, meta, wanted: int):
    """Bytes of an item, by its first extent."""
    place = _first(meta, b"iloc", 4)
    if place is None:
        return None
    version, n = place[0], _Numbers(place, 4)
    sizes = n.take(2)
    offset, length, base, index = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0
    for _ in range(n.take(4 if version == 2 else 2)):
        item, method = n.take(4 if version == 2 else 2), n.take(2) & 15 if version else 0
        n.take(2)
        start, found = n.take(base), None
        for _ in range(n.take(2)):
            n.take(index)
            at, size = n.take(offset), n.take(length)
            found = found or (start + at, size)
        if item == wanted and found:
            inside = data if method == 0 else _first(meta, b"idat", 4)
            return Part(inside, found[0], found[0] + found[1] if found[1] else len(inside)) if inside is not None else None
    return None


def tiff_part(data):
    """The tag structure of a file; None without one."""
    meta = _first(data, b"meta")
    item = _exif_item(meta) if meta is not None else None
    body = _content(data, meta, item) if item is not None else None
    if body is None or len(body) < 8:
        return None
    start = 4 + _int(body[:4])  # the structure starts so many bytes behind this number
    return Part(body, start, len(body))


def size(data) -> tuple[int, int]:
    """(width, height) of the primary picture as it is shown; (0, 0) if not found."""
    meta = _first(data, b"meta")
    properties = _first(meta, b"iprp", 4) if meta is not None else None
    if properties is None:
        return 0, 0
    told = list(boxes(_first(properties, b"ipco") or b""))
    primary, links = _first(meta, b"pitm", 4), _first(properties, b"ipma")
    own = list(range(1, len(told) + 1))
    if primary is not None and links is not None:
        main = _int(primary[4:6] if primary[0] == 0 else primary[4:8])
        n, wide = _Numbers(links, 4), links[3] & 1
        for _ in range(n.take(4)):
            item = n.take(2 if links[0] == 0 else 4)
            found = [n.take(2) & 0x7FFF if wide else n.take(1) & 0x7F for _ in range(n.take(1))]
            if item == main:
                own = found
    mine = [told[i - 1] for i in own if 0 < i <= len(told)]
    for kind, body in mine:
        if kind == b"ispe":
            w, h = _int(body[4:8]), _int(body[8:12])
            turned = any(k == b"irot" and b[0] & 1 for k, b in mine)
            return (h, w) if turned else (w, h)
    return 0, 0

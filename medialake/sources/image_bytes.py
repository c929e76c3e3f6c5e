"""Tags and size of an image from its bytes (standard library only).

Reads the tag directories of JPEG, PNG, WEBP, HEIF and TIFF files, and the
picture size of these, GIF and BMP.  ``data`` is bytes, or anything with a
length and slices, so that a large file need not be in memory.  All entries and
values of a directory are read; only the length of the data bounds them.
Anything malformed gives fewer tags, or size (0, 0), never an error.  The
wording of enumerated tags is that of the public tag tables.
"""

from __future__ import annotations

import struct

from medialake.sources import heif
from medialake.sources.opening import Part

# Tag names by directory.
IMAGE_TAGS = {0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x8769: "ExifOffset", 0x8825: "GPSInfo"}
EXIF_TAGS = {0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram", 0x8827: "ISOSpeedRatings", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9204: "ExposureBiasValue", 0x9205: "MaxApertureValue", 0x9207: "MeteringMode", 0x9208: "LightSource", 0x9209: "Flash", 0x920A: "FocalLength", 0xA001: "ColorSpace", 0xA002: "ExifImageWidth", 0xA003: "ExifImageLength", 0xA402: "ExposureMode", 0xA403: "WhiteBalance", 0xA404: "DigitalZoomRatio", 0xA405: "FocalLengthIn35mmFilm", 0xA406: "SceneCaptureType", 0xA431: "BodySerialNumber", 0xA433: "LensMake", 0xA434: "LensModel"}
INTEROP_TAGS = {1: "InteroperabilityIndex", 2: "InteroperabilityVersion", 0x1000: "RelatedImageFileFormat", 0x1001: "RelatedImageWidth", 0x1002: "RelatedImageLength"}
GPS_TAGS = {0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 16: "GPSImgDirectionRef", 17: "GPSImgDirection", 18: "GPSMapDatum", 29: "GPSDate"}
# Wording of enumerated tags.
WORDS = {
    "EXIF ExposureProgram": {0: "Unidentified", 1: "Manual", 2: "Program Normal", 3: "Aperture Priority", 4: "Shutter Priority", 5: "Program Creative", 6: "Program Action", 7: "Portrait Mode", 8: "Landscape Mode"},
    "EXIF MeteringMode": {0: "Unidentified", 1: "Average", 2: "CenterWeightedAverage", 3: "Spot", 4: "MultiSpot", 5: "Pattern", 6: "Partial", 255: "other"},
    "EXIF WhiteBalance": {0: "Auto", 1: "Manual"},
    "Image Orientation": {1: "Horizontal (normal)", 2: "Mirrored horizontal", 3: "Rotated 180", 4: "Mirrored vertical", 5: "Mirrored horizontal then rotated 90 CCW", 6: "Rotated 90 CW", 7: "Mirrored horizontal then rotated 90 CW", 8: "Rotated 90 CCW"},
}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
#: Directories below others, by the tag that holds their place.
_BELOW = {("Image", 0x8769): ("EXIF", EXIF_TAGS), ("Image", 0x8825): ("GPS", GPS_TAGS), ("EXIF", 0xA005): ("Interoperability", INTEROP_TAGS)}


def flash_words(v: int) -> str:
    out = "Flash fired" if v & 1 else "Flash did not fire"
    mode = {1: "compulsory flash mode", 2: "compulsory flash mode", 3: "auto mode"}.get((v >> 3) & 3)
    if v & 0x20:
        return "No flash function"
    parts = [out, mode, {2: "return light not detected", 3: "return light detected"}.get((v >> 1) & 3), "red-eye reduction mode" if v & 0x40 else None]
    return ", ".join(p for p in parts if p)


def _ratio_text(a: int, b: int) -> str:
    if b and a % b == 0:
        return str(a // b)
    return f"{a}/{b}"


def _value(data: bytes, order: str, kind: int, count: int, at: int):
    """(values, printable text) of a tag; values are numbers or None for text."""
    size = _SIZES.get(kind)
    if not size or not count or at < 0 or at + size * count > len(data):
        return None
    raw = data[at : at + size * count]
    if kind == 2:
        return [], raw.split(b"\0")[0].decode("utf-8", "replace")
    if kind in (5, 10):
        n = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw[: 8 * count])
        pairs = list(zip(n[::2], n[1::2]))
        texts = [_ratio_text(a, b) for a, b in pairs]
        return [a / b if b else None for a, b in pairs], texts[0] if count == 1 else f"[{', '.join(texts)}]"
    if kind == 7:
        return [], raw.decode("ascii", "replace") if raw.isascii() else str(list(raw))
    n = list(struct.unpack(f"{order}{count}{_CODES[kind]}", raw[: size * count]))
    return [float(x) for x in n], str(n[0]) if count == 1 else str(n)


def read_directories(data: bytes) -> tuple[dict[str, str], dict[str, list]]:
    """Tags of a TIFF structure: printable texts and values by name."""
    tags: dict[str, str] = {}
    numbers: dict[str, list] = {}
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8:
        return tags, numbers
    left = len(data)  # values of a sound file do not overlap, so together they are no longer than it
    later = ["Thumbnail"]  # names of the directories that follow the first
    todo, seen = [("Image", IMAGE_TAGS, struct.unpack(order + "I", data[4:8])[0])], set()
    while todo:
        prefix, names, at = todo.pop()
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)  # directories that point back are read once
        entries = struct.unpack(order + "H", data[at : at + 2])[0]
        behind = data[at + 2 + 12 * entries : at + 6 + 12 * entries]
        if (prefix == "Image" or prefix in later) and len(behind) == 4 and any(behind):
            after = later[later.index(prefix) + 1] if prefix in later else "Thumbnail"
            later += [f"IFD {len(later) + 1}"] if after == later[-1] else []
            todo.append((after, IMAGE_TAGS, struct.unpack(order + "I", behind)[0]))
        for i in range(entries):
            e = at + 2 + 12 * i
            if e + 12 > len(data):
                break
            tag, kind, count = struct.unpack(order + "HHI", data[e : e + 8])
            inline = _SIZES.get(kind, 9) * count <= 4
            left -= _SIZES.get(kind, 0) * count
            if left < 0:
                return tags, numbers
            found = _value(data, order, kind, count, e + 8 if inline else struct.unpack(order + "I", data[e + 8 : e + 12])[0])
            if not found:
                continue
            values, text = found
            if (prefix, tag) in _BELOW and values and values[0]:
                todo.append((*_BELOW[prefix, tag], int(values[0])))
            name = f"{prefix} {names.get(tag, f'Tag 0x{tag:04X}')}"
            if values and values[0] is not None:
                if name == "EXIF Flash":
                    text = flash_words(int(values[0]))
                text = WORDS.get(name, {}).get(int(values[0]), text)
            tags[name], numbers[name] = text, values
    return tags, numbers


def _jpeg_segments(data: bytes):
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0x01, *range(0xD0, 0xD9)):
            at += 2
            continue
        if marker in (0xD9, 0xDA):
            return
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + max(2, size)


def _chunks(data: bytes, at: int, order: str, size_first: bool):
    while at + 8 <= len(data):
        a, b = data[at : at + 4], data[at + 4 : at + 8]
        size = struct.unpack(order + "I", a if size_first else b)[0]
        yield (b if size_first else a), Part(data, at + 8, at + 8 + size)
        at += 8 + size + (4 if size_first else size % 2)


def read_tags(data: bytes) -> tuple[dict[str, str], dict[str, list]]:
    try:
        if data[:2] == b"\xff\xd8":
            for marker, body in _jpeg_segments(data):
                if marker == 0xE1 and body[:6] == b"Exif\0\0":
                    return read_directories(body[6:])
        elif data[:8] == b"\x89PNG\r\n\x1a\n":
            for kind, body in _chunks(data, 8, ">", True):
                if kind == b"eXIf":
                    return read_directories(body)
        elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            for kind, body in _chunks(data, 12, "<", False):
                if kind == b"EXIF":
                    return read_directories(Part(body, 6, len(body)) if body[:6] == b"Exif\0\0" else body)
        elif heif.is_heif(data):
            body = heif.tiff_part(data)
            return read_directories(body) if body is not None else ({}, {})
        elif data[:4] in (b"II*\0", b"MM\0*"):
            return read_directories(data)
    except (struct.error, ValueError, IndexError, OverflowError):
        pass
    return {}, {}


def read_size(data: bytes) -> tuple[int, int]:
    """(width, height), (0, 0) if not found."""
    try:
        if data[:2] == b"\xff\xd8":
            for marker, body in _jpeg_segments(data):
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", body[1:5])
                    return w, h
        elif data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        elif data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", data[6:10])
        elif data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if data[12:16] == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + ((bits >> 14) & 0x3FFF)
            if data[12:16] == b"VP8 ":
                w, h = struct.unpack("<HH", data[26:30])
                return w & 0x3FFF, h & 0x3FFF
        elif heif.is_heif(data):
            return heif.size(data)
        elif data[:4] in (b"II*\0", b"MM\0*"):
            _, numbers = read_directories(data)
            w, h = (numbers.get(f"Image Tag 0x{t:04X}") for t in (0x0100, 0x0101))
            if w and h:
                return int(w[0]), int(h[0])
    except (struct.error, ValueError, IndexError):
        pass
    return 0, 0

"""Topics: clusters of word use, as a dimension for mixing.

A text is a vector of hashed words, log counts times inverse document
frequency, scaled to length 1; topics are the centres of a spherical k-means
over all texts, and every text takes the nearest centre.

All texts are counted: each round sums the vectors of all of them by their
nearest centre, in tasks first, in whole numbers of 2^-24, so that the sums do
not depend on the tasks.  A likeness changes by no more than its centre moves,
so a text whose nearest centre leads by more than the centres have moved since
keeps it: once they move little, a round that sums all texts also writes those
that may change, and the next rounds read these only, with the sums of the
others, until a centre has moved further than was allowed for.  The sums are the same as those of all texts.  The first centres are taken as in k-means||: in two
passes over all texts those are picked whose hashed draw, weighted by the square
of their distance from those picked so far, is least; each is weighed by the
number of texts nearest to it, and those that leave the least distance are
taken one by one.  Only picked texts and sums by centre reach the driver.

A text is read ``PIECE`` bytes at a time and becomes ``WIDTH`` entries at most;
shorter ones are counted many at once, by arrays of all their words.  For the
rounds vectors are written a few to a row, two bytes for nearly all entries, and
not compressed further, as each round would spend half as much on reading
compressed ones as on comparing them; a task takes a batch of them as arrays.

Defined cases: a text without words has no vector and no topic (None); of
equally near centres the first wins; texts with equal vectors are picked once;
with no text to learn from no text has a topic.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm.common import materialise, release, summed, written

PIECE = 1 << 20
WIDTH = 2048
ENTRY = np.dtype([("at", "<u2"), ("weight", "<f4")])
_LOGS = np.log(np.arange(2, 33)).astype("<f4")  # weights that have a number: those of words that occur up to 31 times, alone at their place or together
_OTHER = len(_LOGS) * WIDTH  # from here on a code says that the weight stands elsewhere
_UNIT = float(1 << 24)
_LOG = float(1 << 32)  # log counts are summed in whole numbers of 2^-32, in any order
_STEP = 128  # texts whose vectors are unpacked at once
_MANY = 384  # short texts that are counted at once
_ROW = 8  # vectors in a row of the tables for the rounds


def word_counts(text: bytes | None) -> Counter:
    """Lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` and how often each occurs."""
    found: Counter = Counter()
    text = text or b""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        found.update(text[at:end].lower().split())
        at = end
    return found


def packed(counts: Counter) -> bytes | None:
    """The places of a text's words and the sum of the log counts at each; None without words."""
    if not counts:
        return None
    at = np.fromiter(map(zlib.crc32, counts), dtype=np.uint32, count=len(counts)) % WIDTH
    return _entries(at, np.fromiter(counts.values(), dtype=np.int64, count=len(counts)), 1)[0]


def _log(counts: np.ndarray) -> np.ndarray:
    return np.rint(np.log1p(counts) * _LOG)


_COUNT_LOGS = _log(np.arange(1024))


def _entries(at: np.ndarray, counts: np.ndarray, texts: int) -> list[bytes | None]:
    """The vectors of texts; ``at``: of each of their words the place, plus ``WIDTH`` times the text's number."""
    logs = _COUNT_LOGS[np.minimum(counts, len(_COUNT_LOGS) - 1)]
    if len(many := np.flatnonzero(counts >= len(_COUNT_LOGS))):
        logs[many] = _log(counts[many])
    sums = np.bincount(at, weights=logs, minlength=texts * WIDTH)
    held = np.flatnonzero(sums > 0)
    entries = np.empty(len(held), ENTRY)
    entries["at"], entries["weight"] = held & (WIDTH - 1), sums[held] / _LOG
    ends = (np.searchsorted(held, np.arange(texts + 1) * WIDTH) * ENTRY.itemsize).tolist()
    data = entries.tobytes()
    return [data[a:b] or None for a, b in zip(ends, ends[1:])]


_CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], dtype=np.uint32)


def _crc32(data: np.ndarray, ends: np.ndarray, most: int = 32) -> np.ndarray:
    """crc32 of the words that lie one behind the other in ``data``, a byte of each at a time; of those over ``most`` bytes one by one."""
    size = np.diff(ends)
    order = np.argsort(-np.minimum(size, most + 1), kind="stable")
    live, crc = np.searchsorted(-size[order], -np.arange(most), "left"), np.full(len(size), 0xFFFFFFFF, dtype=np.uint32)
    begin = ends[:-1][order]
    for i, n in enumerate(live.tolist()):
        if not n:
            break
        crc[:n] = _CRC[(crc[:n] ^ data[begin[:n] + i]) & 0xFF] ^ (crc[:n] >> 8)
    out = np.empty_like(crc)
    out[order] = ~crc
    for i in np.flatnonzero(size > most).tolist():
        out[i] = zlib.crc32(data[ends[i] : ends[i + 1]])
    return out


def _counted_together(texts: list[bytes]) -> tuple[list[int], list[bytes | None]]:
    """Words of each text and its vector, by arrays of all their words."""
    raw = pa.array(texts, pa.binary()).view(pa.string())  # not checked to be UTF-8: what follows goes by bytes
    lists = pc.ascii_split_whitespace(pc.ascii_lower(raw))
    told = lists.values.dictionary_encode()
    _, ends, data = told.dictionary.buffers()
    different = len(told.dictionary)
    ends = np.frombuffer(ends, np.int32, different + 1) if ends else np.zeros(1, np.int32)
    place = (_crc32(np.frombuffer(data or b"", np.uint8), ends.astype(np.int64)) % WIDTH).astype(np.int64)
    pairs = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy())) * different + told.indices.to_numpy()
    pairs.sort()
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    counts = np.diff(first, append=len(pairs))
    text, kind = np.divmod(pairs[first], max(1, different))
    for none in np.flatnonzero(ends[1:] == ends[:-1]):  # no word stands before a leading blank or behind the last one
        full = kind != none
        text, kind, counts = text[full], kind[full], counts[full]
    sizes = np.bincount(text, weights=counts, minlength=len(texts)).astype(np.int64)
    return sizes.tolist(), _entries(text * WIDTH + place[kind], counts, len(texts))


def counted(texts: list[bytes | None]) -> tuple[list[int], list[bytes | None]]:
    """Words of each text and its vector, as ``packed(word_counts(text))`` gives it."""
    sizes, vectors, lo = [], [], 0
    while lo < len(texts):
        hi, total = lo, 0
        while hi < len(texts) and hi - lo < _MANY and (total := total + len(texts[hi] or b"")) <= PIECE:
            hi += 1
        if hi > lo:
            some = _counted_together([t or b"" for t in texts[lo:hi]])
        else:
            counts, hi = word_counts(texts[lo]), lo + 1
            some = [sum(counts.values())], [packed(counts)]
        sizes += some[0]
        vectors += some[1]
        lo = hi
    return sizes, vectors


class Texts:
    """Vectors of texts: ``sizes`` in entries, ``codes`` (the place, plus ``WIDTH`` times the number of the weight in ``_LOGS``), and ``rest``, in order the weights that have no number."""

    def __init__(self, sizes: np.ndarray, codes: np.ndarray, rest: np.ndarray):
        self.sizes, self.codes, self.rest = sizes, codes, rest

    def __len__(self) -> int:
        return len(self.sizes)

    def vectors(self) -> list[bytes]:
        """The same one by one, as ``packed`` gives them."""
        entries = np.empty(len(self.codes), ENTRY)
        entries["at"] = self.codes & (WIDTH - 1)
        entries["weight"] = np.append(_LOGS, np.float32(0))[self.codes // WIDTH]
        entries["weight"][self.codes >= _OTHER] = self.rest
        ends = np.append(0, np.cumsum(self.sizes, dtype=np.int64) * ENTRY.itemsize).tolist()
        data = entries.tobytes()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def take(self, chosen: np.ndarray) -> Texts:
        """Those for which ``chosen`` is true."""
        kept = np.repeat(chosen, self.sizes)
        return Texts(self.sizes[chosen], self.codes[kept], self.rest[kept[self.codes >= _OTHER]])


def _coded(entries: np.ndarray, sizes: np.ndarray) -> Texts:
    weight = entries["weight"]
    number = np.minimum(np.searchsorted(_LOGS, weight), len(_LOGS) - 1)
    number[other := _LOGS[number] != weight] = len(_LOGS)
    return Texts(sizes.astype(np.int32), (entries["at"] + number * WIDTH).astype(np.uint16), weight[other])


def coded(vectors: list[bytes]) -> Texts:
    return _coded(np.frombuffer(b"".join(vectors), ENTRY), _sizes(vectors))


def _sizes(vectors: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, vectors), dtype=np.int64, count=len(vectors)) // ENTRY.itemsize


def _unpacked(vectors: list[bytes] | Texts, idf: np.ndarray):
    """(first text, places, weights scaled to length 1, where each text begins, its entries) of texts a step at a time."""
    if isinstance(vectors, Texts):
        scaled, begin, used = np.outer(np.append(_LOGS, np.float32(0)).astype(float), idf).ravel(), 0, 0
    for i in range(0, len(vectors), _STEP):
        if isinstance(vectors, Texts):
            size = vectors.sizes[i : i + _STEP].astype(np.int64)
            codes = vectors.codes[begin : (begin := begin + int(size.sum()))]
            at, x, other = (codes & (WIDTH - 1)).astype(np.int64), scaled[codes], np.flatnonzero(codes >= _OTHER)
            x[other] = vectors.rest[used : (used := used + len(other))] * idf[at[other]]
        else:
            rows, size = np.frombuffer(b"".join(vectors[i : i + _STEP]), ENTRY), _sizes(vectors[i : i + _STEP])
            at = rows["at"].astype(np.int64)
            x = rows["weight"] * idf[at]
        starts = np.cumsum(size) - size
        yield i, at, x / np.repeat(np.sqrt(np.add.reduceat(x * x, starts)), size), starts, size


def _likeness(at, x, starts, centres: np.ndarray) -> np.ndarray:
    """Cosine of each centre (rows) and text (columns)."""
    out, product = np.empty((len(centres), len(starts))), np.empty_like(x)
    for c, own in zip(centres, out):
        c.take(at, out=product, mode="clip")
        np.multiply(product, x, out=product)
        np.add.reduceat(product, starts, out=own)
    return out


class Model:
    def __init__(self, idf: np.ndarray, centres: np.ndarray):
        self.idf, self.centres = idf, centres

    def nearest(self, vectors: list[bytes]) -> list[int]:
        rows = np.ascontiguousarray(self.centres.T)
        return [k for _, at, x, starts, _ in _unpacked(vectors, self.idf) for k in _likeness(at, x, starts, rows).argmax(axis=0).tolist()]

    def topic(self, counts: Counter) -> int:
        return self.nearest([packed(counts)])[0]


# --- steps over all texts: their vectors, or a table of them ------------------
_COLUMNS = ["sizes", "codes", "rest"]
_SCHEMA = ", ".join(f"{c} binary" for c in _COLUMNS)


def _rows(texts: Texts) -> list[pa.Array]:
    """Columns of a table of ``texts``, ``_ROW`` to a row."""
    first = np.minimum(np.arange(0, len(texts) + _ROW, _ROW), len(texts))
    begin = np.append(0, np.cumsum(texts.sizes, dtype=np.int64))[first]
    used = np.searchsorted(np.flatnonzero(texts.codes >= _OTHER), begin)
    parts = zip((texts.sizes, texts.codes, texts.rest), (first, begin, used))
    return [pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(x.tobytes())]) for x, at in parts]


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, one value behind the other, and where they begin and end."""
    _, ends, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    return np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _texts(batch: pa.RecordBatch) -> Texts:
    """The texts of ``_rows``."""
    return Texts(*(_joined(column)[0].view(kind) for column, kind in zip(batch.columns, (np.int32, np.uint16, np.float32))))


def _vectors(batch: pa.RecordBatch) -> list[bytes]:
    return _texts(batch).vectors()


def _stored(vectors: DataFrame) -> DataFrame:
    """A table of a vector a row, written a few to a row."""

    def run(batches):
        for b in batches:
            data, ends = _joined(b.column(0))
            yield pa.RecordBatch.from_arrays(_rows(_coded(data.view(ENTRY), np.diff(ends) // ENTRY.itemsize)), names=_COLUMNS)

    return materialise(vectors.mapInArrow(run, _SCHEMA), "none")


def _summed(vectors: Texts | DataFrame, part, size: int) -> np.ndarray:
    """Sum of ``part(vectors)``, ``size`` whole numbers, over all texts."""
    if isinstance(vectors, Texts):
        return part(vectors)
    return summed(vectors, lambda b: part(_texts(b)), size)


def _least(vectors: Texts | DataFrame, part, n: int) -> list[bytes]:
    """The ``n`` different vectors for which ``part`` gives the least keys."""

    def few(lists):
        found: dict[bytes, float] = {}
        for some in lists:
            for some_vectors, keys in part(some):
                most = max(found.values()) if len(found) >= n else np.inf
                found.update((some_vectors[i], float(keys[i])) for i in np.flatnonzero(keys < most))
                found = dict(heapq.nsmallest(n, found.items(), key=lambda r: (r[1], r[0])))
        return found

    if isinstance(vectors, Texts):
        return list(few([vectors]))

    def run(batches):
        found = few(map(_texts, batches))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.float64())], names=["vec", "key"])

    return [bytes(r.vec) for r in vectors.mapInArrow(run, "vec binary, key double").groupBy("vec").agg(F.min("key").alias("key")).orderBy("key", "vec").limit(n).collect()]


def _held(vectors: Texts) -> np.ndarray:
    """Texts that hold each place, and texts."""
    return np.append(np.bincount(vectors.codes & (WIDTH - 1), minlength=WIDTH), len(vectors))


def _dense(vectors: list[bytes], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(vectors), WIDTH))
    for row, v in zip(out, vectors):
        for _, at, x, _, _ in _unpacked([v], idf):
            row[at] = x
    return out


def _draws(idf: np.ndarray, centres: np.ndarray, seed: int):
    """Keys of texts: an exponential draw over the squared distance from the nearest centre."""

    def part(vectors):
        each = vectors.vectors()
        for i, at, x, starts, size in _unpacked(vectors, idf):
            some = each[i : i + len(size)]
            u = (np.array([xxhash.xxh64_intdigest(v, seed) for v in some], dtype=np.uint64) + 0.5) / 2.0**64
            far = 1 - _likeness(at, x, starts, centres).max(axis=0) if len(centres) else np.ones(len(some))
            yield some, np.where(far > 1e-6, -np.log(np.minimum(u, 1 - 1e-16)) / np.maximum(far, 1e-6) ** 2, np.inf)

    return part


def _by_centre(idf: np.ndarray, centres: np.ndarray):
    """Sums of the texts' vectors by nearest centre and place."""
    size_all = len(centres) * WIDTH

    def part(vectors):
        total = np.zeros(size_all, dtype=np.int64)
        for _, at, x, starts, size in _unpacked(vectors, idf):
            own = _likeness(at, x, starts, centres).argmax(axis=0)
            total += np.bincount(np.repeat(own * WIDTH, size) + at, weights=np.rint(x * _UNIT), minlength=size_all).astype(np.int64)
        return total

    return part


def _open(idf: np.ndarray, centres: np.ndarray, slack: np.ndarray):
    """(texts whose nearest centre may be another once each centre has moved by its ``slack`` at most, sums as by ``_by_centre`` of the others and of these)."""
    half = len(centres) * WIDTH

    def part(vectors):
        out, total = [np.zeros(0, dtype=bool)], np.zeros(2 * half, dtype=np.int64)
        for _, at, x, starts, size in _unpacked(vectors, idf):
            like, each = _likeness(at, x, starts, centres), np.arange(len(size))
            own = like.argmax(axis=0)
            least = like[own, each] - slack[own] - 1e-9
            like += slack[:, None]
            like[own, each] = -np.inf
            may = like.max(axis=0) >= least
            out.append(may)
            total += np.bincount(np.repeat(may * half + own * WIDTH, size) + at, weights=np.rint(x * _UNIT), minlength=2 * half).astype(np.int64)
        return vectors.take(np.concatenate(out)), total

    return part


def _parted(vectors: Texts | DataFrame, part, size: int) -> tuple[Texts | DataFrame, np.ndarray]:
    """The vectors that ``part`` gives, written, and its ``size`` sums."""
    if isinstance(vectors, Texts):
        return part(vectors)

    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            some, sums = part(_texts(b))
            total += sums
            own = _rows(some)
            yield pa.RecordBatch.from_arrays([*own, pa.nulls(len(own[0]), pa.binary())], names=[*_COLUMNS, "sums"])
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.binary()) for _ in _COLUMNS), pa.array([total.tobytes()], pa.binary())], names=[*_COLUMNS, "sums"])

    found = materialise(vectors.mapInArrow(run, f"{_SCHEMA}, sums binary"), "none")
    sums = summed(found.select("sums").where("sums is not null"), lambda b: sum((np.frombuffer(x, np.int64) for x in b.column(0).to_pylist()), np.zeros(size, dtype=np.int64)), size)
    return found.select(*_COLUMNS).where("sizes is not null"), sums


class _Rounds:
    """Sums of all texts by nearest centre, round after round.

    ``levels`` are ever smaller parts of the texts: from a level on, those left
    out are in ``done``, as long as no centre is further than ``slack`` from
    where it was when they were left out.  ``step``: how far each centre moved
    last.
    """

    def __init__(self, vectors: Texts | DataFrame, idf: np.ndarray, shape: tuple[int, int]):
        self.idf, self.step = idf, np.full(shape[0], np.inf)
        self.levels = [(vectors, np.zeros(shape, dtype=np.int64), None, self.step, _LITTLE)]

    def sums(self, centres: np.ndarray) -> np.ndarray:
        while self.levels[-1][2] is not None and (_apart(centres, self.levels[-1][2]) > self.levels[-1][3]).any():
            self.levels.pop()
        vectors, done, _, _, little = self.levels[-1]
        most = self.step.max()
        if most > little:
            return done + _summed(vectors, _by_centre(self.idf, centres), centres.size).reshape(centres.shape)
        slack = _AHEAD * (self.step + most)
        some, sums = _parted(vectors, _open(self.idf, centres, slack), 2 * centres.size)
        left, now = sums.reshape(2, *centres.shape)
        self.levels.append((some, done + left, centres, slack, most / _LESS))
        return done + left + now


_LITTLE = 0.02  # texts are left out once no centre moves by more,
_LESS = 3  # and again when none moves by more than this part of that
_AHEAD = 2  # times its last step and the longest one a centre may move before all are read again


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each centre from where it was."""
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def _near(idf: np.ndarray, centres: np.ndarray):
    """Texts by nearest centre."""
    return lambda vectors: sum((np.bincount(_likeness(at, x, starts, centres).argmax(axis=0), minlength=len(centres)) for _, at, x, starts, _ in _unpacked(vectors, idf)), np.zeros(len(centres), dtype=np.int64))


def learn(vectors: list[bytes] | DataFrame, topics: int = 8, rounds: int = 25, passes: int = 2, still: float = 1e-3) -> Model | None:
    """Spherical k-means over all of ``vectors``: a list, or a table whose first column holds them, none null; ends when no centre moves by more than ``still``; leaves no table behind."""
    if isinstance(vectors, list):
        return _learn(coded(vectors), topics, rounds, passes, still)
    before = written()
    try:
        return _learn(_stored(vectors), topics, rounds, passes, still)
    finally:
        release(vectors.sparkSession, before)


def _learn(vectors: Texts | DataFrame, topics: int, rounds: int, passes: int, still: float) -> Model | None:
    *held, n = _summed(vectors, _held, WIDTH + 1).tolist()
    if not n:
        return None
    idf = np.log((1 + n) / (1 + np.array(held))) + 1
    picked = np.zeros((0, WIDTH))
    for seed in range(passes):
        picked = np.concatenate([picked, _dense(_least(vectors, _draws(idf, picked, seed), 2 * topics), idf)])
    weight = _summed(vectors, _near(idf, picked), len(picked))
    apart, left, first = (1 - np.minimum(1, picked @ picked.T)) ** 2, np.full(len(picked), 1e9), []
    for _ in range(min(topics, len(picked))):
        first.append(int((weight[:, None] * np.minimum(left[:, None], apart)).sum(axis=0).argmin()))
        left = np.minimum(left, apart[:, first[-1]])
    centres = picked[first]
    texts = _Rounds(vectors, idf, centres.shape)
    for _ in range(rounds):
        sums = texts.sums(centres) / _UNIT
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        new = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
        texts.step, centres = _apart(new, centres), new
        if texts.step.max() <= still:
            break
    return Model(idf, centres.T.copy())


def train(texts: list[bytes], topics: int = 8, rounds: int = 25) -> Model | None:
    return learn([v for v in map(packed, map(word_counts, texts)) if v], topics, rounds)


def fit(docs: DataFrame, text_col: str = "text", topics: int = 8) -> Model | None:
    """Train on all rows of ``docs``."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(counted(b.column(0).to_pylist())[1], pa.binary())], names=["vec"])

    return learn(materialise(docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "vec binary").where("vec is not null")), topics)

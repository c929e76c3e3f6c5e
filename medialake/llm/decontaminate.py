"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are cut into windows of ``window`` consecutive
normalised words (an item of fewer words is one window).  The automaton reads
words, not characters: each benchmark word is a symbol, every other word is
one "unknown" symbol.  A document is scanned once; hits are word positions,
and offsets in the original text are looked up only where something was hit.

The benchmark travels to the tasks in blocks of about ``max_words`` item words
(one item is never cut), dealt by a hash.  The driver and each worker process
hold one block at a time; a worker builds its automaton once and keeps it for
the next tasks.  A benchmark of one block is searched in one narrow pass.  For
more the texts are written once with row numbers, each block's hits, which are
few, are written as a table, and the tables meet by row number.

Defined cases: a null or empty text has no words and no hits; null or empty
items have no windows; items of equal text all count; repeated item ids count
once; a null item id still marks words but names no item; repeated documents
each get a row; an empty benchmark contaminates nothing; other columns of both
tables are ignored.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm.common import filter_by_text, materialise

#: Bytes of a word: digits, letters and everything outside ASCII; A-Z fold to a-z, all else parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_SPANS = "array<struct<first:int,last:int>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Matcher:
    """Automaton for the windows of some items.

    Every window of w words holds a whole seed: ceil(w / 2) words that begin at
    a multiple of that number in its item.  The automaton holds the seeds, and
    items of fewer than w words as they are: about one state a word instead of
    one for each word of each window.  Where a seed occurs, the words around it
    are compared with those around it in the item, up to a window's reach; that
    finds exactly the windows that hold this seed.
    """

    CHUNK = 1 << 16  # places compared at a time

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window, self.seed = window, (window + 1) // 2
        self.symbol: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        number: dict[tuple, int] = {}
        places, keys, short, parts, starts, at = [], [], {}, [], [], 0
        gap = np.full(window, -2, dtype=np.int32)  # like no word
        for i, (_, text) in enumerate(items):
            s = [self.symbol.setdefault(x, len(self.symbol) + 1) for x in words_of(text)]
            starts.append(at)
            if 0 < len(s) < window:
                short.setdefault(tuple(s), []).append(i)
            elif s:
                for q in range(0, len(s) - self.seed + 1, self.seed):
                    keys.append(number.setdefault(tuple(s[q : q + self.seed]), len(number)))
                    places.append(at + q)
                parts += [np.array(s, dtype=np.int32), gap]
                at += len(s) + window
        self.flat = np.concatenate([gap, *parts]) if parts else gap
        self.starts = np.array(starts, dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.places = np.array(places, dtype=np.int64)[order] if places else np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(np.array(keys, dtype=np.int64)[order], np.arange(len(number) + 1)) if places else np.zeros(1, dtype=np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key in {**number, **short}:
            self.automaton.add_word(key, (len(key), number.get(key, -1), tuple(short.get(key, ()))))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]):
        """([(first word, last word)], items) of all windows that occur in ``words``."""
        get = self.symbol.get
        symbols = tuple([get(w, 0) for w in words])
        spans, found = [], set()
        if self.empty or not any(symbols):
            return spans, found
        seeds, owners = [], set()
        for end, (n, seed, short) in self.automaton.iter(symbols):
            if short:
                spans.append((end - n + 1, end))
                owners.update(short)
            if seed >= 0:
                seeds.append((end - n + 1, seed))
        if seeds:
            more, own = self._around(symbols, seeds)
            spans += more
            owners |= own
        return merged(spans), {self.items[i] for i in owners}

    def _around(self, symbols: tuple, seeds: list[tuple[int, int]]):
        reach, text = self.window - self.seed, np.array(symbols, dtype=np.int32)
        text = np.pad(text, self.window, constant_values=-1)
        at, seed = np.array(seeds, dtype=np.int64).T
        n = self.first[seed + 1] - self.first[seed]
        ends = np.cumsum(n)
        spans, owners, total = set(), set(), int(ends[-1])
        for lo in range(0, total, self.CHUNK):
            k = np.arange(lo, min(total, lo + self.CHUNK))
            hit = np.searchsorted(ends, k, side="right")
            d = at[hit] + self.window
            p = self.places[self.first[seed[hit]] + k - (ends[hit] - n[hit])] + self.window
            left = right = np.zeros(len(k), dtype=np.int64)
            go_l = go_r = np.ones(len(k), dtype=bool)
            for j in range(reach):
                go_l = go_l & (text[d - 1 - j] == self.flat[p - 1 - j])
                go_r = go_r & (text[d + self.seed + j] == self.flat[p + self.seed + j])
                left, right = left + go_l, right + go_r
            ok = left + right + self.seed >= self.window
            first = (d - left - self.window)[ok]
            spans.update(zip(first.tolist(), (first + (left + right + self.seed)[ok] - 1).tolist()))
            owners.update((np.searchsorted(self.starts, p[ok] - self.window, side="right") - 1).tolist())
        return spans, owners


def covered(spans) -> int:
    """Words inside any span."""
    n, reach = 0, -1
    for first, last in sorted(spans):
        n += max(0, last - max(first - 1, reach))
        reach = max(reach, last)
    return n


def char_offsets(text: bytes, spans) -> list[tuple[int, int]]:
    """Character offsets [start, end) in the original text of spans of words."""
    at = [m.span() for m in _WORD.finditer(text)]
    starts = np.frombuffer(text, dtype=np.uint8)
    chars = np.concatenate([[0], np.cumsum((starts & 0xC0) != 0x80)])
    return [(int(chars[at[a][0]]), int(chars[at[b][1]])) for a, b in spans]


# --- blocks of the benchmark ------------------------------------------------
_MATCHERS: dict[tuple, Matcher] = {}


class Block:
    """Items of a block, sent to the tasks; a worker process builds their automaton once and keeps the last one."""

    def __init__(self, context, items: list[tuple[str | None, bytes]]):
        self.name, self.shared = uuid.uuid4().hex, context.broadcast(items)

    def matcher(self, window: int) -> Matcher:
        key = self.name, window
        if key not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[key] = Matcher(self.shared.value, window)
        return _MATCHERS[key]


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, max_words: int):
    """Blocks of the items that have a text, about ``max_words`` words at a time; the driver holds one block."""
    text = F.col(item_text)
    items = benchmark.where(text.isNotNull()).select(F.col(item_col).cast("string").alias("item"), text.cast("binary").alias("body"), F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).alias("n"))
    words = items.agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-words // max_words))
    own = F.pmod(F.xxhash64("item", "body"), F.lit(n))
    context = benchmark.sparkSession.sparkContext
    for k in range(n):
        rows = sorted({(r[0], bytes(r[1])) for r in items.where(own == k).select("item", "body").collect()}, key=lambda r: (r[0] or "", r[1]))
        yield n, Block(context, rows)


_FOUND = "n_words long, n_hit long, items array<string>, offsets array<struct<start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_OFFSETS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _result(first_column, texts, spans, items) -> pa.RecordBatch:
    """Counts and offsets of each text's spans (merged here) and items."""
    n_words, hits, offsets, names = [], [], [], []
    for text, own, found in zip(texts, spans, items):
        pairs = merged([(s["first"], s["last"]) if isinstance(s, dict) else s for s in own or []])
        n_words.append(len(words_of(text)))
        hits.append(covered(pairs))
        offsets.append([{"start": a, "end": z} for a, z in char_offsets(text, pairs)] if pairs else [])
        names.append(sorted({x for x in found or [] if x is not None}))
    return pa.RecordBatch.from_arrays([first_column, pa.array(n_words, pa.int64()), pa.array(hits, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(offsets, _OFFSETS)], names=["id", "n_words", "n_hit", "items", "offsets"])


def _whole(block, window):
    def run(batches):
        m = block.matcher(window)
        for b in batches:
            texts = b.column(1).to_pylist()
            spans, items = zip(*[m.scan(words_of(t)) for t in texts]) if texts else ([], [])
            yield _result(b.column(0), texts, spans, items)

    return run


def _hits_only(block, window):
    def run(batches):
        m = block.matcher(window)
        for b in batches:
            rows = [(n, *m.scan(words_of(t))) for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            rows = [r for r in rows if r[1]]
            spans = [[{"first": a, "last": z} for a, z in r[1]] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(spans, _SPAN), pa.array([list(r[2]) for r in rows], pa.list_(pa.string()))], names=["number", "spans", "items"])

    return run


def _joined(batches):
    for b in batches:
        yield _result(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())


def _block_hits(numbered: DataFrame, blocks, window: int) -> DataFrame:
    """(number, spans, items) of the rows that any block hits; each block is searched and dropped before the next is read."""
    found = None
    for _, block in blocks:
        part = materialise(numbered.select("number", "body").mapInArrow(_hits_only(block, window), f"number long, spans {_SPANS}, items array<string>"))
        block.shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found.groupBy("number").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))


def _chained(first, rest):
    yield first
    yield from rest


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, max_words: int = 1_000_000) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted ids), offsets [start, end) of hit passages."""
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("body"))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {_FOUND}"
    blocks = _blocks(benchmark, item_col, item_text, max_words)
    n, block = next(blocks)
    if n == 1:
        return slim.mapInArrow(_whole(block, window), schema)
    numbered = materialise(slim.withColumn("number", F.monotonically_increasing_id()))
    hits = _block_hits(numbered, _chained((n, block), blocks), window)
    return numbered.join(hits, "number", "left").select("id", "body", "spans", "items").mapInArrow(_joined, schema)


def merged(spans):
    out = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """``find_hits`` with the item digest: n_items, items_sha256, contaminated."""
    hits = find_hits(docs, benchmark, id_col, **kw)
    return hits.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, max_words: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window.

    For a benchmark of one block the verdict is made on the row itself, so
    nothing is shuffled; for more the rows are written once with a number.
    """
    blocks = _blocks(benchmark, item_col, item_text, max_words)
    n, block = next(blocks)
    if n == 1:

        def prepare():
            m = block.matcher(window)
            return lambda texts: [not m.scan(words_of(t))[0] for t in texts]

        return filter_by_text(docs, text_col, prepare)
    numbered = materialise(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[text_col].cast("binary").alias("body"), F.monotonically_increasing_id().alias("number")))
    hits = _block_hits(numbered, _chained((n, block), blocks), window)
    return numbered.join(hits, "number", "left_anti").select("row.*")

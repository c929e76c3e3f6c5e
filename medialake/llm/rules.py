"""Quality rules: base counts, then line labels by Viterbi decoding.

A linear-chain conditional random field marks each line content (1) or
boilerplate (0); the best path is found by Viterbi decoding, and the share of
characters on content lines decides.  The field learns from a bounded sample
(``fit``): lines of texts marked good are content, lines of texts marked bad
are boilerplate.

Base counts of a text, with words ``[^\\x20\\x09-\\x0D]+``: n_words; word_chars
(code points in words); n_symbols (characters of ``#*$%&|<>``); n_dup_lines
(lines with a word that equal an earlier line); n_repeat_words (words inside
five-word windows that occur twice or more, first occurrence included).
``base_failed``: fewer than 10 words, or more than 20 % repeated words.
Words, lines and windows are told apart by 64-bit hashes.

Defined cases: a null or empty text has no words and fails; with no labelled
rows every line is content; bytes that are not UTF-8 count as U+FFFD; a text of
very many lines is decoded, and a long text counted, a part at a time; null ids and repeated rows give a
row each; other columns are ignored.
"""

from __future__ import annotations

import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm.common import decoded
from medialake.llm.langid import _runs
from medialake.llm.lines import PIECE, Lines, fit_lines
from medialake.llm.quality import labelled_sample

_SYMBOLS = b"#*$%&|<>"
_SPACE = re.compile(rb"\s")
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]
WINDOW = 5


def repeat_words(ids: np.ndarray, step: int = PIECE) -> int:
    """Words in windows of five equal to another window of the same text; windows are mixed and looked up ``step`` at a time."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    key = np.zeros(n, dtype=np.uint64)
    for at in range(0, n, step):
        part = key[at : at + step]
        for i in range(WINDOW):  # a 64-bit mix of the five words
            x = (part ^ ids[at + i : at + i + len(part)].astype(np.uint64)) * _MIX[i]
            part[:] = x ^ (x >> np.uint64(29))
    ranked = np.sort(key)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    del ranked
    if not len(twice):
        return 0
    held = np.zeros(len(ids), dtype=bool)
    for at in range(0, n, step):
        part = key[at : at + step]
        found = twice[np.minimum(np.searchsorted(twice, part), len(twice) - 1)] == part
        for i in range(WINDOW):
            held[at + i : at + i + len(part)] |= found
    return int(held.sum())


def pieces(text: bytes, size: int = PIECE):
    """Parts of about ``size`` bytes that cut no word."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + size)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


def base_counts(text: bytes | None, size: int = PIECE) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); eight bytes a word and a line are held beside a part of the text."""
    if not text:
        return 0, 0, 0, 0, 0
    ids, chars, symbols = [], 0, 0
    for piece in pieces(text, size):
        words = piece.split()
        ids.append(np.fromiter(map(hash, words), dtype=np.int64, count=len(words)))
        chars += len(b"".join(words).decode("utf-8", "replace"))
        symbols += len(piece) - len(piece.translate(None, _SYMBOLS))
    lines = np.fromiter((hash(x.removesuffix(b"\n")) for x in io.BytesIO(text) if not x.isspace()), dtype=np.int64)
    lines.sort()
    repeated = int((lines[1:] == lines[:-1]).sum())
    ids = np.concatenate(ids)
    return len(ids), chars, symbols, repeated, repeat_words(ids)


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def content_share(crf, texts: list[str | None]) -> np.ndarray:
    """Share of characters on content lines; nan without lines."""
    out = np.full(len(texts), np.nan)
    for lo, hi in _runs([len(t or "") for t in texts], 2_000_000):
        lines = Lines(texts[lo:hi])
        path = lines.best_path(crf) if crf else np.ones(len(lines))
        out[lo:hi] = lines.share(path.astype(float))
    return out


def fit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 400, max_chars: int = 30_000):
    """Line field from at most ``per_class`` whole labelled texts of each class; None if a class is missing."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, per_class, max_chars)
    found = [y for _, y in sample]
    return fit_lines([t for t, _ in sample], found) if {0, 1} <= set(found) else None


def judge(docs: DataFrame, crf, id_col: str = "doc_id", text_col: str = "text", min_share: float = 0.5) -> DataFrame:
    """One row per document: id, base counts, base_failed, content_share, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in batches:
            counts = [base_counts(t) for t in b.column(1).to_pylist()]
            share = content_share(shared.value, [decoded(t) for t in b.column(1).to_pylist()])
            failed = np.array([base_fails(c[0], c[4]) for c in counts], dtype=bool)
            kept = ~failed & (np.nan_to_num(share) >= min_share)
            cols = [pa.array([c[i] for c in counts], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(failed), pa.array(share, pa.float64(), from_pandas=True), pa.array(kept)], names=[id_col, *names, "base_failed", "content_share", "kept"])

    slim = docs.select(id_col, F.col(text_col).cast("binary").alias("_t"))
    kind = docs.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, content_share double, kept boolean")

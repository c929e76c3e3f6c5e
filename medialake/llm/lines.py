"""Lines of a text as positions of a chain, with binned features."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from medialake.llm.crf import Crf, forward_backward, long_marginals, long_viterbi, viterbi

_OTHER, _UPPER, _DIGIT, _SPACE, _SYMBOL, _PIPE, _STOP, _COMMA = range(8)
_EDGES = [
    [2, 4, 8, 16, 32, 64, 128, 256, 512, 1024],  # characters
    [2, 3, 5, 9, 17, 33, 65, 129],  # words
    [1e-9, 0.01, 0.02, 0.04, 0.08, 0.2, 0.5, 0.8],  # upper case a letter
    [1e-9, 0.005, 0.02, 0.05, 0.1, 0.2],  # symbols a character
    [1e-9, 0.01, 0.05, 0.2],  # digits a character
    [1e-9, 0.01, 0.03, 0.1],  # pipes a character
    [0.05, 0.1, 0.2, 0.4, 0.6, 0.7, 0.8, 0.9, 0.95],  # distinct words a word
    [2, 3, 4, 5, 6, 7, 8, 10, 15, 30],  # letters a word
    [1e-9, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8],  # sentence ends a word
    [1e-9, 0.02, 0.05, 0.1, 0.2],  # commas a word
]
_SIZES = [len(e) + 2 for e in _EDGES] + [6, 5, 3]  # each with a bin for "no such line"
_OFFSETS = np.cumsum([0, *_SIZES, *_SIZES, *_SIZES])
N_FEATURES = int(_OFFSETS[-1]) + 1  # and a bias


def _class_of(c: str) -> int:
    if c == "|":
        return _PIPE
    if c in ".!?。！？":
        return _STOP
    if c in ",;:":
        return _COMMA
    if c.isspace():
        return _SPACE
    kind = unicodedata.category(c)
    return _UPPER if kind == "Lu" else _DIGIT if kind[0] == "N" else _SYMBOL if kind[0] in "PSC" else _OTHER


_CLASSES = None


def _classes() -> np.ndarray:
    global _CLASSES
    if _CLASSES is None:
        _CLASSES = np.array([_class_of(chr(i)) for i in range(0x10000)], dtype=np.int64)
    return _CLASSES


#: Characters that are held in arrays at a time.
PIECE = 1 << 20
_WORDS = re.compile(r"\S+")


def _rows(text: str | None):
    """Lines of a text, without a list of all of them if it is long."""
    text = text or ""
    if len(text) <= PIECE:
        yield from text.split("\n")
        return
    at = 0
    while (end := text.find("\n", at)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


def _tokens(line: str):
    """(words, distinct words, first character, last character) of a line; None without a word."""
    if len(line) <= PIECE:
        words = line.split()
        return (len(words), len(set(words)), words[0][0], words[-1][-1]) if words else None
    n, seen, first, last = 0, set(), "", ""
    for m in _WORDS.finditer(line):
        n += 1
        seen.add(hash(m.group()))
        first, last = first or m.group()[0], line[m.end() - 1]
    return (n, len(seen), first, last) if n else None


class Lines:
    """Features of all lines with a visible character, of some texts.

    ``own``: (lines x features) bins; ``chars``: characters of each line;
    ``per_text``: lines of each text; ``starts``: where each text's lines begin.
    Only these few bytes a line are held for the whole of a text.
    """

    def __init__(self, texts: list[str | None]):
        self._parts, per_text, rows, size = [], [], [], 0
        for text in texts:
            seen, n = set(), 0
            for line in _rows(text):
                tokens = _tokens(line)
                if not tokens:
                    continue
                n += 1
                key = hash(line)
                rows.append((line, *tokens, key in seen))
                seen.add(key)
                size += len(line)
                if size > PIECE:
                    self._parts.append(self._bins(rows))
                    rows, size = [], 0
            per_text.append(n)
        self._parts.append(self._bins(rows))
        self.chars, self.own = (np.concatenate(x) for x in zip(*self._parts))
        del self._parts
        self.per_text = np.array(per_text, dtype=np.int64)
        self.starts = np.cumsum(self.per_text) - self.per_text

    @staticmethod
    def _counts(lines: list[str], chars: np.ndarray) -> np.ndarray:
        """Characters of each class in each line."""
        out = np.zeros((len(lines), 8), dtype=np.int64)
        long = [i for i, n in enumerate(chars) if n > PIECE]
        short = [i for i, n in enumerate(chars) if n <= PIECE]
        for i in long:
            for at in range(0, chars[i], PIECE):
                points = np.frombuffer(lines[i][at : at + PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                out[i] += np.bincount(_classes()[np.minimum(points, 0xFFFF)], minlength=8)
        if short:
            points = np.frombuffer("".join(lines[i] for i in short).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            line = np.repeat(np.arange(len(short)), chars[short])
            out[short] = np.bincount(line * 8 + _classes()[np.minimum(points, 0xFFFF)], minlength=len(short) * 8).reshape(-1, 8)
        return out

    def _bins(self, rows) -> tuple[np.ndarray, np.ndarray]:
        if not rows:
            return np.zeros(0, dtype=np.int64), np.zeros((0, len(_SIZES)), dtype=np.uint8)
        lines, words, distinct, begins, ends, repeated = zip(*rows)
        chars, words, distinct = np.array([len(x) for x in lines]), np.array(words), np.array(distinct)
        c = self._counts(lines, chars)
        letters = np.maximum(1, c[:, _OTHER] + c[:, _UPPER])
        values = [chars, words, c[:, _UPPER] / letters, (c[:, _SYMBOL] + c[:, _PIPE]) / chars, c[:, _DIGIT] / chars, c[:, _PIPE] / chars, distinct / words, letters / words, c[:, _STOP] / words, c[:, _COMMA] / words]
        own = [np.digitize(v, e) for v, e in zip(values, _EDGES)]
        end = {_STOP: 0, _COMMA: 1, _PIPE: 2, _SYMBOL: 3}
        own.append(np.array([end.get(_classes()[min(ord(x), 0xFFFF)], 4) for x in ends]))
        first = {_UPPER: 0, _OTHER: 1, _DIGIT: 2}
        own.append(np.array([first.get(_classes()[min(ord(x), 0xFFFF)], 3) for x in begins]))
        own.append(np.array(repeated, dtype=np.int64))
        return chars, np.stack(own, axis=1).astype(np.uint8)

    def __len__(self) -> int:
        return len(self.chars)

    def fids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """(lines x features) feature ids of lines ``lo`` to ``hi``: their own, those of the line before and of the line after, and a bias."""
        hi = len(self) if hi is None else hi
        none = np.array(_SIZES, dtype=np.uint8) - 1
        own, full = self.own[lo:hi], self.per_text > 0
        if not len(own):
            return np.zeros((0, 3 * len(_SIZES) + 1), dtype=np.int64)
        before = np.vstack([self.own[lo - 1] if lo else none, own[:-1]])
        after = np.vstack([own[1:], self.own[hi] if hi < len(self) else none])
        firsts, lasts = self.starts[full] - lo, (self.starts + self.per_text - 1)[full] - lo
        before[firsts[(firsts >= 0) & (firsts < len(own))]] = none
        after[lasts[(lasts >= 0) & (lasts < len(own))]] = none
        bias = np.full((len(own), 1), N_FEATURES - 1)
        return np.hstack([np.hstack([own, before, after]).astype(np.int64) + _OFFSETS[:-1], bias])

    def emissions(self, crf: Crf, lo: int = 0, hi: int | None = None) -> np.ndarray:
        fids = self.fids(lo, hi)
        out = np.zeros((len(fids), crf.weights.shape[1]))
        for j in range(fids.shape[1]):
            out += crf.weights[fids[:, j]]
        return out

    def marginals(self, crf: Crf, step: int = 100_000) -> np.ndarray:
        """Marginal of label 1 of each line; a text of more than ``step`` lines is scored a part at a time."""
        if len(self) <= step or len(self.per_text) > 1:
            return forward_backward(self.emissions(crf), self.per_text, crf.trans, crf.start)[:, 1]
        out = np.empty(len(self), dtype=np.float32)

        def use(i, gamma):
            out[i * step : i * step + len(gamma)] = gamma[:, 1]

        long_marginals(-(-len(self) // step), lambda i: self.emissions(crf, i * step, min(len(self), (i + 1) * step)), crf.trans, crf.start, use)
        return out

    def best_path(self, crf: Crf, step: int = 100_000) -> np.ndarray:
        """Label of each line by Viterbi decoding, a long text a part at a time."""
        if len(self) <= step or len(self.per_text) > 1:
            return viterbi(self.emissions(crf), self.per_text, crf.trans, crf.start)
        return long_viterbi(-(-len(self) // step), lambda i: self.emissions(crf, i * step, min(len(self), (i + 1) * step)), crf.trans, crf.start)

    def share(self, mass: np.ndarray) -> np.ndarray:
        """Length-weighted mean over the lines of each text; nan for a text without lines."""
        out = np.full(len(self.per_text), np.nan)
        full = self.per_text > 0
        if full.any():
            at = self.starts[full]
            out[full] = np.add.reduceat(mass * self.chars, at) / np.add.reduceat(self.chars, at)
        return out


def fit_lines(texts: list[str], labels: list[int], rounds: int = 60) -> Crf:
    """Two-label field over lines; each line of a training text has the text's label."""
    lines = Lines(texts)
    fids = lines.fids()
    n, width = fids.shape
    crf = Crf(N_FEATURES, 2)
    if n:
        y = np.repeat(np.array(labels, dtype=np.int64), lines.per_text)
        crf.fit(fids.ravel(), np.arange(n + 1) * width, np.arange(n), y, lines.per_text, weight_decay=1e-4, rounds=rounds)
    return crf

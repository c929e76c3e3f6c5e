"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are lower-cased and folded first: homoglyphs become the Latin letters
they imitate, marks that show nothing go, and in every token of letters, digits
and signs that holds a letter the digits and signs become the letters they stand
for (all but ``!`` at its end).  Such a token is matched in this form and in its
plain one, cut at digits and signs; the heavier match counts.  The lexicon holds whole words and word beginnings;
each has a weight, its log odds of standing in a toxic text (lower bound).  A text counts
as evidence for a term only if it shows it between neighbours that no other
text showed, so words of one much-copied text do not enter.  Exception phrases are pairs of words that
hold a term and that clean texts use; a match inside one does not count, in
whichever form the token stands there.  The
sum of weights, and that sum divided by the text's length, enter a logistic
curve.

Training sees at most ``per_class`` whole documents of each label, none longer
than ``max_chars``; every term of theirs that passes the tests enters.

Defined cases: bytes that are not UTF-8 count as U+FFFD; a text that is null or has no letter scores as one without a
match; with no labelled row of both classes every score is 0; null ids and
repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from medialake.llm.common import bounded_sample
from medialake.llm.quality import logistic

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ı": "i", "ł": "l", "ø": "o",
}
# Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
_HIDDEN = "​‌‍⁠﻿­"

_TABLE = str.maketrans(HOMOGLYPHS | {c: None for c in _HIDDEN})
_ODD = re.compile("[" + "".join(HOMOGLYPHS) + _HIDDEN + "̀-ͯ＀-￯\U0001d400-\U0001d7ff]")
#: Tokens with a digit or sign to fold; underscores are blanks by then.
_LEET = re.compile(r"(?<![\w@$!])[^\W01345789]*+[01345789@$!][\w@$!]*")
_WORD = re.compile(r"[^\W\d_]+")
_LEET_TABLE = str.maketrans(SUBSTITUTES)


def _normal(text: str) -> str:
    text = text.lower()
    if _ODD.search(text):
        text = unicodedata.normalize("NFKC", text).lower().translate(_TABLE)
    return text.replace("_", " ")


def _folded(token: re.Match) -> str:
    core = token.group().rstrip("!")
    return core.translate(_LEET_TABLE) + token.group()[len(core) :] if _WORD.search(core) else token.group()


def fold(text: str) -> str:
    return _LEET.sub(_folded, _normal(text))


def forms_of(text: str | None) -> tuple[list[str], dict[int, tuple[int, list[str]]]]:
    """Folded words, and position of a token's first word -> (its folded words, its plain words) where these differ."""
    words, plain, at = [], {}, 0
    text = _normal(text) if text else ""
    for m in _LEET.finditer(text):
        new = _WORD.findall(_folded(m))
        old = _WORD.findall(m.group())
        if new != old:
            words += _WORD.findall(text, at, m.start())
            plain[len(words)] = len(new), old
            words += new
            at = m.end()
    return words + _WORD.findall(text, at), plain


def words_of(text: str | None) -> list[str]:
    return forms_of(text)[0]


def _terms(word: str, stems=(4, 5, 6, 7, 8)):
    """The word itself, and its beginnings as ``stem*``."""
    yield word
    for n in stems:
        if len(word) > n:
            yield word[:n] + "*"


class Lexicon:
    """Term weights and exception phrases in one automaton over " w1 w2 ... "."""

    def __init__(self, weights: dict[str, float], exceptions: set[tuple[str, str]]):
        self.weights, self.exceptions = weights, exceptions
        self.automaton = ahocorasick.Automaton()
        for t, w in weights.items():
            key = " " + t[:-1] if t.endswith("*") else f" {t} "
            self.automaton.add_word(key, (len(key), w))
        for a, b in exceptions:
            key = f" {a} {b} "
            self.automaton.add_word(key, (len(key), None))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def __reduce__(self):
        return Lexicon, (self.weights, self.exceptions)

    def _matches(self, words: list[str], owner) -> tuple[dict[int, tuple[float, str]], set[int]]:
        """(owner -> its heaviest match and the word, owners inside an exception); ``owner`` has one number a word."""
        place, begin = {}, 0
        text = f" {' '.join(words)} "
        hits = [(end - n + 1, end, w) for end, (n, w) in self.automaton.iter(text)]
        if not hits:
            return {}, set()
        for i, word in enumerate(words):
            place[begin] = i
            begin += len(word) + 1
        at, spared = {}, set()
        for begin, end, w in hits:
            i = place[begin]
            if w is None:
                spared |= {owner[i], owner[i + 1]}
            elif w > at.get(owner[i], (0.0,))[0]:
                at[owner[i]] = w, words[i]
        return at, spared

    def weight(self, words: list[str], plain: dict[int, tuple[int, list[str]]] | None = None) -> tuple[float, int]:
        """(sum of the weights of matched words, matched words).

        The heaviest term of each word counts, in its folded or plain form; the k-th repeat of a word adds 1/k of its weight.
        """
        if self.empty or not words:
            return 0.0, 0
        owner = list(range(len(words)))
        for i, (n, _) in (plain or {}).items():
            owner[i : i + n] = [i] * n
        at, spared = self._matches(words, owner)
        if plain:
            other, owners, last = [], [], 0
            for i, (n, old) in plain.items():
                other += words[last:i] + old
                owners += owner[last:i] + [i] * len(old)
                last = i + n
            more, clean = self._matches(other + words[last:], owners + owner[last:])
            spared |= clean
            for i, m in more.items():
                at[i] = max(at.get(i, m), m)
        times: dict[str, int] = {}
        total = 0.0
        kept = [m for i, m in sorted(at.items()) if i not in spared]
        for w, word in kept:
            times[word] = times.get(word, 0) + 1
            total += w / times[word]
        return total, len(kept)


class Model:
    def __init__(self, lexicon: Lexicon, curve: np.ndarray):
        self.lexicon, self.curve = lexicon, curve

    def features(self, texts) -> np.ndarray:
        rows = []
        for t in texts:
            words, plain = forms_of(t)
            total, n = self.lexicon.weight(words, plain)
            rows.append((1.0, math.log1p(total), math.log1p(1000 * total / (len(words) + 20)), min(n, 4) / 4))
        return np.array(rows).reshape(len(rows), 4)

    def score(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.curve, -30, 30)))


def _evidence(texts: list[list[str]], wanted) -> dict[str, int]:
    """Texts that show a wanted term between neighbours in which no text before showed it."""
    seen, found = defaultdict(set), defaultdict(int)
    for words in texts:
        padded, here = ["", *words, ""], defaultdict(set)
        for i, w in enumerate(words):
            for t in _terms(w):
                if wanted(t):
                    here[t].add(hash((padded[i], padded[i + 2])))
        for t, pairs in here.items():
            found[t] += not pairs <= seen[t]
            seen[t] |= pairs
    return found


def learn_lexicon(texts: list[str | None], labels: list[int], min_texts: int = 3, min_weight: float = 1.2) -> Lexicon:
    """Terms that ``min_texts`` toxic texts show, each between other neighbours.

    A term's weight is the log odds of a toxic text showing it, against a clean
    one, less one standard error; ``min_weight`` at least.
    """
    split = [words_of(t) for t in texts]
    total = [sum(y == v for y in labels) for v in (0, 1)]
    uses = _evidence([w for w, y in zip(split, labels) if y], lambda t: True)
    uses = {t: n for t, n in uses.items() if n >= min_texts}
    clean = _evidence([w for w, y in zip(split, labels) if not y], uses.__contains__)
    weights = {}
    for t, n in uses.items():
        other = clean.get(t, 0)
        odds = math.log(((n + 0.5) / (total[1] + 1)) / ((other + 0.5) / (total[0] + 1)))
        low = odds - math.sqrt(1 / (n + 0.5) + 1 / (other + 0.5))
        if low >= min_weight:
            weights[t] = low
    pairs = (defaultdict(int), defaultdict(int))
    for words, y in zip(split, labels):
        for p in {(a, b) for a, b in zip(words, words[1:]) if any(t in weights for w in (a, b) for t in _terms(w))}:
            pairs[y][p] += 1
    exceptions = {p for p, n in pairs[0].items() if n >= 3 and n > 4 * pairs[1].get(p, 0)}
    return Lexicon(weights, exceptions)


def train(texts: list[str | None], labels: list[int], **kw) -> Model | None:
    """Lexicon from two thirds of the sample, curve from the last third."""
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    part = np.arange(len(texts)) % 3 < 2 if len(texts) >= 60 else np.ones(len(texts), dtype=bool)
    lexicon = learn_lexicon([t for t, p in zip(texts, part) if p], [v for v, p in zip(labels, part) if p], **kw)
    rest = ~part if len(set(y[~part])) == 2 else np.ones(len(texts), dtype=bool)
    model = Model(lexicon, np.zeros(4))
    x = model.features([t for t, r in zip(texts, rest) if r])
    model.curve = logistic(x, y[rest], ridge=0.05)
    return model


def fit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 1500, max_chars: int = 20_000) -> Model | None:
    """Train on at most ``per_class`` whole texts of each label; it is a column of ``docs``, or of ``labels`` (id, label)."""
    known = f"`{label_col}` in (0, 1)"
    rows, labels = (docs.where(known), None) if labels is None else (docs, labels.where(known))
    sample = bounded_sample(rows, id_col, label_col, per_class, max_chars, text_col, labels)
    return train([t for t, _ in sample], [int(y) for _, y in sample])

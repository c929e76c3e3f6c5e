"""Language of a text by a conditional random field over its words.

Features of a word: prefixes and suffixes of one to three letters, character
pairs and triples of the word with its borders, and the word itself
(lexicon), as far as they make up one in ``_RARE`` of the words and occur
thrice; that bounds the model.  A text that switches between languages is
labelled word by word with forward-backward.  A document's language has the
largest share of letters, weighted by the words' marginals; that share is its
score.

Training counts the words of all documents that have a language, whole texts,
by language; every language weighs alike.  The field is trained piecewise: the
weights of features by maximum likelihood of the languages of all counted words
(each round sums the gradient over the table of counts, in whole numbers, so
that it does not depend on the tasks), the transitions from the counts of
words and of fragments of ``_FRAGMENT`` words, as if all fragments were laid end
to end in any order.  Weights and sums by feature reach the driver, no text.
Words are letters (and marks after the first), by Unicode category.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
ties go to the language that sorts first; with no row to learn from every text
is ``und``; bytes that are not UTF-8 count as U+FFFD; a very long text is read a
part at a time with the forward vector carried on; repeated rows and null ids
give a row each; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from itertools import count, islice
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm.common import bounded_sample, decoded, filter_by_text, materialise, release, summed, written
from medialake.llm.crf import Crf, Layout, long_marginals, smoothed

_ASCII = re.compile("[a-z]+")
_LATIN = re.compile("[a-zªµºß-öø-ÿ]+")  # the letters up to U+00FF, where there are no marks
#: A word begins with a letter; marks, such as vowel signs, belong to it.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    text = text.lower()
    if text.isascii():
        return _ASCII.findall(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _LETTERS.findall(text)
    return _LATIN.findall(text)


def slices(text: str, size: int):
    """Consecutive (from, to) of about ``size`` characters that cut no word."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and (text[end].isalpha() or unicodedata.category(text[end])[0] == "M"):
            end += 1
        yield at, end
        at = end


def word_features(word: str) -> set[str]:
    padded = f"^{word}$"
    pairs = list(map(add, padded, padded[1:]))
    found = {f"={word}", "<" + word[:1], "<" + word[:2], "<" + word[:3], ">" + word[-1:], ">" + word[-2:], ">" + word[-3:]}
    found.update(pairs, map(add, pairs, padded[2:]))
    return found


def _points(words: list[str]) -> np.ndarray:
    """Code points of the words with their borders, in a row."""
    return np.frombuffer(f"^{'$^'.join(words)}$".encode("utf-32-le"), dtype=np.uint32)


def _short_keys(digits: np.ndarray, size: np.ndarray, base: int):
    """(keys, the words they belong to) of affixes, pairs and triples of words of ``size`` letters; some twice.

    ``digits`` are those of ``_points``, from 1 to ``base`` - 1.  A key is a
    number of three digits; those of prefixes and suffixes are greater by
    ``base`` ** 3 and twice that.
    """
    word, step = np.repeat(np.arange(len(size)), size + 2), base**3
    pair = digits[:-1] * base + digits[1:]
    triple = pair[:-1] * base + digits[2:]
    for n, keys in ((1, pair), (2, triple)):
        inside = word[:-n] == word[n:]
        yield keys[inside], word[:-n][inside]
    end = np.cumsum(size + 2) - 1
    begin = end - size
    for n in (1, 2, 3):
        full = np.flatnonzero(size >= n)
        head, tail = np.zeros(len(full), dtype=np.int64), np.zeros(len(full), dtype=np.int64)
        for i in range(n):
            head, tail = head * base + digits[begin[full] + i], tail * base + digits[end[full] - n + i]
        yield head + step, full
        yield tail + 2 * step, full


_TABLE = 1 << 22  # keys up to here are looked up in a table


class Model:
    """Languages, features by name, and the field.

    Features of at most four characters (all but the lexicon) are also kept as
    numbers, their characters being the digits, so that many words are looked
    up at once.
    """

    def __init__(self, languages: list[str], feature_ids: dict[str, int], crf: Crf):
        self.languages, self.feature_ids, self.crf = languages, feature_ids, crf
        short = {f: i for f, i in feature_ids.items() if f and f[0] != "="}
        letters = sorted({ord(c) for f in short for c in f.lstrip("<>")})
        self.base = len(letters) + 2  # digits from 1; the last is any other character
        self.digits = np.full(letters[-1] + 2 if letters else 1, self.base - 1, dtype=np.int64)
        self.digits[letters] = np.arange(1, len(letters) + 1)
        keys = np.array([self._key(f) for f in short], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ids, self.table = keys[order], np.array(list(short.values()), dtype=np.int64)[order], None
        if 3 * self.base**3 <= _TABLE:
            self.table = np.zeros(3 * self.base**3, dtype=np.int32)
            self.table[self.keys] = self.key_ids

    def _key(self, feature: str) -> int:
        key, kind = 0, "<>".find(feature[0]) + 1
        for c in feature[kind > 0 :]:
            key = key * self.base + int(self.digits[ord(c)])
        return kind * self.base**3 + key

    def _known(self, keys: np.ndarray) -> np.ndarray:
        """Features by key; 0 for what is none."""
        if self.table is not None:
            return self.table[keys].astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.key_ids[at], 0)

    def features(self, words: list[str]):
        """(features, where those of each word begin): each once a word, in order, 0 (the bias) first."""
        n, get = len(self.feature_ids), self.feature_ids.get
        lexicon = np.fromiter((get("=" + w, 0) for w in words), dtype=np.int64, count=len(words))
        all_words = np.arange(len(words)) * n
        ids = [all_words, (all_words + lexicon)[lexicon > 0]]
        if len(self.keys) and words:
            size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            digits = self.digits[np.minimum(_points(words), len(self.digits) - 1)]
            for keys, word in _short_keys(digits, size, self.base):
                found = self._known(keys)
                known = found > 0
                ids.append(word[known] * n + found[known])
        ids = np.sort(np.concatenate(ids))
        ids = ids[np.diff(ids, prepend=-1) > 0]
        starts = np.searchsorted(ids, all_words)
        return ids - np.repeat(all_words, np.diff(starts, append=len(ids))), starts

    def emission(self, words: list[str]) -> np.ndarray:
        ids, starts = self.features(words)
        return self.crf.emissions(ids, np.append(starts, len(ids)))


_FRAGMENT = 35  # words of one language that follow each other in a text that switches
_RARE = 100_000
_UNIT = float(1 << 50)
_PART = 1 << 20  # characters of a text that are held as words at once
_HELD = 200_000  # counts that a task holds at once


def _counts(rows):
    """Counters of words by language, the word "" for fragments, of (text, language) rows; more than one set if there is much."""
    found, held = defaultdict(Counter), 0
    for text, lang in rows:
        own, n = found[lang], 0
        held -= len(own)
        for lo, hi in slices(text, _PART):
            words = words_of(text[lo:hi])
            n += len(words)
            own.update(words)
        if n:
            own[""] += -(-n // _FRAGMENT)
        held += len(own)
        if held > _HELD:
            yield found
            found, held = defaultdict(Counter), 0
    yield found


def _pairs(counters):
    """Record batches (lang, word, n) of such counters."""
    for found in counters:
        for lang, own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), lang, dtype=object), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["lang", "word", "n"])


_POINTS = 0x110001  # base of keys that hold for any text: the digit of a character is its code point and one


def _feature_counts(batches):
    """Record batches (lang, key, n) of record batches (lang, word, n): how many words hold each short feature."""

    def together():
        some, held = [], 0
        for b in batches:
            some.append(b)
            held += b.num_rows
            if held >= _AT_ONCE:
                yield some
                some, held = [], 0
        if some:
            yield some

    for some in together():
        langs, words, ns = ([x for b in some for x in b.column(i).to_pylist()] for i in range(3))
        names = sorted(set(langs))
        number = {x: i for i, x in enumerate(names)}
        lang = np.fromiter(map(number.get, langs), dtype=np.int64, count=len(langs))
        for of, keys, n in _key_counts(words, lang, np.array(ns, dtype=np.int64)):
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(of)), pa.array(keys), pa.array(n)], names=["lang", "key", "n"])


_AT_ONCE = 40_000  # words whose features are counted at once


def _key_counts(words: list[str], lang: np.ndarray, n: np.ndarray):
    """(language, key, words that hold it) arrays."""
    if not words:
        return
    points = _points(words)
    digits = np.zeros(int(points.max()) + 1, dtype=np.int64)
    digits[points] = 1
    letters = np.flatnonzero(digits)
    base = len(letters) + 1
    digits[letters] = np.arange(1, base)
    bits = (3 * base**3).bit_length()
    if len(words) > 1 and bits + len(words).bit_length() + 1 > 62:  # numbers of a word and a key in 63 bits
        half = len(words) // 2
        yield from _key_counts(words[:half], lang[:half], n[:half])
        yield from _key_counts(words[half:], lang[half:], n[half:])
        return
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    held = np.sort(np.concatenate([(word << bits) | keys for keys, word in _short_keys(digits[points], size, base)]))
    held = held[np.diff(held, prepend=-1) > 0]  # a feature counts once a word
    word, key = held >> bits, held & ((1 << bits) - 1)
    of, found = np.unique(lang, return_inverse=True)  # not more than words
    pairs, at = np.unique((found[word] << bits) | key, return_inverse=True)
    sums = np.zeros(len(pairs), dtype=np.int64)
    np.add.at(sums, at, n[word])
    key = pairs & ((1 << bits) - 1)
    points_of, any_key = np.append(0, letters + 1), key // base**3
    for power in (2, 1, 0):
        any_key = any_key * _POINTS + points_of[key // base**power % base]
    yield of[pairs >> bits], any_key, sums


def _named(key: int) -> str:
    """A short feature by its key."""
    found = ""
    for _ in range(3):
        key, point = divmod(key, _POINTS)
        found = (chr(point - 1) if point else "") + found
    return ("", "<", ">")[key] + found


_BLOCK = 8  # instances in a row of their table: few, as Spark's readers hold thousands of rows at once
_STEP = 4096  # instances whose gradient is summed at once


def _instances(batches, languages: list[str], feature_ids: dict[str, int]):
    """Record batches of record batches (lang, word, n): each row has the labels, counts, numbers of features and features of a block of words."""
    label, model, kind = {x: i for i, x in enumerate(languages)}, Model(languages, feature_ids, Crf(0, 0)), _kind(len(feature_ids))
    for b in batches:
        langs, words, n = (c.to_pylist() for c in b.columns)
        ids, starts = model.features(words)
        ends = np.append(starts, len(ids))
        at = np.append(np.arange(0, len(words), _BLOCK), len(words))  # where the blocks begin
        held = ((np.array([label[x] for x in langs], dtype=np.int32), at), (np.array(n, dtype=np.int64), at), (np.diff(ends).astype(np.int32), at), (ids.astype(kind), ends[at]))
        yield pa.RecordBatch.from_arrays([_packed(values, of) for values, of in held], names=["label", "n", "held", "ids"])


def _packed(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary values, each of those from one of ``at`` to the next."""
    offsets = (at * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _flat(column: pa.Array, kind) -> np.ndarray:
    """All values of a binary column in a row, without a copy."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if len(column) else np.zeros(0, kind)


def _kind(size: int) -> np.dtype:
    """The least type of the numbers of so many features."""
    return np.min_scalar_type(max(0, size - 1))


def _gradient(weights: np.ndarray, share: np.ndarray):
    """Of a batch of instances, the gradient of the log likelihood by language and feature, in whole numbers; a word of language y weighs ``share[y]``.

    Weights count from those of the last language, whose gradient is what the
    others leave to 0.
    """
    size, k = weights.shape
    apart, kind = np.ascontiguousarray((weights[:, :-1] - weights[:, -1:]).T), _kind(size)

    def part(batch):
        total = np.zeros((k, size))
        labels, counts, sizes, features = (_flat(c, t) for c, t in zip(batch.columns, (np.int32, np.int64, np.int32, kind)))
        ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
        for lo in range(0, len(labels), _STEP):
            y, n, held = (x[lo : lo + _STEP] for x in (labels, counts, sizes))
            ids = features[ends[lo] : ends[lo + len(y)]].astype(np.intp)
            starts, miss = np.cumsum(held) - held, np.zeros((k, len(y)))
            for c in range(k - 1):
                np.add.reduceat(apart[c].take(ids), starts, out=miss[c])
            miss = -np.exp(miss - miss.max(axis=0))
            miss /= -miss.sum(axis=0)
            miss[y, np.arange(len(y))] += 1
            miss = np.rint(miss * (n * share[y] * _UNIT))
            word = np.repeat(np.arange(len(y)), held)
            for c in range(k - 1):
                total[c] += np.bincount(ids, weights=miss[c].take(word), minlength=size)
        total[-1] = -total[:-1].sum(axis=0)
        return total.astype(np.int64).ravel()

    return part


def _learn(totals: dict[str, tuple[int, int]], feature_ids: dict[str, int], gradient, rounds: int, weight_decay: float = 1e-5, rate: float = 0.15) -> Model:
    """``totals``: words and fragments of each language; ``gradient(part, size)`` sums ``part`` over all instances.  Adam, as in ``Crf.fit``."""
    languages, k = sorted(totals), len(totals)
    crf = Crf(len(feature_ids), k)
    share = np.array([1 / (k * totals[x][0]) for x in languages])
    m1, m2 = np.zeros_like(crf.weights), np.zeros_like(crf.weights)
    for step in range(1, rounds + 1):
        g = gradient(_gradient(crf.weights, share), crf.weights.size).reshape(k, -1).T / _UNIT - weight_decay * crf.weights
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.99 * m2 + 0.01 * g * g
        crf.weights = crf.weights + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-10)
    ends = np.array([totals[x][1] / totals[x][0] for x in languages])
    crf.trans = np.log(k * np.diag(1 - ends) + ends[:, None])  # over the languages' equal weight, which the features' weights hold
    return Model(languages, feature_ids, crf)


def _numbered(features) -> dict[str, int]:
    return {"": 0} | {f: i for i, f in enumerate(sorted(features), 1)}


def train(texts: list[tuple[str, str]], rounds: int = 40) -> Model | None:
    """Fit on (text, language) pairs; None without any word to learn from."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for found in _counts(texts):
        for x, own in found.items():
            counts[x].update(own)
    totals = {x: (sum(own.values()) - own[""], own[""]) for x, own in counts.items() if own}
    if not totals:
        return None
    batches = [b.filter(pc.not_equal(b.column(1), "")) for b in _pairs([counts])]
    held, share = Counter(), Counter()
    for b in (*_feature_counts(batches), *batches):
        for x, f, n in zip(*(c.to_pylist() for c in b.columns)):
            held[f] += n
            share[f] += n / (len(totals) * totals[x][0])
    often = [f for f in held if held[f] >= 3 and share[f] * _RARE >= 1]
    feature_ids = _numbered(f"={f}" if isinstance(f, str) else _named(f) for f in often)
    blocks = list(_instances(batches, sorted(totals), feature_ids))
    return _learn(totals, feature_ids, lambda part, size: sum(map(part, blocks), np.zeros(size, dtype=np.int64)), rounds)


def train_on_all(rows: DataFrame, rounds: int = 40) -> Model | None:
    """``train`` on a table (text as bytes, language); leaves no table behind."""
    before = written()
    try:
        return _train_on_all(rows, rounds)
    finally:
        release(rows.sparkSession, before)


def _train_on_all(rows: DataFrame, rounds: int) -> Model | None:
    listed = lambda batches: (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    told = rows.mapInArrow(lambda batches: _pairs(_counts((decoded(t), x) for t, x in listed(batches))), "lang string, word string, n long")
    counts = materialise(told.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    of_word = F.col("word") != ""
    totals = {r.lang: (r.words, r.fragments) for r in counts.groupBy("lang").agg(F.sum(F.when(of_word, F.col("n"))).alias("words"), F.sum(F.when(~of_word, F.col("n"))).alias("fragments")).collect()}
    if not totals:
        return None
    words, languages = counts.where(of_word), sorted(totals)
    sizes = F.broadcast(rows.sparkSession.createDataFrame([(x, float(len(totals) * n)) for x, (n, _) in totals.items()], "lang string, size double"))

    def often(by_lang: DataFrame) -> list:
        found = by_lang.join(sizes, "lang").groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") / F.col("size")).alias("share"))
        return [r.key for r in found.where((F.col("n") >= 3) & (F.col("share") * _RARE >= 1)).select("key").collect()]

    short = words.mapInArrow(_feature_counts, "lang string, key long, n long").groupBy("key", "lang").agg(F.sum("n").alias("n"))
    feature_ids = _numbered([*map(_named, often(short)), *(f"={w}" for w in often(words.withColumnRenamed("word", "key")))])
    shared = rows.sparkSession.sparkContext.broadcast(feature_ids)
    instances = materialise(words.mapInArrow(lambda batches: _instances(batches, languages, shared.value), "label binary, n binary, held binary, ids binary"))
    return _learn(totals, feature_ids, lambda part, size: summed(instances, part, size), rounds)


class Labeller:
    """Applies a model to texts; remembers the emissions of words it has seen."""

    def __init__(self, model: Model, memory: int = 200_000):
        self.model, self.memory = model, memory
        self._reset()

    def _reset(self):
        self.ids: dict[str, int] = defaultdict(count().__next__)
        self.emit = np.zeros((1024, len(self.model.languages)))  # the likelihoods of the languages, the greatest being 1
        self.letters = np.zeros(1024, dtype=np.int64)

    def _learn(self, new: list[str], at: int) -> None:
        if at + len(new) > len(self.emit):
            more = max(len(new), len(self.emit))
            self.emit = np.concatenate([self.emit, np.zeros((more, self.emit.shape[1]))])
            self.letters = np.concatenate([self.letters, np.zeros(more, dtype=np.int64)])
        for i in range(0, len(new), 10_000):
            some = new[i : i + 10_000]
            emit = self.model.emission(some)
            self.emit[at + i : at + i + len(some)] = np.exp(np.maximum(emit - emit.max(axis=1, keepdims=True), -60.0))
            self.letters[at + i : at + i + len(some)] = np.fromiter(map(len, some), dtype=np.int64, count=len(some))

    def _kinds(self, words: list[str]) -> np.ndarray:
        before = len(self.ids)
        kinds = np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))
        if len(self.ids) > before:
            self._learn(list(islice(self.ids, before, None)), before)
        return kinds

    def _make_room(self) -> None:
        if len(self.ids) > self.memory:
            self._reset()

    def long_mass(self, text: str, part: int) -> np.ndarray:
        """Letters of each language, and those told with certainty, in a text of which ``part`` characters are held at a time."""
        places = list(slices(text, part))
        mass = np.zeros(len(self.model.languages) + 1)

        def emissions(i):
            self._make_room()
            return np.log(self.emit[self._kinds(words_of(text[slice(*places[i])]))])

        def use(i, gamma):
            words = words_of(text[slice(*places[i])])
            if words:
                letters = np.array([len(w) for w in words])
                mass[:-1] += letters @ gamma
                mass[-1] += letters @ gamma.max(axis=1)

        long_marginals(len(places), emissions, self.model.crf.trans, self.model.crf.start, use)
        return mass

    def _smoothed(self, texts: list[str]):
        """(marginals, letters and layout of all words, in the layout's order, words of each text)."""
        self._make_room()
        words, lengths = [], []
        for text in texts:
            found = words_of(text)
            words += found
            lengths.append(len(found))
        kind, lengths = self._kinds(words), np.array(lengths, dtype=np.int64)
        del words
        lay = Layout(lengths)
        kind = kind[lay.perm]
        return smoothed(self.emit.take(kind, axis=0), lay, self.model.crf.trans, self.model.crf.start), self.letters[kind], lay, lengths

    def marginals(self, texts: list[str]):
        """(marginals of all words, letters of each word, words of each text)."""
        gamma, size, lay, lengths = self._smoothed(texts)
        out, letters = np.empty_like(gamma), np.empty_like(size)
        out[lay.perm], letters[lay.perm] = gamma, size
        return out, letters, lengths

    def judge(self, texts: list[str | None], long: int = 3_000_000):
        """[(language, its share of the letters, mean best marginal)] of each text; those of over ``long`` characters are read a part at a time."""
        out = [(UNKNOWN, 0.0, 0.0)] * len(texts)
        for i, t in enumerate(texts):
            if t and len(t) > long and (mass := self.long_mass(t, max(1, long // 3)))[:-1].sum():
                best, total = int(mass[:-1].argmax()), mass[:-1].sum()
                out[i] = self.model.languages[best], float(min(1.0, mass[best] / total)), float(mass[-1] / total)
        live = [i for i, t in enumerate(texts) if t and len(t) <= long]
        for lo, hi in _runs([len(texts[i]) for i in live], 1_500_000):
            part = live[lo:hi]
            m, letters, lay, lengths = self._smoothed([texts[i] for i in part])
            full = np.flatnonzero(lengths)
            if not len(full):
                continue
            text = np.repeat(np.arange(len(lengths)), lengths)[lay.perm]
            by_text = lambda x: np.bincount(text, weights=x, minlength=len(lengths))[full]
            m *= letters[:, None]
            mass = np.stack([by_text(c) for c in m.T], axis=1)
            total = mass.sum(axis=1)
            sure = by_text(np.maximum.reduce(list(m.T))) / total
            share = mass / total[:, None]
            best = share.argmax(axis=1)
            for j, b, s, c in zip(full, best, share[np.arange(len(full)), best], sure):
                out[part[j]] = self.model.languages[b], float(min(1.0, s)), float(c)
        return out

    def languages(self, texts: list[str | None], **kw):
        """[(language, score)] of each text."""
        return [(x, s) for x, s, _ in self.judge(texts, **kw)]


def _runs(sizes: list[int], limit: int):
    """Consecutive (from, to) whose sizes sum to about ``limit`` at most."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int | None = None, max_chars: int = 20_000) -> Model | None:
    """Train on all rows of ``labelled`` that have a text and a language; if ``per_language`` is given, on so many of each language, none longer than ``max_chars``."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(id_col, text_col, lang_col)
    if per_language is not None:
        return train(bounded_sample(rows, id_col, lang_col, per_language, max_chars, text_col))
    return train_on_all(rows.select(F.col(text_col).cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang")))


def identify(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred and score (names taken by ``docs`` give way)."""
    names = [c for c in keep if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labeller = Labeller(shared.value) if shared.value else None
        for b in batches:
            texts = [decoded(t) for t in b.column(b.num_columns - 1).to_pylist()]
            found = labeller.languages(texts) if labeller else [(UNKNOWN, 0.0)] * len(texts)
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*names, "lang_pred", "score"])

    slim = docs.select(*names, F.col(text_col).cast("binary").alias("_scored_text"))
    schema = slim.drop("_scored_text").schema.add("lang_pred", "string").add("score", "double")
    return slim.mapInArrow(run, schema)


def keep_clear(docs: DataFrame, model: Model | None, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """``docs`` without the rows that are ``und`` or whose words are unclear.

    A text that switches between languages is clear if its words are: the mean
    of each word's best marginal, by letters, is ``min_score`` at least.
    Without a model all are ``und``, so none stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        labeller = Labeller(shared.value) if shared.value else None

        def judge(texts):
            found = labeller.judge([decoded(t) for t in texts]) if labeller else [(UNKNOWN, 0.0, 0.0)] * len(texts)
            return [x != UNKNOWN and sure >= min_score for x, _, sure in found]

        return judge

    return filter_by_text(docs, text_col, prepare)

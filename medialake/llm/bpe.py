"""Byte-level BPE: exact encoding by backtracking, decoding by an offset table.

A text is cut at special tokens, then into pieces by the pattern of byte-level
tokenizers.  Within a piece (of bytes), merging pairs by rank until none is
left gives one sequence of tokens, and that sequence is the only one whose
neighbours are all *compatible*, that is, whose boundary no merge would cross.
So the encoder looks for that sequence instead of merging:
* one scan of an Aho-Corasick automaton gives the longest token that starts at
  each byte;
* the longest token goes first; if it is not compatible with the one before, or
  ends where the rest is known to have no answer, the next shorter prefix that
  is a token is tried; if none is left, the token before is taken back and its
  end noted.  Each end is noted once, so the work is linear in the bytes.
Whether a pair is compatible is found by taking both tokens apart along the
boundary, the younger first, and looking up the pairs that stood side by side;
answers are kept in a table.

Decoding looks up where each token's bytes lie in one string of all tokens and
gathers them; bytes that are not UTF-8 become U+FFFD.

Each Python worker builds the tables once from a broadcast copy of the
vocabulary (about 1 MB).  Pieces of up to 64 characters are remembered (500,000
at most).  Memory for one text is its bytes, five bytes for each token and one
for each byte of its longest piece.

Defined cases: a null text has no tokens and decodes to an empty text; bytes
that are not UTF-8 become U+FFFD before encoding; special tokens in a text are
encoded as such, as tokenizers do by default; null ids are skipped and ids
outside the vocabulary raise; empty tables give empty results; other columns
are kept, whatever their names, but those named like the result give way.
"""

from __future__ import annotations

import functools
import itertools
import json
import pickle
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm.common import decoded

# Fixed value: how byte-level tokenizers cut a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SLICE = 1 << 16
_MEMO, _MEMO_CHARS = 250_000, 64
_ROWS = 500  # of a result's batch
_LONG = 1 << 20


def byte_letters() -> dict[str, int]:
    """Letters by which vocabulary files write bytes: visible ones stand for themselves, others follow from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> bytes:
    """Tokens, merges and special tokens of a tokenizer file, packed for a broadcast."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [x["content"] for x in spec["added_tokens"] if x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]]
    if odd or model["type"] != "BPE" or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
        raise ValueError(f"{path} is not a plain byte-level BPE {odd}")
    letters, vocab = byte_letters(), model["vocab"]
    tokens = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    return pickle.dumps((tokens, merges, {x["content"]: x["id"] for x in spec["added_tokens"]}))


class Encoder:
    """Tables of one vocabulary, and encoding and decoding with them."""

    def __init__(self, packed: bytes):
        tokens, merges, self.special = pickle.loads(packed)
        size = max([*tokens, *self.special.values()]) + 1
        self.rank, self.parts = [-1] * size, [None] * size
        self.pairs: dict[tuple[int, int], int] = {}
        for r, (a, b, t) in enumerate(merges):
            self.pairs.setdefault((a, b), r)
            if self.parts[t] is None:
                self.parts[t], self.rank[t] = (a, b), r
        self.compatible = functools.lru_cache(1 << 17)(self.apart)
        made: dict[int, str] = {}  # tokens that merging their own bytes gives; no others ever appear
        for t in sorted(tokens, key=lambda t: self.rank[t]):
            ab = self.parts[t]
            if ab is None and len(tokens[t]) == 1 or ab and ab[0] in made and ab[1] in made and self.apart(*ab, self.rank[t]):
                made[t] = tokens[t].decode("latin-1")
        ids = {s: t for t, s in made.items()}
        self.width = np.zeros(size, np.int64)
        self.shorter, self.automaton = [-1] * size, ahocorasick.Automaton()
        for t, s in made.items():
            self.automaton.add_word(s, t)
            self.shorter[t] = next((ids[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in ids), -1)
        self.automaton.make_automaton()
        told = tokens | {i: s.encode() for s, i in self.special.items()}
        for t, b in told.items():
            self.width[t] = len(b)
        self.length = self.width.tolist()
        self.widest = max(self.length, default=1)
        self.start = np.cumsum(self.width) - self.width
        self.known = np.zeros(size, bool)
        self.known[list(told)] = True
        self.bytes = np.frombuffer(b"".join(told.get(t, b"") for t in range(size)), np.uint8)
        self.cut = regex.compile(PIECES)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo = _Memo(self)

    def apart(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether no merge of a rank below ``before`` joins the end of ``a`` to the start of ``b``.

        Both are taken apart along the boundary, last merge first.  A pair that
        then stands side by side would have been merged if its rank comes before
        that of the merge undone; at equal rank the pair further left goes first.
        """
        rank, parts, pairs = self.rank, self.parts, self.pairs
        while True:
            r = pairs.get((a, b))
            if r is not None and r < before:
                return False
            if rank[a] > rank[b]:
                before, a = rank[a], parts[a][1]
            elif rank[b] >= 0:
                before, b = rank[b] + 1, parts[b][0]
            else:
                return True

    def longest(self, piece: str) -> list[int]:
        """The longest token that starts at each place of ``piece`` (bytes as Latin-1)."""
        found, length = [0] * len(piece), self.length
        for end, t in self.automaton.iter(piece):  # ends ascend, so the longest comes last
            found[end + 1 - length[t]] = t
        return found

    def encode_piece(self, piece: str) -> array:
        """Tokens of the bytes of one piece."""
        raw = piece if piece.isascii() else piece.encode().decode("latin-1")
        end, place = len(raw), 0
        if not raw:
            return array("i")
        longest = self.longest(raw) if end <= _SLICE else _Slices(self, raw)
        token = longest[0]
        length, shorter, fits, out = self.length, self.shorter, self.compatible, array("i")
        if length[token] == end:  # one token, or two that nothing joins, which is most pieces
            return array("i", (token,))
        second = longest[length[token]]
        if length[token] + length[second] == end and fits(token, second):
            return array("i", (token, second))
        dead = bytearray(end + 1)
        while place < end:
            while token >= 0 and (dead[place + length[token]] or out and not fits(out[-1], token)):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                place += length[token]
                token = longest[place] if place < end else -1
            else:  # nothing goes from here: take the last token back, and never end here again
                dead[place] = 1
                token = out.pop()
                place -= length[token]
        return out

    def encode(self, text: str) -> array:
        out = array("i")
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                pieces = self.cut.findall(part) if len(part) < _LONG else (m.group() for m in self.cut.finditer(part))
                out.extend(itertools.chain.from_iterable(map(self.memo.__getitem__, pieces)))
        return out

    def token_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one behind the other."""
        found = []
        for i in range(0, len(ids), _LONG):
            some = ids[i : i + _LONG]
            if some.size and (some.min() < 0 or some.max() >= len(self.known) or not self.known[some].all()):
                raise ValueError("ids outside the vocabulary")
            width = self.width[some]
            shift = self.start[some] - (np.cumsum(width) - width)
            found.append(self.bytes[np.repeat(shift, width) + np.arange(width.sum())].tobytes())
        return b"".join(found)

    def decode(self, ids) -> str:
        return self.token_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


class _Slices:
    """``Encoder.longest`` of a long piece, a slice at a time, of which the last few are kept."""

    def __init__(self, encoder: Encoder, piece: str):
        self.encoder, self.piece, self.found = encoder, piece, {}

    def __getitem__(self, place: int) -> int:
        k = place // _SLICE
        if k not in self.found:
            if len(self.found) == 4:
                self.found.clear()
            self.found[k] = self.encoder.longest(self.piece[k * _SLICE : (k + 1) * _SLICE + self.encoder.widest])
        return self.found[k][place % _SLICE]


class _Memo(dict):
    """Tokens of the pieces asked for last; when it is full, those of the time before are kept apart once more."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encode_piece, self.before = encoder.encode_piece, {}

    def __missing__(self, piece: str):
        ids = self.before.get(piece)
        if ids is None:
            ids = self.encode_piece(piece)
        if len(piece) <= _MEMO_CHARS:
            if len(self) >= _MEMO:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@functools.lru_cache(1)
def _encoder(packed: bytes) -> Encoder:
    """One for each Python worker."""
    return Encoder(packed)


def _added(rows: DataFrame, source: str, vocabulary: bytes, run, made: dict[str, str]) -> DataFrame:
    """``rows`` with the columns ``made`` (name to type), which ``run(encoder, Arrow column)`` gives for column ``source``.

    The other columns travel with it as they are, strings as bytes.
    """
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    sent = lambda c, kind: rows[c].cast("binary") if kind == "string" else rows[c]
    kept = [(i, c, t) for i, (c, t) in enumerate(rows.dtypes) if c not in made]
    packed = rows.select(sent(source, dict(rows.dtypes)[source]).alias("_source"), F.struct(F.lit(0).alias("_"), *(sent(c, t).alias(f"_{i}") for i, c, t in kept)).alias("_row"))
    names = [f"_made{i}" for i in range(len(made))]

    def work(batches):
        encoder = _encoder(shared.value)
        for b in batches:
            for low in range(0, b.num_rows, _ROWS):
                part = b.slice(low, _ROWS)
                yield pa.RecordBatch.from_arrays([*run(encoder, part.column(0)), part.column(1)], names=[*names, "_row"])

    schema = ", ".join(f"{n} {'binary' if t == 'string' else t}" for n, t in zip(names, made.values()))
    found = packed.mapInArrow(work, f"{schema}, _row {packed.schema['_row'].dataType.simpleString()}")
    return found.select(*(F.col(f"_row._{i}").cast(t).alias(c) for i, c, t in kept), *(F.col(n).cast(t).alias(c) for n, (c, t) in zip(names, made.items())))


def _encode_column(encoder: Encoder, column: pa.Array) -> pa.Array:
    ids, ends = array("i"), [0]
    for raw in column:
        ids.extend(encoder.encode(decoded(raw.as_py()) or ""))
        ends.append(len(ids))
    return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)))


def _decode_column(encoder: Encoder, column: pa.Array) -> pa.Array:
    texts = [encoder.decode([] if not row.is_valid else row.values.drop_null().to_numpy(zero_copy_only=False)).encode() for row in column]
    return pa.array(texts, pa.binary())


def encode(docs: DataFrame, vocabulary: bytes, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the token ids of their texts as an array, and, if it has a name, with the text decoded from these ids by the same task."""

    def run(encoder, column):
        ids = _encode_column(encoder, column)
        return [ids, _decode_column(encoder, ids)] if decoded_col else [ids]

    return _added(docs, text_col, vocabulary, run, {ids_col: "array<int>"} | ({decoded_col: "string"} if decoded_col else {}))


def decode(rows: DataFrame, vocabulary: bytes, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their token ids."""
    return _added(rows, ids_col, vocabulary, lambda encoder, column: [_decode_column(encoder, column)], {text_col: "string"})

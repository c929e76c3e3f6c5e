"""Language-model scores by deleted interpolation.

Model: p(w | u v) = a c(u v w) / c(u v) + b c(v w) / c(v) + (1 - a - b) (c(w) + 0.5) / (N + 0.5 (V + 1)).
The weights belong to the bucket of the context: floor(log2(c(u v) + 1)) of the
pair, or of the word where the pair was never seen (a is 0 there) or where a
text begins.  They are learned by expectation-maximisation on held-out counts:
one in ``em_part`` training documents is set aside, the estimates come from the
others, and the ratios of the first two components to the third of each token
set aside enter a histogram (bucket by half binary orders), which is all that
reaches the driver.  The final counts include the part set aside.

All counts are taken over all training documents.  N-grams travel as keys of 64
bits, so the tables hold no text; at 10^13 tokens a key is shared with another
n-gram with a probability of about 10^-6.
1. Each task packs the documents it reads into blocks, one row each, with the
   texts compressed; this table is written to the shared folder.
2. A block sends each of its distinct keys once, with its count, to the key's
   range.  A word that is everywhere costs one entry a block.
3. Each range sums its keys and returns the sums in the block's own order, so
   the answer holds no keys.  This table is written, too.
   Words and pairs come first, then triples, and the shuffle files of the first
   go before the second begins.
4. Blocks meet their answers and score their documents.
Memory of a task is that of one block or one range.  Blocks hold
``block_bytes`` of text, more only as the square root of the input, which
keeps the pieces that go from a block to a range from becoming tiny.

Defined cases: a null or empty text is one end token; a null id is trained on
and never held out; repeated rows each count and each get a row; without
training tokens every estimate is the uniform one; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm.common import id_fold, materialise

_END = (0x5BD1E995A5A5A5A5).to_bytes(8, "big")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_NONE_BIN = -1000
_SPACES = ("w", "p", "t")  # words, pairs, triples


# --- tokens and keys --------------------------------------------------------
def word_keys(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(word keys of all texts, each followed by the end key; tokens of each text)."""
    parts, lengths, key = [], [], xxhash.xxh3_64_digest
    for t in texts:
        words = t.lower().split() if t else []
        parts.append(b"".join([key(w) for w in words]) + _END)
        lengths.append(len(words) + 1)
    return np.frombuffer(b"".join(parts), dtype=">u8").astype(np.uint64), np.array(lengths, dtype=np.int64)


def _mixed(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of (what ``x`` stands for, word); changes ``x``."""
    x *= _M1
    x ^= (words >> np.uint64(31)) ^ (words << np.uint64(33))
    x *= _M2
    x ^= x >> np.uint64(32)
    x *= _M1
    return x


def gram_keys(words: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """Keys of each token's word, of the pair and of the triple that it ends; a text starts after two ends."""
    keys, first = {"w": words}, np.cumsum(lengths) - lengths
    for space, shorter, edge in (("p", "w", int.from_bytes(_END, "big")), ("t", "p", 0x1F83D9ABFB41BD6B)):
        x = np.empty_like(words)
        x[1:] = keys[shorter][:-1]
        x[first] = np.uint64(edge)
        keys[space] = _mixed(x, words)
    return keys


class Distinct:
    """Distinct keys in order, and the place among them of each key given."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        ordered = keys[self.order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        self.starts = np.flatnonzero(new)
        self.keys = ordered[self.starts]
        self.at = np.empty(len(keys), dtype=np.int64)
        self.at[self.order] = np.cumsum(new) - 1

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Occurrences of each distinct key whose flag is set."""
        return np.add.reduceat(flags[self.order].astype(np.int64), self.starts)


def _edges(buckets: int) -> np.ndarray:
    return np.array([-(-(i << 64) // buckets) for i in range(1, buckets)], dtype=np.uint64)


def pack(values: np.ndarray) -> bytes:
    """The byte planes that the largest value needs, after a byte with their number."""
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]
    return bytes([width]) + planes.tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.uint64)
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


# --- blocks of documents ----------------------------------------------------
def _pack_blocks(block_bytes: int, id_type: pa.DataType):
    """Rows of the block table from the documents of one task."""
    def row(number: int, docs: list, asking: bool):
        ids, texts, held, train, em = zip(*docs)
        data = [[number], [asking], [list(ids)], [list(held)], [list(train)], [list(em)], [[len(t) for t in texts]], [zstandard.compress(b"".join(texts), 1)]]
        bools = pa.list_(pa.bool_())
        kinds = [pa.int64(), pa.bool_(), pa.list_(id_type), bools, bools, bools, pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(d, k) for d, k in zip(data, kinds)], names=["block", "asking", "ids", "held", "train", "em", "sizes", "blob"])

    def run(batches):
        numbers = itertools.count(TaskContext.get().partitionId() << 24)
        open_ = {False: ([], 0), True: ([], 0)}
        for b in batches:
            for doc in zip(*[b.column(i).to_pylist() for i in range(5)]):
                doc = (doc[0], doc[1] or b"", *doc[2:])
                for asking in (False, True) if doc[4] else (False,):
                    docs, size = open_[asking]
                    docs.append(doc)
                    size += len(doc[1])
                    if size >= block_bytes:
                        yield row(next(numbers), docs, asking)
                        docs, size = [], 0
                    open_[asking] = docs, size
        for asking, (docs, _) in open_.items():
            if docs:
                yield row(next(numbers), docs, asking)

    return run


def _texts(blob: bytes, sizes: list[int]) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, sum(sizes)))
    ends = np.cumsum(sizes).tolist()
    return [data[a:z] for a, z in zip([0, *ends], ends)]


# --- counts -----------------------------------------------------------------
def _block_counts(buckets: int, spaces: tuple[str, ...]):
    """Rows (space, bucket, block, asking, keys, their counts in training, in the part set aside) of each block."""

    def run(batches):
        for b in batches:
            for block, asking, train, em, sizes, blob in zip(*[b.column(i).to_pylist() for i in range(6)]):
                words, lengths = word_keys(_texts(blob, sizes))
                flags = [np.repeat(np.array(f, dtype=bool) & (not asking), lengths) for f in (train, em)]  # blocks of the part set aside only ask
                grams = gram_keys(words, lengths)
                for space in spaces:
                    d = Distinct(grams.pop(space))
                    counts = [d.count(f) for f in flags]
                    cut = [0, *np.searchsorted(d.keys, _edges(buckets)).tolist(), len(d.keys)]
                    rows = [(i, pack(np.diff(d.keys[x:y], prepend=np.uint64(0))), *(pack(n[x:y]) if n[x:y].any() else b"" for n in counts)) for i, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
                    bucket, keys, in_training, aside = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array([space] * len(rows)), pa.array(bucket, pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([asking] * len(rows), pa.bool_()), pa.array(keys, pa.binary()), pa.array(in_training, pa.binary()), pa.array(aside, pa.binary())], names=_COUNTED_NAMES)

    return run


_COUNTED = "space string, bucket int, block long, asking boolean, keys binary, train binary, held binary"
_COUNTED_NAMES = [c.split()[0] for c in _COUNTED.split(", ")]
_ANSWERS = "space string, bucket int, block long, asking boolean, total binary, held binary, tokens long, held_tokens long, vocab long"


def _bucket_sums(t: pa.Table) -> pa.Table:
    """Answers of one key range: the sums in each block's order, and a row (block -1) of totals."""
    n, asking, space = len(t), t.column("asking").to_pylist(), t.column("space")[0].as_py()
    keys = [np.cumsum(unpack(x.as_py()), dtype=np.uint64) for x in t.column("keys")]
    ends = np.cumsum([len(k) for k in keys]).tolist()
    spans = list(zip([0, *ends], ends))
    d = Distinct(np.concatenate(keys))
    del keys
    sums = {}
    for name in ("train", "held"):
        sums[name] = np.zeros(len(d.keys), dtype=np.int64)
        for x, (a, z) in zip(t.column(name), spans):
            if packed := x.as_py():
                sums[name][d.at[a:z]] += unpack(packed).astype(np.int64)  # keys of a block are distinct
    total = [pack(sums["train"][d.at[a:z]]) for a, z in spans]
    held = [pack(sums["held"][d.at[a:z]]) if ask else b"" for ask, (a, z) in zip(asking, spans)]
    whole = [int(x) for x in (sums["train"].sum(), sums["held"].sum(), (sums["train"] > 0).sum())]
    return pa.table([pa.array([space] * (n + 1)), pa.array(t.column("bucket").to_pylist()[:1] * (n + 1), pa.int32()), pa.array([*t.column("block").to_pylist(), -1], pa.int64()), pa.array([*asking, False], pa.bool_()), pa.array([*total, b""], pa.binary()), pa.array([*held, b""], pa.binary()), *(pa.array([0] * n + [x], pa.int64()) for x in whole)], names=[c.split()[0] for c in _ANSWERS.split(", ")])


# --- scores -----------------------------------------------------------------
class _Counted:
    """Tokens of a block with the sums of their keys."""

    def __init__(self, docs: pa.Table, answers: pa.Table):
        words, self.lengths = word_keys(_texts(docs.column("blob")[0].as_py(), docs.column("sizes")[0].as_py()))
        grams = gram_keys(words, self.lengths)
        self.at = {s: Distinct(grams.pop(s)).at for s in _SPACES}
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.answers, space = answers, np.array(answers.column("space").to_pylist())
        by_bucket = np.argsort(answers.column("bucket").to_numpy(), kind="stable")
        self.rows = {s: by_bucket[space[by_bucket] == s].tolist() for s in _SPACES}

    def counts(self, space: str, name: str) -> np.ndarray:
        """Count of the n-gram that each token ends."""
        return np.concatenate([unpack(self.answers.column(name)[i].as_py()) for i in self.rows[space]]).astype(np.float64)[self.at[space]]

    def estimates(self, counts: dict[str, np.ndarray], n_tokens: int, n_vocab: int):
        """(context bucket, estimate by triple, by pair, by word) of each token."""
        word, pair, triple = (counts[s] for s in _SPACES)
        before, before_pair = np.empty_like(word), np.empty_like(word)
        before[1:], before_pair[1:] = word[:-1], pair[:-1]
        before[self.starts], before_pair[self.starts] = word[-1], 0  # the last token is an end
        low = (word + 0.5) / (n_tokens + 0.5 * (n_vocab + 1))
        by_pair = np.divide(pair, before, out=np.zeros_like(pair), where=before > 0)
        by_triple = np.divide(triple, before_pair, out=np.zeros_like(pair), where=before_pair > 0)
        return context_bucket(before, before_pair), by_triple, by_pair, low


def context_bucket(word: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Below 64 for contexts known by the word alone, from 64 on for pairs."""
    return np.where(pair > 0, 64 + np.floor(np.log2(pair + 1)), np.floor(np.log2(word + 1))).astype(np.int64)


def _bins(estimate: np.ndarray, low: np.ndarray) -> np.ndarray:
    out = np.full(len(low), float(_NONE_BIN))
    hit = estimate > 0
    out[hit] = np.round(2 * np.log2(estimate[hit] / low[hit]))
    return out.astype(np.int64)


def _ratios(n_tokens: int, n_vocab: int):
    """Histogram (context bucket, half binary orders of the ratios of the triple's and the pair's estimate to the word's) of the part set aside."""

    def run(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        c = _Counted(docs, answers)
        bucket, triple, pair, low = c.estimates({s: c.counts(s, "total") - c.counts(s, "held") for s in _SPACES}, n_tokens, n_vocab)
        bins, n = np.unique(np.stack([bucket, _bins(triple, low), _bins(pair, low)]), axis=1, return_counts=True)
        return pa.table({"context": pa.array(bins[0], pa.int32()), "triple": pa.array(bins[1], pa.int32()), "pair": pa.array(bins[2], pa.int32()), "n": pa.array(n, pa.int64())})

    return run


def mixture_weights(histogram: list[tuple[int, int, int, int]], rounds: int = 200) -> np.ndarray:
    """Weights (triple, pair, word) of each context bucket, by expectation-maximisation.

    One success of each component is added to each bucket.  Where the pair, or
    the word, before was never seen there is no estimate by it, and its weight is 0.
    """
    rows = np.array(sorted(histogram), dtype=np.int64).reshape(-1, 4)
    weights = np.zeros((128, 3))
    for b in range(128):
        own = rows[rows[:, 0] == b]
        n = own[:, 3].astype(float)
        ratio = np.stack([np.where(own[:, k] == _NONE_BIN, 0.0, 2.0 ** (own[:, k] / 2)) for k in (1, 2)] + [np.ones(len(own))], axis=1)
        live = np.array([b >= 64, b > 0, True])
        a = live / live.sum()
        for _ in range(rounds):
            part = ratio * a
            new = live + (part / part.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) if len(own) else live.astype(float)
            new = new / new.sum()
            done, a = np.abs(new - a).max() < 1e-9, new
            if done:
                break
        weights[b] = a
    return weights


def _scores(id_col: str, n_tokens: int, n_vocab: int, weights: np.ndarray):
    def run(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        c = _Counted(docs, answers)
        counts = {s: c.counts(s, "total") for s in _SPACES}
        bucket, triple, pair, low = c.estimates(counts, n_tokens, n_vocab)
        a = weights[bucket]
        p = a[:, 0] * triple + a[:, 1] * pair + a[:, 2] * low
        base, score = (np.add.reduceat(np.log10(x), c.starts) for x in (low, p))
        known = np.add.reduceat((counts["w"] > 0).astype(np.int64), c.starts)
        columns = [docs.column("ids")[0].values, docs.column("held")[0].values, c.lengths, known, np.full(len(known), n_tokens, dtype=np.int64), base, score]
        return pa.table(columns, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, em_part: int = 20, block_bytes: int = 4 << 20, bucket_bytes: int = 6 << 20, min_buckets: int = 24) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    kind = docs.schema[id_col].dataType.simpleString()
    fold = id_fold(id_col, folds * em_part)
    held_out = F.coalesce(fold % folds == held, F.lit(False))
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_t"), held_out.alias("held"), (~held_out).alias("train"), ((F.floor(fold / folds) == 0) & ~held_out).alias("em"))
    total = slim.agg(F.sum(F.coalesce(F.octet_length("_t"), F.lit(0)).cast("long") + 16)).first()[0] or 0
    size = max(block_bytes, int(math.sqrt(64 * total)))
    buckets = max(min_buckets, -(-total // max(bucket_bytes, 2 * size)))
    bools = "array<boolean>"
    id_type = pa.schema(_arrow_field(slim.schema["_id"].dataType)).field(0).type
    blocks = materialise(slim.mapInArrow(_pack_blocks(size, id_type), f"block long, asking boolean, ids array<{kind}>, held {bools}, train {bools}, em {bools}, sizes array<int>, blob binary"))
    answers = None
    for spaces in (("w", "p"), ("t",)):  # one after the other, so that less lies in shuffle files at a time
        counted = blocks.select("block", "asking", "train", "em", "sizes", "blob").mapInArrow(_block_counts(buckets, spaces), _COUNTED)
        part = materialise(counted.repartition(3 * buckets, "space", "bucket").groupBy("space", "bucket").applyInArrow(_bucket_sums, _ANSWERS))
        answers = part if answers is None else answers.unionByName(part)
    n_tokens, n_held, n_vocab = (x or 0 for x in answers.where("block = -1 and space = 'w'").agg(F.sum("tokens"), F.sum("held_tokens"), F.sum("vocab")).first())
    asked = answers.where("asking").select("block", "space", "bucket", "total", "held").groupBy("block")
    bins = blocks.where("asking").select("block", "sizes", "blob").groupBy("block").cogroup(asked).applyInArrow(_ratios(n_tokens - n_held, n_vocab), "context int, triple int, pair int, n long")
    weights = mixture_weights([tuple(map(int, r)) for r in bins.groupBy("context", "triple", "pair").agg(F.sum("n")).collect()])
    mine = answers.where("not asking and block >= 0").select("block", "space", "bucket", "total").groupBy("block")
    out = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.where("not asking").select("block", "ids", "held", "sizes", "blob").groupBy("block").cogroup(mine).applyInArrow(_scores(id_col, n_tokens, n_vocab, weights), out)


def _arrow_field(spark_type) -> list:
    from pyspark.sql.pandas.types import to_arrow_type

    return [pa.field("x", to_arrow_type(spark_type))]

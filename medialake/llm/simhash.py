"""SimHash near-duplicate search with a Gray-order hierarchical index.

Fingerprints are 64-bit SimHashes of word shingles.  Two texts link when their
fingerprints differ in at most ``max_bits`` bits; linked texts form components.

Plan
1. One pass over the texts gives (id, fingerprint); it is written once.
2. Equal fingerprints collapse to one node before anything else, so a group of
   copies, however large, costs one node.
3. Nodes are sorted by Gray rank and cut into ranges.  Each range is a tree:
   consecutive nodes share the bits on which all of them agree (mask and
   pattern), and upper nodes hold what their children share.  This is done in
   two Gray orders, the second with the bits turned by 32: of at most four
   differing bits at most two lie in one of the halves, so in the order which
   that half leads a search may give up after two differences in the first 32
   bits.  No pair can be missed, and far fewer nodes survive.
4. A range searches itself first.  The upper nodes of all ranges (four numbers
   each) are the routing layer: two ranges meet in a task only if their shared
   bits do not rule out every link.  Both trees are then descended together;
   differences counted above are carried downwards, and a pair of groups goes
   as a whole once these pass the bound.  Groups known to be connected with
   each other are skipped, so a large group of close fingerprints is not
   compared pair by pair, and only a spanning forest leaves a task.
   A task holds two ranges of at most 2^22 fingerprints.  A range of 2^r goes to
   about 1 + r + r(r-1)/2 others in each order, which is what the shuffle grows by.
5. Components by alternating large-star and small-star rounds, each written
   to the shared folder.

Defined cases: a null or empty text has no words and fingerprint 0, which is
linked like any other; a null id takes part, and gives its component no id of
its own (``component_id`` is the smallest non-null id, null if there is none);
repeated rows each get a result row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from medialake.llm.common import join_spread, materialise

FANOUT = 16


# --- fingerprints -----------------------------------------------------------
def simhash64(text: bytes | None, shingle: int = 4) -> int:
    """Unsigned SimHash of the lower-cased (A-Z) words' shingles."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    if shingle == 4 and n > 1:
        hashes = [digest(b"%b %b %b %b" % q, 42) for q in zip(words, words[1:], words[2:], words[3:])]
    else:
        hashes = [digest(b" ".join(words[i : i + shingle]), 42) for i in range(n)]
    rows = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(rows), 16384):  # bounded memory for very long texts
        ones += np.unpackbits(rows[i : i + 16384], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, text_hash, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([simhash64(t, shingle) for t in b.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=[id_col, "text_hash", "fp"])

    slim = docs.select(id_col, F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("_t"))
    return slim.mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, text_hash long, fp long")


# --- search -----------------------------------------------------------------
def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def turned(x: np.ndarray, bits: int) -> np.ndarray:
    """64-bit words turned left by ``bits``."""
    bits %= 64
    return x if not bits else (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


class GrayTree:
    """Distinct fingerprints in Gray order below nodes that hold what all of theirs share.

    Level 0 are the fingerprints; each node of a higher level stands for
    ``FANOUT`` neighbours of the level below and keeps the bits on which all of
    them agree (mask) and their values (pattern).  Levels are padded with
    copies of their last node; ``sizes`` are the real ones.
    """

    def __init__(self, fps: np.ndarray, height: int = 0):
        self.fps, self.sizes, self.masks, self.patterns = fps, [], [], []
        mask, pattern = np.full(len(fps), ~np.uint64(0)), fps
        while True:
            self.sizes.append(len(mask))
            pad = -len(mask) % FANOUT
            self.masks.append(np.pad(mask, (0, pad), mode="edge").reshape(-1, FANOUT))
            self.patterns.append(np.pad(pattern, (0, pad), mode="edge").reshape(-1, FANOUT))
            if self.sizes[-1] <= FANOUT and len(self.sizes) > height:
                break
            below, value = self.masks[-1], self.patterns[-1]
            mask = np.bitwise_and.reduce(below & ~(value ^ value[:, :1]), axis=1)
            pattern = value[:, 0] & mask

    @property
    def height(self) -> int:
        return len(self.sizes) - 1

    def shared(self, label: np.ndarray) -> list[np.ndarray]:
        """Of each level's nodes: the label that all fingerprints below carry, or -1."""
        out = [label]
        for n in self.sizes[1:]:
            x = np.pad(out[-1], (0, -len(out[-1]) % FANOUT), mode="edge").reshape(-1, FANOUT)
            low, high = x.min(axis=1), x.max(axis=1)
            out.append(np.where(low == high, low, -1)[:n])
        return out


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the trees of each pair (a, b) in ``label`` (position -> root)."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def connect(a: GrayTree, b: GrayTree, label: np.ndarray, max_bits: int, lead: int = 64, lead_bits: int | None = None, chunk: int = 2048) -> int:
    """Merge in ``label`` the fingerprints of ``a`` with those of ``b`` that differ in at most ``max_bits`` bits; how many pairs were compared.

    ``label`` names a root for each member of ``a``, then of ``b`` (only of
    ``a`` if both are the same tree).  Pairs of nodes are opened from the top;
    each carries the differences counted on the way down, and only bits that
    no node above had fixed in both are added.  A pair is dropped once these
    pass ``max_bits``, or those within the first ``lead`` bits pass
    ``lead_bits``, or when all below both are known to be connected.
    """
    same, after = a is b, 0 if a is b else len(a.fps)
    first = ~np.uint64(0) << np.uint64(64 - lead)
    lead_bits = max_bits if lead_bits is None else lead_bits
    top = a.height
    if b.height != top:
        raise ValueError("trees of one height, please")
    ia, ib = (x.ravel() for x in np.meshgrid(np.arange(a.sizes[top]), np.arange(b.sizes[top]), indexing="ij"))
    known_a = a.shared(label[: len(a.fps)])
    known_b = known_a if same else b.shared(label[after:])
    found_a, found_b, found, compared = [], [], 0, 0
    ma, mb, pa, pb = (x[top].ravel()[i] for x, i in ((a.masks, ia), (b.masks, ib), (a.patterns, ia), (b.patterns, ib)))
    differ = (pa ^ pb) & ma & mb
    spent = np.bitwise_count(differ)
    led = np.bitwise_count(differ & first)
    keep = (spent <= max_bits) & (led <= lead_bits)
    if same:
        keep &= ia <= ib
    if top == 0:  # these are the fingerprints
        _union(label, ia[keep], ib[keep] + after)
        return len(keep)
    stack = [(top, ia[keep], ib[keep], spent[keep], led[keep])]
    while stack:
        level, ia, ib, spent, led = stack.pop()
        if len(ia) > chunk:
            for i in range(0, len(ia), chunk):
                stack.append((level, *(x[i : i + chunk] for x in (ia, ib, spent, led))))
            continue
        open_ = (known_a[level][ia] != known_b[level][ib]) | (known_a[level][ia] < 0)
        ia, ib, spent, led = ia[open_], ib[open_], spent[open_], led[open_]
        if not len(ia):
            continue
        compared += len(ia) * FANOUT * FANOUT
        differ = a.patterns[level - 1][ia][:, :, None] ^ b.patterns[level - 1][ib][:, None, :]
        if level == 1:
            keep = np.bitwise_count(differ) <= max_bits
        else:
            above = a.masks[level].ravel()[ia] & b.masks[level].ravel()[ib]
            differ &= a.masks[level - 1][ia][:, :, None] & b.masks[level - 1][ib][:, None, :] & ~above[:, None, None]
            more, lead_more = np.bitwise_count(differ) + spent[:, None, None], np.bitwise_count(differ & first) + led[:, None, None]
            keep = (more <= max_bits) & (lead_more <= lead_bits)
        n, x, y = np.nonzero(keep)
        ca, cb = ia[n] * FANOUT + x, ib[n] * FANOUT + y
        real = (ca < a.sizes[level - 1]) & (cb < b.sizes[level - 1])
        if same:
            real &= ca < cb if level == 1 else ca <= cb
        ca, cb = ca[real], cb[real]
        if level > 1:
            n, x, y = n[real], x[real], y[real]
            stack.append((level - 1, ca, cb, more[n, x, y], lead_more[n, x, y]))
            continue
        found_a.append(ca)
        found_b.append(cb + after)
        found += len(ca)
        if found > max(1 << 16, len(label) // 16):
            _union(label, np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, found = [], [], 0
            known_a = a.shared(label[: len(a.fps)])
            known_b = known_a if same else b.shared(label[after:])
    if found:
        _union(label, np.concatenate(found_a), np.concatenate(found_b))
    return compared


def range_count(nodes: int, least: int = 12, fewest: int = 1024, factor: int = 100, most: int = 1 << 22) -> int:
    """Ranges of each Gray order: of ``factor * sqrt(nodes)`` fingerprints, ``most`` at most, and ``least`` in number if that leaves ``fewest``."""
    size = min(most, max(1, int(factor * nodes**0.5)))
    return max(1, -(-nodes // size), min(least, nodes // fewest))


_RANGES = "turn int, place int, mask long, pattern long, fps binary, roots binary"


def _index_ranges(max_bits: int, orders: int):
    """One row for each Gray order's share of a task: what its fingerprints share, they themselves, and their roots among themselves."""
    step = 64 // orders

    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        turn, word = (np.concatenate(x) for x in zip(*parts))
        place = TaskContext.get().partitionId()
        for t in np.unique(turn):
            tree = GrayTree(word[turn == t].view(np.uint64))
            label = np.arange(len(tree.fps))
            connect(tree, tree, label, max_bits, step, max_bits // orders)
            mask = np.bitwise_and.reduce(tree.masks[-1].ravel() & ~(tree.patterns[-1].ravel() ^ tree.patterns[-1].ravel()[0]))
            yield pa.RecordBatch.from_pydict({"turn": pa.array([t], pa.int32()), "place": pa.array([place], pa.int32()), "mask": pa.array([mask.view(np.int64)]), "pattern": pa.array([(tree.fps[0] & mask).view(np.int64)]), "fps": [tree.fps.tobytes()], "roots": [label.astype(np.int32).tobytes()]})

    return run


def partners(upper: list[tuple[int, int, int, int]], max_bits: int, orders: int) -> dict[tuple[int, int], list[int]]:
    """(turn, place) of a range -> places of the later ranges of its order that its upper node does not rule out.

    ``upper`` holds (turn, place, mask, pattern) of every range: four numbers for millions of fingerprints.
    """
    out: dict[tuple[int, int], list[int]] = {}
    first = ~np.uint64(0) << np.uint64(64 - 64 // orders)
    for t in sorted({u[0] for u in upper}):
        rows = sorted(u for u in upper if u[0] == t)
        place = [u[1] for u in rows]
        mask, pattern = (np.array([u[i] for u in rows], dtype=np.int64).view(np.uint64) for i in (2, 3))
        for i in range(len(rows)):
            differ = (pattern[i] ^ pattern[i + 1 :]) & mask[i] & mask[i + 1 :]
            near = (np.bitwise_count(differ) <= max_bits) & (np.bitwise_count(differ & first) <= max_bits // orders)
            out[t, place[i]] = [place[j] for j in i + 1 + np.flatnonzero(near)]
    return out


def _deal_pairs(pairs: dict[tuple[int, int], list[int]]):
    """Each range once for every pair it belongs to."""
    back: dict[tuple[int, int], list[int]] = {}
    for (t, i), later in pairs.items():
        for j in later:
            back.setdefault((t, j), []).append(i)

    def run(batches):
        for b in batches:
            for t, place, fps, roots in zip(*(b.column(i).to_pylist() for i in range(4))):
                for i, j in [(place, j) for j in pairs.get((t, place), [])] + [(i, place) for i in back.get((t, place), [])]:
                    yield pa.RecordBatch.from_pydict({"turn": pa.array([t], pa.int32()), "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "place": pa.array([place], pa.int32()), "fps": [fps], "roots": [roots]})

    return run


def _edge_table(turn: int, step: int, fps: np.ndarray, label: np.ndarray, at: np.ndarray) -> pa.Table:
    """Edges (a, b), a > b, from the fingerprints at ``at`` to their roots."""
    x, y = (turned(v, 64 - turn * step).view(np.int64) for v in (fps[at], fps[label[at]]))
    return pa.table({"a": np.maximum(x, y), "b": np.minimum(x, y)})


def _join_ranges(max_bits: int, orders: int):
    """Edges between the roots of two ranges."""
    step = 64 // orders

    def run(key, t):
        order = np.argsort(t.column("place").to_numpy())
        fps = [np.frombuffer(t.column("fps")[int(i)].as_py(), dtype=np.uint64) for i in order]
        roots = [np.frombuffer(t.column("roots")[int(i)].as_py(), dtype=np.int32).astype(np.int64) for i in order]
        trees = [GrayTree(f) for f in fps]
        top = max(x.height for x in trees)
        trees = [x if x.height == top else GrayTree(x.fps, top) for x in trees]
        label = np.concatenate([roots[0], roots[1] + len(fps[0])])
        before = label.copy()
        connect(*trees, label, max_bits, step, max_bits // orders)
        own = np.flatnonzero((before == np.arange(len(before))) & (label != before))
        return _edge_table(key[0].as_py(), step, np.concatenate(fps), label, own)

    return run


def _local_edges(orders: int):
    step = 64 // orders

    def run(batches):
        for b in batches:
            for t, fps, roots in zip(*(b.column(i).to_pylist() for i in range(3))):
                label = np.frombuffer(roots, dtype=np.int32)
                edges = _edge_table(t, step, np.frombuffer(fps, dtype=np.uint64), label, np.flatnonzero(label != np.arange(len(label))))
                yield from edges.to_batches(max_chunksize=1 << 16)

    return run


def _ranked(orders: int):
    """Rows (turn, word, rank): each fingerprint turned so that each part of its bits leads once."""
    step = 64 // orders

    def run(batches):
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for t in range(orders):
                word = turned(fps, t * step)
                rank = gray_rank(word) ^ (np.uint64(1) << np.uint64(63))  # in the order of signed numbers
                yield pa.RecordBatch.from_pydict({"turn": pa.array(np.full(len(fps), t), pa.int32()), "word": word.view(np.int64), "rank": rank.view(np.int64)})

    return run


def links(nodes: DataFrame, max_bits: int = 4, orders: int = 2, ranges: int | None = None) -> DataFrame:
    """Edges (a, b), a > b, that connect all fingerprints of ``nodes`` within ``max_bits`` bits: a spanning forest of each pair of ranges.

    ``orders`` divides 64.
    """
    n = ranges or range_count(nodes.count())
    ranked = nodes.select("fp").mapInArrow(_ranked(orders), "turn int, word long, rank long")
    spread = ranked.repartitionByRange(n * orders, "turn", "rank").sortWithinPartitions("turn", "rank").select("turn", "word")
    indexed = materialise(spread.mapInArrow(_index_ranges(max_bits, orders), _RANGES))
    upper = [tuple(r) for r in indexed.select("turn", "place", "mask", "pattern").collect()]  # one row a range
    pairs = partners(upper, max_bits, orders)
    dealt = indexed.select("turn", "place", "fps", "roots").mapInArrow(_deal_pairs(pairs), "turn int, i int, j int, place int, fps binary, roots binary")
    across = dealt.groupBy("turn", "i", "j").applyInArrow(_join_ranges(max_bits, orders), "a long, b long")
    return indexed.select("turn", "fps", "roots").mapInArrow(_local_edges(orders), "a long, b long").unionByName(across).distinct()


# --- components -------------------------------------------------------------
def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node on an edge; root is the smallest node reachable.

    The centre of a large star meets one row on the other side of each join,
    so its rows stream through; AQE deals them to several tasks.
    """
    edges = materialise(edges.select("a", "b"))
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        edges = materialise(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError("components did not settle")


def _rooted(nodes: DataFrame, max_bits: int) -> DataFrame:
    """``nodes`` with the root of each fingerprint's component."""
    roots = components(links(nodes.select("fp"), max_bits))
    return nodes.join(roots, nodes.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per document: id, fingerprint (hex), component_id, component_size.

    ``component_id`` is the smallest id reachable over links; ``component_size``
    counts the documents of the component.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle).select(id_col, "fp"))
    nodes = materialise(fps.groupBy("fp").agg(F.min(id_col).alias("rep"), F.count("*").alias("n")))
    rooted = materialise(_rooted(nodes, max_bits))
    groups = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("n").alias("component_size"), F.count("*").alias("_nodes"))
    named = join_spread(rooted, groups, "root", "_nodes", rooted.count()).select("fp", "n", "component_id", "component_size")
    found = join_spread(fps, named, "fp", "n", fps.count())
    return found.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4) -> DataFrame:
    """``docs`` with exactly one row of each component, and no other text lost.

    It is that of the smallest id (none comes last), then fingerprint, then
    hash of the text.  Rows with neither id nor text are one component of their
    own, apart from other texts without words.  A row is known by id and hash
    of the text, so rows that share an id stand for themselves; of rows that
    share both, one stays: that with the smallest hash of all columns.  The
    texts are shuffled once, by that key; numbering them reuses that order.
    """
    fps = fingerprints(docs, id_col, text_col)
    blank = F.col(id_col).isNull() & (F.col("text_hash") == F.xxhash64(F.lit(None).cast("string")))
    row = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), "fp", F.col("text_hash").alias("hash"))
    nodes = materialise(fps.groupBy("fp", blank.alias("blank")).agg(F.min(row).alias("row")))
    rooted = materialise(_rooted(materialise(nodes.select("fp").distinct()), max_bits).select("fp", "root"))
    first = nodes.join(rooted, "fp").groupBy("root", "blank").agg(F.min("row").alias("row")).select(F.struct("row.id", "row.hash").alias("key"))
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")).alias("key")
    plain = [c.name for c in docs.schema.fields if c.dataType.typeName() != "map"]
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), key, F.xxhash64(*(docs[c] for c in plain)).alias("tie"))
    order = Window.partitionBy("key").orderBy("tie")
    kept = keyed.join(first, "key", "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1")
    return kept.select("row.*")

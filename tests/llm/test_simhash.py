import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from medialake.llm import simhash
from tests.llm.cases import awkward, empty


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, max_bits=4):
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= max_bits:
                label[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab C\n\x1cé", max_size=80))
def test_fingerprint(text):
    assert simhash.simhash64(text.encode()) == brute_fingerprint(text)


def near_points(n, seed=3):
    rng = np.random.default_rng(seed)
    fps = []
    for _ in range(n):
        x = int(rng.integers(0, 1 << 63)) * 2
        fps.append(x)
        for _ in range(int(rng.integers(0, 5))):
            for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    return sorted(set(fps))


def in_gray_order(fps):
    x = np.array(list(fps), dtype=np.uint64)
    return x[np.argsort(simhash.gray_rank(x))]


def test_gray_rank_and_turns():
    code = np.array([i ^ i >> 1 for i in range(300)], dtype=np.uint64)
    assert simhash.gray_rank(code).tolist() == list(range(300))
    x = np.array([1 << 63 | 5], dtype=np.uint64)
    assert simhash.turned(x, 32).tolist() == [5 << 32 | 1 << 31] and simhash.turned(simhash.turned(x, 32), 32).tolist() == simhash.turned(x, 64).tolist() == x.tolist()


def test_upper_nodes_hold_what_all_below_share():
    tree = simhash.GrayTree(in_gray_order(near_points(200)))
    for level in range(1, tree.height + 1):
        below = simhash.FANOUT**level
        for i in range(tree.sizes[level]):
            own = tree.fps[i * below : (i + 1) * below]
            mask, pattern = tree.masks[level].ravel()[i], tree.patterns[level].ravel()[i]
            assert mask == ~np.bitwise_or.reduce(own ^ own[0]) and pattern == own[0] & mask


def test_tree_equals_all_pairs():
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 1 << 63))
    for fps in ({base ^ int(m) for m in rng.integers(0, 1 << 14, 900)}, set(near_points(300)), {base}, {base, base ^ 3}):
        x = in_gray_order(fps)
        for bits in (0, 1, 2, 4):
            label = np.arange(len(x))
            tree = simhash.GrayTree(x)
            simhash.connect(tree, tree, label, bits, chunk=7)
            want = brute_components([int(v) for v in x], bits)
            assert label.tolist() == want


def test_two_ranges_equal_all_pairs():
    x = in_gray_order(near_points(400))
    for cut in (5, len(x) // 2, len(x) - 20):
        trees = [simhash.GrayTree(x[:cut]), simhash.GrayTree(x[cut:])]
        top = max(t.height for t in trees)
        trees = [simhash.GrayTree(t.fps, top) for t in trees]
        label = np.arange(len(x))
        simhash.connect(*trees, label, 4, chunk=50)
        pairs = [(i, j) for i in range(cut) for j in range(cut, len(x)) if (int(x[i]) ^ int(x[j])).bit_count() <= 4]
        want = np.arange(len(x))
        simhash._union(want, np.array([p[0] for p in pairs], dtype=int), np.array([p[1] for p in pairs], dtype=int))
        assert label.tolist() == want.tolist()


def test_pruning_spares_most_comparisons():
    x = in_gray_order(np.random.default_rng(7).integers(0, 1 << 63, 40_000, dtype=np.uint64))
    tree, label = simhash.GrayTree(x), np.arange(40_000)
    assert simhash.connect(tree, tree, label, 4, 32, 2) < len(x) ** 2 / 25  # all pairs are half of the square


def test_dense_group_is_not_compared_pair_by_pair():
    x = in_gray_order([1 << a | 1 << b | 1 << c for a in range(60) for b in range(a) for c in range(b)])
    tree, label = simhash.GrayTree(x), np.arange(len(x))
    assert simhash.connect(tree, tree, label, 4, chunk=64) < len(x) ** 2 / 8
    assert (label == 0).all()


def test_components_equal_all_pairs(spark):
    fps = near_points(250)
    roots = brute_components(fps)
    nodes = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    for ranges, orders in ((9, 2), (5, 1), (3, 4)):
        found = {r.node: r.root for r in simhash.components(simhash.links(nodes, 4, orders, ranges)).collect()}
        got = {}
        for x, want in zip(fps, roots):
            node = int(np.uint64(x).view(np.int64))
            got.setdefault(want, set()).add(found.get(node, node))
        assert all(len(v) == 1 for v in got.values()) and len({*map(frozenset, got.values())}) == len(got)


def test_upper_nodes_rule_ranges_out():
    x = in_gray_order(np.random.default_rng(8).integers(0, 1 << 63, 1 << 14, dtype=np.uint64))
    upper = []
    for i, own in enumerate(np.split(x, 256)):
        mask = ~np.bitwise_or.reduce(own ^ own[0])
        upper.append((0, i, int(mask.view(np.int64)), int((own[0] & mask).view(np.int64))))
    pairs = simhash.partners(upper, 4, 2)
    assert sum(map(len, pairs.values())) < 256 * 255 / 2 / 3
    for i in range(0, 256, 17):
        for j in range(i + 1, 256):
            a, b = x[i * 64 : i * 64 + 64, None], x[None, j * 64 : j * 64 + 64]
            near = (np.bitwise_count(a ^ b) <= 4) & (np.bitwise_count((a ^ b) >> np.uint64(32)) <= 2)
            assert j in pairs[0, i] or not near.any()


def test_tree_search_finds_every_link_of_the_table(spark):
    """``links`` has no other search; its forest spans just what all pairs would."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fps = [int(np.int64(r.fp).view(np.uint64)) for r in simhash.fingerprints(docs).select("fp").distinct().collect()]
    nodes = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    roots = dict(zip(fps, brute_components(fps)))
    edges = [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in simhash.links(nodes, ranges=8).collect()]
    assert edges and all(roots[a] == roots[b] for a, b in edges)
    at = {x: i for i, x in enumerate(fps)}
    label = np.arange(len(fps))
    simhash._union(label, np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    assert len(set(label.tolist())) == len(set(roots.values()))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    roots = brute_components(fps)
    least = {}
    for r, root in zip(rows, roots):
        least[root] = min(r.doc_id, least.get(root, r.doc_id))
    expected = {r.doc_id: (f"{fp:016x}", least[root]) for r, fp, root in zip(rows, fps, roots)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == expected
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} == set(least.values())


def test_cases(spark):
    rows = simhash.near_duplicates(awkward(spark)).collect()
    assert len(rows) == 11
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[5].component_id == 1 and by[1].component_size == 3
    assert by[2].fingerprint == by[3].fingerprint == "0" * 16 and by[4].component_id == 2
    kept = simhash.keep_first(awkward(spark))
    assert kept.columns == awkward(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 6, 7, 8] and ids.count(None) == 2
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_first(empty(spark)).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    words = [[f"{c}{i}" for i in range(60)] for c in "abcd"]
    a, b, c, d = map(" ".join, words)
    near = " ".join(words[0][:-1] + ["end"])
    assert 0 < (brute_fingerprint(a) ^ brute_fingerprint(near)).bit_count() <= 4
    rows = [(3, a), (5, near), (5, b), (7, b), (7, b), (9, c), (9, c), (None, a), (None, near), (None, d), (None, d), (None, None), (None, None), (11, None), (11, "")]
    for rows in (rows, rows[::-1]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        kept = sorted(map(tuple, simhash.keep_first(docs).collect()), key=str)
        wordless = [r for r in kept if r[0] == 11]
        assert len(wordless) == 1 and sorted(set(kept) - set(wordless), key=str) == sorted([(3, a), (5, b), (9, c), (None, d), (None, None)], key=str)
        assert len(kept) == 6

import math
import zlib
from collections import Counter

import numpy as np

from medialake.llm import lm
from tests.llm.cases import awkward, empty


def brute(docs, em_part=20):
    """Exact scores from dictionaries of words, pairs and triples."""
    def tokens(t):
        return [*((t or "").encode().lower().split()), None]

    def fold(i):
        return -1 if i is None else zlib.crc32(str(i).encode()) % (5 * em_part)

    def counts(rows):
        w, p, q = Counter(), Counter(), Counter()
        for _, t in rows:
            k = tokens(t)
            w.update(k)
            p.update(zip([None, *k], k))
            q.update(zip(["start", None, *k], [None, *k], k))
        return w, p, q

    def parts(k, w, p, q, n, v):
        """(context bucket, estimates by triple, pair and word) of each token."""
        for i, b in enumerate(k):
            a, u = k[i - 1] if i else None, (k[i - 2] if i > 1 else None)
            low = (w[b] + 0.5) / (n + 0.5 * (v + 1))
            context = p[u, a] if i else 0
            triple = q[u, a, b] / context if i > 1 and context else q[None, a, b] / context if context else 0.0
            bucket = 64 + int(math.log2(context + 1)) if context else int(math.log2(w[a] + 1))
            yield bucket, triple, p[a, b] / w[a] if w[a] else 0.0, low

    train = [d for d in docs if fold(d[0]) % 5 != 1 or fold(d[0]) < 0]
    aside = [d for d in train if 0 <= fold(d[0]) < 5]
    some = counts([d for d in train if d not in aside])
    n = sum(some[0].values())
    every = counts(train)
    n_all, v_all = sum(every[0].values()), len(every[0])
    bins = Counter()
    ratio = lambda x, low: round(2 * math.log2(x / low)) if x else lm._NONE_BIN
    for _, t in aside:
        for bucket, triple, pair, low in parts(tokens(t), *some, n, v_all):
            bins[bucket, ratio(triple, low), ratio(pair, low)] += 1
    weights = lm.mixture_weights([(*k, c) for k, c in bins.items()])
    out = []
    for i, t in docs:
        k = tokens(t)
        base = score = 0.0
        for bucket, triple, pair, low in parts(k, *every, n_all, v_all):
            a, b, c = weights[bucket]
            base += math.log10(low)
            score += math.log10(a * triple + b * pair + c * low)
        out.append((i, len(k), sum(every[0][x] > 0 for x in k), n_all, round(base, 6), round(score, 6)))
    return sorted(out, key=str), v_all, weights


def test_matches_dictionaries(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    expected, _, weights = brute(docs)
    for kw in ({}, {"block_bytes": 20_000, "bucket_bytes": 50_000}):
        got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(table, **kw).collect()), key=str)
        assert [g[:4] for g in got] == [e[:4] for e in expected]
        assert max(abs(g[4] - e[4]) for g, e in zip(got, expected)) < 1e-3
        assert max(abs(g[5] - e[5]) for g, e in zip(got, expected)) < 1e-3
    assert (weights[66] > 0).all() and np.allclose(weights.sum(axis=1), 1) and (weights[:64, 0] == 0).all() and weights[0, 1] == 0


def test_held_out_text_is_better_predicted_than_by_words(spark):
    rows = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").selectExpr("sum(base_score) b", "sum(score) s").first()
    assert rows.s > rows.b + abs(rows.b) * 0.15


def test_cases(spark):
    rows = lm.score(awkward(spark)).collect()
    assert len(rows) == 11 and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[2].n_tokens == by[3].n_tokens == by[4].n_tokens == 1 and by[2].score == by[3].score
    assert by[6].n_tokens == 120_001 and not any(r.held_out for r in rows if r.doc_id is None)
    assert lm.score(empty(spark)).count() == 0


def test_packing_and_weights():
    for values in ([], [0], [0, 255, 256, 1 << 63], list(range(1000))):
        x = np.array(values, dtype=np.uint64)
        assert lm.unpack(lm.pack(x)).tolist() == x.tolist()
    weights = lm.mixture_weights([(3, lm._NONE_BIN, 20, 100), (5, lm._NONE_BIN, lm._NONE_BIN, 100), (70, 20, lm._NONE_BIN, 100)])
    assert weights[3, 1] > 0.9 and weights[5, 1] < 0.1 and weights[0].tolist() == [0, 0, 1] and weights[70, 0] > 0.9 and weights[3, 0] == 0


def test_weights_are_a_maximum():
    """No mixture close by explains the held-out counts better (with the added successes)."""
    rows = [(70, 8, 4, 30), (70, lm._NONE_BIN, 6, 50), (70, lm._NONE_BIN, lm._NONE_BIN, 20), (70, 2, 2, 10)]
    value = lambda a: np.log(a).sum() + sum(n * math.log(a[0] * (2 ** (t / 2) if t != lm._NONE_BIN else 0) + a[1] * (2 ** (p / 2) if p != lm._NONE_BIN else 0) + a[2]) for _, t, p, n in rows)
    best = lm.mixture_weights(rows, 5000)[70]
    for i in range(3):
        for j in range(3):
            step = np.zeros(3)
            step[i] += 1e-3
            step[j] -= 1e-3
            assert value(best) >= value(best + step) - 1e-9

import itertools

import numpy as np

from medialake.llm import crf


def test_against_all_paths():
    rng = np.random.default_rng(1)
    lengths = [3, 0, 1, 4]
    emit, trans, start = rng.normal(size=(8, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    gamma, log_z, xi, starts = crf.forward_backward(emit, lengths, trans, start, counts=True)
    path, at, total = crf.viterbi(emit, lengths, trans, start), 0, 0.0
    seen = np.zeros((3, 3))
    for n in lengths:
        if not n:
            continue
        e = emit[at : at + n]
        scores = {p: start[p[0]] + sum(e[i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in itertools.product(range(3), repeat=n)}
        z = np.log(sum(np.exp(s) for s in scores.values()))
        total += z
        for i in range(n):
            for y in range(3):
                assert abs(gamma[at + i, y] - sum(np.exp(s - z) for p, s in scores.items() if p[i] == y)) < 1e-9
        for p, s in scores.items():
            for a, b in zip(p, p[1:]):
                seen[a, b] += np.exp(s - z)
        assert tuple(path[at : at + n]) == max(scores, key=scores.get)
        at += n
    assert abs(log_z - total) < 1e-9 and np.allclose(xi, seen) and abs(starts.sum() - 3) < 1e-9


def test_learns_transitions():
    rng = np.random.default_rng(2)
    labels = np.concatenate([np.repeat([0, 1], 5) for _ in range(60)])
    kind = np.where(rng.random(len(labels)) < 0.7, labels, 2)  # a third of the positions say nothing
    field = crf.Crf(3, 2).fit(np.arange(3), np.arange(4), kind, labels, np.full(60, 10), rounds=80)
    got = crf.viterbi(field.emissions(np.arange(3), np.arange(4))[kind], np.full(60, 10), field.trans, field.start)
    assert (got == labels).mean() > 0.93 and field.trans[0, 0] > field.trans[1, 0]


def test_no_chain():
    assert crf.forward_backward(np.zeros((0, 2)), [], np.zeros((2, 2)), np.zeros(2)).shape == (0, 2)
    assert len(crf.viterbi(np.zeros((0, 2)), [0, 0], np.zeros((2, 2)), np.zeros(2))) == 0

"""Linear-chain conditional random field in numpy, for use inside tasks.

Chains are given flat: emissions of all positions of all chains in a row, and
the length of each chain.  All chains of a call advance together, one position
at a time, so the cost of a step is shared by every chain that is long enough.
"""

from __future__ import annotations

import numpy as np


class Layout:
    """Order of positions by time, then by chain (longest chains first)."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        n, longest = int(lengths.sum()), int(lengths.max(initial=0))
        ends = np.bincount(lengths, minlength=longest + 1)
        self.active = len(lengths) - np.cumsum(ends)[:longest]  # chains longer than t
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        rank = np.repeat(np.arange(len(lengths)), sizes)
        t = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.perm = np.empty(n, dtype=np.int64)
        self.perm[self.offset[t] + rank] = np.repeat(starts, sizes) + t
        self.n, self.longest = n, longest

    def steps(self):
        return [(int(self.offset[t]), int(self.active[t])) for t in range(self.longest)]


def forward_backward(emit: np.ndarray, lengths, trans: np.ndarray, start: np.ndarray, counts: bool = False):
    """Marginals (positions x labels); with ``counts`` also (log likelihood part, expected transitions, expected starts)."""
    lay = Layout(lengths)
    if not lay.n:
        return (np.zeros((0, len(start))), 0.0, np.zeros_like(trans), np.zeros_like(start)) if counts else np.zeros((0, len(start)))
    top = emit.max(axis=1, keepdims=True)
    e = np.exp(np.maximum(emit - top, -60.0))[lay.perm]
    a_mat, s_vec = np.exp(trans - trans.max()), np.exp(start - start.max())
    alpha, scale = np.empty_like(e), np.empty((lay.n, 1))
    steps, prev = lay.steps(), None
    for t, (o, m) in enumerate(steps):
        cur = (prev[:m] @ a_mat if t else s_vec) * e[o : o + m]
        c = cur.sum(axis=1, keepdims=True)
        cur /= c
        alpha[o : o + m], scale[o : o + m], prev = cur, c, cur
    e /= scale
    beta = np.ones_like(e)
    xi = np.zeros_like(a_mat)
    for t in range(lay.longest - 2, -1, -1):
        (o, _), (o2, m2) = steps[t], steps[t + 1]
        nxt = e[o2 : o2 + m2] * beta[o2 : o2 + m2]
        beta[o : o + m2] = nxt @ a_mat.T
        if counts:
            xi += alpha[o : o + m2].T @ nxt
    gamma = alpha * beta
    out = np.empty_like(gamma)
    out[lay.perm] = gamma
    if not counts:
        return out
    log_z = float(np.log(scale).sum() + top.sum()) + trans.max() * (lay.n - steps[0][1]) + start.max() * steps[0][1]
    return out, log_z, xi * a_mat, gamma[: steps[0][1]].sum(axis=0)


_SCALED = 8  # steps after which a chain's vector is scaled anew


def smoothed(e: np.ndarray, lay: Layout, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marginals of positions in the order of ``lay``, where ``e`` has their likelihoods, the greatest of each being 1 and none below e**-60.

    Vectors are scaled every ``_SCALED`` steps: as one likelihood is 1, the
    greatest entry falls by the least transition at most in a step.
    """
    if not lay.n:
        return np.zeros((0, len(start)))
    a_mat, s_vec = np.exp(trans - trans.max()), np.exp(start - start.max())
    back, steps = np.ascontiguousarray(a_mat.T), lay.steps()
    gamma, beta = np.empty_like(e), np.ones_like(e)
    prev = None
    for t, (o, m) in enumerate(steps):
        cur = gamma[o : o + m]
        if t:
            np.matmul(prev[:m], a_mat, out=cur)
            cur *= e[o : o + m]
        else:
            np.multiply(e[o : o + m], s_vec, out=cur)
        if t % _SCALED == 0:
            cur /= cur.sum(axis=1, keepdims=True)
        prev = cur
    for t in range(lay.longest - 2, -1, -1):
        (o, _), (o2, m2) = steps[t], steps[t + 1]
        cur = beta[o : o + m2]
        np.matmul(e[o2 : o2 + m2] * beta[o2 : o2 + m2], back, out=cur)
        if t % _SCALED == 0:
            cur /= cur.sum(axis=1, keepdims=True)
    gamma *= beta
    gamma /= (gamma @ np.ones(len(start)))[:, None]
    return gamma


def viterbi(emit: np.ndarray, lengths, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label of each position on the best path of its chain (ties: the lower label)."""
    lay = Layout(lengths)
    path = np.zeros(lay.n, dtype=np.int64)
    if not lay.n:
        return path
    e, steps, k = emit[lay.perm], lay.steps(), len(start)
    best, back = None, np.zeros((lay.n, k), dtype=np.int8)
    finals = np.empty((lay.n, k))
    for t, (o, m) in enumerate(steps):
        if t:
            via = best[:m, :, None] + trans[None]
            back[o : o + m] = via.argmax(axis=1)
            best = via.max(axis=1) + e[o : o + m]
        else:
            best = start + e[:m]
        finals[o : o + m] = best
    lab, out = None, np.empty(lay.n, dtype=np.int64)
    for t in range(lay.longest - 1, -1, -1):
        o, m = steps[t]
        cur = finals[o : o + m].argmax(axis=1)
        if lab is not None:
            o2, m2 = steps[t + 1]
            cur[:m2] = back[o2 + np.arange(m2), lab]
        out[o : o + m], lab = cur, cur
    path[lay.perm] = out
    return path


def long_marginals(parts: int, emissions, trans: np.ndarray, start: np.ndarray, use) -> None:
    """Forward-backward over one chain that is held a part at a time.

    ``emissions(i)`` gives those of part ``i``, and is called twice;
    ``use(i, marginals)`` takes the result, last part first.  The forward
    vector is carried from part to part and kept only where a part begins.
    """
    a_mat, s_vec = np.exp(trans - trans.max()), np.exp(start - start.max())
    k, alpha, entries = len(start), None, []

    def scaled(i):
        e = emissions(i)
        return np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -60.0)) if len(e) else e

    def forward(e, alpha, keep):
        for t, row in enumerate(e):
            alpha = row * (s_vec if alpha is None else alpha @ a_mat)
            alpha = alpha / alpha.sum()
            if keep is not None:
                keep[t] = alpha
        return alpha

    for i in range(parts):
        entries.append(alpha)
        alpha = forward(scaled(i), alpha, None)
    beta, back = np.ones(k), a_mat.T.copy()
    for i in reversed(range(parts)):
        e = scaled(i)
        gamma = np.empty((len(e), k))
        forward(e, entries[i], gamma)
        for t in range(len(e) - 1, -1, -1):
            gamma[t] *= beta
            beta = (e[t] * beta) @ back
            beta /= beta.sum()
        use(i, gamma / gamma.sum(axis=1, keepdims=True))


def long_viterbi(parts: int, emissions, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best path of one chain whose emissions come a part at a time; one byte a position and label is held."""
    best, back = None, []
    for i in range(parts):
        e = emissions(i)
        came = np.zeros((len(e), len(start)), dtype=np.int8)
        for t, row in enumerate(e):
            if best is None:
                best = start + row
            else:
                via = best[:, None] + trans
                came[t] = via.argmax(axis=0)
                best = via.max(axis=0) + row
        back.append(came)
    came = np.concatenate(back) if back else np.zeros((0, len(start)), dtype=np.int8)
    path = np.zeros(len(came), dtype=np.int64)
    label = 0 if best is None else int(best.argmax())
    for t in range(len(came) - 1, -1, -1):
        path[t] = label
        label = int(came[t, label])
    return path


class Crf:
    """Weights of binary features (rows of ``weights``), transitions and starts."""

    def __init__(self, n_features: int, n_labels: int):
        self.weights = np.zeros((n_features, n_labels))
        self.trans = np.zeros((n_labels, n_labels))
        self.start = np.zeros(n_labels)

    def emissions(self, fids: np.ndarray, indptr: np.ndarray) -> np.ndarray:
        """Sum of the weights of each row's features; ``indptr`` as in a CSR matrix, no row empty."""
        if len(indptr) < 2:
            return np.zeros((0, self.weights.shape[1]))
        return np.add.reduceat(self.weights[fids], indptr[:-1], axis=0)

    def fit(self, fids, indptr, kind, labels, lengths, weight_decay=1e-5, rounds=40, rate=0.15) -> "Crf":
        """Maximise the mean conditional log likelihood by Adam over all chains.

        ``kind`` names the feature row of each position, ``labels`` its label.
        """
        k, n = self.weights.shape[1], len(kind)
        row_of = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
        ends = np.cumsum(lengths)
        first = np.zeros(n, dtype=bool)
        first[(ends - lengths)[np.asarray(lengths) > 0]] = True
        prev = np.flatnonzero(~first) - 1
        seen_trans = np.bincount(labels[prev] * k + labels[prev + 1], minlength=k * k).reshape(k, k)
        seen_start = np.bincount(labels[first], minlength=k)
        gold = np.zeros((n, k))
        gold[np.arange(n), labels] = 1
        params = [self.weights, self.trans, self.start]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, rounds + 1):
            emit = self.emissions(fids, indptr)[kind]
            gamma, _, xi, starts = forward_backward(emit, lengths, self.trans, self.start, counts=True)
            miss = gold - gamma
            rows = len(indptr) - 1
            by_kind = np.stack([np.bincount(kind, weights=miss[:, c], minlength=rows) for c in range(k)], axis=1)
            g_w = np.stack([np.bincount(fids, weights=by_kind[row_of, c], minlength=len(self.weights)) for c in range(k)], axis=1)
            for i, g in enumerate((g_w, seen_trans - xi, seen_start - starts)):
                g = g / n - weight_decay * params[i]
                m1[i] = 0.9 * m1[i] + 0.1 * g
                m2[i] = 0.99 * m2[i] + 0.01 * g * g
                params[i] += rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.99**step)) + 1e-10)
        return self

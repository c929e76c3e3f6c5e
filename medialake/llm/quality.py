"""Document quality from a conditional random field over lines.

Every line is good or bad, judged by its own features and those of the lines
before and after it; forward-backward gives each line's marginal.  The
length-weighted mean of the marginals is the document's share of good text,
which a logistic curve, fitted on the training sample, maps to a probability.

Training sees at most ``per_class`` whole documents of each label, none longer
than ``max_chars``.

Defined cases: a text that is null or has no visible character scores 0; with
no labelled row of both classes every other text scores 0.5; bytes that are not
UTF-8 count as U+FFFD; a text of very many lines is scored a part at a time
with the forward vector carried on; null ids and repeated rows give a row each;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from medialake.llm.common import bounded_sample, decoded
from medialake.llm.langid import _runs
from medialake.llm.lines import Lines, fit_lines


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, both classes weighing the same (ridge on all but the first column)."""
    w = np.zeros(x.shape[1])
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y)
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (each * (y - p)) - penalty * w
        hess = (x * (each * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def good_share(crf, texts: list[str | None]) -> np.ndarray:
    out = np.full(len(texts), np.nan)
    for lo, hi in _runs([len(t or "") for t in texts], 2_000_000):
        lines = Lines(texts[lo:hi])
        out[lo:hi] = lines.share(lines.marginals(crf))
    return out


def _curve(share: np.ndarray) -> np.ndarray:
    s = np.clip(np.nan_to_num(share), 0.005, 0.995)
    return np.stack([np.ones_like(s), np.log(s / (1 - s)), s], axis=1)


class Model:
    def __init__(self, crf, weights):
        self.crf, self.weights = crf, weights

    def score(self, texts: list[str | None]) -> np.ndarray:
        share = good_share(self.crf, texts)
        p = 1 / (1 + np.exp(-np.clip(_curve(share) @ self.weights, -30, 30)))
        return np.where(np.isnan(share), 0.0, p)


def train(texts: list[str], labels: list[int]) -> Model | None:
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    crf = fit_lines(texts, labels)
    return Model(crf, logistic(_curve(good_share(crf, texts)), y))


def fit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 400, max_chars: int = 30_000) -> Model | None:
    """Train on a bounded sample of ``docs`` (id, text); the label 0/1 is a column of it, or of ``labels`` (id, label)."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, per_class, max_chars)
    return train([t for t, _ in sample], [y for _, y in sample])


def labelled_sample(docs, labels, id_col, text_col, label_col, per_class, max_chars) -> list[tuple[str, int]]:
    """Whole texts of rows labelled 0 or 1 that have a visible character."""
    known = f"`{label_col}` in (0, 1)"
    rows = docs.where(f"trim(coalesce(`{text_col}`, '')) != ''")
    rows, labels = (rows.where(known), None) if labels is None else (rows, labels.where(known))
    return [(t, int(y)) for t, y in bounded_sample(rows, id_col, label_col, per_class, max_chars, text_col, labels)]


def score(docs: DataFrame, model, keep: list[str], text_col: str = "text", threshold: float = 0.7, neutral: float = 0.5) -> DataFrame:
    """Columns ``keep`` of ``docs`` with score and predicted (1 from ``threshold`` on).

    ``model`` is any object with ``score(texts)``; None scores ``neutral``.
    """
    names = [c for c in keep if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            texts = [decoded(t) for t in b.column(b.num_columns - 1).to_pylist()]
            s = m.score(texts) if m else np.array([neutral if t and t.strip() else 0.0 for t in texts])
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    slim = docs.select(*names, docs[text_col].cast("binary").alias("_scored_text"))
    return slim.mapInArrow(run, slim.drop("_scored_text").schema.add("score", "double").add("predicted", "integer"))

"""Logistic regression on NumPy arrays, for models that a bounded sample can fit on the driver, and that sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 0.1, steps: int = 120) -> np.ndarray:
    """Coefficients, the intercept last (not penalised), by accelerated gradient descent from zero: the same data give the same model."""
    n, k = x.shape
    x = np.concatenate([x, np.ones((n, 1), dtype=x.dtype)], axis=1)
    w = (np.ones(n) if weight is None else weight).astype(x.dtype)
    penalty = np.full(k + 1, l2)
    penalty[-1] = 1e-3
    v = np.random.default_rng(0).normal(size=k + 1)
    for _ in range(20):  # the largest curvature, by power iteration
        v /= np.linalg.norm(v)
        v = x.T @ (w * (x @ v.astype(x.dtype))) / 4 + penalty * v
    step = 1 / np.linalg.norm(v) / 1.05
    beta, ahead, t = np.zeros(k + 1), np.zeros(k + 1), 1.0
    for _ in range(steps):
        grad = x.T @ (w * (sigmoid(x @ ahead.astype(x.dtype)) - y)).astype(x.dtype) + penalty * ahead
        new = ahead - step * grad
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, beta, t = new + (t - 1) / t_new * (new - beta), new, t_new
    return beta


def predict(beta: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ beta[:-1] + beta[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, by: str, rows: int, most_bytes: int) -> pa.Table:
    """Labelled texts, for the driver: at most `rows` of each class (0 and 1) of the label `by`, and most_bytes of text in all.

    docs has doc_id and text, labels has doc_id once and labels. Ids come in the order of their
    hashes, classes in turn; of texts that share an id the least is taken. Rows are sorted by id.
    """
    chosen = None
    for kind in (0, 1):
        some = labels.where(F.col(by) == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = some if chosen is None else chosen.union(some)
    chosen = F.broadcast(chosen.withColumnRenamed("doc_id", "labelled"))  # at most 2 * rows ids and labels
    found = docs.where("text IS NOT NULL").join(chosen, F.col("doc_id") == F.col("labelled")).drop("labelled")
    found = found.groupBy(*[c for c in found.columns if c != "text"]).agg(F.min("text").alias("text")).checkpoint()
    sizes = found.select(by, F.xxhash64("doc_id").alias("h"), "doc_id", F.octet_length("text").alias("size")).toArrow().sort_by([(by, "ascending"), ("h", "ascending"), ("doc_id", "ascending")])
    place = np.concatenate([np.arange(n) for n in np.unique(sizes.column(by), return_counts=True)[1]] or [np.zeros(0, dtype=int)])
    turn = np.lexsort((np.arange(len(place)), place))
    fit_in = turn[np.cumsum(sizes.column("size").to_numpy()[turn]) <= most_bytes]
    ids = sizes.select(["doc_id"]).take(pa.array(fit_in))
    if not ids.num_rows:
        return found.limit(0).toArrow()
    if ids.num_rows < sizes.num_rows:
        found = found.join(F.broadcast(found.sparkSession.createDataFrame(ids)), "doc_id")
    return found.toArrow().sort_by("doc_id")

"""Bounded training samples and small numpy models shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into ``fold`` of ``folds``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def training_labels(labels: DataFrame, label: str, folds: int, fold: int, bound: int) -> DataFrame:
    """``doc_id, y`` of at most ``bound`` rows of each class outside the held-out fold.

    The rows with the smallest hashes of their ids, so the sample repeats; an
    id labelled twice counts once, by its largest label.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    usable = one.where(~held_out(F.col("doc_id"), folds, fold))
    return usable.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).unionByName(usable.where("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Full-batch Adam over a list of arrays, which it changes in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def fit_logistic(row: np.ndarray, column: np.ndarray, dense: np.ndarray, width: int, target: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of sparse 0/1 features (row, column pairs), of dense features, and a bias, for soft targets."""
    sparse, own, bias = np.zeros(width), np.zeros(dense.shape[1]), np.array([0.0])
    optimizer = Adam([sparse, own, bias], 0.1)
    scale = weight / max(weight.sum(), 1e-12)
    for _ in range(rounds):
        logit = np.bincount(row, sparse[column], minlength=len(target)) + dense @ own + bias
        error = (sigmoid(logit) - target) * scale
        optimizer.step([np.bincount(column, error[row], minlength=width) + ridge * sparse, dense.T @ error + ridge * own, np.array([error.sum()])])
    return sparse, own, float(bias[0])

"""Bounded labelled samples and a small logistic fit, shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick


def sample(docs: DataFrame, id_: str, text: str, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled ids, chosen by a hash of the id.

    Only ids and labels of the sample visit the driver and are broadcast, both
    bounded by ``rows``; documents are not shuffled.
    """
    known = labels.select(F.col(id_).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    table = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "doc_id long, y int")
    return pick(docs, doc_id=id_, text=text).join(F.broadcast(table), "doc_id")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression; the last one is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))

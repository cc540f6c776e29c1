"""What the operators that learn from labels share: a bounded sample of labelled rows, and logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, train_rows: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text and y (the label) of at most `per_class` documents of each label (0 and 1), and how many each label has.

    Labels that aren't 0 or 1, null doc_ids and documents with both labels are left out. Documents are taken in the
    order of md5 of doc_id, so the sample is the same each time; at most 2 * per_class doc_ids are broadcast.
    """
    marked = labels.where(train_rows & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("other")).where("y = other").select("doc_id", "y")
    number = {int(r["y"]): r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    some = marked.where("y = 0").orderBy(*order).limit(per_class).unionByName(marked.where("y = 1").orderBy(*order).limit(per_class))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id"), number


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train_rows: Column, per_class: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Texts and labels of `labelled_rows`, by doc_id."""
    found, number = labelled_rows(docs, labels, label, train_rows, per_class)
    rows = found.collect()
    return [(r["text"], int(r["y"])) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))], number


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights (the last is the constant) of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = sigmoid(np.einsum("ij,j->i", x, w))  # not BLAS, whose threads may wait for ever once a driver has forked
        h = np.einsum("ij,i,ik->jk", x, weight * p * (1 - p), x) + penalty
        step = np.linalg.solve(h, np.einsum("ij,i->j", x, weight * (p - y)) + np.diag(penalty) * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def class_weights(y: np.ndarray, number: dict[int, int]) -> np.ndarray:
    """Weights that give the sample the proportions of all labelled documents; they add up to the sample's size."""
    w = np.ones(len(y))
    for k in (0, 1):
        if (y == k).any():
            w[y == k] = number.get(k, 0) / (y == k).sum()
    return w * len(w) / max(w.sum(), 1e-9)

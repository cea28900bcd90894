"""Bounded samples of labelled rows, and a logistic regression on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import hash_unit, key_hash


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def labels_to_learn(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label 0/1) of the rows that may be learned from; null ids and labels fall away, of several labels the largest counts."""
    return (labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label"))
            .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max("label").alias("label")))


def sample(labels: DataFrame, most: int, zeros: int | None = None, seed: int = 7) -> DataFrame:
    """About ``most`` rows of label 1 and ``zeros`` (default: as many) of label 0, or all there are, chosen by a hash of the id."""
    counts = {r.label: r.n for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two classes
    share = F.when(F.col("label") == 1, min(1.0, most / max(1, counts.get(1, 0)))).otherwise(min(1.0, (most if zeros is None else zeros) / max(1, counts.get(0, 0))))
    return labels.where(hash_unit(key_hash(seed, ["doc_id"])) < share)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients with the intercept last, by Newton steps with an L2 penalty (not on the intercept)."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.ones(len(x)) if weight is None else weight
    beta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + ridge * beta
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta

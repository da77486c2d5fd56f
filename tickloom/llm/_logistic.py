"""Logistic regression on a bounded sample, by Newton steps with a small ridge."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Coefficients, the intercept last, for rows ``x`` and targets in 0..1 (soft targets allowed)."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.ones(len(x)) if weight is None else weight
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(a.shape[1])
    if not len(x):
        return beta
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (w * (y - p)) - penalty * beta
        hess = (a * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        beta += step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score(features: list[Column], beta: np.ndarray) -> Column:
    """The probability as a Spark expression."""
    total = F.lit(float(beta[-1]))
    for f, b in zip(features, beta[:-1], strict=True):
        total = total + f * F.lit(float(b))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(total, F.lit(-30.0)), F.lit(30.0))))

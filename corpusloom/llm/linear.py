"""Logistic regression by Newton steps, for models that are fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Coefficients, the constant last, of the ridge-penalised fit; y in 0 to 1. The penalty is a share of the number of rows."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(1.0, weight.sum()) / 100)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + penalty * w
        hess = (x.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Log-odds."""
    return x @ w[:-1] + w[-1]

"""Logistic regression on a small matrix, fitted by Newton steps on the driver."""

from __future__ import annotations

import numpy as np


class Logistic:
    """Columns are standardised; a small ridge keeps the weights finite on separable rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> None:
        self.centre = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        spread = x.std(axis=0) if len(x) else np.ones(x.shape[1])
        self.scale = np.where(spread > 0, spread, 1.0)
        z = np.hstack((np.ones((len(x), 1)), (x - self.centre) / self.scale))
        w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6 if 0 < y.sum() < len(y) else ridge
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -30, 30)))

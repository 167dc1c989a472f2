"""Follow-the-regularised-leader (proximal) learner for sparse softmax and logistic models.

One pass is sequential, as the method demands, so it runs on a bounded sample of rows that
the caller documents; the corpus is only ever scored, in parallel.
"""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Per-coordinate FTRL-proximal with elastic-net penalties, k outputs.

    k = 1 is logistic regression with labels 0 and 1; k > 1 is softmax with labels 0..k-1.
    The last row of the weights is an unpenalised bias.
    """

    def __init__(self, dim: int, k: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.dim, self.k, self.alpha, self.beta, self.l1, self.l2 = dim, k, alpha, beta, l1, l2
        self.z = np.zeros((dim + 1, k))
        self.n = np.zeros((dim + 1, k))

    def _weights(self, rows: np.ndarray, l1: np.ndarray) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, idx: np.ndarray, val: np.ndarray, label: int, weight: float = 1.0) -> None:
        rows = np.append(idx, self.dim)
        x = np.append(val, 1.0)[:, None]
        l1 = np.full((len(rows), 1), self.l1)
        l1[-1] = 0
        w = self._weights(rows, l1)
        s = (w * x).sum(0)
        if self.k == 1:
            p = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
            g = (p - label) * x
        else:
            e = np.exp(s - s.max())
            p = e / e.sum()
            p[label] -= 1
            g = x * p
        g = g * weight
        sigma = (np.sqrt(self.n[rows] + g * g) - np.sqrt(self.n[rows])) / self.alpha
        self.z[rows] += g - sigma * w
        self.n[rows] += g * g

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, seed: int = 0) -> Ftrl:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                self.step(*rows[i])
        return self

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Dense (dim, k) weights and the k biases."""
        l1 = np.full((self.dim + 1, 1), self.l1)
        l1[-1] = 0
        w = self._weights(np.arange(self.dim + 1), l1)
        return w[:-1].astype(np.float32), w[-1]

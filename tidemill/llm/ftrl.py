"""Sparse multinomial logistic regression, trained by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties."""

from __future__ import annotations

import numpy as np

Row = tuple[np.ndarray, np.ndarray]  # indices and values


class FtrlClassifier:
    """Weights are a function of the sums z and n: zero within the L1 penalty, shrunk by the L2 penalty beyond it."""

    def __init__(self, dim: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4):
        self.z = np.zeros((dim + 1, classes))  # the last row is the bias, not penalised by L1
        self.n = np.zeros((dim + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.temperature = 1.0

    def _weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def _bias(self) -> np.ndarray:
        return -self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha + self.l2)

    def fit(self, rows: list[Row], labels: np.ndarray, epochs: int = 3, seed: int = 0) -> FtrlClassifier:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)).tolist():
                at, x = rows[k]
                w, b = self._weights(at), self._bias()
                p = softmax(x @ w + b)
                p[labels[k]] -= 1
                g = x[:, None] * p[None, :]
                grown = self.n[at] + g * g
                self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / self.alpha * w
                self.n[at] = grown
                grown = self.n[-1] + p * p
                self.z[-1] += p - (np.sqrt(grown) - np.sqrt(self.n[-1])) / self.alpha * b
                self.n[-1] = grown
        return self

    def freeze(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights and bias, divided by the temperature."""
        return (self._weights(slice(0, -1)) / self.temperature).astype(np.float32), (self._bias() / self.temperature).astype(np.float32)

    def logits(self, rows: list[Row]) -> np.ndarray:
        w, b = self._weights(slice(0, -1)), self._bias()
        return np.array([x @ w[at] + b for at, x in rows]).reshape(len(rows), self.z.shape[1])

    def calibrate(self, rows: list[Row], labels: np.ndarray) -> FtrlClassifier:
        """Sets the temperature that makes held-back labels most likely, by golden-section search on its logarithm."""
        if len(rows):
            logits = self.logits(rows)
            loss = lambda t: -log_softmax(logits / np.exp(t))[np.arange(len(labels)), labels].mean()
            a, b, g = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
            for _ in range(50):
                c, d = b - g * (b - a), a + g * (b - a)
                a, b = (a, d) if loss(c) < loss(d) else (c, b)
            self.temperature = float(np.exp((a + b) / 2))
        return self


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def softmax(x: np.ndarray) -> np.ndarray:
    return np.exp(log_softmax(x))

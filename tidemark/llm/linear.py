"""Multinomial logistic regression on sparse features, trained with follow-the-regularised-leader."""

from __future__ import annotations

import numpy as np


class FtrlProximal:
    """Per-coordinate FTRL with L1 and L2 (elastic net); weights whose leader stays within L1 are exactly 0."""

    def __init__(self, features: int, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 0.1):
        self.z, self.n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))  # the last is the bias
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        """One example; `at` are distinct features."""
        at, values = np.append(at, len(self.z) - 1), np.append(values, 1.0)
        z, n = self.z[at], self.n[at]
        w = self._weights(z, n)
        p = softmax(values @ w)
        p[label] -= 1.0
        g = values[:, None] * p[None, :]
        more = n + g * g
        self.z[at] = z + g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int, seed: int = 1) -> FtrlProximal:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(examples)):
                self.learn(*examples[i], labels[i])
        return self

    def weights(self) -> np.ndarray:
        """[feature, class], the bias last."""
        return self._weights(self.z, self.n).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def scores(weights: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    return values @ weights[at] + weights[-1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of logits with the least negative log likelihood, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))

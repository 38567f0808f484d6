"""Sparse multinomial logistic regression by follow-the-regularised-leader, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Sparse:
    """One example: feature places (each once) and their values."""

    at: np.ndarray
    value: np.ndarray


class Ftrl:
    """FTRL-proximal with elastic-net penalties ``l1`` and ``l2`` and a rate per coordinate.

    The last feature is the bias: it is always on and bears no penalty.
    """

    def __init__(self, n_features: int, n_classes: int, alpha: float = 0.3, beta: float = 0.1,
                 l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((n_features + 1, n_classes))
        self.n = np.zeros((n_features + 1, n_classes))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        rate = (self.beta + np.sqrt(n)) / self.alpha
        free = np.zeros(len(z), dtype=bool)
        free[-1] = True
        l1 = np.where(free, 0.0, self.l1)[:, None]
        l2 = np.where(free, 0.0, self.l2)[:, None]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / (rate + l2))

    def step(self, x: Sparse, label: int, weight: float = 1.0) -> None:
        at = np.append(x.at, len(self.z) - 1)
        value = np.append(x.value, 1.0)
        w = self.weights(at)
        p = softmax(value @ w)
        p[label] -= 1.0
        g = weight * value[:, None] * p
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g

    def fit(self, xs: list[Sparse], labels: list[int], epochs: int = 3, seed: int = 7) -> Ftrl:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(xs)):
                self.step(xs[i], labels[i])
        return self

    def logits(self, xs: list[Sparse]) -> np.ndarray:
        w = self.weights()
        return np.array([x.value @ w[x.at] + w[-1] for x in xs]).reshape(len(xs), w.shape[1])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits that gives held-back labels the highest likelihood."""

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels]
        return -float(np.log(np.maximum(p, 1e-12)).mean())

    if not len(labels):
        return 1.0
    low, high, ratio = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = loss(a), loss(b)
    for _ in range(60):
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = loss(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = loss(b)
    return float(np.exp((low + high) / 2))

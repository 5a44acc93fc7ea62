"""Sparse linear classifiers fitted on the driver from bounded samples."""

from __future__ import annotations

import numpy as np

Example = tuple[np.ndarray, np.ndarray]  # places and values of the features that are not zero


class Ftrl:
    """Multinomial logistic regression by follow-the-regularised-leader with elastic-net penalties.

    The last row of the weights is the intercept, which is not penalised.
    """

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.3, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features + 1, classes))
        self.n = np.zeros((features + 1, classes))

    def _weights(self, z: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + l2))

    def _rows(self, at: np.ndarray) -> np.ndarray:
        w = self._weights(self.z[at], self.n[at], self.l1, self.l2)
        w[-1] = self._weights(self.z[-1], self.n[-1], 0.0, 0.0)
        return w

    def fit(self, examples: list[Example], classes: np.ndarray, rounds: int = 4) -> Ftrl:
        """Sees the examples in the given order, ``rounds`` times."""
        for _ in range(rounds):
            for (at, x), y in zip(examples, classes.tolist(), strict=True):
                at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
                w = self._rows(at)
                p = softmax(x @ w)
                p[y] -= 1.0
                g = x[:, None] * p
                n = self.n[at]
                grown = n + g * g
                self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
                self.n[at] = grown
        return self

    def weights(self) -> np.ndarray:
        """(features + 1) by classes; the last row is the intercept."""
        w = self._weights(self.z, self.n, self.l1, self.l2)
        w[-1] = self._weights(self.z[-1], self.n[-1], 0.0, 0.0)
        return w


def logits(weights: np.ndarray, examples: list[Example]) -> np.ndarray:
    return np.array([x @ weights[at] + weights[-1] for at, x in examples]).reshape(-1, weights.shape[1])


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(scores: np.ndarray, classes: np.ndarray) -> float:
    """The temperature with the least log loss, between 1/20 and 20; 1 without examples."""
    if not len(classes):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(np.maximum(softmax(scores / t)[np.arange(len(classes)), classes], 1e-300)).mean())

    low, high = np.log(0.05), np.log(20.0)
    for _ in range(40):  # the loss has one minimum in 1 / t
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(np.exp(a)) <= loss(np.exp(b)) else (a, high)
    return float(np.exp((low + high) / 2))

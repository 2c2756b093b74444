"""Logistic regression on sparse rows, for samples of bounded size."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Sparse rows: the entries `col`, `value` of row i lie from `start[i]` to `start[i + 1]`."""

    start: np.ndarray
    col: np.ndarray
    value: np.ndarray
    width: int

    @classmethod
    def of(cls, rows: Sequence[tuple[np.ndarray, np.ndarray]], width: int) -> Rows:
        start = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(c) for c, _ in rows], out=start[1:])
        join = lambda i, kind: np.concatenate([r[i] for r in rows] or [[]]).astype(kind)
        return cls(start, join(0, np.int64), join(1, np.float64), width)

    def __len__(self) -> int:
        return len(self.start) - 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.start))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.col] * self.value, len(self))

    def take(self, chosen: np.ndarray) -> Rows:
        at = np.flatnonzero(chosen) if chosen.dtype == bool else chosen
        sizes = np.diff(self.start)[at]
        start = np.concatenate([[0], np.cumsum(sizes)])
        index = np.repeat(self.start[at] - start[:-1], sizes) + np.arange(start[-1])
        return Rows(start, self.col[index], self.value[index], self.width)

    def frequent(self, least: int) -> np.ndarray:
        """Columns that occur in at least so many rows."""
        return np.bincount(self.col, minlength=self.width) >= least

    def plus(self, values: np.ndarray) -> Rows:
        """The rows with further dense columns (rows × columns) after the sparse ones."""
        n, k = values.shape
        start = self.start + k * np.arange(n + 1)
        col = np.empty(start[-1], np.int64)
        value = np.empty(start[-1])
        own = np.ones(start[-1], bool)
        for j in range(k):
            at = start[1:] - k + j
            col[at], value[at], own[at] = self.width + j, values[:, j], False
        col[own], value[own] = self.col, self.value
        return Rows(start, col, value, self.width + k)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def logit(self, rows: Rows) -> np.ndarray:
        return rows.dot(self.weights) + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(
    rows: Rows, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 150, rate: float = 0.5
) -> Model:
    """Full-batch AdaGrad on the mean log loss with an L2 term. Without rows, or with one
    class only, a constant."""
    weight = np.ones(len(y)) if weight is None else weight
    total = max(weight.sum(), 1e-9)
    share = np.clip((weight * y).sum() / total, 1e-3, 1 - 1e-3) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    w = np.zeros(rows.width)
    if not len(y) or y.min() == y.max():
        return Model(w, bias)
    row, seen, seen_bias = rows.row, np.full(rows.width, 1e-8), 1e-8
    for _ in range(steps):
        off = weight * (sigmoid(np.bincount(row, w[rows.col] * rows.value, len(y)) + bias) - y) / total
        slope = np.bincount(rows.col, off[row] * rows.value, rows.width) + l2 * w
        seen += slope**2
        w -= rate * slope / np.sqrt(seen)
        seen_bias += (s := off.sum()) ** 2
        bias -= rate * s / seen_bias**0.5
    return Model(w, float(bias))


def folds(n: int, k: int) -> np.ndarray:
    """Fold of each of n rows, in turn."""
    return np.arange(n) % k


def telling(rows: Rows, y: np.ndarray, weight: np.ndarray | None = None, least: float = 12.0, rare: int = 5) -> np.ndarray:
    """Columns whose presence goes with the class: chi-square of the two by two table of
    at least `least`, and `rare` rows or more that have it."""
    weight = np.ones(len(y)) if weight is None else weight
    row, hit = rows.row, (rows.value != 0).astype(float)
    a = np.bincount(rows.col, hit * (weight * y)[row], rows.width)
    b = np.bincount(rows.col, hit * (weight * (1 - y))[row], rows.width)
    pos, neg = float((weight * y).sum()), float((weight * (1 - y)).sum())
    c, d = pos - a, neg - b
    under = (a + b) * (c + d) * pos * neg
    chi = (pos + neg) * (a * d - b * c) ** 2 / np.where(under > 0, under, np.inf)
    return (chi >= least) & rows.frequent(rare)

"""Logistic regression on sparse rows of counts."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np

#: Entries worked on at once, about.
CHUNK = 1 << 19


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Counts:
    """A sparse matrix of counts, row after row; an entry's value is its count times its row's and its column's scale."""

    sizes: np.ndarray
    columns: np.ndarray
    counts: np.ndarray
    row_scale: np.ndarray
    column_scale: np.ndarray

    def parts(self) -> list[tuple[slice, slice, np.ndarray]]:
        """Runs of rows with their entries and the rows' first entries, so that temporaries stay small."""
        ends = np.cumsum(self.sizes)
        cuts = np.unique(np.searchsorted(ends, np.arange(CHUNK, ends[-1] if len(ends) else 0, CHUNK)))
        edges = np.unique(np.concatenate([[0], cuts, [len(ends)]]))
        first = ends - self.sizes
        return [(slice(a, b), slice(int(first[a]), int(ends[b - 1])), first[a:b] - first[a]) for a, b in zip(edges, edges[1:])]

    def times(self, theta: np.ndarray) -> np.ndarray:
        weights, out = theta * self.column_scale, np.zeros(len(self.sizes))
        for rows, entries, first in self.parts():
            if entries.stop > entries.start:
                sums = np.zeros(entries.stop - entries.start + 1)
                np.cumsum(weights[self.columns[entries]] * self.counts[entries], out=sums[1:])
                out[rows] = sums[first + self.sizes[rows]] - sums[first]
        return out * self.row_scale

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        scaled, out = g * self.row_scale, np.zeros(len(self.column_scale))
        for rows, entries, _ in self.parts():
            out += np.bincount(self.columns[entries], np.repeat(scaled[rows], self.sizes[rows]) * self.counts[entries], minlength=len(out))
        return out * self.column_scale


def fit_logistic(x: Counts, labels: np.ndarray, weights: np.ndarray, l2: float, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the weighted log loss plus l2/2 |w|^2, by limited-memory BFGS."""
    n_columns = len(x.column_scale)

    def value(theta: np.ndarray) -> tuple[float, np.ndarray]:
        z = theta[-1] + x.times(theta[:-1])
        loss = weights @ (np.logaddexp(0, z) - labels * z) + l2 / 2 * theta[:-1] @ theta[:-1]
        g = weights * (sigmoid(z) - labels)
        return loss, np.append(x.transposed_times(g) + l2 * theta[:-1], g.sum())

    theta = np.zeros(n_columns + 1)
    loss, grad = value(theta)
    past: deque = deque(maxlen=8)
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, y, rho in reversed(past):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(past, reversed(alphas)):
            q += s * (a - rho * (y @ q))
        step, slope = 1.0 if past else 1.0 / max(1.0, np.abs(grad).sum()), grad @ q
        while True:
            new = theta - step * q
            new_loss, new_grad = value(new)
            if new_loss <= loss - 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = new - theta, new_grad - grad
        done = loss - new_loss < 1e-7 * max(1.0, abs(loss))
        theta, loss, grad = new, new_loss, new_grad
        if s @ y > 1e-12:
            past.append((s, y, 1.0 / (s @ y)))
        if done:
            break
    return theta[:-1], float(theta[-1])

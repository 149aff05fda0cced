"""Linear hinge-loss fitting by dual coordinate descent, and the logistic curve that turns margins into probabilities."""

from __future__ import annotations

import numpy as np


def fit_dense(x: np.ndarray, y: np.ndarray, cost: np.ndarray, *, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) that minimise |w|^2 / 2 + sum of cost * max(0, 1 - y w.x); y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, alpha, q = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), cost[i])
            if (step := new - alpha[i]) != 0.0:
                w += step * y[i] * x[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def fit_sparse(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, *, epochs: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """The same for rows of indices whose entry at index j is values[j] times the row's scale 1/norm; weights by index, and the bias."""
    w, bias, alpha = np.zeros(len(values)), 0.0, np.zeros(len(rows))
    own = []
    for r in rows:
        v = values[r]
        norm = np.sqrt((v * v).sum()) or 1.0
        own.append(v / norm)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ own[i] + bias) - 1
            new = min(max(alpha[i] - g / 2.0, 0.0), cost[i])  # each row has norm 1, and 1 for the bias
            if (step := new - alpha[i]) != 0.0:
                w[rows[i]] += step * y[i] * own[i]
                bias += step * y[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def fit_curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a margin + b))), by Newton steps on Platt's smoothed targets; classes weigh alike."""
    n1, n0 = int(label.sum()), int(len(label) - label.sum())
    if not n1 or not n0:
        return 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    t = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(label == 1, 0.5 / n1, 0.5 / n0) * len(label)
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (t - p)) - 1e-3 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def curve(margin: np.ndarray, ab: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(ab[0] * margin + ab[1], -30, 30)))

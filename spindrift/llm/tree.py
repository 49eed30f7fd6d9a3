"""A small decision tree: Gini impurity, binary splits of numeric features."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1, leading: int | None = None, levels: int = 0) -> tuple:
    """A nested tuple (feature, limit, at most, above), or a leaf (the part of positive rows,). Of equal splits the first is taken.

    The first `levels` levels split by the first `leading` features, where these split at all.
    """
    part = float(y.mean()) if len(y) else 0.0
    if depth == 0 or part in (0.0, 1.0):
        return (part,)
    best = None
    for f in range(leading if levels and leading else x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= limit
            n = low.sum()
            if n < least or len(y) - n < least:
                continue
            p, q = y[low].mean(), y[~low].mean()
            impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(limit), low)
    if best is None:
        return fit(x, y, depth, least) if levels else (part,)
    _, f, limit, low = best
    return f, limit, *(fit(x[part], y[part], depth - 1, least, leading, max(levels - 1, 0)) for part in (low, ~low))


def predict(node: tuple, x: np.ndarray) -> np.ndarray:
    """The part of positive training rows in each row's leaf."""
    if len(node) == 1:
        return np.full(len(x), node[0])
    low = x[:, node[0]] <= node[1]
    out = np.empty(len(x))
    out[low], out[~low] = predict(node[2], x[low]), predict(node[3], x[~low])
    return out

"""Components of a bounded graph, in whole-array steps."""

from __future__ import annotations

import numpy as np


def union(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component: hook the larger root to the smaller, then halve all ways to the roots."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def inscribed(inside: np.ndarray) -> float:
    """Largest distance from a cell inside to the nearest one outside, exact, by squared distances along columns and then rows."""
    far = float(sum(inside.shape))
    down = np.zeros(inside.shape)
    for step in (1, -1):
        run = np.zeros(inside.shape[1])
        for k in range(inside.shape[0])[::step]:
            run = np.where(inside[k], run + 1, 0)
            down[k] = run if step == 1 else np.minimum(down[k], run)
    best, columns = 0.0, np.arange(inside.shape[1])
    for row in down:
        if row.any():
            near = ((columns[:, None] - columns[None, :]) ** 2 + row[None, :] ** 2).min(axis=1)
            best = max(best, float(near[row > 0].max()))
    return min(far, best**0.5)

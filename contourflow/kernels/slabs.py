"""Cheapest costs on graphs whose edges join near names only, by slabs of blocks: each block is a cut, so distances cross it by matrices.

A matrix is an array (4, n, m) of cost, length, climb and number of edges of the cheapest way from each of n nodes to each of m; a cost of inf is no way.
A fifth measure, where there is one, is the greatest of a way's edges; the others are sums.
A block is `band` consecutive names; an edge joins a block and itself or the next. A slab is some blocks and the first block of the next slab.
"""

from __future__ import annotations

import numpy as np

Matrix = np.ndarray


def nothing(n: int, m: int, measures: int = 4) -> Matrix:
    out = np.zeros((measures, n, m))
    out[0] = np.inf
    return out


def after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The measures of ways a and then b, pair by pair."""
    out = a + b
    out[4:] = np.maximum(a[4:], b[4:])
    return out


def times(a: Matrix, b: Matrix, rows: int = 512) -> Matrix:
    """The cheapest ways by a and then b."""
    if a.shape[1] > rows:
        return np.concatenate([times(a[:, k : k + rows], b, rows) for k in range(0, a.shape[1], rows)], axis=1)
    at = (a[0][:, None, :] + np.ascontiguousarray(b[0].T)[None]).argmin(axis=2)
    return after(a[:, np.arange(a.shape[1])[:, None], at], b[:, at, np.arange(b.shape[2])])


def least(a: Matrix, b: Matrix) -> Matrix:
    return np.where(a[0] <= b[0], a, b)


def closed(m: Matrix) -> Matrix:
    """The cheapest ways by any number of steps of m."""
    m = m.copy()
    for k in range(m.shape[1]):
        r, c = np.nonzero(m[0][:, k, None] + m[0][None, k] < m[0])
        if len(r):
            m[:, r, c] = after(m[:, r, k], m[:, k, c])
    return m


class Slab:
    """within: each block's own edges, ahead: those to the next block, back: those from the next block."""

    def __init__(self, u: np.ndarray, v: np.ndarray, measures: np.ndarray, band: int, first: int, blocks: int) -> None:
        """measures: (4 or 5, edges); the names lie in blocks first to first + blocks - 1."""
        self.within, self.ahead, self.back = (np.zeros((n, len(measures), band, band)) for n in (blocks, blocks - 1, blocks - 1))
        for part in (self.within, self.ahead, self.back):
            part[:, 0] = np.inf
        order = np.argsort(-measures[0], kind="stable")  # the cheapest of parallel edges is written last
        u, v, measures = u[order], v[order], measures[:, order]
        a, b = u // band - first, v // band - first
        for part, own in ((self.within, a == b), (self.ahead, b == a + 1), (self.back, b == a - 1)):
            part[np.minimum(a, b)[own], :, u[own] % band, v[own] % band] = measures[:, own].T
        for x, k in ((a, u), (b, v)):
            self.within[x, :, k % band, k % band] = 0.0

    def ends(self) -> tuple[Matrix, Matrix, Matrix, Matrix]:
        """Ways inside the slab from first block to first, first to last, last to first and last to last."""
        ll = lr = rl = rr = closed(self.within[0])
        for own, f, g in zip(self.within[1:], self.ahead, self.back, strict=True):
            out, home = times(lr, f), times(g, rl)
            rr = closed(least(own, times(times(g, rr), f)))
            lr, rl = times(out, rr), times(rr, home)
            ll = least(ll, times(lr, home))
        return ll, lr, rl, rr

    def spread(self, left: Matrix, right: Matrix) -> None:
        """Whole distances in the slab, given those among its first block's and among its last block's nodes."""
        f, g, own = self.ahead, self.back, list(self.within)
        n = len(own) - 1
        own[0] = least(own[0], left)
        own[n] = least(own[n], right)
        low, high = [closed(own[0])], [closed(own[n])]
        for r in range(n):
            low.append(closed(least(own[r + 1], times(times(g[r], low[r]), f[r]))))
        for r in reversed(range(n)):
            high.append(closed(least(own[r], times(times(f[r], high[-1]), g[r]))))
        self.among = [closed(least(a, b)) for a, b in zip(low, high[::-1], strict=True)]
        self.from_left, self.to_left = [self.among[0]], [self.among[0]]
        for r in range(n):
            self.from_left.append(times(times(self.from_left[r], f[r]), self.among[r + 1]))
            self.to_left.append(times(self.among[r + 1], times(g[r], self.to_left[r])))
        from_right, to_right = [self.among[n]], [self.among[n]]
        for r in reversed(range(n)):
            from_right.append(times(times(from_right[-1], g[r]), self.among[r]))
            to_right.append(times(self.among[r], times(f[r], to_right[-1])))
        self.from_right, self.to_right = from_right[::-1], to_right[::-1]

    def between(self, a: int, i: int, b: int, j: int) -> np.ndarray:
        """From place i of block a to place j of block b, after spread()."""
        v = self.among[a][:, i : i + 1]
        for r in range(a, b):
            v = times(times(v, self.ahead[r]), self.among[r + 1])
        for r in range(a, b, -1):
            v = times(times(v, self.back[r - 1]), self.among[r - 1])
        return v[:, 0, j]


def joined(slabs: dict[int, tuple[Matrix, Matrix, Matrix, Matrix]], band: int) -> tuple[dict[int, Matrix], dict[int, Matrix], dict[int, Matrix]]:
    """Of the slabs' ends(): whole distances among each slab's first block's nodes, from there to the next slab's, and back from there."""
    none = nothing(band, band, len(next(iter(slabs.values()))[0]))
    ks = range(min(slabs), max(slabs) + 1)
    at = {k: slabs.get(k, (none,) * 4) for k in ks}
    low, high = {ks[0]: none}, {ks[-1] + 1: none}
    for k in ks:
        ll, lr, rl, rr = at[k]
        low[k + 1] = least(rr, times(times(rl, closed(least(ll, low[k]))), lr))
    for k in reversed(ks):
        ll, lr, rl, rr = at[k]
        high[k] = least(ll, times(times(lr, closed(least(rr, high[k + 1]))), rl))
    among = {k: closed(least(low[k], high[k])) for k in low}
    return among, {k: times(times(among[k], at[k][1]), among[k + 1]) for k in ks}, {k: times(times(among[k + 1], at[k][2]), among[k]) for k in ks}

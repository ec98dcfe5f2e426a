"""Parametric smoothing splines of one path, after Dierckx: knots go where the residuals are until their sum can reach s, then the penalty on the
jumps of the highest derivative is set so that it does."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

DEGREE = 3
SAMPLES = 8
MOST_S = 2.0**20
S_TOLERANCE = 1e-3


def basis(knots: np.ndarray, degree: int, u: np.ndarray) -> np.ndarray:
    """Values of all B-splines at u (rows), by the recurrence of Cox and de Boor."""
    n = len(knots) - 1
    last = int(np.flatnonzero(knots[:-1] < knots[1:])[-1])
    at = np.clip(np.searchsorted(knots, u, side="right") - 1, degree, last)
    # At most degree + 1 splines are not 0 at a place: column r is the spline at - d + r.
    some = np.ones((len(u), 1))
    zero = np.zeros((len(u), 1))
    for d in range(1, degree + 1):
        k = at[:, None] + np.arange(-d, 1)
        low, high, high2, low2 = knots[k], knots[k + d], knots[k + d + 1], knots[k + 1]
        left, right = high - low, high2 - low2
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(left > 0, (u[:, None] - low) / left, 0.0)
            c = np.where(right > 0, (high2 - u[:, None]) / right, 0.0)
        some = a * np.hstack([zero, some]) + c * np.hstack([some, zero])
    b = np.zeros((len(u), n - degree))
    b[np.arange(len(u))[:, None], at[:, None] + np.arange(-degree, 1)] = some
    return b


def jumps(knots: np.ndarray, degree: int) -> np.ndarray:
    """Jump of each spline's derivative of order `degree` at the inner knots (rows)."""
    inner = np.unique(knots[degree + 1 : -degree - 1])
    if not len(inner):
        return np.zeros((0, len(knots) - degree - 1))
    # The derivative is constant between knots: difference the coefficients' matrix `degree` times and step over each knot.
    m = np.eye(len(knots) - degree - 1)
    t = knots
    for d in range(degree, 0, -1):
        t = t[1:-1]
        width = t[d : d + len(m) - 1] - t[: len(m) - 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            m = np.where(width[:, None] > 0, d * (m[1:] - m[:-1]) / width[:, None], 0.0)
    spans = np.searchsorted(t, inner, side="right") - 1
    return m[spans] - m[spans - 1]


@dataclass
class Spline:
    knots: np.ndarray
    coefficients: np.ndarray
    degree: int
    residual: float
    #: Its values at the points that it was fitted to.
    fitted: np.ndarray

    def at(self, u: np.ndarray) -> np.ndarray:
        return basis(self.knots, self.degree, u) @ self.coefficients


def parameter(points: np.ndarray) -> np.ndarray:
    """Share of the chord length at each point."""
    s = np.concatenate([[0.0], np.cumsum(np.hypot(*(points[1:] - points[:-1]).T))])
    return s / s[-1]


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a x = b; the shortest of the nearest solutions where a is singular, as it is for points that nearly coincide."""
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


class Smoother:
    """Splines of one path for any s; what does not hang on s is made once. Repeated points are left out; with fewer than four the degree falls."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE) -> None:
        step = np.hypot(*(points[1:] - points[:-1]).T)
        self.points = points[np.concatenate([[True], step > 0])]
        n = len(self.points)
        if n < 2:
            raise ValueError("a spline has two points at least")
        self.degree = k = min(degree, n - 1)
        self.u = u = parameter(self.points)
        half = (k + 1) // 2
        self.through = u[half : n - half] if k % 2 else (u[half : n - half - 1] + u[half + 1 : n - half]) / 2
        self.exact = self._solve(self.through)
        self.inner: list[float] = []
        self.stages = [self._solve(np.array(self.inner))]
        self.weakest: dict[int, float] = {}

    def _system(self, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Knots, the splines' values, and the normal equations without a penalty."""
        knots = np.concatenate([np.zeros(self.degree + 1), inner, np.ones(self.degree + 1)])
        b = basis(knots, self.degree, self.u)
        return knots, b, b.T @ b, b.T @ self.points

    def _of(self, knots: np.ndarray, b: np.ndarray, c: np.ndarray) -> Spline:
        fitted = b @ c
        return Spline(knots, c, self.degree, float(((fitted - self.points) ** 2).sum()), fitted)

    def _solve(self, inner: np.ndarray) -> Spline:
        knots, b, square, right = self._system(inner)
        return self._of(knots, b, solved(b, self.points) if b.shape[0] == b.shape[1] else solved(square, right))

    def _next(self) -> Spline | None:
        """One more knot: at the middle point of the stretch with the largest residuals."""
        if len(self.inner) >= len(self.through):
            return None
        u, bounds = self.u, np.array([0.0, *self.inner, 1.0])
        error = ((self.stages[-1].fitted - self.points) ** 2).sum(axis=1)
        span = np.clip(np.searchsorted(bounds, u, side="right") - 1, 0, len(bounds) - 2)
        free = ~np.isin(u, bounds)
        sums = np.bincount(span, weights=error, minlength=len(bounds) - 1)
        sums[np.bincount(span, weights=free, minlength=len(bounds) - 1) == 0] = -1.0
        if sums.max() < 0:
            return None
        candidates = u[free & (span == int(sums.argmax()))]
        self.inner = sorted([*self.inner, float(candidates[len(candidates) // 2])])
        return self._solve(np.array(self.inner))

    def fit(self, s: float) -> Spline:
        """The smoothest spline whose squared residuals sum to s (relative tolerance 1e-3); s = 0 goes through all points."""
        if s <= 0:
            return self.exact
        while self.stages[-1].residual > s:
            more = self._next()
            self.stages.append(self.exact if more is None else more)
            if more is None:
                break
        now = next((x for x in self.stages if x.residual <= s), self.exact)
        inner = now.knots[self.degree + 1 : -self.degree - 1]
        if not len(inner) or now.residual >= s:
            return now
        if self.weakest.get(id(now), 0.0) > s:  # the weakest penalty is too much, so all are
            return now
        knots, b, square, right = self._system(inner)
        j = jumps(knots, self.degree)
        bent = j.T @ j
        low, high, best = -40.0, 40.0, now
        if id(now) not in self.weakest:
            self.weakest[id(now)] = self._of(knots, b, solved(square + 2.0**low * bent, right)).residual
            if self.weakest[id(now)] > s:
                return now
        for _ in range(60):
            mid = (low + high) / 2
            one = self._of(knots, b, solved(square + 2.0**mid * bent, right))
            if one.residual <= s:
                low, best = mid, one
                if s - one.residual <= 1e-3 * s:
                    break
            else:
                high = mid
        return best


def fit(points: np.ndarray, s: float, degree: int = DEGREE) -> Spline:
    return Smoother(points, degree).fit(s)


def sampled(spline: Spline, n_points: int, samples: int = SAMPLES) -> np.ndarray:
    return spline.at(np.linspace(0, 1, samples * n_points))


def hausdorff(a: np.ndarray, b: np.ndarray) -> float:
    """Symmetric distance of two point sets, by blocks of rows; squares find the nearest points, roots are taken of those alone."""
    worst_a, nearest, least = 0.0, np.zeros(len(b), dtype=np.int64), np.full(len(b), np.inf)
    for k in range(0, len(a), 64):
        dx, dy = a[k : k + 64, None, 0] - b[None, :, 0], a[k : k + 64, None, 1] - b[None, :, 1]
        dx *= dx
        dy *= dy
        dx += dy
        worst_a = max(worst_a, float(np.hypot(*(a[k : k + 64] - b[dx.argmin(axis=1)]).T).max()))
        here = dx.argmin(axis=0)
        d = dx[here, np.arange(len(b))]
        closer = d < least
        nearest[closer], least[closer] = here[closer] + k, d[closer]
    return max(worst_a, float(np.hypot(*(a[nearest] - b).T).max()))


@dataclass
class Search:
    s: float
    deviation: float
    tried: int
    hit_cap: bool
    degenerate: bool
    curve: np.ndarray


def to_polyline(points: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Distance of each point to the nearest place on a line's segments, by blocks of points."""
    a, d = line[:-1], line[1:] - line[:-1]
    size = np.maximum((d**2).sum(axis=1), 1e-300)
    out = np.empty(len(points))
    for k in range(0, len(points), 256):
        p = points[k : k + 256, None, :] - a[None]
        t = np.clip((p * d[None]).sum(axis=2) / size, 0.0, 1.0)
        out[k : k + 256] = np.sqrt(((p - t[:, :, None] * d[None]) ** 2).sum(axis=2)).min(axis=1)
    return out


def element_deviations(base: np.ndarray, curve: np.ndarray, is_curve: np.ndarray) -> list[tuple[bool, float]]:
    """Each element of the base curve, a run of curve or tangent, with its largest distance from the other curve (PL-23)."""
    d = to_polyline(base, curve)
    cuts = np.flatnonzero(is_curve[1:] != is_curve[:-1]) + 1
    return [(bool(is_curve[part[0]]), float(d[part].max())) for part in np.split(np.arange(len(base)), cuts)]


def largest_s(points: np.ndarray, budget: float, most: float = MOST_S, tolerance: float = S_TOLERANCE, is_curve: Callable[[np.ndarray], np.ndarray] | None = None, tangent_budget: float = 0.0) -> Search:
    """The largest s whose curve stays within the budget of the curve through all points: doubling from 1, then bisection (SM-6).

    is_curve: which places of that curve lie in curves; then each curve has the budget and each tangent the tangent_budget for itself (SM-11).
    """
    smoother = Smoother(points)
    base = sampled(smoother.fit(0.0), len(points))
    if len(points) < 4:
        return Search(0.0, 0.0, 0, False, True, base)
    bends = None if is_curve is None else is_curve(base)
    tried, good, bad, held = 0, 0.0, None, (0.0, base)
    known: dict[int, tuple[Spline, bool, float, np.ndarray]] = {}

    def judged(spline: Spline) -> tuple[Spline, bool, float, np.ndarray]:
        curve = sampled(spline, len(points))
        if is_curve is None:
            d = hausdorff(curve, base)
            return spline, d <= budget, d, curve
        parts = element_deviations(base, curve, bends)
        return spline, all(x <= (budget if bend else tangent_budget) for bend, x in parts), max(x for _, x in parts), curve

    def within(s: float) -> bool:
        nonlocal tried, held
        tried += 1
        spline = smoother.fit(s)  # often the same one for near values of s
        if id(spline) not in known:
            known[id(spline)] = judged(spline)
        _, ok, d, curve = known[id(spline)]
        if ok:
            held = (d, curve)
        return ok

    s = 1.0
    while s <= most:
        if not within(s):
            bad = s
            break
        good, s = s, 2 * s
    if bad is None:
        return Search(good, held[0], tried, True, False, held[1])
    while bad - good > tolerance * max(bad, 1.0):
        mid = (good + bad) / 2
        if within(mid):
            good = mid
        else:
            bad = mid
    return Search(good, held[0], tried, False, False, held[1])

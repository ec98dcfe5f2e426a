"""Smoothing of paths: representative points, the largest smoothing within a deviation budget, arms, reports and the guard (SM-*).

A path is one group; its points are bounded by the domain.
"""

from __future__ import annotations

import contourflow
import numpy as np
import pandas as pd
from contourflow.kernels.runs import absorb_short, thin, with_midpoints
from contourflow.kernels.spline import largest_s
from contourflow.operators.polyline import straight_radius
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(contourflow)

#: Budget of the deviation as a share of the class's smallest radius, the growth of a budget, the back-off of a radius, and how often either is changed.
BUDGET_SHARE, GROWTH, BACK_OFF, MOST_CHANGES = 0.1, 2.0, 0.5, 8
#: Budget of a tangent, where each element has its own.
TANGENT_SHARE = 0.3
ARMS = ("baseline", "gradient_aware", "per_element_budget", "min_tangent", "radius_iterate", "smooth_z")


def radii(xy: np.ndarray, step: float = 5.0, chord: float = 20.0) -> np.ndarray:
    """Circumradii along a curve by the chord method."""
    s = np.concatenate([[0.0], np.cumsum(np.hypot(*(xy[1:] - xy[:-1]).T))])
    n = max(int(s[-1] // step), 1)
    at = np.linspace(0, s[-1], n + 1)
    p = np.stack([np.interp(at, s, xy[:, 0]), np.interp(at, s, xy[:, 1])], axis=1)
    w = min(max(round(chord / step), 1), (len(p) - 1) // 2)
    if w < 1:
        return np.array([np.inf])
    a, b, c = p[: -2 * w], p[w:-w], p[2 * w :]
    cross = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]))
    with np.errstate(divide="ignore"):
        return np.hypot(*(b - a).T) * np.hypot(*(c - b).T) * np.hypot(*(c - a).T) / (2 * cross)


def smooth_path(xyz: np.ndarray, r_min: float, i_max: float, iterations: int = 1, arm: str = "baseline", cell_m: float = 1.0) -> tuple[np.ndarray, dict]:
    """A smoothed axis with heights by the share of length, and its report."""
    if arm not in ARMS:
        raise ValueError(f"no arm {arm}")
    rough_s = np.concatenate([[0.0], np.cumsum(np.hypot(*(xyz[1:, :2] - xyz[:-1, :2]).T))])

    def heights(xy: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0.0], np.cumsum(np.hypot(*(xy[1:] - xy[:-1]).T))])
        return np.interp(s / max(s[-1], 1e-12) * rough_s[-1], rough_s, xyz[:, 2])

    def steepest(xy: np.ndarray, z: np.ndarray) -> float:
        run = np.hypot(*(xy[1:] - xy[:-1]).T)
        ok = run > 1e-9
        return float(np.abs(100 * np.diff(z)[ok] / run[ok]).max(initial=0.0))

    def bends(curve: np.ndarray) -> np.ndarray:
        r = radii(curve)
        at = np.linspace(0, len(r) - 1, len(curve)).round().astype(int)
        return np.isfinite(r[at]) & (r[at] <= straight_radius())

    def once(radius: float, budget: float, drop: np.ndarray | None = None) -> tuple[np.ndarray, object]:
        xy = xyz[:, :2]
        found = None
        for _ in range(iterations):
            points = with_midpoints(thin(xy, radius / cell_m), r_min)
            if drop is not None and len(points) - int(drop[: len(points)].sum()) >= 4:
                points = points[~drop[: len(points)]]
            own = {"is_curve": bends, "tangent_budget": TANGENT_SHARE * r_min} if arm == "per_element_budget" else {}
            found = largest_s(points, budget, **own)
            xy = found.curve
        return xy, found

    radius, budget, changes = r_min, BUDGET_SHARE * r_min, 0
    xy, found = once(radius, budget)
    rough_i = steepest(xyz[:, :2], xyz[:, 2])
    while arm == "gradient_aware" and changes < MOST_CHANGES and steepest(xy, heights(xy)) > max(i_max, rough_i):
        radius, changes = radius * BACK_OFF, changes + 1
        xy, found = once(radius, budget)
    while arm == "radius_iterate" and changes < MOST_CHANGES and radii(xy).min() < r_min:
        budget, changes = budget * GROWTH, changes + 1
        xy, found = once(radius, budget)
    if arm == "min_tangent":
        points = with_midpoints(thin(xyz[:, :2], radius / cell_m), r_min)
        s = np.concatenate([[0.0], np.cumsum(np.hypot(*(points[1:] - points[:-1]).T))])
        turn = np.zeros(len(points), dtype=bool)
        if len(points) > 2:
            d = np.diff(points, axis=0)
            angle = np.abs(np.diff(np.unwrap(np.arctan2(d[:, 1], d[:, 0]))))
            turn[1:-1] = angle > 0.05
        straight = ~absorb_short(turn, s, 2 * r_min)
        drop = straight.copy()
        drop[[0, -1]] = False
        xy, found = once(radius, budget, drop)
    z = heights(xy)
    if arm == "smooth_z":
        s = np.concatenate([[0.0], np.cumsum(np.hypot(*(xy[1:] - xy[:-1]).T))])
        at = np.linspace(0, s[-1], max(int(s[-1] // 50), 1) + 1)
        z = np.interp(s, at, np.interp(at, s, z))
    report = {"s": found.s, "deviation_m": found.deviation, "hit_cap": found.hit_cap, "degenerate": found.degenerate, "changes": changes, "r_min_before": float(radii(xyz[:, :2]).min()), "r_min_after": float(radii(xy).min()), "i_before": rough_i, "i_after": steepest(xy, z)}
    return np.column_stack([xy, z]), report


REPORT = "path_id long, road_class string, arm string, iterations int, s double, deviation_m double, hit_cap boolean, degenerate boolean, changes int, r_min_before double, r_min_after double, i_before double, i_after double"


def before_after(points: DataFrame, classes: DataFrame, arms: tuple[str, ...] = ("baseline",), iterations: int = 1) -> DataFrame:
    """A report for each path, class and arm (SM-7, SM-8, SM-10). classes: (name, r_min_m, i_max_percent), a fixed small table."""
    jobs = [(r["name"], r["r_min_m"], r["i_max_percent"], arm) for r in classes.select("name", "r_min_m", "i_max_percent").collect() for arm in arms]
    columns = [x.split()[0] for x in REPORT.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        xyz = pdf.sort_values("seq")[["x_m", "y_m", "z_m"]].to_numpy(dtype=float)
        moved = np.concatenate([[True], np.hypot(*(xyz[1:, :2] - xyz[:-1, :2]).T) > 1e-12])
        rows = []
        for name, r, i, arm in jobs:
            if moved.sum() >= 2:
                _, report = smooth_path(xyz[moved], r, i, iterations, arm)
                rows.append({"path_id": key[0], "road_class": name, "arm": arm, "iterations": iterations} | report)
        return pd.DataFrame(rows, columns=columns)

    # A path is a few kilobytes and tens of milliseconds, so partitions by size would leave the work to a few tasks.
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return points.repartition(parts, "path_id").groupBy("path_id").applyInPandas(run, REPORT)


def guarded(reports: DataFrame, classes: DataFrame) -> DataFrame:
    """reports with the decision: an axis that was within the class's gradient and is no more is refused (SM-9)."""
    limits = F.broadcast(classes.select(F.col("name").alias("road_class"), "i_max_percent", "r_min_m"))
    both = reports.join(limits, "road_class")
    refused = (F.col("i_before") <= F.col("i_max_percent")) & (F.col("i_after") > F.col("i_max_percent"))
    warning = F.when(F.col("hit_cap"), "the smoothing met its cap").when(F.col("degenerate"), "too few points to smooth").when(F.col("r_min_after") < F.col("r_min_m"), "the radius is under the class's")
    return both.withColumns({"accepted": ~refused, "warning": warning, "r_gain": F.col("r_min_after") - F.col("r_min_before"), "i_gain": F.col("i_after") - F.col("i_before")})


def absorbed(stations: DataFrame, least: float) -> DataFrame:
    """stations(path_id, k, s, is_curve, ..) with short runs absorbed into their neighbours (PL-14)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        return pdf.assign(is_curve=absorb_short(pdf["is_curve"].to_numpy(dtype=bool), pdf["s"].to_numpy(), least))

    return stations.groupBy("path_id").applyInPandas(run, stations.schema)


def drop_in_spans(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points within none of their path's spans(path_id, s_start, s_end); ends stay, and a path keeps its points where fewer than four would be left (SM-12)."""


    path = W.partitionBy("path_id")
    marked = points.withColumns({"_first": F.min("s").over(path), "_last": F.max("s").over(path)})
    inner = marked.filter("s > _first AND s < _last").alias("p").join(spans.alias("q"), (F.col("p.path_id") == F.col("q.path_id")) & F.col("p.s").between(F.col("q.s_start"), F.col("q.s_end")), "left_semi").select("path_id", "s").withColumn("_in", F.lit(True))
    rows = marked.join(inner.distinct(), ["path_id", "s"], "left").withColumn("_left", F.count_if(F.col("_in").isNull()).over(path))
    return rows.filter("_in IS NULL OR _left < 4").select(points.columns)

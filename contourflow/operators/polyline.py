"""Polylines: path_points(path_id, seq, x_m, y_m, z_m) in, measures, stations, runs and grade lines out (PL-*).

A path is one group of a window; everything is a window or an equi-join on the path, and places between points are found by
a union with the targets and the last point seen, never by a range join.
"""

from __future__ import annotations

from math import pi

from contourflow.functions.values import INF, finite
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STEP_M = 5.0
CHORD_M = 20.0
SAGITTA_M = 0.05
#: Changes of gradient up to this are none: they come from the rounding of places.
LEVEL = 1e-9
#: Places nearer than this are one place.
SAME_M = 1e-6

PATH = "path_id"


def along(order: str = "seq") -> W:
    return W.partitionBy(PATH).orderBy(order)


def so_far(order: str = "seq") -> W:
    return along(order).rowsBetween(W.unboundedPreceding, W.currentRow)


def whole() -> W:
    return W.partitionBy(PATH)


def drop_repeats(points: DataFrame, least: float = 1e-12) -> DataFrame:
    """Points that differ in plan from the one before (FLT-9)."""
    step = F.hypot(F.col("x_m") - F.lag("x_m").over(along()), F.col("y_m") - F.lag("y_m").over(along()))
    return points.withColumn("_step", step).filter(F.col("_step").isNull() | (F.col("_step") > least)).drop("_step")


def segments(points: DataFrame) -> DataFrame:
    """A row a segment: seq of its first point, planar and spatial length, dz (PL-1)."""
    ahead = [F.lead(c).over(along()) - F.col(c) for c in ("x_m", "y_m", "z_m")]
    rows = points.withColumns(dict(zip(("dx", "dy", "dz"), ahead, strict=True))).filter("dx IS NOT NULL")
    planar = F.hypot("dx", "dy")
    return rows.select(PATH, "seq", planar.alias("length_m"), F.hypot(planar, F.col("dz")).alias("length_3d_m"), "dx", "dy", "dz")


def measures(points: DataFrame) -> DataFrame:
    """Lengths, straight distance, sinuosity, steepest gradient and elevation of each path (PL-1, PL-2, PL-6, PL-7, PL-10).

    Gradients skip segments without length; a closed path's sinuosity is inf.
    """
    seg = segments(points)
    g = F.when(F.col("length_m") > 0, 100 * F.col("dz") / F.col("length_m"))
    sums = seg.groupBy(PATH).agg(
        F.sum("length_m").alias("length_m"), F.sum("length_3d_m").alias("length_3d_m"), F.max(F.abs(g)).alias("i_max_percent"),
        F.sum(F.greatest("dz", F.lit(0.0))).alias("ascent_m"), F.sum(F.greatest(-F.col("dz"), F.lit(0.0))).alias("descent_m"),
    )
    end = lambda f: f(F.struct("x_m", "y_m", "z_m"), F.col("seq"))
    ends = points.groupBy(PATH).agg(end(F.min_by).alias("a"), end(F.max_by).alias("b"), (F.max("z_m") - F.min("z_m")).alias("span_m"))
    straight = F.hypot(F.col("b.x_m") - F.col("a.x_m"), F.col("b.y_m") - F.col("a.y_m"))
    out = sums.join(ends, PATH).withColumns({"straight_m": straight, "net_m": F.col("b.z_m") - F.col("a.z_m")}).drop("a", "b")
    closed = F.col("straight_m") <= 1e-9 * F.greatest(F.col("length_m"), F.lit(1.0))
    return out.withColumn("sinuosity", F.when(closed, F.lit(INF)).otherwise(F.col("length_m") / F.nullif(F.col("straight_m"), F.lit(0.0))))


def bundle(points: DataFrame, step: float = STEP_M, chord: float = CHORD_M) -> DataFrame:
    """measures() with the smallest radius, inf where nothing bends, and the length after resampling (PL-10)."""
    stations = resample(points, step)
    r_min = curve_radii(stations, step, chord).groupBy(PATH).agg(F.min("radius_m").alias("_r"))
    length = chainage(stations.withColumn("seq", F.col("k"))).groupBy(PATH).agg(F.max("s").alias("resampled_length_m"))
    both = measures(points).join(length, PATH, "left").join(r_min, PATH, "left")
    return both.withColumn("r_min_m", F.coalesce("_r", F.lit(INF))).drop("_r")


def chainage(points: DataFrame) -> DataFrame:
    """points with s, the planar length so far (WN-1)."""
    step = F.hypot(F.col("x_m") - F.lag("x_m").over(along()), F.col("y_m") - F.lag("y_m").over(along()))
    return points.withColumn("_d", F.coalesce(step, F.lit(0.0))).withColumn("s", F.sum("_d").over(so_far())).drop("_d")


def places(line: DataFrame, targets: DataFrame, values: list[str], s: str = "s") -> DataFrame:
    """targets(path_id, k, s) with the line's values there by linear interpolation (JN-6).

    line: (path_id, s, values). A target beyond the ends gets the end's value.
    """
    ahead = [F.lead(c).over(along(s)).alias(f"{c}_next") for c in (s, *values)]
    known = line.select(PATH, F.col(s).alias("s"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("k"), F.struct(s, *values, *ahead).alias("p"))
    asked = targets.select(PATH, "s", F.lit(1).alias("kind"), F.col("k").cast("long").alias("k"), F.lit(None).cast(known.schema["p"].dataType).alias("p"))
    order = W.partitionBy(PATH).orderBy("s", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    first = F.first("p", ignorenulls=True).over(W.partitionBy(PATH).orderBy("s", "kind").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    both = known.unionByName(asked).withColumn("p", F.coalesce(F.last("p", ignorenulls=True).over(order), first)).filter("kind = 1")
    width = F.col(f"p.{s}_next") - F.col(f"p.{s}")
    t = F.when(width > 0, F.greatest(F.lit(0.0), (F.col("s") - F.col(f"p.{s}")) / F.nullif(width, F.lit(0.0)))).otherwise(F.lit(0.0))
    return both.withColumn("_t", t).select(PATH, "k", "s", *[(F.col(f"p.{c}") + F.when(F.col("_t") > 0, F.col("_t") * (F.col(f"p.{c}_next") - F.col(f"p.{c}"))).otherwise(0.0)).alias(c) for c in values])


def even_targets(totals: DataFrame, step: float, at_least: int = 1) -> DataFrame:
    """(path_id, k, s, n): n = floor(total / step), at least one, even spaces of each path's total; k from 0 to n."""
    n = F.greatest(F.floor(F.col("total") / step), F.lit(at_least))
    rows = totals.withColumn("n", n).select(PATH, "total", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("k"))
    return rows.select(PATH, "k", (F.col("total") * F.col("k") / F.col("n")).alias("s"), "n")


def resample(points: DataFrame, step: float = STEP_M) -> DataFrame:
    """(path_id, k, s, x_m, y_m, z_m) at even places; a path shorter than one step keeps its two ends (PL-3, PL-11)."""
    line = chainage(drop_repeats(points))
    targets = even_targets(line.groupBy(PATH).agg(F.max("s").alias("total")), step)
    return places(line.select(PATH, "s", "x_m", "y_m", "z_m"), targets, ["x_m", "y_m", "z_m"])


def circumradius(a: Column, b: Column, c: Column) -> Column:
    """Radius of the circle through three points (structs of x_m, y_m); inf for points on a line (PL-4)."""
    side = lambda p, q: F.hypot(q["x_m"] - p["x_m"], q["y_m"] - p["y_m"])
    cross = F.abs((b["x_m"] - a["x_m"]) * (c["y_m"] - a["y_m"]) - (b["y_m"] - a["y_m"]) * (c["x_m"] - a["x_m"]))
    return F.when(cross > 0, side(a, b) * side(b, c) * side(a, c) / (2 * F.nullif(cross, F.lit(0.0)))).when(cross == 0, F.lit(INF))


def menger_radii(points: DataFrame, stride: int = 1, order: str = "seq") -> DataFrame:
    """(path_id, order, radius_m) of triples at a constant stride, placed at the first point."""
    p = F.struct("x_m", "y_m")
    rows = points.select(PATH, order, p.alias("a"), F.lead(p, stride).over(along(order)).alias("b"), F.lead(p, 2 * stride).over(along(order)).alias("c"))
    return rows.filter("c IS NOT NULL").select(PATH, order, circumradius(F.col("a"), F.col("b"), F.col("c")).alias("radius_m"))


def curve_radii(stations: DataFrame, step: float = STEP_M, chord: float = CHORD_M) -> DataFrame:
    """(path_id, k, w, radius_m, on_axis) with the stride that spans the chord, less on short paths (PL-5); a path of under three points has none.

    on_axis: the three points coincide or lie on a line along an axis, so no rounding of their places can bend them; on other lines it can. The stride differs by path, which a window cannot, so the middle and far points come by equi-joins on k.
    """
    most = max(1, round(chord / step))
    sizes = stations.groupBy(PATH).agg(F.count("*").alias("n")).withColumn("w", F.least(F.lit(most), F.floor((F.col("n") - 1) / 2))).filter("w >= 1").select(PATH, "w")
    near = stations.join(sizes, PATH).select(PATH, "k", "w", F.struct("x_m", "y_m").alias("a"))
    for n, name in ((1, "b"), (2, "c")):
        other = stations.select(PATH, F.col("k").alias("_k"), F.struct("x_m", "y_m").alias(name))
        near = near.withColumn("_k", F.col("k") + n * F.col("w")).join(other, [PATH, "_k"]).drop("_k")
    turn = [(F.col(f"b.{p}_m") - F.col(f"a.{p}_m")) * (F.col(f"c.{q}_m") - F.col(f"a.{q}_m")) for p, q in ("xy", "yx")]
    return near.select(PATH, "k", "w", circumradius(F.col("a"), F.col("b"), F.col("c")).alias("radius_m"), ((turn[0] == 0) & (turn[1] == 0)).alias("on_axis"))


def station_radii(stations: DataFrame, step: float = STEP_M, chord: float = CHORD_M) -> DataFrame:
    """stations with r_h: the radius of the triple around each, that of the nearest triple at the ends, inf on a straight (PL-12)."""
    placed = curve_radii(stations, step, chord).select(PATH, (F.col("k") + F.col("w")).alias("k"), F.col("radius_m").alias("r_h"))
    both = stations.join(placed, [PATH, "k"], "left")
    order = W.partitionBy(PATH).orderBy("k")
    before = F.last("r_h", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    after = F.first("r_h", ignorenulls=True).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    return both.withColumn("r_h", F.coalesce("r_h", before, after, F.lit(INF)))


def straight_radius(chord: float = CHORD_M, sagitta: float = SAGITTA_M) -> float:
    """Radius from which a chord's sagitta cannot be told from a straight line (PL-13)."""
    return chord * chord / (8 * sagitta)


def detection_floor(step: float = STEP_M, chord: float = CHORD_M) -> float:
    """Shortest tangent that the curvature method can see."""
    return chord + 2 * step


def runs(stations: DataFrame, label: str = "is_curve", order: str = "k") -> DataFrame:
    """stations with run: the number of label changes so far (WN-3)."""
    changed = F.when(F.col(label) != F.lag(label).over(along(order)), 1).otherwise(0)
    return stations.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(so_far(order))).drop("_changed")


def elements(stations: DataFrame) -> DataFrame:
    """A row a run of curve or tangent: first and last station, chainages, length, smallest and mean finite radius (PL-15)."""
    r = F.when(F.col("is_curve"), finite(F.col("r_h")))
    return runs(stations).groupBy(PATH, F.col("run").alias("elem")).agg(
        F.when(F.bool_or("is_curve"), "curve").otherwise("tangent").alias("kind"), F.min("k").alias("k_start"), F.max("k").alias("k_end"),
        F.min("s").alias("s_start"), F.max("s").alias("s_end"), (F.max("s") - F.min("s")).alias("length_m"), F.min(r).alias("r_min"), F.avg(r).alias("r_mean"),
    )


def tangent_lengths(stations: DataFrame) -> DataFrame:
    """stations with tangent_len: their tangent's length, NULL in curves (PL-16), and interior: neither the first nor the last element (CK-7)."""
    by_run = W.partitionBy(PATH, "run")
    rows = runs(stations).withColumn("_last", F.max("run").over(whole())).withColumn("_length", F.max("s").over(by_run) - F.min("s").over(by_run))
    return rows.withColumns({"tangent_len": F.when(~F.col("is_curve"), F.col("_length")), "interior": (F.col("run") > 0) & (F.col("run") < F.col("_last"))}).drop("_last", "_length")


def grade_line(stations: DataFrame, step: float) -> DataFrame:
    """Design points at even places with the gradient ahead and the break there (PL-17, PL-18).

    (path_id, k, s, z_m, gradient, delta, curve_m, r_v, v_kind): at an inner point the gradient changes by delta over a curve as long as the shorter
    neighbour; r_v is inf without a change.
    """
    line = stations.select(PATH, "s", "z_m")
    points = places(line, even_targets(line.groupBy(PATH).agg(F.max("s").alias("total")), step), ["z_m"])
    order = along("k")
    length = F.lead("s").over(order) - F.col("s")
    rows = points.withColumn("length_m", length).withColumn("gradient", (F.lead("z_m").over(order) - F.col("z_m")) / F.nullif(F.col("length_m"), F.lit(0.0)))
    delta, curve = F.col("gradient") - F.lag("gradient").over(order), F.least(F.lag("length_m").over(order), F.col("length_m"))
    rows = rows.withColumns({"delta": F.when(F.lag("length_m").over(order).isNotNull(), delta), "curve_m": F.when(F.col("length_m").isNotNull() & F.lag("length_m").over(order).isNotNull(), curve)})
    level = F.abs("delta") <= LEVEL
    radius = F.when(~level, F.col("curve_m") / F.abs(F.nullif(F.col("delta"), F.lit(0.0)))).when(level, F.lit(INF))
    kind = F.when(level, "none").when(F.col("delta") > 0, "concave").when(F.col("delta") < 0, "convex")
    return rows.withColumns({"r_v": radius, "v_kind": kind}).select(PATH, "k", "s", "z_m", "gradient", "delta", "curve_m", "r_v", "v_kind")


def vertical_series(stations: DataFrame, line: DataFrame) -> DataFrame:
    """stations with r_v and v_kind of the vertical curve that covers them; of two that share an end, the later (PL-19).

    A curve is at most as long as the shorter neighbour, so only the breaks next to a station can cover it: they come by
    the last and next break seen, not by an interval join.
    """
    breaks = line.filter("curve_m IS NOT NULL").select(PATH, "s", F.lit(0).alias("kind"), F.struct("s", "curve_m", "r_v", "v_kind").alias("b"))
    asked = stations.select(PATH, "s", F.lit(1).alias("kind"), F.lit(None).cast(breaks.schema["b"].dataType).alias("b"), F.struct(*stations.columns).alias("row"))
    breaks = breaks.withColumn("row", F.lit(None).cast(asked.schema["row"].dataType))
    order = W.partitionBy(PATH).orderBy(F.round("s", 6), "kind")
    last = F.last("b", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    following = F.first("b", ignorenulls=True).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    rows = breaks.unionByName(asked).withColumns({"before": last, "after": following}).filter("kind = 1")
    inside = lambda b: F.abs(F.col("s") - F.col(f"{b}.s")) <= F.col(f"{b}.curve_m") / 2 + SAME_M
    curve = F.when(inside("after"), F.col("after")).when(inside("before"), F.col("before"))
    return rows.withColumn("c", curve).select("row.*", "c.r_v", "c.v_kind")


def grade_series(stations: DataFrame, line: DataFrame) -> DataFrame:
    """stations with the designed gradient ahead of them; at the end, that of the last stretch (PL-20)."""
    known = line.filter("gradient IS NOT NULL").select(PATH, "s", F.lit(0).alias("kind"), "gradient")
    asked = stations.select(PATH, "s", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("gradient"), F.struct(*stations.columns).alias("row"))
    known = known.withColumn("row", F.lit(None).cast(asked.schema["row"].dataType))
    order = W.partitionBy(PATH).orderBy(F.round("s", 6), "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = known.unionByName(asked).withColumn("grade", F.last("gradient", ignorenulls=True).over(order)).filter("kind = 1")
    return rows.select("row.*", "grade")


def station_gradient(stations: DataFrame) -> DataFrame:
    """stations with gradient: central differences of z over the chainage, second order on uneven spaces, one-sided at the ends (PL-21)."""
    order = along("k")
    before, after = F.col("s") - F.lag("s").over(order), F.lead("s").over(order) - F.col("s")
    down, up = F.col("z_m") - F.lag("z_m").over(order), F.lead("z_m").over(order) - F.col("z_m")
    rows = stations.withColumns({"_hb": before, "_ha": after, "_db": down, "_da": up})
    hb, ha, db, da = (F.col(c) for c in ("_hb", "_ha", "_db", "_da"))
    middle = (hb * hb * da + ha * ha * db) / F.nullif(hb * ha * (hb + ha), F.lit(0.0))
    return rows.withColumn("gradient", F.coalesce(middle, da / F.nullif(ha, F.lit(0.0)), db / F.nullif(hb, F.lit(0.0)))).drop("_hb", "_ha", "_db", "_da")


def classify(stations: DataFrame, radius: float | None = None) -> DataFrame:
    """stations with is_curve: a finite radius up to that of a straight line (PL-14, before short runs are absorbed; smoothing.classified absorbs them)."""
    return stations.withColumn("is_curve", F.coalesce(finite(F.col("r_h")) <= (straight_radius() if radius is None else radius), F.lit(False)))


def point_distances(pairs: DataFrame, points: DataFrame, order: str = "seq") -> DataFrame:
    """For pairs(pair_id, a, b) of paths: each point of one with the distance of the nearest of the other, both ways (PL-8, PL-9).

    All points of a pair meet on the pair's key, a path's points being bounded by the domain.
    """
    own = lambda end: pairs.join(points.select(F.col(PATH).alias(end), F.col(order).alias(f"k_{end}"), F.col("x_m").alias(f"x_{end}"), F.col("y_m").alias(f"y_{end}")), end).select("pair_id", f"k_{end}", f"x_{end}", f"y_{end}")
    both = own("a").join(own("b"), "pair_id").withColumn("d", F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")))
    ways = [both.groupBy("pair_id", F.col(f"k_{end}").alias("k")).agg(F.min("d").alias("d")).withColumn("side", F.lit(end)) for end in ("a", "b")]
    return ways[0].unionByName(ways[1])


def deviation(pairs: DataFrame, points: DataFrame, order: str = "seq") -> DataFrame:
    """Symmetric Hausdorff distance of the point sets, and mean, median and largest distance from a's points to b's."""
    d = point_distances(pairs, points, order)
    from_a = F.when(F.col("side") == "a", F.col("d"))
    return d.groupBy("pair_id").agg(F.max("d").alias("hausdorff_m"), F.avg(from_a).alias("mean_m"), F.median(from_a).alias("median_m"), F.max(from_a).alias("max_m"))


def to_polyline(pairs: DataFrame, points: DataFrame, order: str = "seq") -> DataFrame:
    """For pairs(pair_id, a, b): each point of a with its distance to the nearest place on b's segments (PL-22)."""
    ahead = [F.lead(c).over(along(order)).alias(f"{c[0]}2") for c in ("x_m", "y_m")]
    seg = points.select(F.col(PATH).alias("b"), F.col("x_m").alias("x1"), F.col("y_m").alias("y1"), *ahead).filter("x2 IS NOT NULL")
    own = pairs.join(points.select(F.col(PATH).alias("a"), F.col(order).alias("k"), "x_m", "y_m"), "a").drop("a", "b")
    both = own.join(pairs.join(seg, "b").drop("a", "b"), "pair_id")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("x_m") - F.col("x1")) * dx + (F.col("y_m") - F.col("y1")) * dy) / F.nullif(size, F.lit(0.0))))).otherwise(F.lit(0.0))
    d = both.withColumn("t", t).withColumn("d", F.hypot(F.col("x_m") - (F.col("x1") + F.col("t") * dx), F.col("y_m") - (F.col("y1") + F.col("t") * dy)))
    return d.groupBy("pair_id", "k").agg(F.min("d").alias("d"))


def insert_midpoints(points: DataFrame, r_min: float) -> DataFrame:
    """Midpoints of segments longer than pi r_min; the first segment is never split (SM-3)."""
    ahead = F.lead(F.struct("x_m", "y_m")).over(along())
    far = F.hypot(F.col("n.x_m") - F.col("x_m"), F.col("n.y_m") - F.col("y_m")) > pi * r_min
    here = F.struct(F.col("seq").cast("double").alias("seq"), F.col("x_m").alias("x_m"), F.col("y_m").alias("y_m"))
    middle = F.struct((F.col("seq") + 0.5).alias("seq"), ((F.col("x_m") + F.col("n.x_m")) / 2).alias("x_m"), ((F.col("y_m") + F.col("n.y_m")) / 2).alias("y_m"))
    rows = points.withColumn("n", ahead).withColumn("_rank", F.row_number().over(along()))
    made = F.when(F.col("n").isNotNull() & far & (F.col("_rank") > 1), F.array(here, middle)).otherwise(F.array(here))
    return rows.select(PATH, F.explode(made).alias("p")).select(PATH, "p.*")

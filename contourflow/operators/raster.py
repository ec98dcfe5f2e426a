"""Raster algebra over cell tables: cells(terrain_id, node, i, j, z, valid), a row a cell; a cell that lacks or is not valid is void."""

from __future__ import annotations

from math import pi

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: WGS84: semi-major axis in metres and first eccentricity squared (fixed values).
WGS84_A = 6378137.0
WGS84_E2 = 0.00669437999014


def height(valid: str = "valid", z: str = "z") -> Column:
    return F.when(F.col(valid), F.col(z))


def decimate(cells: DataFrame, stride: int) -> DataFrame:
    """Every stride-th row and column (SRC-5); the filter reaches the scan."""
    return cells.filter((F.col("i") % stride == 0) & (F.col("j") % stride == 0))


def crop(cells: DataFrame, row0: int, col0: int, n_rows: int, n_cols: int) -> DataFrame:
    """A rectangle, its corner at (0, 0) and its nodes numbered anew (SRC-6)."""
    inside = cells.filter(F.col("i").between(row0, row0 + n_rows - 1) & F.col("j").between(col0, col0 + n_cols - 1))
    i, j = F.col("i") - row0, F.col("j") - col0
    return inside.withColumns({"node": (i * n_cols + j).cast("long"), "i": i.cast("int"), "j": j.cast("int")})


def coarsen(cells: DataFrame, factor: int, n_rows: int, n_cols: int, strict: bool = False) -> DataFrame:
    """Block means (RAS-4, RAS-5): trailing partial blocks are dropped; strict: a block with a void is void, else it is the mean of the rest."""
    f = F.lit(factor)
    whole = cells.filter((F.col("i") < n_rows // factor * factor) & (F.col("j") < n_cols // factor * factor))
    blocks = whole.groupBy("terrain_id", F.floor(F.col("i") / f).cast("int").alias("i"), F.floor(F.col("j") / f).cast("int").alias("j"))
    out = blocks.agg(F.avg(height()).alias("z"), F.count(height()).alias("n_valid"))
    z = F.when(F.col("n_valid") == factor * factor, F.col("z")) if strict else F.col("z")
    return out.withColumns({"z": z, "valid": z.isNotNull()})


def coverage(cells: DataFrame, stride: int) -> DataFrame:
    """Validity at a stride (RAS-6)."""
    return decimate(cells, stride).select("terrain_id", (F.col("i") / stride).cast("int").alias("i"), (F.col("j") / stride).cast("int").alias("j"), F.col("valid").alias("covered"))


def full_windows(cells: DataFrame, size: int, stride: int = 1, least_relief: float = 0.0) -> DataFrame:
    """Corners of all fully valid size x size windows with their relief (RAS-7).

    Counts, minima and maxima slide along j, then along i: two partitioned windows over the cells, whatever the window's size. Windows are looked
    for on the decimated raster, so a size is a multiple of the stride.
    """
    if size % stride:
        raise ValueError("a window's size is a multiple of the stride")
    k = size // stride
    coarse = decimate(cells, stride).select("terrain_id", (F.col("i") / stride).cast("int").alias("i"), (F.col("j") / stride).cast("int").alias("j"), height().alias("z"))
    along = W.partitionBy("terrain_id", "i").orderBy("j").rangeBetween(0, k - 1)
    down = W.partitionBy("terrain_id", "j").orderBy("i").rangeBetween(0, k - 1)
    rows = coarse.select("terrain_id", "i", "j", F.count("z").over(along).alias("n"), F.min("z").over(along).alias("lo"), F.max("z").over(along).alias("hi"))
    both = rows.select("terrain_id", "i", "j", F.sum("n").over(down).alias("n"), F.min("lo").over(down).alias("lo"), F.max("hi").over(down).alias("hi"))
    found = both.filter(F.col("n") == k * k).select("terrain_id", (F.col("i") * stride).alias("row0"), (F.col("j") * stride).alias("col0"), F.lit(size).alias("size"), (F.col("hi") - F.col("lo")).alias("relief_m"))
    return found.filter(F.col("relief_m") >= least_relief)


def census(cells: DataFrame, sizes: list[int], stride: int = 1) -> DataFrame:
    """Candidates and their range of relief for each window size (RAS-15)."""
    out = None
    for size in sizes:
        one = full_windows(cells, size, stride)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("terrain_id", "size").agg(F.count("*").alias("n_windows"), F.min("relief_m").alias("relief_lo"), F.max("relief_m").alias("relief_hi"))


def extent(cells: DataFrame, align: int = 1) -> DataFrame:
    """Bounding box of the valid cells, its corner aligned down (RAS-9)."""
    box = cells.filter("valid").groupBy("terrain_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("i", "j") for n, f in (("lo", F.min), ("hi", F.max))])
    down = lambda c: (F.floor(F.col(c) / align) * align).cast("int")
    return box.select("terrain_id", down("lo_i").alias("row0"), down("lo_j").alias("col0"), (F.col("hi_i") + 1 - down("lo_i")).alias("n_rows"), (F.col("hi_j") + 1 - down("lo_j")).alias("n_cols"))


def slope_percent(cells: DataFrame, n_rows: int, n_cols: int, cell_m: float) -> DataFrame:
    """Slope by central differences, one-sided at the raster's edge, at valid cells whose four neighbours are valid or outside (RAS-10)."""
    rows = cells.select("terrain_id", "i", "j", height().alias("z"))
    h, v = W.partitionBy("terrain_id", "i").orderBy("j"), W.partitionBy("terrain_id", "j").orderBy("i")

    def beside(window: W, axis: str) -> tuple[Column, Column]:
        """The neighbours' heights; null where the neighbouring cell lacks."""
        return tuple(F.when(f(F.col(axis), 1).over(window) == F.col(axis) + d, f(F.col("z"), 1).over(window)) for f, d in ((F.lag, -1), (F.lead, 1)))

    west, east = beside(h, "j")
    north, south = beside(v, "i")
    rows = rows.withColumns({"west": west, "east": east}).withColumns({"north": north, "south": south})

    def slope(low: str, high: str, axis: str, n: int) -> Column:
        first, last = F.col(axis) == 0, F.col(axis) == n - 1
        return F.when(first, F.col(high) - F.col("z")).when(last, F.col("z") - F.col(low)).otherwise((F.col(high) - F.col(low)) / 2) / cell_m

    inner = F.col("z").isNotNull()
    for name, axis, edge in (("west", "j", 0), ("east", "j", n_cols - 1), ("north", "i", 0), ("south", "i", n_rows - 1)):
        inner &= (F.col(axis) == edge) | F.col(name).isNotNull()
    return rows.filter(inner).select("terrain_id", "i", "j", (100 * F.hypot(slope("west", "east", "j", n_cols), slope("north", "south", "i", n_rows))).alias("slope_percent"))


def gon_from_percent(percent: Column) -> Column:
    return F.atan(percent / 100) * (200 / pi)


def sample_bilinear(points: DataFrame, cells: DataFrame, n_rows: int, n_cols: int, row: str = "row", col: str = "col") -> DataFrame:
    """points (terrain_id, point, row, col) with the height there, clamped to the border (RAS-12): one equi-join with four corners a point."""
    r, c = F.greatest(F.lit(0.0), F.least(F.col(row), F.lit(float(n_rows - 1)))), F.greatest(F.lit(0.0), F.least(F.col(col), F.lit(float(n_cols - 1))))
    r0, c0 = F.least(F.floor(r), F.lit(max(0, n_rows - 2))), F.least(F.floor(c), F.lit(max(0, n_cols - 2)))
    with_base = points.withColumns({"_r": r, "_c": c}).withColumns({"_r0": r0.cast("int"), "_c0": c0.cast("int")})
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("k")
    corners = with_base.select("terrain_id", "point", "_r", "_c", "_r0", "_c0", corner)
    weight = lambda x, x0, k: F.when(k == 1, x - x0).otherwise(1 - (x - x0))
    corners = corners.select("terrain_id", "point", (F.col("_r0") + F.col("k.a")).alias("i"), (F.col("_c0") + F.col("k.b")).alias("j"), (weight(F.col("_r"), F.col("_r0"), F.col("k.a")) * weight(F.col("_c"), F.col("_c0"), F.col("k.b"))).alias("w"))
    heights = cells.select("terrain_id", "i", "j", height().alias("z"))
    return corners.filter("w > 0").join(heights, ["terrain_id", "i", "j"]).groupBy("terrain_id", "point").agg(F.sum(F.col("w") * F.col("z")).alias("z"))


def path_xyz(points: DataFrame, cells: DataFrame, n_rows: int, n_cols: int, cell_m: float) -> DataFrame:
    """(terrain_id, path_id, seq, x_m, y_m, z_m) of points(terrain_id, path_id, seq, row, col) in cells: metres, with the heights sampled from the raster (RAS-13)."""
    named = points.select("terrain_id", F.struct("path_id", "seq").alias("point"), "row", "col")
    heights = sample_bilinear(named, cells, n_rows, n_cols).select("terrain_id", "point", F.col("z").alias("z_m"))
    both = named.join(heights, ["terrain_id", "point"], "left")
    return both.select("terrain_id", "point.path_id", "point.seq", (F.col("row") * cell_m).alias("x_m"), (F.col("col") * cell_m).alias("y_m"), "z_m")


def cell_size_m(lat: Column, arcsec: float) -> tuple[Column, Column]:
    """North-south and east-west size of a sample at a latitude, from the ellipsoid's radii of curvature (RAS-2)."""
    step = pi / 180 / 3600 * arcsec
    w2 = 1 - WGS84_E2 * F.pow(F.sin(F.radians(lat)), F.lit(2.0))
    return step * WGS84_A * (1 - WGS84_E2) / F.pow(w2, F.lit(1.5)), step * WGS84_A * F.cos(F.radians(lat)) / F.sqrt(w2)


def resample_columns(cells: DataFrame, n_cols: int, n_new: int) -> DataFrame:
    """Columns interpolated at n_new even places from the first to the last (RAS-3)."""
    if n_new < 2:
        raise ValueError("two columns at least")
    at = F.col("jj") * ((n_cols - 1) / (n_new - 1))
    places = cells.sparkSession.range(n_new).select(F.col("id").cast("int").alias("jj")).withColumn("x", at).withColumn("j", F.least(F.floor("x"), F.lit(n_cols - 2)).cast("int"))
    left = cells.select("terrain_id", "i", "j", height().alias("z0"))
    right = cells.select("terrain_id", "i", (F.col("j") - 1).alias("j"), height().alias("z1"))
    both = F.broadcast(places).join(left, "j").join(right, ["terrain_id", "i", "j"])
    return both.select("terrain_id", "i", F.col("jj").alias("j"), (F.col("z0") + (F.col("x") - F.col("j")) * (F.col("z1") - F.col("z0"))).alias("z"))


def fill_voids(cells: DataFrame, n_rows: int, n_cols: int, reach: int = 8) -> DataFrame:
    """Voids with the height of the nearest valid cell (RAS-1); ties go to the smallest node.

    A void looks in squares of doubling reach; the distance of what it found bounds where a nearer one can lie, so a result stands once
    it is not farther than the reach. Candidates meet by an equi-join on tiles of the reach's size, never by all pairs.
    """
    known = cells.filter(F.col("valid"))
    todo = cells.filter(~F.col("valid")).select("terrain_id", "node", "i", "j")
    done, most = None, max(n_rows, n_cols)
    while True:
        tile = lambda c: F.floor(F.col(c) / reach)
        around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("k")
        asked = todo.select("terrain_id", "node", "i", "j", around).select("terrain_id", "node", "i", "j", (tile("i") + F.col("k.a")).alias("ti"), (tile("j") + F.col("k.b")).alias("tj"))
        held = known.select("terrain_id", tile("i").alias("ti"), tile("j").alias("tj"), F.col("i").alias("vi"), F.col("j").alias("vj"), F.col("z").alias("vz"), F.col("node").alias("vn"))
        d2 = (F.pow(F.col("i") - F.col("vi"), F.lit(2)) + F.pow(F.col("j") - F.col("vj"), F.lit(2))).alias("d2")
        near = asked.join(held, ["terrain_id", "ti", "tj"]).groupBy("terrain_id", "node").agg(F.min(F.struct(d2, "vn", "vz")).alias("best"))
        sure = near.filter((F.col("best.d2") <= reach * reach) | F.lit(reach >= most)).select("terrain_id", "node", F.col("best.vz").alias("filled"))
        done = sure if done is None else done.unionByName(sure)
        if reach >= most:
            break
        todo, reach = todo.join(sure, ["terrain_id", "node"], "left_anti"), reach * 4
        if todo.isEmpty():
            break
    return cells.join(done, ["terrain_id", "node"], "left").select("terrain_id", "node", "i", "j", F.coalesce(height(), "filled").alias("z"), (~F.col("valid")).alias("was_void"))


def assert_plausible(cells: DataFrame, low: float, high: float) -> None:
    """Refuse a raster whose heights leave a range (RAS-14)."""
    lo, hi = cells.filter("valid").agg(F.min("z"), F.max("z")).first()
    if lo is not None and (lo < low or hi > high):
        raise ValueError(f"heights from {lo} to {hi} are not within {low} to {high}")


def map_cell(k: Column, cell_from: float, cell_to: float) -> Column:
    """A cell index at another resolution, by its centre (RAS-16)."""
    return F.floor((k + 0.5) * (cell_from / cell_to))


def pixel_to_world(row: Column, col: Column, origin_x: float, origin_y: float, pixel: float) -> tuple[Column, Column]:
    """World coordinates of a pixel; the northing falls with the row (SRC-18)."""
    return origin_x + col * pixel, origin_y - row * pixel


def choose_windows(windows: DataFrame, n: int, seed: int, most: int = 1_000_000) -> list[tuple[int, int, int]]:
    """n windows that do not overlap, in a seeded order (RAS-8). Corners only are gathered; more than `most` of them are refused: thin them by a stride."""
    rows = windows.select("row0", "col0", "size").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} windows to choose from")
    rows = sorted(tuple(r) for r in rows)
    chosen: list[tuple[int, int, int]] = []
    for k in np.random.default_rng(seed).permutation(len(rows)):
        r, c, size = rows[k]
        if all(abs(r - a) >= max(size, s) or abs(c - b) >= max(size, s) for a, b, s in chosen):
            chosen.append((r, c, size))
        if len(chosen) == n:
            break
    return chosen


def load_grid(cells: DataFrame, row0: int, col0: int, size: int, most_void_share: float = 0.05, low: float = -500.0, high: float = 9000.0) -> DataFrame:
    """A square of a raster as a grid without voids: crop, refuse too many voids, fill, check the heights (SRC-7, SRC-8)."""
    square = crop(cells, row0, col0, size, size)
    n, void = square.agg(F.count("*"), F.count_if(~F.col("valid"))).first()
    if n < size * size or void > most_void_share * n:
        raise ValueError(f"{size * size - n + void} of {size * size} cells are void")
    filled = fill_voids(square, size, size)
    out = filled.select("terrain_id", "node", "i", "j", "z", F.lit(True).alias("valid"), "was_void")
    assert_plausible(out, low, high)
    return out

"""Synthetic terrain: seeded gradient noise in two and three dimensions, and sums of octaves (SRC-9 to SRC-12).

The lattice of gradients is small and drawn on the driver; cells are a range, and each meets its corners by an equi-join.
"""

from __future__ import annotations

from itertools import product
from math import sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fade(t: Column) -> Column:
    return t * t * t * (t * (t * 6 - 15) + 10)


def lattice_2d(res: tuple[int, int], rng: np.random.RandomState, tileable: tuple[bool, bool] = (False, False)) -> np.ndarray:
    """Unit gradients at (res0 + 1) x (res1 + 1) corners."""
    angles = 2 * np.pi * rng.rand(res[0] + 1, res[1] + 1)
    g = np.dstack((np.cos(angles), np.sin(angles)))
    return _tiled(g, tileable)


def lattice_3d(res: tuple[int, int, int], rng: np.random.RandomState, tileable: tuple[bool, ...] = (False, False, False)) -> np.ndarray:
    theta, phi = 2 * np.pi * rng.rand(*(r + 1 for r in res)), 2 * np.pi * rng.rand(*(r + 1 for r in res))
    return _tiled(np.stack((np.sin(phi) * np.cos(theta), np.sin(phi) * np.sin(theta), np.cos(phi)), axis=3), tileable)


def _tiled(g: np.ndarray, tileable: tuple[bool, ...]) -> np.ndarray:
    for axis, wrap in enumerate(tileable):
        if wrap:
            last = [slice(None)] * g.ndim
            first = list(last)
            last[axis], first[axis] = -1, 0
            g[tuple(last)] = g[tuple(first)]
    return g


def noise(spark: SparkSession, shape: tuple[int, ...], lattice: np.ndarray) -> DataFrame:
    """(node, p0, p1, .., noise) on a raster whose sides are multiples of the lattice's."""
    dims, res = len(shape), tuple(n - 1 for n in lattice.shape[:-1])
    if any(s % r for s, r in zip(shape, res, strict=True)):
        raise ValueError("a raster's sides are multiples of the lattice's")
    node, at, cells = F.col("node"), [], spark.range(int(np.prod(shape))).withColumnRenamed("id", "node")
    for axis in range(dims):
        below = int(np.prod(shape[axis + 1 :]))
        at.append((F.floor(node / below) % shape[axis]).cast("int"))
    cells = cells.select("node", *[p.alias(f"p{k}") for k, p in enumerate(at)])
    step = [s // r for s, r in zip(shape, res, strict=True)]
    cells = cells.select("*", *[F.floor(F.col(f"p{k}") / d).cast("int").alias(f"c{k}") for k, d in enumerate(step)], *[((F.col(f"p{k}") % d) / d).alias(f"f{k}") for k, d in enumerate(step)])
    corners = [(*map(int, at), *map(float, lattice[at])) for at in np.ndindex(*lattice.shape[:-1])]
    names = [f"c{k}" for k in range(dims)]
    table = spark.createDataFrame(corners, ", ".join([f"{n} int" for n in names] + [f"g{k} double" for k in range(dims)]))
    for bits in product((0, 1), repeat=dims):
        tag = "".join(map(str, bits))
        moved = table.select(*[(F.col(n) - b).alias(n) for n, b in zip(names, bits, strict=True)], *[F.col(f"g{k}").alias(f"g{k}_{tag}") for k in range(dims)])
        cells = cells.join(moved, names)
    values = {bits: sum(F.col(f"g{k}_{''.join(map(str, bits))}") * (F.col(f"f{k}") - b) for k, b in enumerate(bits)) for bits in product((0, 1), repeat=dims)}
    for axis in range(dims):
        t = fade(F.col(f"f{axis}"))
        values = {rest: (1 - t) * values[(0, *rest)] + t * values[(1, *rest)] for rest in product((0, 1), repeat=dims - axis - 1)}
    scale = sqrt(2) if dims == 2 else 1.0
    return cells.select("node", *[f"p{k}" for k in range(dims)], (scale * values[()]).alias("noise"))


def fractal(spark: SparkSession, shape: tuple[int, ...], res: tuple[int, ...], octaves: int, persistence: float, lacunarity: int, seed: int) -> DataFrame:
    """Octaves of noise, each lacunarity times finer and persistence times weaker than the last (SRC-11, SRC-12)."""
    rng, out = np.random.RandomState(seed), None
    for k in range(octaves):
        fine = tuple(r * lacunarity**k for r in res)
        one = noise(spark, shape, lattice_2d(fine, rng) if len(shape) == 2 else lattice_3d(fine, rng)).withColumn("noise", F.col("noise") * persistence**k)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("node", *[f"p{k}" for k in range(len(shape))]).agg(F.sum("noise").alias("noise"))


def terrain(spark: SparkSession, terrain_id: str, n: int, period: int, low: float, high: float, seed: int) -> DataFrame:
    """A cell table of n x n seeded noise, scaled as noise * (high - low) + low: its range is [low - (high - low), high] (SRC-9)."""
    rows = noise(spark, (n, n), lattice_2d((period, period), np.random.RandomState(seed)))
    return rows.select(F.lit(terrain_id).alias("terrain_id"), "node", F.col("p0").alias("i"), F.col("p1").alias("j"), (F.col("noise") * (high - low) + low).alias("z"), F.lit(True).alias("valid"))

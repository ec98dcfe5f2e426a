"""Seeded origin-destination pairs with an account of every rejection (SA-1 to SA-6).

Draws come from numpy's generator in a fixed order, so a terrain's sample hangs on its seed alone; a terrain is one group.
"""

from __future__ import annotations

import contourflow
import numpy as np
import pandas as pd
from contourflow.kernels.labels import union
from contourflow.kernels.search import Graph, hops
from contourflow.operators.graph import offsets
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(contourflow)

MARGIN, LEAST_DIAGONAL, LEAST_HOPS, PAIRS, CANDIDATES = 5, 0.60, 3, 3, 10_000
# The protocol's criteria; each rejected candidate is charged to the first of these that it breaks.
CRITERIA = ("too_short", "same_height_area", "hops_below_min", "no_full_grid_path", "duplicate_start_area", "duplicate_target_area")


class TooFewPairs(ValueError):
    """A terrain whose candidates do not give the pairs asked for."""


def seed_for(terrain_seed: int) -> int:
    return 1000 + terrain_seed


def box(n_rows: int, n_cols: int, margin: int = MARGIN) -> tuple[int, int]:
    """Least coordinate of a candidate and the one after the largest: a square of the shorter side, for rows and columns alike."""
    if min(n_rows, n_cols) <= 2 * margin:
        raise TooFewPairs(f"{n_rows} x {n_cols} cells leave nothing inside a margin of {margin}")
    return margin, min(n_rows, n_cols) - margin


def draw(n_rows: int, n_cols: int, seed: int, n: int = CANDIDATES, margin: int = MARGIN) -> np.ndarray:
    """Candidates (i1, j1, i2, j2), drawn one coordinate after the other."""
    return np.random.default_rng(seed).integers(*box(n_rows, n_cols, margin), size=(n, 4))


def sample_pairs(cells: DataFrame, area_edges: DataFrame, n_rows: int, n_cols: int, seed: int, n_pairs: int = PAIRS, candidates: int = CANDIDATES, margin: int = MARGIN, diagonal: float = LEAST_DIAGONAL, least_hops: int = LEAST_HOPS, connectivity: int = 8, strict: bool = True) -> DataFrame:
    """Accepted pairs and, for each terrain, one row (od_id NULL) of the counts of candidates and rejections (SA-1, SA-3, SA-4).

    cells: labelled cells; area_edges: a, b. A candidate must be far enough apart, in two areas, with enough areas between, joined by a way over valid
    cells, and its start and target areas must not be those of a pair before it. A void cell has no area, so no number of hops. Fewer pairs
    than asked for are an error, unless `strict` is off.
    """
    counts = [f"rejected_{c}" for c in CRITERIA]
    schema = "terrain_id string, od_id long, start long, target long, distance_cells double, area_start long, area_target long, hops long, drawn long, " + ", ".join(f"{c} long" for c in counts)

    def run(key: tuple, cell: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        area, place = np.full((n_rows, n_cols), -1, dtype=np.int64), np.full((n_rows + 2, n_cols + 2), -1, dtype=np.int64)
        i, j = cell["i"].to_numpy(), cell["j"].to_numpy()
        area[i, j] = cell["area_id"].to_numpy()
        place[i + 1, j + 1] = np.arange(len(cell))
        ways = [(place[i + 1, j + 1], place[i + 1 + a, j + 1 + b]) for a, b in offsets(connectivity, forward=True)]
        u, v = (np.concatenate([w[k] for w in ways]) for k in (0, 1))
        island = union(len(cell), u[v >= 0], v[v >= 0])
        both = np.concatenate([edge[["a", "b"]].to_numpy(), edge[["b", "a"]].to_numpy()]) if len(edge) else np.zeros((0, 2), dtype=np.int64)
        graph = Graph.of(both[:, 0], both[:, 1], np.ones(len(both)), np.unique(cell["area_id"].to_numpy()))
        known: dict[int, np.ndarray] = {}

        def hops_between(a: int, b: int) -> int:
            if min(a, b) < 0:
                return -1
            if a not in known:
                known[a] = hops(graph, graph.at(a))
            return int(known[a][graph.at(b)])

        rows, rejected, drawn = [], dict.fromkeys(CRITERIA, 0), 0
        for i1, j1, i2, j2 in draw(n_rows, n_cols, seed, candidates, margin).tolist():
            if len(rows) == n_pairs:
                break
            drawn += 1
            a, b, far = int(area[i1, j1]), int(area[i2, j2]), float(np.hypot(i1 - i2, j1 - j2))
            tests = (
                lambda: far < diagonal * np.hypot(n_rows, n_cols),
                lambda: a == b,
                lambda: hops_between(a, b) < least_hops,
                lambda: island[place[i1 + 1, j1 + 1]] != island[place[i2 + 1, j2 + 1]],
                lambda: a in {r[5] for r in rows},
                lambda: b in {r[6] for r in rows},
            )
            why = next((name for name, broken in zip(CRITERIA, tests, strict=True) if broken()), None)
            if why:
                rejected[why] += 1
            else:
                rows.append((key[0], len(rows) + 1, i1 * n_cols + j1, i2 * n_cols + j2, far, a, b, hops_between(a, b), drawn, *[None] * len(CRITERIA)))
        if strict and len(rows) < n_pairs:
            raise TooFewPairs(f"{key[0]}: {len(rows)} of {n_pairs} pairs after {drawn} candidates; {rejected}")
        rows.append((key[0], None, None, None, None, None, None, None, drawn, *[rejected[c] for c in CRITERIA]))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
        return out.astype(dict.fromkeys(["od_id", "start", "target", "area_start", "area_target", "hops", "drawn", *counts], "Int64"))

    edges = area_edges.select(*[F.col(c).alias(c) for c in ("terrain_id", "a", "b")])  # both tables may come of one
    return cells.groupBy("terrain_id").cogroup(edges.groupBy("terrain_id")).applyInPandas(run, schema)


def reference_pair(cells: DataFrame, n_rows: int, n_cols: int, margin: int = MARGIN) -> DataFrame:
    """The fixed pair of each terrain, `margin` cells inside two opposite corners, flagged as outside the protocol (SA-2); 100 x 100 cells give (5, 5) and (94, 94)."""
    ends = ((margin, margin), (n_rows - 1 - margin, n_cols - 1 - margin))
    at = [F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("node"))) for i, j in ends]
    return cells.groupBy("terrain_id").agg(at[0].alias("start"), at[1].alias("target")).withColumn("od_protocol", F.lit(False))


def query_pairs(n: int, n_rows: int, n_cols: int, seed: int) -> np.ndarray:
    """n seeded pairs of cells (i1, j1, i2, j2) at least half a side apart (SA-8); drawn in blocks until there are enough."""
    if n and np.hypot(n_rows - 1, n_cols - 1) < min(n_rows, n_cols) / 2:
        raise TooFewPairs(f"{n_rows} x {n_cols} cells have no two half a side apart")
    rng, found, half = np.random.default_rng(seed), np.zeros((0, 4), dtype=np.int64), min(n_rows, n_cols) / 2
    while len(found) < n:
        four = rng.integers(0, (n_rows, n_cols, n_rows, n_cols), size=(4 * n + 16, 4))
        found = np.concatenate([found, four[np.hypot(four[:, 0] - four[:, 2], four[:, 1] - four[:, 3]) >= half]])
    return found[:n]


def acceptance(sampled: DataFrame) -> DataFrame:
    """Accepted, rejected and drawn candidates by terrain; the first two make the third (SA-3)."""
    counts = [F.coalesce(F.sum(c), F.lit(0)) for c in sampled.columns if c.startswith("rejected_")]
    return sampled.groupBy("terrain_id").agg(F.count("od_id").alias("accepted"), sum(counts[1:], counts[0]).alias("rejected"), F.sum(F.when(F.col("od_id").isNull(), F.col("drawn"))).alias("drawn"))

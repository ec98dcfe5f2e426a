"""Grid graphs, areas of equal height, their borders and prices, and components (GR-*, PRJ-*, FLT-1 to FLT-4)."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from math import pi

import contourflow
import numpy as np
import pandas as pd
from contourflow.functions.costs import CostModel, resolve
from contourflow.kernels.labels import inscribed, union
from contourflow.kernels.search import Graph, hop_diameter
from contourflow.operators import raster
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(contourflow)

#: Fixed order of neighbours: N, W, E, S, NW, NE, SW, SE.
OFFSETS = ((-1, 0), (0, -1), (0, 1), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1))
LEAST_AREA_WEIGHT = 1e-12
#: Edges of a terrain that one task labels; larger terrains are labelled by joins.
KERNEL_EDGES = 8_000_000

_fallback: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir (or setCheckpointDir) names, deleted when the driver ends. A temporary folder only where neither is set and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        if not _fallback:
            _fallback.append(tempfile.mkdtemp(prefix="contourflow-"))
        root = _fallback[0]
    path = f"{root.rstrip('/')}/contourflow-graph-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone already; the folder is temporary either way
            return


def cut_lineage(df: DataFrame) -> DataFrame:
    """A table of df in the shared folder, read again."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def offsets(connectivity: int, forward: bool = False) -> list[tuple[int, int]]:
    """Neighbour offsets of 4 or 8; forward: the half that meets each pair once."""
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    return [o for o in OFFSETS[:connectivity] if not forward or o > (0, 0)]


def _neighbours(cells: DataFrame, connectivity: int, forward: bool, extra: list[str]) -> DataFrame:
    """Pairs of touching cells: u, v and both sides' columns (suffix _u, _v), by one equi-join on computed coordinates.

    The join is a merge by request: cells that compress to a few megabytes would else be broadcast, a multiple of that in the driver.
    """
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("di"), F.lit(b).alias("dj")) for k, (a, b) in enumerate(offsets(connectivity, forward))])).alias("o")
    left = cells.select("terrain_id", F.col("node").alias("u"), "i", "j", *[F.col(c).alias(f"{c}_u") for c in extra], steps)
    left = left.select("*", F.col("o.k").alias("k"), F.hypot(F.col("o.di").cast("double"), F.col("o.dj").cast("double")).alias("step"), (F.col("i") + F.col("o.di")).alias("i2"), (F.col("j") + F.col("o.dj")).alias("j2")).drop("i", "j", "o")
    right = cells.select("terrain_id", F.col("node").alias("v"), F.col("i").alias("i2"), F.col("j").alias("j2"), *[F.col(c).alias(f"{c}_v") for c in extra])
    return left.join(right.hint("merge"), ["terrain_id", "i2", "j2"]).drop("i2", "j2")


def grid_edges(cells: DataFrame, cell_m: float = 1.0, connectivity: int = 8) -> DataFrame:
    """Every directed edge between valid neighbours: u, v, k (the offset), length_m, dh (GR-1)."""
    pairs = _neighbours(cells.filter("valid"), connectivity, False, ["z"])
    return pairs.select("terrain_id", "u", "v", "k", (F.col("step") * cell_m).alias("length_m"), (F.col("z_v") - F.col("z_u")).alias("dh"))


def with_cost(edges: DataFrame, cost: str | CostModel) -> DataFrame:
    """The same graph at another price (FLT-4)."""
    return edges.withColumn("weight", resolve(cost)(F.col("dh"), F.col("length_m")))


def cut_gradient(edges: DataFrame, cap_percent: float) -> DataFrame:
    """Edges no steeper than the cap (FLT-2)."""
    if cap_percent <= 0:
        raise ValueError("a gradient cap is positive")
    return edges.filter(F.abs("dh") <= cap_percent / 100 * F.col("length_m"))


def masked(edges: DataFrame, mask: DataFrame) -> DataFrame:
    """Edges with both ends in mask(terrain_id, node) (FLT-1, FLT-3)."""
    out = edges
    for end in ("u", "v"):
        out = out.join(mask.select("terrain_id", F.col("node").alias(end)).hint("merge"), ["terrain_id", end], "left_semi")
    return out.select(edges.columns)


def buckets(cells: DataFrame, height_delta: float) -> DataFrame:
    """cells with bucket: the lower height of the band, counted from the terrain's minimum (GR-4). The delta is cut to a whole number."""
    delta = int(height_delta)
    if delta <= 0:
        raise ValueError("a height band is positive")
    low = cells.filter("valid").groupBy("terrain_id").agg(F.min("z").alias("_low"))
    return cells.filter("valid").join(low, "terrain_id").withColumn("bucket", F.col("_low") + delta * F.floor((F.col("z") - F.col("_low")) / delta)).drop("_low")


def components(nodes: DataFrame, edges: DataFrame, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """(terrain_id, node, root): the smallest node reachable.

    Terrains are independent. Where none has more than kernel_edges edges, each is one group of a union-find; else rounds of joins label them.
    """
    edges = cut_lineage(edges.select("terrain_id", "u", "v"))
    largest = edges.groupBy("terrain_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > kernel_edges:
        return spread_components(nodes, edges)

    def run(key: tuple, own: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(own["node"].to_numpy())
        return pd.DataFrame({"terrain_id": key[0], "node": names, "root": names[union(len(names), np.searchsorted(names, edge["u"]), np.searchsorted(names, edge["v"]))]})

    return nodes.select("terrain_id", "node").groupBy("terrain_id").cogroup(edges.groupBy("terrain_id")).applyInPandas(run, "terrain_id string, node long, root long")


def spread_components(nodes: DataFrame, edges: DataFrame, rounds: int = 200) -> DataFrame:
    """components() by hooking to smaller neighbours and jumping to the label's own label; tables and labels stay distributed."""
    both = cut_lineage(edges.select("terrain_id", "u", "v").union(edges.select("terrain_id", "v", "u")).distinct())
    labels = cut_lineage(nodes.select("terrain_id", "node", F.col("node").alias("root")))
    for _ in range(rounds):
        seen = both.join(labels.select("terrain_id", F.col("node").alias("v"), F.col("root").alias("other")), ["terrain_id", "v"]).groupBy("terrain_id", F.col("u").alias("node")).agg(F.min("other").alias("least"))
        hooked = labels.join(seen, ["terrain_id", "node"], "left").select("terrain_id", "node", "root", F.least("root", F.coalesce("least", "root")).alias("new"))
        # A root takes the smallest of what its members have found.
        best = hooked.groupBy("terrain_id", F.col("root").alias("at")).agg(F.min("new").alias("best"))
        best = best.select("terrain_id", F.col("at").alias("new"), "best")
        jumped = hooked.join(best, ["terrain_id", "new"], "left").select("terrain_id", "node", "root", F.least("new", F.coalesce("best", "new")).alias("new"))
        now = cut_lineage(jumped)
        if now.filter("new < root").isEmpty():
            return now.select("terrain_id", "node", "root")
        labels = now.select("terrain_id", "node", F.col("new").alias("root"))
    raise RuntimeError("components did not settle")


def height_areas(cells: DataFrame, height_delta: float, connectivity: int = 8) -> DataFrame:
    """Cells with their bucket and area: connected cells of one bucket, numbered by bucket and then by first cell from 0 (GR-5, GR-6)."""
    banded = cut_lineage(buckets(cells, height_delta))
    same = _neighbours(banded, connectivity, True, ["bucket"]).filter("bucket_u = bucket_v")
    roots = components(banded, same)
    labelled = banded.join(roots, ["terrain_id", "node"])
    order = F.row_number().over(W.partitionBy("terrain_id").orderBy("bucket", "root"))
    names = labelled.select("terrain_id", "bucket", "root").distinct().withColumn("area_id", (order - 1).cast("long"))
    return labelled.join(names, ["terrain_id", "bucket", "root"]).select("terrain_id", "node", "i", "j", "z", "valid", "bucket", "area_id")


def area_table(labelled: DataFrame) -> DataFrame:
    """areas(area_id, area_height, area_size, cent_i, cent_j, mean_z) (GR-7, GR-14)."""
    return labelled.groupBy("terrain_id", "area_id").agg(F.min("bucket").alias("area_height"), F.count("*").alias("area_size"), F.avg("i").alias("cent_i"), F.avg("j").alias("cent_j"), F.avg("z").alias("mean_z"))


def crossings(labelled: DataFrame, connectivity: int = 8) -> DataFrame:
    """Undirected touching cells of two areas, the lower area's first (GR-9)."""
    pairs = _neighbours(labelled, connectivity, True, ["area_id", "i", "j", "z"]).filter("area_id_u <> area_id_v")
    up = F.col("area_id_u") < F.col("area_id_v")
    pick = lambda c, first: F.when(up if first else ~up, F.col(f"{c}_u")).otherwise(F.col(f"{c}_v"))
    sides = [(pick(c, first), f"{name}_{side}") for side, first in (("low", True), ("high", False)) for c, name in (("area_id", "area"), ("i", "i"), ("j", "j"), ("z", "z"))]
    nodes = [F.when(up, F.col("u")).otherwise(F.col("v")).alias("node_low"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("node_high")]
    return pairs.select("terrain_id", *[c.alias(n) for c, n in sides], *nodes)


def area_edges(labelled: DataFrame, connectivity: int = 8) -> DataFrame:
    """Undirected pairs of touching areas with the number of crossings (GR-8)."""
    return crossings(labelled, connectivity).groupBy("terrain_id", F.col("area_low").alias("a"), F.col("area_high").alias("b")).agg(F.count("*").alias("n_crossings"))


def shared_boundaries(labelled: DataFrame, connectivity: int = 8) -> DataFrame:
    """Each pair's crossings in order of their nodes (GR-10)."""
    pair = F.struct("node_low", "node_high")
    return crossings(labelled, connectivity).groupBy("terrain_id", F.col("area_low").alias("a"), F.col("area_high").alias("b")).agg(F.sort_array(F.collect_list(pair)).alias("border"))


def border_prices(labelled: DataFrame, cost: str | CostModel, cell_m: float = 1.0, connectivity: int = 8) -> DataFrame:
    """Area edges priced by their shared border: mean height step over the crossings, way from centre to centre over the border's middle (GR-15)."""
    areas = area_table(labelled).select("terrain_id", "area_id", "cent_i", "cent_j")
    border = crossings(labelled, connectivity).groupBy("terrain_id", F.col("area_low").alias("a"), F.col("area_high").alias("b"))
    border = border.agg(F.avg(F.abs(F.col("z_high") - F.col("z_low"))).alias("dh"), F.avg((F.col("i_low") + F.col("i_high")) / 2).alias("mid_i"), F.avg((F.col("j_low") + F.col("j_high")) / 2).alias("mid_j"))
    both = border
    for end in ("a", "b"):
        both = both.join(areas.select("terrain_id", F.col("area_id").alias(end), F.col("cent_i").alias(f"i_{end}"), F.col("cent_j").alias(f"j_{end}")), ["terrain_id", end])
    way = sum(F.hypot(F.col(f"i_{e}") - F.col("mid_i"), F.col(f"j_{e}") - F.col("mid_j")) for e in ("a", "b")) * cell_m
    priced = both.withColumn("length_m", F.greatest(way, F.lit(float(cell_m))))
    return priced.select("terrain_id", "a", "b", "dh", "length_m", F.greatest(resolve(cost)(F.col("dh"), F.col("length_m")), F.lit(LEAST_AREA_WEIGHT)).alias("weight"))


def mean_prices(labelled: DataFrame, cost: str | CostModel, cell_m: float = 1.0, connectivity: int = 8) -> DataFrame:
    """Area edges priced by the areas' mean heights and the distance of their centres (GR-16)."""
    areas, both = area_table(labelled), area_edges(labelled, connectivity)
    for end in ("a", "b"):
        both = both.join(areas.select("terrain_id", F.col("area_id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("cent_i", "cent_j", "mean_z")]), ["terrain_id", end])
    way = F.hypot(F.col("cent_i_a") - F.col("cent_i_b"), F.col("cent_j_a") - F.col("cent_j_b")) * cell_m
    priced = both.withColumns({"dh": F.col("mean_z_b") - F.col("mean_z_a"), "length_m": F.greatest(way, F.lit(float(cell_m)))})
    return priced.select("terrain_id", "a", "b", "dh", "length_m", F.greatest(resolve(cost)(F.col("dh"), F.col("length_m")), F.lit(LEAST_AREA_WEIGHT)).alias("weight"))


def both_ways(priced: DataFrame) -> DataFrame:
    """The symmetric area graph (GR-17)."""
    return priced.unionByName(priced.withColumns({"a": F.col("b"), "b": F.col("a"), "dh": -F.col("dh")}))


def dilate(areas: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """areas(terrain_id, area_id) and all within k steps over edges(a, b) (GR-20)."""
    both = edges.select("terrain_id", "a", "b").union(edges.select("terrain_id", "b", "a"))
    out = areas.select("terrain_id", "area_id").distinct()
    for _ in range(k):
        out = out.unionByName(both.join(out.withColumnRenamed("area_id", "a"), ["terrain_id", "a"]).select("terrain_id", F.col("b").alias("area_id"))).distinct()
    return out


def perimeters(labelled: DataFrame, connectivity: int = 8) -> DataFrame:
    """Cells of each area with fewer than `connectivity` neighbours in it (GR-12, GR-32)."""
    same = _neighbours(labelled, connectivity, False, ["area_id"]).filter("area_id_u = area_id_v").groupBy("terrain_id", F.col("u").alias("node")).agg(F.count("*").alias("n"))
    edge = labelled.join(same, ["terrain_id", "node"], "left").filter(F.coalesce("n", F.lit(0)) < connectivity)
    return edge.groupBy("terrain_id", "area_id").agg(F.count("*").alias("perimeter_cells"))


def blocks(cells: DataFrame, side: int) -> DataFrame:
    """Square blocks in the place of areas, with the same columns (GR-35)."""
    valid = cells.filter("valid")
    a, b = F.floor(F.col("i") / side), F.floor(F.col("j") / side)
    order = F.dense_rank().over(W.partitionBy("terrain_id").orderBy("_a", "_b")) - 1
    return valid.withColumns({"_a": a, "_b": b}).withColumn("area_id", order.cast("long")).withColumn("bucket", F.avg("z").over(W.partitionBy("terrain_id", "area_id"))).drop("_a", "_b")


def descriptors(labelled: DataFrame, connectivity: int = 8) -> DataFrame:
    """A row a terrain: areas, pairs, bands, degrees, cycles and sizes of its area graph (GR-30)."""
    areas, edges = cut_lineage(area_table(labelled)), cut_lineage(area_edges(labelled, connectivity))
    ends = edges.select("terrain_id", F.col("a").alias("area_id")).union(edges.select("terrain_id", F.col("b").alias("area_id")))
    degree = areas.join(ends.groupBy("terrain_id", "area_id").agg(F.count("*").alias("d")), ["terrain_id", "area_id"], "left").withColumn("degree", F.coalesce("d", F.lit(0)))
    rank = F.row_number().over(W.partitionBy("terrain_id").orderBy("area_size", "area_id"))
    ranked = degree.withColumn("rank", rank)
    parts = components(areas.select("terrain_id", F.col("area_id").alias("node")), edges.select("terrain_id", F.col("a").alias("u"), F.col("b").alias("v"))).groupBy("terrain_id").agg(F.count_distinct("root").alias("n_components"))
    n, total = F.count("*"), F.sum("area_size")
    out = ranked.groupBy("terrain_id").agg(
        n.alias("n_areas"), F.count_distinct("area_height").alias("n_bands"), F.median("degree").alias("degree_median"), F.percentile("degree", F.lit(0.9)).alias("degree_p90"), F.max("degree").alias("degree_max"),
        (F.count_if(F.col("degree") == 1) / n).alias("share_degree_1"), F.median("area_size").alias("size_median"), (F.max("area_size") / total).alias("largest_share"), (F.count_if(F.col("area_size") == 1) / n).alias("single_cell_share"),
        (2 * F.sum(F.col("rank") * F.col("area_size")) / (n * total) - (n + 1) / n).alias("gini"), (F.sum("degree") / 2).cast("long").alias("n_edges"),
    )
    out = out.join(parts, "terrain_id")
    return out.withColumns({"cyclomatic": F.col("n_edges") - F.col("n_areas") + F.col("n_components"), "planarity": F.when(F.col("n_areas") >= 3, F.col("n_edges") / (3 * F.col("n_areas") - 6))})


def describe(cells: DataFrame, labelled: DataFrame, n_rows: int, n_cols: int, cell_m: float, connectivity: int = 8, diameter: bool = True) -> DataFrame:
    """A row a terrain with all descriptors of its area graph and of its ground (GR-30): descriptors() beside what follows from areas, perimeters, heights and slopes."""
    top = descriptors(labelled, connectivity)
    areas = area_table(labelled).select("terrain_id", "area_id", "area_size")
    compact = F.col("area_size") * (4 * pi) / F.pow(F.greatest(F.coalesce("perimeter_cells", F.lit(0)), F.lit(1)).cast("double"), F.lit(2.0))
    shapes = areas.join(perimeters(labelled, connectivity), ["terrain_id", "area_id"], "left").groupBy("terrain_id").agg(
        F.median(compact).alias("compactness_median"), (F.median("area_size") * cell_m**2).alias("area_m2_median"), (F.avg("area_size") * cell_m**2).alias("area_m2_mean"),
    )
    ground = labelled.groupBy("terrain_id").agg(F.count("*").alias("n_valid_cells"), (F.max("z") - F.min("z")).alias("relief_m"))
    slope = F.col("slope_percent")
    gon = raster.gon_from_percent(slope)
    slopes = raster.slope_percent(cells, n_rows, n_cols, cell_m).groupBy("terrain_id").agg(
        F.avg(slope).alias("slope_mean"), F.max(slope).alias("slope_max"), F.percentile(slope, F.lit(0.5)).alias("slope_p50"), F.percentile(slope, F.lit(0.9)).alias("slope_p90"),
        F.percentile(gon, F.lit(0.5)).alias("slope_gon_p50"), (F.count_if((gon >= 20) & (gon <= 25)) / F.count("*")).alias("share_slope_20_25_gon"),
    )
    out = top.join(shapes, "terrain_id").join(ground, "terrain_id").join(slopes, "terrain_id", "left")
    out = out.withColumns({
        "areas_per_band_mean": F.col("n_areas") / F.col("n_bands"), "edges_per_area_mean": 2.0 * F.col("n_edges") / F.col("n_areas"),
        "n_cells_total": F.lit(n_rows * n_cols).cast("long"), "valid_share": F.col("n_valid_cells") / float(n_rows * n_cols),
    })
    return out.join(hop_diameters(area_edges(labelled, connectivity)), "terrain_id", "left") if diameter else out


def void_audit(cells: DataFrame) -> DataFrame:
    """(terrain_id, n_void, void_share, largest_void_cells): the voids of each terrain and the largest piece of them, joined by sides (RAS-1)."""
    voids = cut_lineage(cells.filter(~F.col("valid")).select("terrain_id", "node", "i", "j"))
    pieces = components(voids.select("terrain_id", "node"), _neighbours(voids, 4, True, []).select("terrain_id", "u", "v"))
    largest = pieces.groupBy("terrain_id", "root").agg(F.count("*").alias("n")).groupBy("terrain_id").agg(F.max("n").alias("largest"))
    counts = cells.groupBy("terrain_id").agg(F.count_if(~F.col("valid")).alias("n_void"), F.count("*").alias("n"))
    return counts.join(largest, "terrain_id", "left").select("terrain_id", "n_void", (F.col("n_void") / F.col("n")).alias("void_share"), F.coalesce("largest", F.lit(0)).cast("long").alias("largest_void_cells"))


def describe_selection(chain: DataFrame, selected: DataFrame, labelled: DataFrame, cell_m: float = 1.0) -> DataFrame:
    """(terrain_id, od_id, hops, n_areas, n_cells, narrowest_m) of a chain (terrain_id, od_id, seq, area_id) and the areas selected around it (terrain_id, od_id, area_id) (GR-34)."""
    sizes = area_table(labelled).select("terrain_id", "area_id", "area_size")
    hops = chain.groupBy("terrain_id", "od_id").agg((F.count("*") - 1).alias("hops"))
    own = selected.join(sizes, ["terrain_id", "area_id"]).groupBy("terrain_id", "od_id").agg(F.count("*").alias("n_areas"), F.sum("area_size").alias("n_cells"))
    asked = labelled.join(selected.select("terrain_id", "area_id").distinct(), ["terrain_id", "area_id"], "left_semi")
    narrow = selected.join(widths(asked, cell_m), ["terrain_id", "area_id"]).groupBy("terrain_id", "od_id").agg(F.min("width_m").alias("narrowest_m"))
    return hops.join(own, ["terrain_id", "od_id"]).join(narrow, ["terrain_id", "od_id"], "left")


def boundary_components(labelled: DataFrame, connectivity: int = 8) -> DataFrame:
    """(terrain_id, a, b, node, arc): the cells on either side of each pair's border, by connected stretch; an arc is named by its smallest cell (GR-11)."""
    pairs = crossings(labelled, connectivity).select("terrain_id", F.col("area_low").alias("a"), F.col("area_high").alias("b"), F.explode(F.array("node_low", "node_high")).alias("node")).distinct()
    zones = cut_lineage(pairs.join(labelled.select("terrain_id", "node", "i", "j", "valid"), ["terrain_id", "node"]).withColumn("terrain_id", F.concat_ws("#", "terrain_id", "a", "b")))
    arcs = components(zones, _neighbours(zones, connectivity, True, []))
    named = arcs.withColumn("parts", F.split("terrain_id", "#"))
    at = lambda k: F.element_at("parts", k)
    return named.select(F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 2), "#").alias("terrain_id"), at(-2).cast("long").alias("a"), at(-1).cast("long").alias("b"), "node", F.col("root").alias("arc"))


def areas_without_equal_neighbours(labelled: DataFrame, connectivity: int = 8) -> DataFrame:
    """Pairs of touching areas of one height; there are none (GR-13)."""
    areas = area_table(labelled).select("terrain_id", "area_id", "area_height")
    pairs = area_edges(labelled, connectivity)
    for end in ("a", "b"):
        pairs = pairs.join(areas.select("terrain_id", F.col("area_id").alias(end), F.col("area_height").alias(f"h_{end}")), ["terrain_id", end])
    return pairs.filter("h_a = h_b")


def contour(labelled: DataFrame, connectivity: int = 4) -> DataFrame:
    """Cells of each area with a neighbour that is not of it, or none (GR-12)."""
    same = _neighbours(labelled, connectivity, False, ["area_id"]).filter("area_id_u = area_id_v").groupBy("terrain_id", F.col("u").alias("node")).agg(F.count("*").alias("n"))
    inner = same.filter(F.col("n") == connectivity).select("terrain_id", "node")
    return labelled.join(inner, ["terrain_id", "node"], "left_anti")


def selection(chain: DataFrame, labelled: DataFrame, edges: DataFrame, rings: int | None) -> DataFrame:
    """Areas of a chain with k rings around; None: all areas (GR-21)."""
    if rings is None:
        return labelled.select("terrain_id", "area_id").distinct()
    return dilate(chain, edges, rings)


def space_share(labelled: DataFrame, chosen: DataFrame) -> DataFrame:
    """Share of the valid cells that lie in the chosen areas (GR-22)."""
    marked = labelled.join(chosen.select("terrain_id", "area_id").distinct().withColumn("_in", F.lit(1)), ["terrain_id", "area_id"], "left")
    return marked.groupBy("terrain_id").agg((F.count("_in") / F.count("*")).alias("share"), F.count("_in").alias("n_cells"), F.count_distinct(F.when(F.col("_in") == 1, F.col("area_id"))).alias("n_areas"))


def hop_diameters(edges: DataFrame, sweeps: int = 4) -> DataFrame:
    """A lower bound of each terrain's hop diameter on its largest component (GR-33). edges: a, b."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = np.concatenate([pdf["a"], pdf["b"]]), np.concatenate([pdf["b"], pdf["a"]])
        return pd.DataFrame({"terrain_id": [key[0]], "hop_diameter": [hop_diameter(Graph.of(u, v, np.ones(len(u))), sweeps)]})

    return edges.groupBy("terrain_id").applyInPandas(run, "terrain_id string, hop_diameter long")


def widths(labelled: DataFrame, cell_m: float = 1.0) -> DataFrame:
    """(terrain_id, area_id, width_m): twice the largest distance of a cell to the nearest cell outside its area, of each area (GR-34).

    Distances are found by erosion in rings: a group is one area's cells, whose number of rings is its width.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        inside = np.zeros((i.max() - i.min() + 3, j.max() - j.min() + 3), dtype=bool)
        inside[i - i.min() + 1, j - j.min() + 1] = True
        return pd.DataFrame({"terrain_id": [key[0]], "area_id": [key[1]], "width_m": [2 * inscribed(inside) * cell_m]})

    return labelled.select("terrain_id", "area_id", "i", "j").groupBy("terrain_id", "area_id").applyInPandas(run, "terrain_id string, area_id long, width_m double")

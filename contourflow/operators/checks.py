"""Compliance of paths and stations with a table of road classes (CK-*)."""

from __future__ import annotations

from contourflow.functions.values import at_least, at_most, finite
from contourflow.operators.polyline import PATH, along, whole
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The road classes. name, design speed km/h, i_max %, r_min m, r_min in serpentines m, shortest tangent m, shortest design step m,
# smallest concave and convex vertical radius m, official, confirmed, synthetic.
ROAD_CLASSES = (
    ("RO_CLASS_II_DEAL", 100, 5.0, 450.0, None, None, None, None, None, False, False, False),
    ("RO_CLASS_III_DEAL", 80, 6.0, 240.0, None, None, None, None, None, False, False, False),
    ("RO_CLASS_IV_DEAL", 60, 6.5, 125.0, 30.0, None, None, None, None, False, False, False),
    ("RO_CLASS_V_DEAL", 50, 7.0, 95.0, 25.0, None, None, None, None, False, False, False),
    ("RO_CLASS_V_DEAL_REDUS", 40, 7.0, 60.0, 20.0, None, None, None, None, False, False, False),
    ("RO_CLASS_I_DEAL_AUTOSTRADA", 120, 4.0, 650.0, None, None, None, None, None, False, False, False),
    ("RO_CLASS_III_SES", 100, 5.0, 450.0, None, None, None, None, None, False, False, False),
    ("RO_CLASS_V_MUNTE", 40, 7.0, 60.0, 20.0, None, None, None, None, False, False, False),
    ("STAS863_V40", 40, 7.0, 60.0, None, 56.0, 50.0, 1000.0, 1000.0, True, True, False),
    ("STAS863_V25", 25, 8.0, 25.0, None, 35.0, 50.0, 300.0, 500.0, True, True, False),
    ("SYNTHETIC_STRICT", 90, 3.0, 300.0, None, None, None, None, None, False, False, True),
    ("SYNTHETIC_LOOSE", 25, 10.0, 25.0, None, None, None, None, None, False, False, True),
)
CLASS_SCHEMA = "name string, design_speed_kmh int, i_max_percent double, r_min_m double, r_min_serpentine_m double, l_alignment_min_m double, l_design_step_min_m double, r_vert_concave_min_m double, r_vert_convex_min_m double, official boolean, confirmed boolean, synthetic boolean"
#: check -> (series of the stations, limit of the class, whether the limit is the least or the most)
STATION_CHECKS = (
    ("R_H", "r_h_series", "r_min_m", "least"),
    ("i", "i_series", "i_max_percent", "most"),
    ("L_alignment", "l_series", "l_alignment_min_m", "least"),
    ("R_V_concave", "concave_series", "r_vert_concave_min_m", "least"),
    ("R_V_convex", "convex_series", "r_vert_convex_min_m", "least"),
)


def road_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROAD_CLASSES, CLASS_SCHEMA)


def road_class(spark: SparkSession, name: str) -> dict:
    for row in ROAD_CLASSES:
        if row[0] == name:
            return dict(zip(spark.createDataFrame([], CLASS_SCHEMA).columns, row, strict=True))
    raise KeyError(name)


def unconfirmed(classes: DataFrame) -> DataFrame:
    return classes.filter("NOT confirmed").select("name")


def unofficial(classes: DataFrame) -> DataFrame:
    return classes.filter("NOT official").select("name")


def check_paths(measured: DataFrame, classes: DataFrame) -> DataFrame:
    """Each path against each class: smallest radius and steepest gradient, whether the radius would do in a serpentine, verdict (CK-2, CK-3).

    measured: (path_id, r_min_m, i_max_percent). The dozen classes are a fixed table, so they are broadcast.
    """
    limits = F.broadcast(classes.select(F.col("name").alias("road_class"), F.col("r_min_m").alias("r_limit"), F.col("i_max_percent").alias("i_limit"), "r_min_serpentine_m"))
    both = measured.join(limits, F.lit(True))
    r_ok, i_ok = at_least(F.col("r_min_m"), F.col("r_limit")), at_most(F.col("i_max_percent"), F.col("i_limit"))
    serpentine = ~r_ok & F.coalesce(at_least(F.col("r_min_m"), F.col("r_min_serpentine_m")), F.lit(False))
    return both.select(PATH, "road_class", r_ok.alias("r_ok"), i_ok.alias("i_ok"), serpentine.alias("serpentine_only"), F.when(r_ok & i_ok, "feasible").otherwise("infeasible").alias("verdict"))


def feasible_classes(reports: DataFrame, verdict: str = "feasible") -> DataFrame:
    """Each path's classes of a verdict, sorted; paths without one have an empty list."""
    return reports.groupBy(PATH).agg(F.sort_array(F.collect_list(F.when(F.col("verdict") == verdict, F.col("road_class")))).alias("classes"))


def flags(reports: DataFrame, names: list[str]) -> DataFrame:
    """A row a path, a column a class (CK-4)."""
    return reports.groupBy(PATH).pivot("road_class", names).agg(F.first("verdict"))


def station_weights(stations: DataFrame) -> DataFrame:
    """stations with weight_m: half the way to either neighbour (CK-5)."""
    s = F.col("s")
    half = (F.coalesce(F.lead("s").over(along("k")), s) - F.coalesce(F.lag("s").over(along("k")), s)) / 2
    return stations.withColumn("weight_m", half)


def series(stations: DataFrame) -> DataFrame:
    """The five judged series of stations (r_h, is_curve, tangent_len, interior, gradient, r_v, v_kind); NULL where one does not apply."""
    vertical = lambda kind: F.when(F.col("v_kind") == kind, F.col("r_v"))
    return stations.withColumns({
        "r_h_series": F.when(F.col("is_curve"), F.col("r_h")), "i_series": F.abs(100 * F.col("gradient")), "l_series": F.when(F.col("interior"), F.col("tangent_len")),
        "concave_series": vertical("concave"), "convex_series": vertical("convex"),
    })


def check_stations(stations: DataFrame, classes: DataFrame) -> DataFrame:
    """Every check of every path and class: how many stations it applies to, violations and their length, worst value and where (CK-6, CK-8).

    stations: the columns of series(), s, k and weight_m. Values that are not finite are never judged; a class without a limit has no
    applicable station. The first of equally bad stations is the worst.
    """
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for n, c, _, _ in STATION_CHECKS])).alias("c")
    long = stations.select(PATH, "k", "s", "weight_m", stacked).select(PATH, "k", "s", "weight_m", "c.name", finite(F.col("c.value")).alias("value"))
    limit = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(x).alias("limit"), F.lit(way).alias("way")) for n, _, x, way in STATION_CHECKS])).alias("l")
    limits = classes.select(F.col("name").alias("road_class"), limit).select("road_class", "l.*")
    both = long.join(F.broadcast(limits), "name")
    least = F.col("way") == "least"
    ok = F.when(least, at_least(F.col("value"), F.col("limit"))).otherwise(at_most(F.col("value"), F.col("limit")))
    applies = F.col("value").isNotNull() & F.col("limit").isNotNull()
    broken = applies & ~ok
    badness = F.when(least, F.col("value")).otherwise(-F.col("value"))
    out = both.groupBy(PATH, "road_class", "name").agg(
        F.count_if(applies).alias("n_applicable"), F.count_if(broken).alias("n_violations"), F.sum(F.when(broken, F.col("weight_m")).otherwise(0.0)).alias("violation_length_m"),
        F.min(F.when(applies, F.struct(badness.alias("bad"), F.col("k").alias("k"), F.col("value").alias("value"), F.col("s").alias("s")))).alias("worst"),
    )
    status = F.when(F.col("n_applicable") == 0, "not_applicable").when(F.col("n_violations") > 0, "fail").otherwise("pass")
    return out.select(PATH, "road_class", "name", "n_applicable", "n_violations", "violation_length_m", F.col("worst.value").alias("worst_value"), F.col("worst.s").alias("worst_station_m"), status.alias("status"))


def all_pass(checked: DataFrame) -> DataFrame:
    """A path and class pass if no applicable check fails (CK-9)."""
    return checked.groupBy(PATH, "road_class").agg((F.count_if(F.col("status") == "fail") == 0).alias("ok"))


def screen_grade(pairs: DataFrame, cells: DataFrame, cell_m: float, i_max_percent: float) -> DataFrame:
    """Pairs with the straight line between their ends: its gradient, the length and development the limit needs, and whether it is within the limit (CK-10).

    Two ends at one place have no straight line: gradient, development and verdict are NULL.
    """
    at = lambda end: cells.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("i", "j", "z")])
    both = pairs.join(at("start"), "start").join(at("target"), "target")
    distance = F.hypot((F.col("i_start") - F.col("i_target")).cast("double"), (F.col("j_start") - F.col("j_target")).cast("double")) * cell_m
    rows = both.select("od_id", "start", "target", distance.alias("distance_m"), F.abs(F.col("z_target") - F.col("z_start")).alias("dz_m"))
    straight = F.nullif(F.col("distance_m"), F.lit(0.0))
    rows = rows.withColumns({"gradient_percent": 100 * F.col("dz_m") / straight, "least_length_m": F.col("dz_m") / (i_max_percent / 100)})
    return rows.withColumns({"development": F.col("least_length_m") / straight, "passes": F.col("gradient_percent") <= i_max_percent})


def worst_first(checked: DataFrame, n: int) -> DataFrame:
    """The n longest violations of each check."""
    rank: Column = F.row_number().over(W.partitionBy("name").orderBy(F.desc("violation_length_m"), PATH, "road_class"))
    return checked.withColumn("rank", rank).filter(F.col("rank") <= n)


def element_bounds(stations: DataFrame) -> DataFrame:
    """First and last run of each path."""
    return stations.select(PATH, F.min("run").over(whole()).alias("first"), F.max("run").over(whole()).alias("last")).distinct()

"""The published tables: each is one grouped query over result rows (scenario, arm, class and measures), rendered at the end (AG-12, SNK-9).

Rows: scenario, arm ('full' is the base), group, objective, length_m, nodes, search_s, hausdorff_m, build_s, path_found. The same shape serves every
class of terrain, so the tables differ in their group column and measures only.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from contourflow.functions import text
from contourflow.functions.values import finite
from contourflow.operators import stats
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BASE = "full"
VALUES = ("objective", "length_m", "nodes", "search_s")


def versus(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each restricted row with its ratios to the base of its scenario, its share of the domain and its break-even."""
    both = stats.to_baseline(rows, keys, "arm", BASE, list(VALUES))
    ratios = {f"{v}_ratio": F.col(v) / F.nullif(F.col(f"{v}_base").cast("double"), F.lit(0.0)) for v in VALUES}
    flat = F.col("objective_base") < stats.FLAT_BASELINE_M
    ratios["objective_ratio"] = F.when(~flat, ratios["objective_ratio"])
    return both.withColumns(ratios).withColumn("break_even", stats.break_even(F.col("build_s"), F.col("search_s_base"), F.col("search_s")))


def reduction(rows: DataFrame, keys: list[str], groups: list[str]) -> DataFrame:
    """Mean and deviation of every ratio, median distance and break-even, how many are never repaid, by group and arm."""
    both = versus(rows, keys)
    out = [F.count("*").alias("n")]
    for v in VALUES:
        f = finite(F.col(f"{v}_ratio"))
        out += [F.avg(f).alias(f"{v}_mean"), F.stddev_samp(f).alias(f"{v}_sd")]
    out += [F.median("hausdorff_m").alias("hausdorff_median"), F.median(finite(F.col("break_even"))).alias("break_even_median"), F.count_if(F.col("break_even") == float("inf")).alias("never_repaid")]
    return both.groupBy(*groups, "arm").agg(*out)


def cells_of(table: DataFrame, groups: list[str]) -> DataFrame:
    """The table's text: mean plus-minus deviation of each ratio."""
    return table.select(*groups, "arm", *[text.mean_sd(F.col(f"{v}_mean"), F.col(f"{v}_sd")).alias(v) for v in VALUES], text.decimals(F.col("break_even_median"), 0).alias("break_even"))


def acceptance(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Class medians in the group's order and whether they never fall (AG-15)."""
    medians = rows.groupBy(group).agg(F.median(finite(F.col(value).cast("double"))).alias("median"))
    return medians.crossJoin(stats.monotone(medians.withColumn("_all", F.lit(1)), group, "median", ["_all"]).select("monotone"))


def compliance(checked: DataFrame, groups: list[str]) -> DataFrame:
    """Checked, failing and failing length by check: the station tables (AG-16)."""
    applies = F.col("n_applicable") > 0
    length = F.when(applies, F.col("violation_length_m"))
    return checked.groupBy(*groups, "name").agg(F.count_if(applies).alias("n_checked"), (F.count_if(F.col("status") == "fail") / F.nullif(F.count_if(applies).cast("double"), F.lit(0.0))).alias("share_failing"), F.avg(length).alias("length_mean"), F.stddev_samp(length).alias("length_sd"))


def _mean_sd(name: str, value: Column) -> list[Column]:
    f = finite(value.cast("double"))
    return [F.avg(f).alias(f"{name}_mean"), F.stddev_samp(f).alias(f"{name}_sd")]


def search_cost(rows: DataFrame, keys: list[str], base: str = BASE) -> DataFrame:
    """What each arm's search costs: share of the grid, nodes, milliseconds, and the time saved against the base without and with the build of the area graph; none of the latter for the base.

    rows: arm, space_percent, nodes, search_s, build_s.
    """
    base_s = F.max(F.when(F.col("arm") == base, F.col("search_s"))).over(W.partitionBy(*keys))
    saved = lambda t: F.when(F.col("arm") != base, 100 * (1 - t / F.nullif(F.col("_base").cast("double"), F.lit(0.0))))
    both = rows.withColumn("_base", base_s).withColumns({"_alone": saved(F.col("search_s")), "_built": saved(F.col("search_s") + F.col("build_s"))})
    parts = {"space_percent": F.col("space_percent"), "nodes": F.col("nodes"), "search_ms": 1000 * F.col("search_s"), "saved_percent": F.col("_alone"), "saved_with_build_percent": F.col("_built")}
    return both.groupBy("arm").agg(F.count("*").alias("n"), *[c for name, value in parts.items() for c in _mean_sd(name, value)])


def quality(rows: DataFrame, keys: list[str], base: str = BASE) -> DataFrame:
    """What an arm's saving costs: objective ratio (flat baselines left out), objective difference, length ratio and distance to the base's alignment."""
    both = stats.to_baseline(rows, keys, "arm", base, ["objective", "length_m"]).filter(F.col("objective_base").isNotNull())
    ratio = lambda v: F.col(v) / F.nullif(F.col(f"{v}_base").cast("double"), F.lit(0.0))
    steep = F.when(F.col("objective_base") >= stats.FLAT_BASELINE_M, ratio("objective"))
    parts = {"objective_ratio": steep, "objective_difference": F.col("objective") - F.col("objective_base"), "length_ratio": ratio("length_m"), "hausdorff_m": F.col("hausdorff_m")}
    return both.groupBy("arm").agg(F.count("*").alias("n"), F.count(steep).alias("n_ratio"), *[c for name, value in parts.items() for c in _mean_sd(name, value)])


def engineering(rows: DataFrame, flags: tuple[str, ...] = ("r_min_passed", "i_max_passed", "feasible", "made_worse", "degenerate")) -> DataFrame:
    """By class: how many rows pass each check, and their share in percent; a missing verdict is no pass."""
    counts = [c for f in flags for c in (F.count_if(F.col(f)).alias(f), (100 * F.count_if(F.col(f)) / F.count("*")).alias(f"{f}_percent"))]
    return rows.groupBy("road_class").agg(F.count("*").alias("n"), *counts)


def gradient(rows: DataFrame) -> DataFrame:
    """By class and arm: paths found, checks passed among them, how often the guard refused the smoothing, and the steepest gradient before and after."""
    found = F.coalesce(F.col("path_found"), F.lit(False))
    counts = [F.count_if(found & F.coalesce(F.col(f), F.lit(False))).alias(f) for f in ("i_max_passed", "r_min_passed", "feasible", "smoothing_rejected")]
    means = [c for name in ("rough_i_max", "retained_i_max") for c in _mean_sd(name, F.when(found, F.col(name)))]
    return rows.groupBy("road_class", "arm").agg(F.count("*").alias("n"), F.count_if(found).alias("n_found"), *counts, *means)


def terrains(cells: DataFrame, labelled: DataFrame) -> DataFrame:
    """By terrain: the heights obtained and the number of height areas."""
    heights = cells.filter("valid").groupBy("terrain_id").agg(F.min("z").alias("low_m"), F.max("z").alias("high_m"), F.count("*").alias("n_cells"))
    return heights.join(labelled.groupBy("terrain_id").agg(F.count_distinct("area_id").alias("n_areas")), "terrain_id", "left")


def markdown(df: DataFrame, title: str = "", most_rows: int = 1000) -> str:
    """A small result as a Markdown table (SNK-9); more than most_rows rows are refused, since text is made on the driver."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows are no table for reading")
    head = ["| " + " | ".join(df.columns) + " |", "|" + "|".join(" --- " for _ in df.columns) + "|"]
    body = ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in rows]
    return "\n".join([*([f"**{title}**", ""] if title else []), *head, *body]) + "\n"


Fact = Callable[[DataFrame], str]


def fill_markers(document: str, facts: dict[str, Fact], rows: DataFrame) -> tuple[str, list[str]]:
    """A text with its {{fact:name}} markers replaced, and the names that are not known; those stay visible in the text (RT-13)."""
    missing: list[str] = []

    def put(m: re.Match) -> str:
        if m[1] not in facts:
            missing.append(m[1])
            return f"[missing: {m[1]}]"
        return facts[m[1]](rows)

    return re.sub(r"\{\{fact:([\w.-]+)\}\}", put, document), missing


def numbered(document: str, kind: str) -> tuple[str, list[str]]:
    """{{kind:key}} markers numbered by first use, and the keys in that order."""
    order: list[str] = []

    def put(m: re.Match) -> str:
        if m[1] not in order:
            order.append(m[1])
        return str(order.index(m[1]) + 1)

    return re.sub(r"\{\{" + kind + r":([\w.-]+)\}\}", put, document), order

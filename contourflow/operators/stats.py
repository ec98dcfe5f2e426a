"""Statistics of result rows: describe, populations, paired ratios, break-even, guards and exact differences (AG-*, SET-*, JN-2, SNK-6)."""

from __future__ import annotations

import re
from functools import reduce

from contourflow.functions.values import INF, finite, significant
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FEW_ROWS = 5
FLAT_BASELINE_M = 25.0
STRAIGHT_M = 1e6


def describe(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """n, mean, sample deviation, extremes and median of the finite values; inf, NaN and NULL are counted apart (AG-1)."""
    x = F.col(value).cast("double")
    f = finite(x)
    return df.groupBy(*groups).agg(
        F.count(f).alias("n"), F.avg(f).alias("mean"), F.stddev_samp(f).alias("sd"), F.min(f).alias("min"), F.max(f).alias("max"), F.median(f).alias("median"),
        F.count_if(F.abs(x) == INF).alias("n_inf"), F.count_if(F.isnan(x)).alias("n_nan"), F.count_if(x.isNull()).alias("n_missing"), F.when(F.count(f) < FEW_ROWS, f"fewer than {FEW_ROWS} values").alias("note"),
    )


def long_form(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A row a key and quantity (AG-3)."""
    stacked = F.explode(F.array(*[F.struct(F.lit(v).alias("quantity"), F.col(v).cast("double").alias("value")) for v in values])).alias("q")
    return df.select(*keys, stacked).select(*keys, "q.*")


def percentiles(df: DataFrame, groups: list[str], value: str, at: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Exact percentiles by linear interpolation, with mean and maximum (AG-6)."""
    f = finite(F.col(value).cast("double"))
    return df.groupBy(*groups).agg(*[F.percentile(f, F.lit(p)).alias(f"p{round(100 * p)}") for p in at], F.avg(f).alias("mean"), F.max(f).alias("max"))


def first_of(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in an order (AG-8, WN-6)."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def to_baseline(df: DataFrame, keys: list[str], arm: str, base: str, values: list[str]) -> DataFrame:
    """df's other arms with each value of the base arm beside it (value_base): one shuffle by scenario, no self join (JN-2)."""
    by = W.partitionBy(*keys)
    return df.withColumns({f"{v}_base": F.max(F.when(F.col(arm) == base, F.col(v))).over(by) for v in values}).filter(F.col(arm) != base)


def paired_ratios(df: DataFrame, keys: list[str], arm: str, base: str, value: str, least_base: float = 0.0) -> DataFrame:
    """Ratio and difference to the base arm; scenarios without a base, and ratios over a base under least_base, are NULL (AG-11)."""
    rows = to_baseline(df, keys, arm, base, [value])
    b = F.col(f"{value}_base")
    return rows.withColumns({"ratio": F.when(b >= least_base, F.col(value) / F.nullif(b.cast("double"), F.lit(0.0))), "difference": F.col(value) - b})


def break_even(build: Column, base_time: Column, time: Column) -> Column:
    """Queries after which a build is repaid by the saving of each; inf if nothing is saved (AG-13)."""
    saving = base_time - time
    return F.when(saving > 0, build / F.nullif(saving, F.lit(0.0))).otherwise(F.lit(INF))


def censor_straight(radius: Column) -> Column:
    """Finite radii above a million metres count as straight (FLT-7)."""
    return F.when(finite(radius) > STRAIGHT_M, F.lit(INF)).otherwise(radius)


def gini(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """2 sum(rank x) / (n sum x) - (n + 1) / n over the sorted values (GR-31)."""
    rank = F.row_number().over(W.partitionBy(*groups).orderBy(value))
    n, total = F.count("*"), F.sum(value)
    return df.withColumn("_r", rank).groupBy(*groups).agg((2 * F.sum(F.col("_r") * F.col(value)) / (n * total) - (n + 1) / n).alias("gini"), n.alias("n"))


def monotone(df: DataFrame, order: str, value: str, groups: list[str]) -> DataFrame:
    """Whether a value never falls along an order (AG-15)."""
    before = F.lag(value).over(W.partitionBy(*groups).orderBy(order))
    return df.withColumn("_ok", F.coalesce(F.col(value) >= before, F.lit(True))).groupBy(*groups).agg(F.bool_and("_ok").alias("monotone"))


def one_build(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: each provenance column's number of values; more than one anywhere raises when it is read (AG-10)."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    worst = F.greatest(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])
    return counts.withColumn("one_build", F.when(worst > 1, F.raise_error(F.lit("rows of more than one build"))).otherwise(F.lit(True)))


def latest_status(log: DataFrame, key: str = "unit_id", order: tuple[str, ...] = ("at", "run_id")) -> DataFrame:
    """Each unit's last entry: a mergeable maximum, so a hot unit is no hot task (WN-6, ST-2)."""
    rest = [c for c in log.columns if c not in (key, *order)]
    return log.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("e")).select(key, "e.*")


def keep_latest_runs(rows: DataFrame, log: DataFrame, done: str = "done") -> DataFrame:
    """Rows of the runs that are their unit's last entry of status done (SNK-6)."""
    return rows.join(latest_status(log).filter(F.col("status") == done).select("unit_id", "run_id"), ["unit_id", "run_id"], "left_semi")


def not_done(units: DataFrame, log: DataFrame, done: str = "done") -> DataFrame:
    """Units whose last entry is not done: what a resumed run has to do (JN-9)."""
    return units.join(latest_status(log).filter(F.col("status") == done).select("unit_id"), "unit_id", "left_anti")


def multiset_difference(a: DataFrame, b: DataFrame, columns: list[str], digits: int = 9) -> DataFrame:
    """Rows that one table holds more often than the other over shared columns, doubles at so many digits: copies in a and in b (SET-2, AG-17).

    One union and one aggregation; counts are summed before the shuffle.
    """
    kind = dict(a.dtypes)
    norm = [significant(F.col(c), digits).alias(c) if kind[c] == "double" else F.col(c) for c in columns]
    both = a.select(*norm, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(*norm, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    return both.groupBy(*columns).agg(F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b")).filter("in_a <> in_b")


def compared_columns(a: DataFrame, b: DataFrame, ignored: str = r"(_s|_ms|_bytes|_mb)$|^(run_id|timestamp|git|host|python|workers|memory)") -> tuple[list[str], list[str]]:
    """Columns that both have and that say nothing of the run itself, and those that only one has (SET-2)."""


    keep = lambda c: not re.search(ignored, c)
    return [c for c in a.columns if c in b.columns and keep(c)], sorted(c for c in {*a.columns} ^ {*b.columns} if keep(c))


def file_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Files (name) of two folders that only one has (SET-3)."""
    left, right = a.select("name").distinct().withColumn("in_a", F.lit(True)), b.select("name").distinct().withColumn("in_b", F.lit(True))
    return left.join(right, "name", "full").filter("in_a IS NULL OR in_b IS NULL").select("name", F.when(F.col("in_a").isNull(), "missing in a").otherwise("missing in b").alias("what"))


def stratified(units: DataFrame, strata: list[str], key: str, n: int, seed: str = "stratified") -> DataFrame:
    """n units in turns over the strata, by a hash of the key within each (SA-7)."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    ranked = units.withColumn("_turn", F.row_number().over(W.partitionBy(*strata).orderBy(order, key)))
    return ranked.orderBy("_turn", *strata).limit(n).drop("_turn")


def shares(df: DataFrame, groups: list[str], conditions: dict[str, Column]) -> DataFrame:
    """Counts and shares of conditions by group (AG-7, AG-16)."""
    out = [F.count("*").alias("n")]
    for name, c in conditions.items():
        out += [F.count_if(c).alias(f"n_{name}"), (F.count_if(c) / F.count("*")).alias(f"share_{name}")]
    return df.groupBy(*groups).agg(*out)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of tables whose columns grew, missing ones NULL (SNK-6)."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def protocol_rows(df: DataFrame) -> DataFrame:
    """Rows of protocol pairs under real classes: the reference pair and synthetic classes go (FLT-6)."""
    return df.filter(F.coalesce(F.col("od_protocol"), F.lit(False)) & ~F.coalesce(F.col("road_class"), F.lit("")).startswith("SYNTHETIC"))


def population_geometry(df: DataFrame, iterations: int = 1) -> DataFrame:
    """Protocol rows with a class, at one number of iterations (AG-9)."""
    return protocol_rows(df).filter((F.col("algorithm_1_iterations") == iterations) & (F.coalesce(F.col("road_class"), F.lit("")) != ""))


def reported_rows(df: DataFrame, spaces: list[str], edge_costs: list[str]) -> DataFrame:
    """Rows whose search space and edge cost are still in use; rows without one are of a kind that has none (FLT-10)."""
    space, edge = F.col("search_space"), F.col("hag_edge_cost")
    return df.filter((space.isNull() | space.isin(spaces)) & (edge.isNull() | (edge == "") | edge.isin(edge_costs)))


def by_arm(df: DataFrame, keys: list[str], arm: str, arms: list[str], values: list[str]) -> DataFrame:
    """A row a key with each value of each arm beside each other (value_arm), one shuffle (JN-3)."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(arm) == a, F.col(v))).alias(f"{v}_{a}") for a in arms for v in values])


def timings(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, extremes and number of repeated timings (AG-14)."""
    return df.groupBy(*keys).agg(F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("repeats"))


def flatten_scenarios(scenarios: DataFrame) -> DataFrame:
    """A row for each scenario, arm, class and number of iterations; an arm without geometry keeps one row, with an empty class and 0 iterations (JN-10).

    scenarios: scenario_id, other columns that stay, arms (map: arm -> struct) and geometry (map: arm -> array of struct(road_class, iterations, ..)).
    """
    kept = [c for c in scenarios.columns if c not in ("arms", "geometry")]
    rows = scenarios.select(*kept, "geometry", F.explode("arms").alias("arm", "measures"))
    rows = rows.select(*kept, "arm", "measures.*", F.explode_outer(F.try_element_at("geometry", F.col("arm"))).alias("_g"))
    inner = [f.name for f in rows.schema["_g"].dataType.fields]
    default = {"road_class": F.lit(""), "iterations": F.lit(0)}
    return rows.select(*[c for c in rows.columns if c != "_g"], *[F.coalesce(F.col("_g")[c], default[c]).alias(c) if c in default else F.col("_g")[c].alias(c) for c in inner])

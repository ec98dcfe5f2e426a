"""Edge cost models: functions of (dh, length_m) as columns, their factories and their registry (COST-1 to COST-9)."""

from __future__ import annotations

from collections.abc import Callable

from contourflow.functions.values import INF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CostModel = Callable[[Column, Column], Column]
#: Fixed value: what a metre of length adds to the height change to settle ties.
TIE_BREAK_PER_METRE = 1e-6


class InvalidCostModel(ValueError):
    """A model that gives a negative, infinite or missing weight, or whose name is taken."""


_models: dict[str, CostModel] = {}


def register(name: str, model: CostModel) -> CostModel:
    """Name a model; a name cannot be bound to another one silently."""
    if _models.get(name, model) is not model:
        raise InvalidCostModel(f"{name} is registered already")
    _models[name] = model
    return model


def get(name: str) -> CostModel:
    if name not in _models:
        raise InvalidCostModel(f"no cost model {name}; there are {', '.join(available())}")
    return _models[name]


def available() -> list[str]:
    return sorted(_models)


def resolve(cost: str | CostModel) -> CostModel:
    return get(cost) if isinstance(cost, str) else cost


def name_of(cost: str | CostModel) -> str:
    if isinstance(cost, str):
        return cost
    return next((k for k, v in _models.items() if v is cost), getattr(cost, "__name__", "unnamed"))


def weighted_sum(height: float = 0.0, length: float = 0.0, length_3d: float = 0.0) -> CostModel:
    """A blend of height change, planar length and spatial length; weights are not negative and not all zero (COST-5)."""
    if min(height, length, length_3d) < 0 or max(height, length, length_3d) <= 0:
        raise InvalidCostModel("weights of a blend are not negative, and one is positive")

    def model(dh: Column, metres: Column) -> Column:
        return height * F.abs(dh) + length * metres + length_3d * F.hypot(dh, metres)

    model.__name__ = f"weighted_sum(height={height:g},length={length:g},length_3d={length_3d:g})"
    return model


def gradient_penalised(base: str | CostModel, i_max_percent: float, penalty_per_percent: float) -> CostModel:
    """base + penalty for each percent of gradient above i_max, by the metre (COST-6)."""
    if i_max_percent <= 0 or penalty_per_percent < 0:
        raise InvalidCostModel("the largest gradient is positive and the penalty is not negative")
    under = resolve(base)

    def model(dh: Column, metres: Column) -> Column:
        return under(dh, metres) + penalty_per_percent * F.greatest(100 * F.abs(dh) / metres - i_max_percent, F.lit(0.0)) * metres

    model.__name__ = f"gradient_penalised({name_of(base)},i_max={i_max_percent:g},penalty={penalty_per_percent:g})"
    return model


register("height", lambda dh, metres: F.abs(dh).cast("double"))
register("height_tiebreak", lambda dh, metres: F.abs(dh) + TIE_BREAK_PER_METRE * metres)
register("length", lambda dh, metres: metres.cast("double"))
register("3d", lambda dh, metres: F.hypot(dh, metres))


def probe(spark: SparkSession, cost: str | CostModel) -> None:
    """Refuse a model that is not finite and not negative on six edges (COST-7)."""
    edges = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (-1.0, 1.0), (10.0, 10.0), (-50.0, 14.1), (0.5, 1000.0)], "dh double, length_m double")
    guard(edges.withColumn("weight", resolve(cost)(F.col("dh"), F.col("length_m"))), name_of(cost))


def guard(edges: DataFrame, name: str) -> None:
    """Refuse weights that are missing, not finite or negative on the actual edges (COST-8)."""
    w = F.col("weight")
    bad = edges.agg(F.count_if(w.isNull() | F.isnan(w) | (F.abs(w) >= INF) | (w < 0)).alias("bad")).first()["bad"]
    if bad:
        raise InvalidCostModel(f"{name} gives {bad} weights that are not finite numbers from zero")


# The studies' names of edge costs and the models they stand for.
GRID_EDGE_COSTS = {"climb": "height", "climb_tiebreak": "height_tiebreak", "length_3d": "3d"}
# Search spaces and edge costs by the names of earlier runs.
LEGACY_SPACES = {"full_grid": ("full_grid", ""), "hag_yellow": ("hag_cta", "shared_border"), "hag_yellow_k1": ("hag_cta_ring1", "shared_border")}
LEGACY_COSTS = {
    "height": "climb",
    "height_tiebreak": "climb_tiebreak",
    "3d": "length_3d",
    "weighted_h1_l1": "climb_plus_length",
    "gradpen_1": "climb_gradient_penalty",
    "gradcut": "climb_gradient_cut",
}


def grid_edge_cost(name: str, i_max_percent: float | None = None) -> tuple[CostModel, float | None]:
    """A named edge cost of the studies: its model and, for the cut, the gradient cap in percent (COST-9)."""
    if name in GRID_EDGE_COSTS:
        return get(GRID_EDGE_COSTS[name]), None
    if name == "climb_plus_length":
        return weighted_sum(height=1.0, length=1.0), None
    if name not in ("climb_gradient_penalty", "climb_gradient_cut"):
        raise InvalidCostModel(f"no edge cost {name}")
    if i_max_percent is None:
        raise InvalidCostModel(f"{name} needs a largest gradient")
    if name == "climb_gradient_cut":
        return get("height_tiebreak"), float(i_max_percent)
    return gradient_penalised("height_tiebreak", i_max_percent, 1.0), None


def current_names(space: Column, cost: Column) -> Column:
    """struct(search_space, hag_edge_cost, edge_cost) for the names of earlier runs; names that are not of an earlier run stay."""
    spaces = F.create_map(*[x for k, v in LEGACY_SPACES.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("search_space"), F.lit(v[1]).alias("hag_edge_cost")))])
    names = F.create_map(*[F.lit(x) for kv in LEGACY_COSTS.items() for x in kv])
    known = F.coalesce(F.try_element_at(spaces, space), F.struct(space.alias("search_space"), F.lit(None).cast("string").alias("hag_edge_cost")))
    return F.struct(known["search_space"].alias("search_space"), known["hag_edge_cost"].alias("hag_edge_cost"), F.coalesce(F.try_element_at(names, cost), cost).alias("edge_cost"))

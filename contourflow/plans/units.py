"""Experiments as tables of units: products of parameters, lanes, resumption, estimates and statuses (RT-1 to RT-12)."""

from __future__ import annotations

import os
import platform
import re
import sys
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from itertools import product
from pathlib import Path

import contourflow
import pandas as pd
from contourflow.operators.graph import cut_lineage
from contourflow.operators.stats import latest_status, not_done
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(contourflow)

BYTES_PER_CELL = 96
MEMORY_SHARE = 0.8
# Seeds, sides in cells, lattice periods and reliefs in metres of the synthetic terrains by tier; height intervals by tier.
SYNTHETIC = {
    "quick": (2, (120,), (4,), (20,)),
    "standard": (10, (120, 240, 480), (2, 4, 6), (20, 60)),
    "full": (30, (120, 240, 480, 960), (2, 3, 4, 6, 8), (20, 60, 150)),
}
HILLY = (10, (120, 240, 480), ((4, 200), (6, 120), (8, 100)))
INTERVALS = {"quick": (3,), "standard": (1, 3, 5), "full": (1, 2, 3, 5), "hilly": (1, 3, 5)}
STATUSES = ("done", "failed", "not_possible")


class NotPossible(Exception):
    """A unit that cannot be done as it is; not a failure."""


def units(spark: SparkSession, experiment: str, tier: str) -> DataFrame:
    """(unit_id, experiment, seed, size, period, relief, delta, cells): a row a unit, the product of a tier's parameters."""
    if tier == "hilly":
        seeds, sizes, shapes = HILLY
    elif tier in SYNTHETIC:
        seeds, sizes, periods, reliefs = SYNTHETIC[tier]
        shapes = tuple(product(periods, reliefs))
    else:
        raise ValueError(f"no tier {tier}")
    rows = [(f"{experiment}-s{s}-n{n}-p{p}-r{r}-d{d}", experiment, s, n, p, r, d, n * n) for s in range(seeds) for n in sizes for p, r in shapes for d in INTERVALS[tier]]
    return spark.createDataFrame(rows, "unit_id string, experiment string, seed int, size int, period int, relief int, delta int, cells long")


def lane(rows: DataFrame, where: dict[str, object]) -> DataFrame:
    """Units that a lane accepts (FLT-5): an exact value, bounds {min, max, in}, or a part of the id under `contains`."""
    ok: Column = F.lit(True)
    for name, rule in where.items():
        c = F.col("unit_id" if name == "contains" else name)
        if name == "contains":
            ok &= c.contains(rule)
        elif isinstance(rule, dict):
            if unknown := rule.keys() - {"min", "max", "in"}:
                raise ValueError(f"no bound {', '.join(sorted(unknown))}")
            ok &= (c >= rule["min"]) if "min" in rule else F.lit(True)
            ok &= (c <= rule["max"]) if "max" in rule else F.lit(True)
            ok &= c.isin(*rule["in"]) if "in" in rule else F.lit(True)
        else:
            ok &= c == rule
    return rows.filter(ok)


def with_estimates(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Units with estimate_s: the median seconds a cell of the experiment's done units, times the cells; longest first (RT-8)."""
    per_cell = history.filter("status = 'done' AND cells > 0").groupBy("experiment").agg(F.median(F.col("wall_s") / F.col("cells")).alias("_rate"))
    return rows.join(F.broadcast(per_cell), "experiment", "left").withColumn("estimate_s", F.col("_rate") * F.col("cells")).drop("_rate").orderBy(F.desc_nulls_first("estimate_s"), "unit_id")


def require_memory(cells: int, total_bytes: int, share: float = MEMORY_SHARE) -> None:
    """Refuse a terrain above the share of the memory (RT-9)."""
    if cells * BYTES_PER_CELL > share * total_bytes:
        raise NotPossible(f"{cells} cells need {cells * BYTES_PER_CELL} bytes")


def run(rows: DataFrame, log: DataFrame | None, worker: Callable[[dict], list[dict]], result: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Results and statuses of the units that the log does not call done (RT-2, RT-5, RT-7).

    A unit is a row of its own partition slot; what it raises becomes its status, never the run's. The pass is written to the shared folder and both tables are read from it, so no unit runs twice.
    """
    todo = rows if log is None else not_done(rows, log)
    todo = todo if limit is None else todo.orderBy("unit_id").limit(limit)
    names = [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", result)]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for unit in pdf.to_dict("records"):
                began, made, status, reason = datetime.now(timezone.utc), [], "done", None
                try:
                    made = worker(unit)
                except NotPossible as e:
                    status, reason = "not_possible", str(e)
                except Exception as e:
                    status, reason = "failed", f"{type(e).__name__}: {e}"
                wall = (datetime.now(timezone.utc) - began).total_seconds()
                yield pd.DataFrame([{"unit_id": unit["unit_id"], "status": status, "wall_s": wall, "reason": reason, "row": {n: r.get(n) for n in names} if r else None} for r in made or [None]])

    n = max(1, int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    struct = ", ".join(f"{n}: {t}" for n, t in (c.split(None, 1) for c in re.split(r",\s*(?![^<]*>)", result)))
    both = cut_lineage(todo.repartition(n, "unit_id").mapInPandas(work, f"unit_id string, status string, wall_s double, reason string, row struct<{struct}>"))
    return both.filter("row IS NOT NULL").select("unit_id", "row.*"), both.select("unit_id", "status", "wall_s", "reason").distinct()


def snapshot(log: DataFrame) -> DataFrame:
    """Units by their last status (RT-12)."""
    return latest_status(log).groupBy("status").agg(F.count("*").alias("n_units"), F.max("at").alias("last_at"))


class Locked(RuntimeError):
    """Another run holds the folder."""


class FolderLock:
    """One run at a time in a folder of the driver: an exclusively created file with the process's number (RT-6)."""

    def __init__(self, folder: str) -> None:
        self.path = Path(folder) / ".lock"

    def __enter__(self) -> FolderLock:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        try:
            with open(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                f.write(str(os.getpid()))
        except FileExistsError:
            raise Locked(f"{self.path} is held by process {self.path.read_text()}") from None
        return self

    def __exit__(self, *_: object) -> None:
        if self.path.exists() and self.path.read_text() == str(os.getpid()):
            self.path.unlink()


def provenance(spark: SparkSession) -> dict[str, str]:
    """What made a row: versions, machine and time (RT-11)."""
    return {"python": sys.version.split()[0], "spark": spark.version, "system": platform.system(), "machine": platform.machine(), "cores": str(os.cpu_count()), "timestamp_utc": datetime.now(timezone.utc).isoformat(timespec="seconds")}


def tagged(df: DataFrame, tags: dict[str, str]) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in tags.items()})

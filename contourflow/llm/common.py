"""What the training-data operators share: the shared folder, tables cut from their lineage, hashes and sizes."""

from __future__ import annotations

import atexit
import pickle
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import contourflow
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Worker code travels with the task, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(contourflow)

_made: list[tuple[SparkSession, str]] = []
_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the folder set by setCheckpointDir. A temporary one only where neither is set and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        root = _fallback.setdefault("dir", tempfile.mkdtemp(prefix="contourflow-"))
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/contourflow-{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of whichever file system the path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            delete_path(spark, path)
        except Exception:  # the JVM may be gone already; the folder is temporary either way
            return


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back: its lineage ends there, and a lost executor costs nothing."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have: `name`, or that with more underscores before it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def utf8(text: str | Column) -> Column:
    """UTF-8 bytes of a text, null as no bytes."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def fold(doc_id: Column, n: int) -> Column:
    """Remainder of crc32 of the id as text; null ids fall into fold 0 and so are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def unit_hash(*cols: Column, seed: str = "") -> Column:
    """A uniform number in (0, 1) that depends on the values alone."""
    h = F.xxhash64(*cols, F.lit(seed))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A broadcast value's getter. Its class travels with it, and a task unpacks it once. For models of a bounded size only."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    kept: list[Any] = []

    def get() -> Any:
        if not kept:
            kept.append(pickle.loads(shared.value))
        return kept[0]

    return get

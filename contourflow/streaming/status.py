"""Status logs as streams: latest entry of each unit, heartbeats that stopped, progress (ST-1 to ST-5)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HEARTBEAT_S = 5
STALLED_AFTER_S = max(120, 4 * HEARTBEAT_S)


def read_json_log(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """An append-only log of JSON lines; torn lines are left out (ST-1)."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(folder)


def read_table(spark: SparkSession, folder: str, schema: str, glob: str) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def latest(log: DataFrame) -> DataFrame:
    """The last entry of each unit so far: state of one row a unit (ST-2). log: unit_id, run_id, status, at."""
    return log.groupBy("unit_id").agg(F.max(F.struct("at", "run_id", "status")).alias("e")).select("unit_id", "e.run_id", "e.status", "e.at")


def progress(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Entries by window and status; windows close when the watermark passes them (ST-5)."""
    return log.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("since"), "status", "n")


def sessions(log: DataFrame, gap: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches of a unit's entries with no gap longer than that (ST-4)."""
    return log.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "unit_id").agg(F.count("*").alias("n")).select("unit_id", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n")


def stalled(log: DataFrame, after_s: int = STALLED_AFTER_S, late: str = "10 seconds") -> DataFrame:
    """A row whenever a unit has not been heard of for after_s seconds of event time (ST-4): a timer for each unit, set anew by every entry."""

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"unit_id": [key[0]], "last_heard": [pd.Timestamp(last, unit="ms")]})
            return
        newest = max(int(pdf["at"].max().value // 1_000_000) for pdf in batches)
        last = max(newest, state.get[0]) if state.exists else newest
        state.update((last,))
        state.setTimeoutTimestamp(max(last + 1000 * after_s, state.getCurrentWatermarkMs() + 1))

    marked = log.withWatermark("at", late)
    return marked.groupBy("unit_id").applyInPandasWithState(watch, "unit_id long, last_heard timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def into_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete", trigger: dict | None = None) -> StreamingQuery:
    """Keep a parquet table equal to the stream's result (ST-3): each batch replaces it in complete mode, adds to it in append mode."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    sink: Callable[[DataFrame, int], None] = put
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(**(trigger or {"availableNow": True})).start()

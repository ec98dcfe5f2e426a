"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A row's key is exponential, with its quality weight as the rate; the rows of a source with the smallest keys are a weighted
sample without replacement. A source takes complete epochs first; what is left of its budget takes rows by
key until their sizes' running sum reaches it. Keys are dealt into buckets of known order: only the one bucket that holds
the end of the budget is sorted, all others are taken or left whole by their sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from contourflow.llm import quality
from contourflow.llm.common import broadcast, free_name, materialize, unit_hash, utf8
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3.0
ROWS_A_BUCKET = 256
#: Sources up to which their table of one row each is broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 10_000


def words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text if isinstance(text, Column) else F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_EPOCHS, share: float = 1.0) -> DataFrame:
    """sizes (one row a source: source, source_size) with target.

    Sources in order of code points, null last, weigh `weights`, repeating; `share` of all sizes is dealt by weight. A target
    stops at `most` times its source's size and the excess is dealt among the others by weight, until none is above.
    Those that stop are the first by size / weight, so the level at which the rest share is found by running sums. The windows hold one row a source.
    """
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    caps = caps.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - before) / F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing))
    levels = caps.withColumn("level", level)
    shared = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return levels.withColumn("shared", shared).select("source", "source_size", F.least(F.coalesce(F.col("shared") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, weight_of: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most: float = MOST_EPOCHS, share: float = 1.0, whole: bool = False, seed: str = "mix") -> DataFrame:
    """(id_col, row_hash, source, size, source_size, target, epochs, part, taken), a row for each row of docs.

    size: words of the text, 0 for null. weight: a row's quality weight, positive; null or none counts as 1. weight_of: weights by id, (label_id, quality_weight) with
    one row an id, in its place; they meet the rows' sizes and hashes, not their texts. epochs: how often the
    whole source is taken; part: how many words the last, fractional epoch takes of the row. With `whole` the row at the end of the budget is
    taken whole if at least half of it fits, else not at all. A null source is a source of its own. Ties in the key (repeated rows) go by
    id and row_hash; equal rows are interchangeable. Reruns give equal results: keys hang on id and text alone. Rows of size 0 take nothing.
    """
    rate = F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(1.0))
    text_hash = F.xxhash64(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(text_col).alias("size"), text_hash.alias("row_hash"), rate.alias("quality"))
    if weight_of is not None:
        narrow = materialize(rows.drop("quality"), "sizes")
        rows = narrow.join(weight_of, narrow["id"] == weight_of["label_id"], "left").withColumn("quality", F.coalesce("quality_weight", F.lit(1.0)))
    return _deal(rows, docs.count(), id_col, weights, most, share, whole, seed)


def mix_by_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", low: float = 0.5, high: float = 2.0, weights: Sequence[float] = WEIGHTS, most: float = MOST_EPOCHS, share: float = 1.0, whole: bool = False, seed: str = "mix") -> DataFrame:
    """mix with the weights of quality_weights: the same rows, in one pass over the texts from which no text comes back."""
    return _deal(measured(docs, labels, id_col, text_col, source_col, low, high), docs.count(), id_col, weights, most, share, whole, seed)


def measured(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", low: float = 0.5, high: float = 2.0) -> DataFrame:
    """(id, source, row_hash, size, quality), a row for each row of docs: what mix takes of a text, and its weight as in quality_weights.

    A text goes to Python once, is counted and scored there and does not wait in the JVM for its score. Null texts have size 0.
    """
    shared = broadcast(docs.sparkSession, quality.fit(docs, labels, id_col, text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("row_hash"), utf8(text_col).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("data").to_pylist()
            size = pa.array([len(t.split()) for t in texts], pa.int64())  # splits bytes where WORD does
            weight = pa.array(low + quality.scores(shared(), texts) * (high - low), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), batch.column("row_hash"), size, weight], ["id", "source", "row_hash", "size", "quality"])

    schema = rows.drop("data").schema.add("size", "long").add("quality", "double")
    return rows.mapInArrow(run, schema)


def _deal(rows: DataFrame, n: int, id_col: str, weights: Sequence[float], most: float, share: float, whole: bool, seed: str) -> DataFrame:
    """The mix of n rows (id, source, size, row_hash, quality), as mix gives it."""
    key = -F.log(unit_hash(F.col("id"), F.col("row_hash"), seed=seed)) / F.col("quality")
    rows = rows.withColumn("key", key)
    buckets = min(1 << 16, max(16, n // ROWS_A_BUCKET))
    rows = rows.withColumn("bucket", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * buckets))
    rows = materialize(rows.select("id", "source", "size", "row_hash", "key", "bucket"), "rows")

    sums = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "sums")
    aims = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most, share)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = aims.withColumn("epochs", epochs).withColumn("budget", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    aims = materialize(aims, "aims")

    # The bucket in which each source's budget ends.
    own = sums.alias("s").join(aims.alias("a"), F.col("s.source").eqNullSafe(F.col("a.source"))).select("s.source", "s.bucket", "s.bucket_size", "a.budget")
    before = F.coalesce(F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = own.withColumn("before", before).filter((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("before") + F.col("bucket_size")))
    ends = ends.select("source", F.col("bucket").alias("end_bucket"), "before")
    plan = aims.alias("a").join(ends.alias("e"), F.col("a.source").eqNullSafe(F.col("e.source")), "left").select("a.*", "e.end_bucket", "e.before")
    plan = materialize(plan, "plan")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    planned = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    planned = planned.select("r.*", "p.source_size", "p.target", "p.epochs", "p.budget", "p.end_bucket", "p.before")

    # A source whose budget is its whole rest (or nothing) has no end bucket: all rows then come before the end.
    at_end = F.coalesce(F.col("bucket") == F.col("end_bucket"), F.lit(False))
    inside = F.coalesce(F.col("bucket") < F.col("end_bucket"), F.col("budget") > 0)
    settled = planned.filter(~at_end).withColumn("part", F.when(inside, F.col("size")).otherwise(F.lit(0)).cast("long"))
    by_key = W.partitionBy("source").orderBy("key", "id", "row_hash").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("budget") - F.col("before") - F.coalesce(F.sum("size").over(by_key), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left")))
    if whole:
        part = F.when((F.col("left") > 0) & (2 * F.col("left") >= F.col("size")), F.col("size")).otherwise(F.lit(0))
    ending = planned.filter(at_end).withColumn("left", left).withColumn("part", part.cast("long")).drop("left")
    out = settled.unionByName(ending)
    return out.select(F.col("id").alias(id_col), "row_hash", "source", "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def quality_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 0.5, high: float = 2.0) -> tuple[DataFrame, Column]:
    """(docs with a column of weights, that column): every document's weight by the quality classifier's score of its whole text, from `low` at 0 to `high` at 1.

    The classifier learns from the labels as in quality.fit; documents with and without a label are weighed alike, equal texts equally. Null and empty
    texts are scored too. Without labels of both kinds all weights are equal. The new column's name is one that docs does not have.
    """
    name = free_name(docs, "quality_weight")
    scored = quality.score(docs, quality.fit(docs, labels, id_col, text_col), text_col, into=name)
    return scored.withColumn(name, F.lit(low) + F.col(name) * (high - low)), F.col(name)

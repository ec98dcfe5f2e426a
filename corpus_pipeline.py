"""The training-data pipeline: toxic documents go, one of each group of near duplicates stays, contaminated documents go, sources are mixed,
and what is left is dealt into shards. Each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from contourflow.llm import decontam, mixing, near_copies, sharding, toxicity
from contourflow.llm.common import materialize, shared_path, table
from contourflow.llm.queries import SHARDS
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under TOXIC_FROM. Null and empty texts stay; repeated rows share their fate. Other columns than COLUMNS go."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, into="_toxic").filter(F.col("_toxic") < TOXIC_FROM).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component, null ids only where no other is; of rows that repeat it, one.

    Components are of all pairs whose sets of five-word shingles have a Jaccard index of 0.8 or more: the SimHash operator proposes close pairs, a
    prefix filter the others, and all are compared on their whole sets. Documents without words are alike. Other columns than COLUMNS go.
    """
    marked, roots = near_copies.near_copies(docs.select(*COLUMNS))
    rows = marked.groupBy("_key", "doc_id").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("_key").alias("key"), "n")).alias("least")
    keys = materialize(rows.groupBy("_key").agg(least, F.sum("n").alias("rows")), "keys")
    of_root = keys.join(roots.withColumnRenamed("key", "_key"), "_key", "left").withColumn("root", F.coalesce("root", "_key"))
    of_root = materialize(of_root, "rooted")
    chosen = of_root.groupBy("root").agg(F.min("least").alias("chosen"), F.sum("rows").alias("all_rows")).filter("all_rows > 1")
    # Keys of components of one row need no look-up: that row stays.
    special = materialize(of_root.select("_key", "root").join(chosen, "root").select("_key", "chosen"), "special")
    found = near_copies.with_keys(marked, special, "left")
    mine = F.col("chosen").isNull() | ((F.col("chosen.key") == F.col("_key")) & F.col("chosen.id").eqNullSafe(F.col("doc_id")))
    repeated = F.coalesce(F.col("chosen.n") > 1, F.lit(False))
    out = found.filter(mine & ~repeated).select(*COLUMNS)
    if special.filter("chosen.n > 1").isEmpty():
        return out
    return out.unionByName(found.filter(mine & repeated).dropDuplicates(["doc_id", "_key"]).select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows do not reach in one word of twenty. Null and empty texts stay, repeated rows too. Other columns than COLUMNS go."""
    return decontam.annotate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).filter("NOT contaminated").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: once for every complete epoch of its source and once more if the last one takes it.

    Documents are taken whole. Documents without words, which the mix neither needs nor counts, go. Rows that repeat an id, text and
    source count together. Ties go as in mixing.mix. Other columns than COLUMNS go.
    """
    docs = docs.select(*COLUMNS)
    weighed, weight = mixing.quality_weights(docs, table(spark, sf_dir, "labels"))
    mixed = mixing.mix(weighed, weight=weight, whole=True)
    times = F.when(F.col("size") > 0, F.col("epochs") + (F.col("part") > 0).cast("long")).otherwise(F.lit(0))
    picks = mixed.groupBy(F.col("doc_id").alias("id"), "row_hash", F.col("source").alias("of")).agg(F.sum(times).alias("times"), F.count("*").alias("n"))
    rows = docs.withColumn("_hash", F.xxhash64("text"))
    if not picks.filter("n > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id", "_hash", "source"])
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("row_hash")) & F.col("source").eqNullSafe(F.col("of"))
    both = rows.join(picks.filter("times > 0"), same)
    return both.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_k")).select(*COLUMNS)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and slot, as sharding.shard gives them: ties in a shard go by its order, repeated rows get slots of their own, nulls too; none of the other columns stays."""
    return sharding.shard(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", into_shards),
]

#: Neither the classifier nor the components of links can be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs

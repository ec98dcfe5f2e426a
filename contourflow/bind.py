"""The domain's tables made of the driver's: rasters, paths, result rows, logs and pairs, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells(terrain_id, node, i, j, z, valid): 50 columns, sizes as heights."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.lit("part").alias("terrain_id"), key.alias("node"), F.floor(key / 50).cast("int").alias("i"), (key % 50).cast("int").alias("j"), F.col("p_size").cast("double").alias("z"), F.lit(True).alias("valid"))


PART_GRID = "SELECT p_partkey AS node, CAST(p_partkey // 50 AS INT) AS i, CAST(p_partkey % 50 AS INT) AS j, CAST(p_size AS DOUBLE) AS z, TRUE AS valid FROM part"


def lineitem_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 x 40 cells, quantities as heights; cells may lack."""
    i, j = (F.col("l_partkey") % 40).cast("int").alias("i"), (F.col("l_suppkey") % 40).cast("int").alias("j")
    z = table(spark, sf_dir, "lineitem").groupBy(i, j).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("z"))
    return z.select(F.lit("lineitem").alias("terrain_id"), (F.col("i") * 40 + F.col("j")).cast("long").alias("node"), "i", "j", "z", F.lit(True).alias("valid"))


LINEITEM_GRID = """SELECT CAST(i * 40 + j AS BIGINT) AS node, i, j, z, TRUE AS valid FROM (
  SELECT CAST(l_partkey % 40 AS INT) AS i, CAST(l_suppkey % 40 AS INT) AS j, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS z FROM lineitem GROUP BY 1, 2)"""


def hill_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 x 60 cells of 10 m, one smooth hill."""
    cells = spark.range(3600).select(F.col("id").alias("node"), F.floor(F.col("id") / 60).cast("int").alias("i"), (F.col("id") % 60).cast("int").alias("j"))
    z = 400 - F.floor((F.pow(F.col("i") - 30, F.lit(2)) + F.pow(F.col("j") - 20, F.lit(2))) / 8)
    return cells.select(F.lit("hill").alias("terrain_id"), "node", "i", "j", z.cast("double").alias("z"), F.lit(True).alias("valid"))


HILL_GRID = """SELECT node, i, j, CAST(400 - ((i - 30) * (i - 30) + (j - 20) * (j - 20)) // 8 AS DOUBLE) AS z, TRUE AS valid
  FROM (SELECT range AS node, CAST(range // 60 AS INT) AS i, CAST(range % 60 AS INT) AS j FROM range(3600))"""


def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path_points(path_id, seq, x_m, y_m, z_m): a path a user, a point an event."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("seq", F.row_number().over(order))
    return rows.select(F.col("user_id").alias("path_id"), "seq", (F.col("seq") * 10).cast("double").alias("x_m"), F.floor("value").cast("double").alias("y_m"), (F.col("event_id") % 97).cast("double").alias("z_m"))


EVENT_PATHS = """SELECT user_id AS path_id, CAST(seq AS INT) AS seq, CAST(seq * 10 AS DOUBLE) AS x_m, CAST(floor(value) AS DOUBLE) AS y_m, CAST(event_id % 97 AS DOUBLE) AS z_m
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"""


def embedding_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 points of consecutive pairs of each vector, in steps of 1/1000 to keep sums exact; label groups paths."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("k"), "embedding")
    at = lambda k: F.floor(F.get("embedding", k).cast("double") * 1000)
    return rows.select(F.col("vec_id").alias("path_id"), "label", (F.col("k") + 1).alias("seq"), at(2 * F.col("k")).cast("double").alias("x_m"), at(2 * F.col("k") + 1).cast("double").alias("y_m"), F.lit(0.0).alias("z_m"))


EMBEDDING_PATHS = """SELECT vec_id AS path_id, label, CAST(k + 1 AS INT) AS seq, CAST(floor(CAST(embedding[2 * k + 1] AS DOUBLE) * 1000) AS DOUBLE) AS x_m, CAST(floor(CAST(embedding[2 * k + 2] AS DOUBLE) * 1000) AS DOUBLE) AS y_m, CAST(0 AS DOUBLE) AS z_m
  FROM embeddings, (SELECT unnest(range(32)) AS k)"""


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """results(scenario, arm, nodes, n_lines, cents, days): a row a scenario and arm; A is the full grid, N and R are restricted."""
    cents = F.rint(F.col("l_extendedprice") * 100).cast("long")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("scenario"), F.col("l_returnflag").alias("arm"))
    return rows.agg(F.sum(F.col("l_quantity").cast("long")).alias("nodes"), F.count("*").alias("n_lines"), F.sum(cents).alias("cents"), F.max("l_linenumber").cast("long").alias("line"))


RESULT_ROWS = """SELECT l_partkey AS scenario, l_returnflag AS arm, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS nodes, count(*) AS n_lines,
  CAST(sum(CAST(round_even(l_extendedprice * 100, 0) AS BIGINT)) AS BIGINT) AS cents, CAST(max(l_linenumber) AS BIGINT) AS line FROM lineitem GROUP BY 1, 2"""


def unit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log(unit_id, run_id, status, at, value): the events as the entries of a status log."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("unit_id"), F.col("event_id").alias("run_id"), F.col("event_type").alias("status"), F.col("ts").alias("at"), "value")


UNIT_LOG = "SELECT user_id AS unit_id, event_id AS run_id, event_type AS status, ts AS at, value FROM events"


def od_pairs(cells: DataFrame, every: int = 25) -> DataFrame:
    """pairs(od_id, start, target) of a grid's nodes by an integer formula: one for every so many nodes."""
    n = cells.agg(F.max("node").alias("m")).select((F.col("m") + 1).alias("n"))
    return n.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / every))).alias("od_id")).select("od_id", (F.col("od_id") * 37 % F.col("n")).alias("start"), ((F.col("od_id") * 61 + F.floor(F.col("n") / 2)) % F.col("n")).alias("target"))


def od_pairs_sql(every: int = 25) -> str:
    return f"SELECT od_id, od_id * 37 % n AS start, (od_id * 61 + n // 2) % n AS target FROM (SELECT n, unnest(range(0, (n - 1) // {every} + 1)) AS od_id FROM (SELECT max(node) + 1 AS n FROM cells))"

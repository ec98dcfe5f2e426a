"""Result logs, series, plans and catalogues in; typed text, strict JSON and path files out (SRC-13 to SRC-21, SNK-1 to SNK-7)."""

from __future__ import annotations

import tomllib
from itertools import product

from contourflow.functions.values import INF, parse_cell, render_cell, significant
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A result table, gzip or plain. With a schema the words inf, -inf and nan are doubles and empty cells NULL; without, cells are text."""
    reader = spark.read.option("header", True).option("nanValue", "nan").option("positiveInf", "inf").option("negativeInf", "-inf")
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def typed(df: DataFrame) -> DataFrame:
    """Every text column as a struct of kind and number beside its text."""
    return df.select(*[F.struct(F.col(c).alias("text"), parse_cell(F.col(c)).alias("typed")).alias(c) for c in df.columns])


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines; lines that a crash has torn are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("allowNonNumericNumbers", True).json(path)


def read_series(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A series by station: empty doubles are NaN, is_curve is text."""
    df = read_csv(spark, path, schema)
    return df.select(*[F.coalesce(c, F.lit(float("nan"))).alias(c) if t == "double" else F.lower(F.col(c)).isin("true", "1").alias(c) if c == "is_curve" and t == "string" else F.col(c) for c, t in df.dtypes])


def load_plan(spark: SparkSession, text: str, experiments: set[str]) -> DataFrame:
    """Lanes of a TOML plan: (lane, experiment, workers); unknown or repeated experiments and lanes without workers are refused (SRC-16)."""
    rows, seen = [], set()
    for lane in tomllib.loads(text).get("lane", []):
        if lane.get("workers", 0) < 1:
            raise ValueError(f"lane {lane.get('name')} has no workers")
        for name in lane.get("experiments", []):
            if name not in experiments or name in seen:
                raise ValueError(f"{name} is unknown or planned twice")
            seen.add(name)
            rows.append((lane.get("name", ""), name, int(lane["workers"])))
    if not rows:
        raise ValueError("a plan has a lane with an experiment")
    return spark.createDataFrame(rows, "lane string, experiment string, workers int")


def result_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path, bytes) of all CSV and JSONL files below a folder; a gzip file has the name of its plain one (SRC-17)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,jsonl,csv.gz,jsonl.gz}").load(folder)
    return files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.gz$", "").alias("name"), "path", F.col("length").alias("bytes"))


def catalogue(spark: SparkSession, tables: dict[str, str]) -> dict[str, bool]:
    """Temporary views of the tables that exist, and which do (SRC-20)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = {}
    for name, path in tables.items():
        where = jvm.org.apache.hadoop.fs.Path(path)
        there[name] = bool(where.getFileSystem(conf).exists(where))
        if there[name]:
            spark.read.parquet(path).createOrReplaceTempView(name)
    return there


def config_rows(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations of parameter lists; of grid and scale, those that divide (SRC-21)."""
    names = list(values)
    rows = [r for r in product(*values.values()) if "grid" not in names or "scale" not in names or r[names.index("grid")] % r[names.index("scale")] == 0]
    return spark.createDataFrame(rows, names)


def rendered(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text cells of the columns in order (SNK-1); a column that lacks is empty."""
    kinds = dict(df.dtypes)
    return df.select(*[render_cell(F.col(c), kinds[c]).alias(c) if c in kinds else F.lit("").alias(c) for c in columns or df.columns])


def strict_json(df: DataFrame) -> DataFrame:
    """A column `value` of strict JSON, keys sorted, numbers that are not finite as text (SNK-2)."""

    def clean(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.DoubleType, T.FloatType)):
            word = F.when(F.isnan(c), "nan").when(c == INF, "inf").when(c == -INF, "-inf")
            return F.when(word.isNotNull(), F.to_json(F.struct(word.alias("v")))).otherwise(F.to_json(F.struct(c.alias("v"))))
        return F.to_json(F.struct(c.alias("v")))

    cells = [F.when(F.col(f.name).isNotNull(), F.concat(F.lit(f'"{f.name}":'), F.regexp_extract(clean(F.col(f.name), f.dataType), r"(?s)^\{\"v\":(.*)\}$", 1))) for f in sorted(df.schema, key=lambda f: f.name)]
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}")).alias("value"))


def path_name(terrain: Column, od: Column, arm: Column, road_class: Column, iteration: Column) -> Column:
    """Deterministic name of an axis file (SNK-4)."""
    return F.concat(F.concat_ws("__", terrain, od, arm, road_class, F.concat(F.lit("it"), iteration.cast("string"))), F.lit(".csv"))


def axis_rows(points: DataFrame) -> DataFrame:
    """path_id, seq and coordinates as text of four decimals (SNK-3)."""
    return points.select("path_id", "seq", *[F.format_string("%.4f", F.bround(c, 4)).alias(c) for c in ("x_m", "y_m", "z_m")])


def slim(df: DataFrame, used: list[str], digits: int = 9) -> DataFrame:
    """The used columns alone, doubles at so many significant digits (SNK-7)."""
    kinds = dict(df.dtypes)
    return df.select(*[significant(F.col(c), digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns if c in used])


def series_rows(stations: DataFrame, road_class: DataFrame) -> DataFrame:
    """Stations with their class's limits; the vertical limit is that of the station's own kind of curve (SNK-5). road_class: one row."""
    limits = F.broadcast(road_class.select("r_min_m", "i_max_percent", "l_alignment_min_m", "r_vert_concave_min_m", "r_vert_convex_min_m").limit(1))
    both = stations.join(limits, F.lit(True))
    return both.withColumn("r_v_limit", F.when(F.col("v_kind") == "concave", F.col("r_vert_concave_min_m")).when(F.col("v_kind") == "convex", F.col("r_vert_convex_min_m"))).drop("r_vert_concave_min_m", "r_vert_convex_min_m")

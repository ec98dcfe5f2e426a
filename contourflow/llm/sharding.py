"""Shards by jump consistent hashing: a stable key alone decides, and no ring table is kept. Built-in functions only."""

from __future__ import annotations

from contourflow.llm.common import materialize
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Multiplier of the linear congruential generator in Lamping and Veach's jump hash (a fixed value).
MULTIPLIER = 2862933555777941757
#: Jumps of a key number about ln(shards); more than this many have a probability under 1e-100.
MOST_JUMPS = 256
ROWS_A_BUCKET = 4096


def _low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def _shifted16(x: Column) -> Column:
    return F.shiftleft(x.bitwiseAND(F.lit(0xFFFF)), 16)


def _stepped(s: Column, n: int) -> Column:
    """One jump; the 64-bit product is made of 16-bit parts, since a long that overflows is an error in ANSI mode."""
    c0, c1, c2, c3 = (F.lit((MULTIPLIER >> k) & 0xFFFF).cast("long") for k in (0, 16, 32, 48))
    lo, hi = s["lo"], s["hi"]
    low = lo * c0 + _shifted16(lo * c1) + F.lit(1)
    high = F.shiftright(low, 32) + F.shiftright(lo * c1, 16) + lo * c2 + _shifted16(lo * c3) + hi * c0 + _shifted16(hi * c1)
    new_hi = _low32(high)
    jump = ((s["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(new_hi, 1) + 1).cast("double"))).cast("long")
    moved = F.struct(new_hi.alias("hi"), _low32(low).alias("lo"), s["next"].alias("at"), jump.alias("next"))
    return F.when(s["next"] < n, moved).otherwise(s)


def jump_hash(key: Column, n: int) -> Column:
    """struct(shard, grown): the shards of a 64-bit key among n and among n + 1 shards.

    A key's jumps do not depend on n: with one more shard it stays, or its next jump is the new shard.
    """
    start = F.struct(_low32(F.shiftrightunsigned(key, 32)).alias("hi"), _low32(key).alias("lo"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(min(n, MOST_JUMPS))), start, lambda s, _: _stepped(s, n))
    # No key of this world jumps that often (the number of jumps is about the logarithm of n); one that did must not get a wrong shard.
    end = F.when(end["next"] < n, F.raise_error(F.lit(f"a key jumps more than {MOST_JUMPS} times"))).otherwise(end)
    return F.transform(F.array(end), lambda s: F.struct(s["at"].cast("int").alias("shard"), F.when(s["next"] == n, F.lit(n)).otherwise(s["at"]).cast("int").alias("grown")))[0]


def shard(df: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard), a row for each row of df.

    The law is `key`: the id's XXH64 and the number of shards decide, nothing else. A null id has a key of its own and
    rows of one id share a shard. A null text has size 16 and the crc32 of no bytes. Slots run from 0 in each shard without
    gaps, in an order that follows hashes of id and text; equal rows take the slots of their group in any order. A shard's rows are numbered in buckets of
    about ROWS_A_BUCKET, from offsets of the buckets' counts, so no task holds a shard. Other columns are not looked at.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("id"), F.octet_length(data).cast("long").alias("bytes"), F.crc32(data).alias("crc"))
    n_rows = df.count()
    buckets = max(1, -(-n_rows // (n * ROWS_A_BUCKET)))
    placed = rows.withColumn("jump", jump_hash(F.xxhash64("id"), n)).withColumn("bucket", F.pmod(F.xxhash64("id", "crc"), F.lit(buckets)))
    placed = materialize(placed.select("id", "bytes", "crc", "bucket", F.col("jump.shard").alias("shard"), F.col("jump.grown").alias("grown")), "placed")
    before = F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    offsets = materialize(offsets.select("shard", "bucket", "before"), "offsets")
    rank = F.row_number().over(W.partitionBy("shard", "bucket").orderBy(F.xxhash64("id", "crc"), "id", "crc", "bytes"))
    out = placed.withColumn("rank", rank).join(offsets, ["shard", "bucket"])
    return out.select(
        F.col("id").alias(id_col),
        (F.col("bytes") + 16).alias("size"),
        F.col("crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"),
        F.col("grown").alias("grown_shard"),
    )

"""Document fingerprints: bottom-k sketches of shingle hashes. Built-in functions only.

A sketch is the k smallest distinct hashes of a document's shingles of five words, as a sorted array of longs. Sketches of parts
merge into the sketch of the whole; two of them estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from contourflow.llm.common import materialize, partitions
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 128
SHINGLE_WORDS = 5
SPACE = " \t\n\x0b\x0c\r"
MOST_BUCKETS = 1 << 14


def shingle_hashes(words: Column, width: int = SHINGLE_WORDS) -> Column:
    """Hashes of all shingles of an array of word hashes; of fewer words, one of the whole; of none, none."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < width, F.array(F.xxhash64(words))).otherwise(many)


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words between runs of white space; null as no words."""
    words = F.split(F.lower(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))), r"[\x20\x09-\x0D]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: Column, into: str, k: int = K, width: int = SHINGLE_WORDS) -> DataFrame:
    """df with the sketch of a text. The word hashes stay a column of a step of their own, so they are made once."""
    hashed = df.withColumn("_words", word_hashes(text))
    return hashed.withColumn(into, smallest(shingle_hashes(F.col("_words"), width), k)).drop("_words")


def as_text(sketch: Column) -> Column:
    """16 hex digits a hash, in the sketch's order; a sketch of no shingles is the empty string."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def from_text(text: Column) -> Column:
    parts = F.filter(F.regexp_extract_all(text, F.lit("([0-9A-F]{16})"), F.lit(1)), lambda x: x != "")
    high = lambda x: F.conv(F.substring(x, 1, 8), 16, 10).cast("long")
    low = lambda x: F.conv(F.substring(x, 9, 8), 16, 10).cast("long")
    return F.transform(parts, lambda x: F.shiftleft(high(x), 32).bitwiseOR(low(x)))


def merged(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, exact for fewer than k shingles in all; 1 for two sketches of nothing."""
    union = merged(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), union)).cast("double")
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.greatest(F.size(union), F.lit(1)))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles, exact for fewer than k."""
    place = (F.get(sketch, F.lit(k - 1)).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / F.greatest(place, F.lit(1e-18)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that are b's; 1 if a has none."""
    j, n_a, n_b = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (n_a + n_b) / ((1 + j) * F.greatest(n_a, F.lit(1.0)))))


def merge_groups(df: DataFrame, key: str, sketch: str, k: int = K, fan_in: int = 256) -> DataFrame:
    """(key, sketch): one sketch for each key. Rows of a key are first merged in salted parts, in as many levels as
    keep a part near fan_in rows, so no task gathers a key. Null sketches count as empty; a null key is a key."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(sketch), F.array().cast("array<bigint>")).alias("sketch"))
    parts = 1
    n = rows.count()
    while parts * fan_in < n:
        parts *= fan_in
    salt = F.xxhash64("key", "sketch", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("salt", F.pmod(salt, F.lit(parts))), "salted") if parts > 1 else rows.withColumn("salt", F.lit(0))
    while parts >= 1:
        one = rows.groupBy("key", "salt").agg(F.collect_list("sketch").alias("many"))
        rows = one.select("key", F.pmod("salt", F.lit(max(1, parts // fan_in))).alias("salt"), smallest(F.flatten("many"), k).alias("sketch"))
        if parts == 1:
            break
        parts //= fan_in
    return rows.select(F.col("key").alias(key), F.col("sketch").alias(sketch))


def _bucket(value: Column, boundaries: list[int]) -> Column:
    """Number of boundaries at most the value, by binary search."""
    if not boundaries:
        return F.lit(0)
    edges = F.array(*[F.lit(b).cast("long") for b in boundaries])
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(boundaries)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        up = F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))
        down = F.struct(s["lo"].alias("lo"), mid.alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).when(F.get(edges, mid) <= value, up).otherwise(down)

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(boundaries).bit_length() + 1)), start, halve)["lo"]


def beside_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, ghost, id, t): docs dealt into ranges of the id, each with a copy (ghost = 1) of the document that follows its last one.

    The order is by descending id, null ids last; the first document follows the last. Ids that are equal go by a hash of the text.
    Windows over a bucket, ordered by in_bucket(), then see every document's next one, and no task holds more than its range.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    n = docs.count()
    n_buckets = int(min(MOST_BUCKETS, max(2 * partitions(docs.sparkSession), n // 20_000)))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).filter("id IS NOT NULL")
    cuts = ids.agg(F.percentile_approx("id", [k / n_buckets for k in range(1, n_buckets)], 20 * n_buckets)).first()[0] or []
    null_bucket = -1 - F.pmod(F.xxhash64("t"), F.lit(64))
    range_of = _bucket(F.col("id"), sorted(set(cuts)))
    rows = rows.withColumn("bucket", F.when(F.col("id").isNull(), null_bucket).otherwise(range_of).cast("int"))

    # The first document of each bucket, by the ids alone; null ids, which lie in buckets of their own, by the hash of their text.
    tops = ids.select("id", range_of.cast("int").alias("bucket")).groupBy("bucket").agg(F.max("id").alias("id"))
    first = W.partitionBy("bucket").orderBy(*in_bucket())
    nulls = rows.filter("id IS NULL")
    null_tops = nulls.join(nulls.groupBy("bucket").agg(F.max(F.xxhash64("t")).alias("top")), "bucket").filter(F.xxhash64("t") == F.col("top")).drop("top")
    heads = rows.join(F.broadcast(tops), ["bucket", "id"], "left_semi").unionByName(null_tops.select(*rows.columns))
    heads = heads.dropDuplicates(["bucket", "id", "t"]).withColumn("ghost", F.lit(0)).withColumn("rank", F.row_number().over(first)).filter("rank = 1")
    heads = materialize(heads.select("bucket", "id", "t"), "heads")
    along = W.orderBy(F.desc("bucket"))  # one row a bucket, MOST_BUCKETS and the null ids' at most
    order = heads.select("bucket").withColumn("before", F.lag("bucket").over(along))
    last = heads.agg(F.min("bucket").alias("last"))
    order = order.crossJoin(last).select("bucket", F.coalesce("before", "last").alias("before"))
    ghosts = heads.join(order, "bucket").select(F.col("before").alias("bucket"), F.lit(1).alias("ghost"), "id", "t")
    return rows.select("bucket", F.lit(0).alias("ghost"), "id", "t").unionByName(ghosts)


def in_bucket() -> list[Column]:
    return [F.col("ghost"), F.col("id").desc_nulls_last(), F.xxhash64("t").desc()]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = SHINGLE_WORDS) -> DataFrame:
    """One row a document: (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles).

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document's.
    near_*: estimated resemblance of the fingerprints, 1 for two texts without words, 0 if one of them has none. A null text counts as empty; repeated rows
    all stay and follow each other; a single document is its own next. Other columns are not looked at.
    """
    rows = beside_next(docs, id_col, text_col)
    n = partitions(docs.sparkSession)
    over = W.partitionBy("bucket").orderBy(*in_bucket())
    rows = with_sketch(rows.repartition(n, "bucket"), F.col("t"), "sketch", k, width)
    rows = rows.withColumn("next", F.lead(F.struct("t", "sketch")).over(over)).filter("ghost = 0")
    n_chars = F.char_length("t")
    cut = F.floor(n_chars / 3).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), n_chars - cut), F.substring(F.col("next.t"), F.lit(1), cut))
    rows = rows.select("id", n_chars.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", F.col("next.sketch").alias("next_sketch"))
    rows = with_sketch(rows, F.col("edited"), "edited_sketch", k, width)
    kind = docs.schema[id_col].dataType
    return rows.select(
        F.col("id").cast(kind).alias(id_col),
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles"),
    )

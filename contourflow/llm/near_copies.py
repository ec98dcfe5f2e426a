"""Near copies by likeness: components of all pairs of texts whose sets of five-word shingles have a Jaccard index of LEAST or more.

SimHash alone cannot give these links: at a Jaccard index of 0.8 two fingerprints differ in about ten bits of 64, and no choice of blocks
deals such pairs into small shards. So the SimHash operator's BK-trees (over five-word fingerprints) propose the close pairs, and a prefix-filtered
search proposes what is left; every proposed pair is compared on its whole sets, so neither a near copy is missed nor a clean document linked.

The shingles of all texts are put in one order, and two sets that are alike enough share a shingle among the first n - ceil(LEAST n) + 1
of each. Any order gives the same pairs; this one is by hash, with shingles that are common in a sample of documents last, so that stock passages deal few
texts together. Proposed pairs first meet by parity bitmaps (one bit a shingle), whose differing bits bound the sets' difference from below;
only pairs that pass bring their sets together. Texts that earlier links join are not paired again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from contourflow.llm.common import broadcast, delete_path, materialize, partitions, shared_path, unit_hash, utf8
from contourflow.llm.simhash import components, fingerprint_of, link_edges, shingle_hashes
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
#: Least Jaccard index of a link, as a fraction.
LEAST = (4, 5)
#: One document of so many is looked at for common shingles, a common one is in so many of these, and there are so many at most. They order, and drop nothing.
SAMPLE_ONE_OF = 8
COMMON_FROM = 3
MOST_COMMON = 1 << 21
#: Places at a prefix's end, where shingles are the least rare, in which each text meets some others first, and how many of them: next to it and in the place's largest group.
LAST_PLACES = 4
NEXT, IN_LARGEST = 4, 16
PAIRS_AT_ONCE = 200_000
#: Rows up to which a table of keys is broadcast; beyond, the texts are shuffled.
BROADCAST_KEYS = 1 << 20


def key_of(text: str) -> Column:
    """A hash of the text; one value for all texts without words, null among them."""
    return F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def shingle_set(data: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(data, SHINGLE_WORDS)).view(np.int64)


def prefix(found: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """The shingles of which two sets alike enough share one: those that are not common first, each part by hash; and how many are not common."""
    n = rare = len(found)
    if n and len(common):
        is_common = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
        found = np.concatenate([found[~is_common], found[is_common]])
        rare -= int(is_common.sum())
    return found[: n - -(-LEAST[0] * n // LEAST[1]) + 1], rare


def bitmap(found: np.ndarray) -> bytes:
    """Parities of the numbers of shingles by the low bits of their hashes: a power of two of them, four a shingle at least."""
    size = max(64, 1 << (4 * max(1, len(found)) - 1).bit_length())
    odd = np.bincount(found & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_alike(m: int, p: bytes, n: int, q: bytes) -> bool:
    """Whether sets of m and n shingles with these bitmaps can have a Jaccard index of LEAST; halves of a bitmap add up to a smaller one."""
    a, b = LEAST
    if b * min(m, n) < a * max(m, n):
        return False
    x, y, i, j = int.from_bytes(p, "little"), int.from_bytes(q, "little"), 8 * len(p), 8 * len(q)
    while i > j:
        i //= 2
        x = (x >> i) ^ (x & ((1 << i) - 1))
    while j > i:
        j //= 2
        y = (y >> j) ^ (y & ((1 << j) - 1))
    return (a + b) * (x ^ y).bit_count() <= (b - a) * (m + n)


def _common(docs: DataFrame) -> np.ndarray:
    """Shingles of several documents of the sample, sorted. docs: (key, data)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["data"]:
                yield pd.DataFrame({"shingle": shingle_set(data)})

    picked = docs.filter(unit_hash(F.col("key"), seed="common") < 1 / SAMPLE_ONE_OF).dropDuplicates(["key"]).select("data")
    seen = picked.mapInPandas(of, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON_FROM)
    rows = seen.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).select("shingle").toArrow()
    return np.sort(np.asarray(rows["shingle"], dtype=np.int64))


def _pairs(places: DataFrame, some: bool) -> DataFrame:
    """Distinct pairs (u, v) of texts of different groups that share a shingle of their prefixes and may be alike. places: (shingle, key, n, pos, group, bits).

    bits: the text's bitmap where the shingle is a common one, so that many texts meet, else null.
    some: each text with the next NEXT in order of size, and with IN_LARGEST of the place's largest group if it is not in that; else all such pairs.
    """
    a, b = LEAST

    def within(n: np.ndarray, pos: np.ndarray, key: np.ndarray, group: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        names, of, members = np.unique(group, return_inverse=True, return_counts=True)
        if len(names) == 1:
            return
        largest = of == members.argmax()
        at = np.flatnonzero(largest)
        if some:
            for step in range(1, NEXT + 1):
                other = of[step:] != of[:-step]
                yield key[step:][other], key[:-step][other]
        # Partners by size, and the text's own place among them.
        rest, first, last = n - pos, np.searchsorted(n * b, n * a), np.searchsorted(n * a, n * b, side="right")
        for i in np.flatnonzero(~largest).tolist():
            if some:
                near = at[np.searchsorted(at, first[i]) : np.searchsorted(at, last[i])]
                found = key[near[np.unique(np.linspace(0, len(near) - 1, IN_LARGEST).astype(np.int64))]] if len(near) else near
            else:
                # Shared are this shingle and at most those that follow it in both orders. Two texts of the largest group are of one group, so its texts are partners only.
                j = np.arange(first[i], last[i])
                good = (of[j] != of[i]) & ((j > i) | largest[j]) & ((a + b) * np.minimum(rest[i], rest[j]) >= a * (n[i] + n[j]))
                j = j[good]
                if bits[i] is not None:
                    j = j[[bits[x] is None or may_be_alike(int(n[i]), bits[i], int(n[x]), bits[x]) for x in j.tolist()]] if len(j) else j
                found = key[j]
            if len(found):
                yield found, np.full(len(found), key[i])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, held, out, size = ["shingle", "n", "pos", "key", "group", "bits"], None, [], 0

        def made() -> pd.DataFrame:
            u, v = (np.concatenate([x[k] for x in out]) for k in (0, 1))
            return pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)}).drop_duplicates()

        def batches_and_end() -> Iterator[pd.DataFrame | None]:
            yield from batches
            yield None

        for pdf in batches_and_end():
            now = held if pdf is None else [pdf[c].to_numpy() for c in names]
            if now is None:
                continue
            if pdf is not None and held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            begins = np.concatenate([[0], np.flatnonzero(np.diff(now[0])) + 1, [len(now[0])]])
            if pdf is not None:  # the last shingle may go on
                held, begins = [x[begins[-2] :] for x in now], begins[:-1]
            for k in np.flatnonzero(np.diff(begins) > 1).tolist():
                for found in within(*[x[begins[k] : begins[k + 1]] for x in now[1:]]):
                    out.append(found)
                    size += len(found[0])
                    if size > PAIRS_AT_ONCE:
                        yield made()
                        out, size = [], 0
        if out:
            yield made()

    ordered = places.repartition(partitions(places.sparkSession), "shingle").sortWithinPartitions("shingle", "n", "key")
    return ordered.mapInPandas(run, "u long, v long").distinct()


def with_keys(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Join of docs (with a column _key) and a table of one row a key (_key): broadcast where that is small, else the docs are shuffled."""
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "_key", how)


def _linked(docs: DataFrame, marks: DataFrame, pairs: DataFrame, made: list[str]) -> DataFrame:
    """The pairs whose whole sets are alike enough. docs: (_key, data); marks: (key, n, bits)."""
    names = {x: [F.col("key").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits")] for x in "uv"}

    def possible(m: pd.Series, p: pd.Series, n: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([may_be_alike(*x) for x in zip(m.tolist(), p, n.tolist(), q, strict=True)], dtype="bool")

    near = pairs.join(marks.select(names["u"]), "u").join(marks.select(names["v"]), "v")
    near = _kept(near.filter(F.pandas_udf(possible, "boolean")("u_n", "u_bits", "v_n", "v_bits")).select("u", "v"), "pairs", made)
    nodes = _kept(near.select(F.col("u").alias("_key")).union(near.select("v")).distinct(), "nodes", made)

    def whole(batch: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(x).tobytes() for x in batch])

    one = with_keys(docs, nodes, "left_semi").select("_key", F.pandas_udf(whole, "binary")("data").alias("s"))
    sets = _kept(one.groupBy("_key").agg(F.any_value("s").alias("s")), "sets", made)

    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        def of(p: bytes, q: bytes) -> bool:
            m, n = len(p) // 8, len(q) // 8
            both = len(np.intersect1d(np.frombuffer(p, dtype=np.int64), np.frombuffer(q, dtype=np.int64), assume_unique=True))
            return LEAST[1] * both >= LEAST[0] * (m + n - both)

        return pd.Series([of(p, q) for p, q in zip(x, y, strict=True)], dtype="bool")

    both = near.join(sets.select(F.col("_key").alias("u"), F.col("s").alias("x")), "u").join(sets.select(F.col("_key").alias("v"), F.col("s").alias("y")), "v")
    return materialize(both.filter(F.pandas_udf(alike, "boolean")("x", "y")).select("u", "v"), "links")


def _kept(df: DataFrame, label: str, made: list[str]) -> DataFrame:
    """materialize(), with the path noted so that it can be deleted as soon as it has been used."""
    path = shared_path(df.sparkSession, label)
    made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def near_copies(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(docs with _key, a hash of the text; (key, root) of each key in a component of two or more).

    Keys without a link are not listed. Texts without words, null among them, have one key. Texts that differ in letter case or white space alone are alike.
    Repeated rows all stay. A column _key of docs is replaced.
    """
    spark, made = docs.sparkSession, []
    marked = docs.withColumn("_key", key_of(text_col))
    texts = marked.select("_key", utf8(text_col).alias("data"))
    common = broadcast(spark, _common(texts.withColumnRenamed("_key", "key")))

    def of(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for data in batch:
            hashes = shingle_hashes(data, SHINGLE_WORDS)
            found = np.unique(hashes).view(np.int64)
            rows.append((len(found), fingerprint_of(hashes), bitmap(found), *prefix(found, common())))
        return pd.DataFrame(rows, columns=["n", "fp", "bits", "prefix", "rare"])

    features = F.pandas_udf(of, "n long, fp long, bits binary, prefix array<long>, rare long")("data")
    classes = texts.filter("_key <> 0").select(F.col("_key").alias("key"), features.alias("f")).groupBy("key").agg(F.any_value("f").alias("f"))
    classes = _kept(classes.select("key", "f.*"), "classes", made)
    marks = classes.select("key", "n", "bits")

    firsts = _kept(classes.groupBy("fp").agg(F.min("key").alias("first")), "prints", made)
    prints = classes.select("key", "fp").join(firsts, "fp")
    firsts = firsts.withColumnRenamed("first", "key")
    close = link_edges(firsts.select("fp")).join(firsts.select(F.col("fp").alias("u"), F.col("key").alias("ku")), "u").join(firsts.select(F.col("fp").alias("v"), F.col("key").alias("kv")), "v")
    close = close.select(F.greatest("ku", "kv").alias("u"), F.least("ku", "kv").alias("v")).unionByName(prints.filter("key <> first").select(F.col("key").alias("u"), F.col("first").alias("v")))

    links, groups = None, classes.select("key", F.col("key").alias("group"))
    for some, proposed in ((True, close), (True, None), (False, None)):
        shown = F.slice("prefix", F.greatest(F.lit(1), F.size("prefix") - LAST_PLACES + 1), LAST_PLACES) if some else F.col("prefix")
        bits = F.lit(None).cast("binary") if some else F.when(F.col("pos") >= F.col("rare"), F.col("bits"))
        places = classes.join(groups, "key").select("key", "n", "group", "bits", "rare", F.posexplode(shown).alias("pos", "shingle"))
        pairs = _pairs(places.select("shingle", "key", "n", "pos", "group", bits.alias("bits")), some)
        found = _linked(texts, marks, pairs if proposed is None else pairs.unionByName(proposed).distinct(), made)
        links = found if links is None else links.unionByName(found)
        roots = components(links).withColumnRenamed("node", "key")
        groups = classes.select("key").join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("group"))
    roots = materialize(roots, "near-roots")
    for path in made:
        delete_path(spark, path)
    return marked, roots

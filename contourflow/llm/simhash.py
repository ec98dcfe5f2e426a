"""Near duplicates by 64-bit SimHash: BK-trees over shards of fingerprints, then components of the links.

Two fingerprints within a radius r agree on m - r of any m blocks of bits, so the fingerprints are dealt into shards
by the values of each choice of m - r blocks, and a linked pair meets in at least one shard. Each shard's
fingerprints form a BK-tree, a node's children keyed by their Hamming distance to it; a search follows the
edges within the radius only. m follows the number of distinct fingerprints, so that shards stay small; shards
that are still large (a large group of near copies) are dealt again by more blocks, and what remains is dealt
in cells of two bounded parts of a shard. No shard's links are listed: a task keeps a union-find and returns one edge
for each fingerprint that is not alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from contourflow.llm.common import materialize, partitions, utf8
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Expected fingerprints in a shard, from which a further block is added.
EXPECTED_SHARD = 64
#: Fingerprints in a shard's tree; larger shards are dealt again.
LARGEST_TREE = 512
MOST_BLOCKS = 8


def shingle_hashes(data: bytes, width: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of a UTF-8 text, repeats included; a text of fewer words than a shingle's is one shingle, one without words has none."""
    words = data.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(lengths) + np.arange(n)
    starts = (ends - lengths)[: n - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(starts))


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash as a signed 64-bit number: a bit is set if it is set in more than half of the hashes; 0 without any."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 18):
        part = hashes[at : at + (1 << 18)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def simhash_bytes(data: bytes, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Fingerprint of a UTF-8 text; shingles count as often as they occur."""
    return fingerprint_of(shingle_hashes(data, width, seed))


def simhash(text: Column | str, width: int = SHINGLE_WORDS, seed: int = SEED) -> Column:
    """Column of fingerprints (long). Nulls and texts without words give 0."""

    def of(batch: pd.Series) -> pd.Series:
        return pd.Series([simhash_bytes(x, width, seed) for x in batch], dtype="int64")

    return F.pandas_udf(of, "long")(utf8(text))


class BKTree:
    """Children of a node by their Hamming distance to it; a search follows edges within the radius of the distance."""

    __slots__ = ("children", "root", "values")

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new = len(self.values)
        if new:
            node, values, children = 0, self.values, self.children
            while True:
                d = (value ^ values[node]).bit_count()
                if not d:
                    return
                below = children[node].get(d)
                if below is None:
                    children[node][d] = new
                    break
                node = below
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Positions (in order of insertion) of the values within the radius."""
        if not self.values:
            return []
        found, todo, values, children = [], [0], self.values, self.children
        while todo:
            node = todo.pop()
            d = (value ^ values[node]).bit_count()
            if d <= radius:
                found.append(node)
            edges = children[node]
            if edges:
                lo, hi = d - radius, d + radius
                todo.extend(below for key, below in edges.items() if lo <= key <= hi)
        return found


def _linked(tree_of: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between a tree's fingerprints and the queries (all as unsigned)."""
    tree = BKTree()
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def search(x: int) -> None:
        for at in tree.within(x, radius):
            a, b = root(x), root(tree.values[at])
            if a != b:
                parent[max(a, b)] = min(a, b)

    for x in tree_of:
        parent.setdefault(x, x)
        search(x)
        tree.add(x)
    for x in queries:
        parent.setdefault(x, x)
        search(x)
    return [(x, r) for x in parent if (r := root(x)) != x]


def block_masks(n_blocks: int, radius: int) -> list[int]:
    """Masks of each choice of n_blocks - radius of the blocks of 64 bits."""
    edges = [64 * k // n_blocks for k in range(n_blocks + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, n_blocks - radius)]


def blocks_for(n: int, radius: int) -> int:
    """Blocks with which n random fingerprints leave about EXPECTED_SHARD in a shard at most."""
    m = radius + 1
    while m < max(MOST_BLOCKS, radius + 1) and n / 2 ** (64 * (m - radius) // m) > EXPECTED_SHARD:
        m += 1
    return m


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _dealt(fps: DataFrame, n_blocks: int, radius: int) -> DataFrame:
    """(band, value, fp): a row for each shard of each fingerprint."""
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in block_masks(n_blocks, radius)])
    banded = fps.select("fp", F.posexplode(masks).alias("band", "mask"))
    return banded.select("band", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")


def _edges_of_shards(shards: DataFrame, radius: int, keys: list[str]) -> DataFrame:
    """Spanning edges (u, v) of each shard; side 0 makes the tree, side 1 only searches it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tree, queries, edges = None, [], [], []
        for pdf in batches:
            for *key, side, fp in zip(*[pdf[k].tolist() for k in [*keys, "side", "fp"]], strict=True):
                if key != at:
                    if len(tree) + len(queries) > 1:
                        edges += _linked(tree, queries, radius)
                    at, tree, queries = key, [], []
                (queries if side else tree).append(fp & 0xFFFFFFFFFFFFFFFF)
            if len(edges) > 20_000:
                yield pd.DataFrame([(_signed(a), _signed(b)) for a, b in edges], columns=["u", "v"])
                edges = []
        if len(tree) + len(queries) > 1:
            edges += _linked(tree, queries, radius)
        yield pd.DataFrame([(_signed(a), _signed(b)) for a, b in edges], columns=["u", "v"], dtype="int64")

    n = partitions(shards.sparkSession)
    ordered = shards.repartition(n, *keys).sortWithinPartitions(*keys, "side", "fp")
    return ordered.mapInPandas(run, "u long, v long")


def link_edges(fps: DataFrame, radius: int = RADIUS, largest_tree: int = LARGEST_TREE) -> DataFrame:
    """Edges (u, v) whose components are those of all links within the radius. fps: a column fp of distinct longs."""
    n = fps.count()
    m = blocks_for(n, radius)
    found = []
    rest = fps.select("fp")
    levels = [m] + [k for k in (MOST_BLOCKS,) if k > m]
    for level, blocks in enumerate(levels):
        dealt = _dealt(rest, blocks, radius)
        sizes = materialize(dealt.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1"), "shards")
        small = dealt.join(sizes.filter(F.col("n") <= largest_tree).select("band", "value"), ["band", "value"], "left_semi")
        found.append(_edges_of_shards(small.withColumn("side", F.lit(0)), radius, ["band", "value"]))
        hot = sizes.filter(F.col("n") > largest_tree)
        if hot.isEmpty():
            break
        # Fingerprints of a large shard meet again in smaller ones; after the last level, in cells of two parts.
        if level + 1 < len(levels):
            rest = materialize(dealt.join(hot.select("band", "value"), ["band", "value"], "left_semi").select("fp").distinct(), "again")
        else:
            parts = dealt.join(hot, ["band", "value"]).withColumn("parts", F.ceil(F.col("n") / F.lit(largest_tree // 2)))
            parts = parts.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
            other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
            cells = parts.select("band", "value", "part", "fp", other.alias("other"))
            low, high = F.least("part", "other"), F.greatest("part", "other")
            cells = cells.select("band", "value", low.alias("low"), high.alias("high"), (F.col("part") > F.col("other")).cast("int").alias("side"), "fp")
            found.append(_edges_of_shards(cells, radius, ["band", "value", "low", "high"]))
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges.distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node of each component, by alternating large and small stars.

    edges: u, v (longs). Every round cuts the lineage with a table in the shared folder and ends with stars; the roots
    are found when a round changes no edge. Nodes without an edge do not appear.
    """
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.filter("u <> v"), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = materialize(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
    raise RuntimeError(f"the components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = SHINGLE_WORDS, largest_tree: int = LARGEST_TREE) -> DataFrame:
    """One row a document: (id_col, fingerprint as 16 hex digits, component_id, n_copies).

    component_id is the smallest id of the documents reachable by links of at most `radius` differing bits, n_copies
    the number of rows with the same fingerprint. Null and empty texts have the fingerprint zero, which links as any other. A null
    id keeps its row; a component of null ids only has a null component_id. Repeated rows all stay. Other columns are not looked at.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    prints = materialize(own.select("id", simhash("t", width).alias("fp")), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least_id"), F.count("*").alias("n_copies")), "distinct")
    roots = components(link_edges(distinct, radius, largest_tree))
    named = materialize(roots.join(distinct, roots["node"] == distinct["fp"]).select("fp", "root", "least_id"), "roots")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    classes = distinct.join(named, "fp", "left").select("fp", "n_copies", F.coalesce("component_id", "least_id").alias("component_id"))
    out = prints.join(materialize(classes, "classes"), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies")

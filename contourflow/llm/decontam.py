"""Benchmark decontamination by a prefix-filtered set join.

Every window of an item (13 consecutive words, or all words of a shorter item) is a set of tokens that a document's window must contain
in full, so by the prefix filter one token is enough to meet: the rarest of the window, by the number of documents that hold it. A
document is looked up by its words alone; where a prefix token stands, the window's length and the token's place in it say
where the window would have to begin and end, and the words there are compared.

The benchmark goes to the executors in blocks of a checked size, each a pass over the documents; the documents are never shuffled.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from contourflow.llm.common import broadcast, free_name, materialize, utf8
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
SHARE = 20  # a document is contaminated if one word in so many is hit
#: Bytes of benchmark text in a block that is broadcast.
BLOCK_BYTES = 16 << 20

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

Index = dict[bytes, list[tuple[int, list[bytes], list[str]]]]


def split_words(data: bytes) -> list[bytes]:
    return data.translate(_WORDS).split()


def item_windows(items: list[tuple[str, bytes]], width: int = WINDOW) -> dict[tuple[bytes, ...], list[str]]:
    """Distinct windows with the ids of the items that hold them."""
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, data in items:
        words = split_words(data)
        if words:
            for at in range(max(1, len(words) - width + 1)):
                found[tuple(words[at : at + width])].add(item)
    return {w: sorted(ids) for w, ids in found.items()}


def prefix_index(windows: dict[tuple[bytes, ...], list[str]], frequency: dict[bytes, int]) -> Index:
    """Windows by their rarest token (ties by the token), each with that token's place in it."""
    index: Index = defaultdict(list)
    for window, ids in windows.items():
        rarest = min(window, key=lambda w: (frequency.get(w, 0), w))
        index[rarest].append((window.index(rarest), list(window), ids))
    return dict(index)


def hits(words: list[bytes], index: Index) -> tuple[list[tuple[int, int]], list[str]]:
    """Spans of words (begin, end) of the occurring windows, merged, and the sorted ids of their items."""
    if index.keys().isdisjoint(words):
        return [], []
    n, spans, ids = len(words), [], set()
    for at, word in enumerate(words):
        for place, window, items in index.get(word, ()):
            begin = at - place
            end = begin + len(window)
            if begin >= 0 and end <= n and words[begin:end] == window:
                spans.append((begin, end))
                ids.update(items)
    spans.sort()
    merged: list[tuple[int, int]] = []
    for begin, end in spans:
        if merged and begin <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((begin, end))
    return merged, sorted(ids)


def _frequency(texts: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Number of documents that hold each word of the vocabulary, over all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()
        for pdf in batches:
            for data in pdf["data"]:
                seen.update(vocabulary.intersection(split_words(data)))
        if seen:
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())}).astype({"n": "int64"})

    total = texts.select("data").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in total.collect()}


def _scan(docs: DataFrame, items: list[tuple[str, bytes]], text: str, width: int, into: str) -> DataFrame:
    """docs with a column `into`: struct of n_words, spans (begin, end, begin, ...) and item ids, for the items of one block."""
    windows = item_windows(items, width)
    index = prefix_index(windows, _frequency(docs.select(utf8(text).alias("data")), {w for window in windows for w in window})) if windows else {}
    shared = broadcast(docs.sparkSession, index)

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch:
                words = split_words(data)
                spans, ids = hits(words, shared())
                rows.append((len(words), [x for span in spans for x in span], ids))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return docs.withColumn(into, F.pandas_udf(scan, "n_words long, spans array<int>, items array<string>")(utf8(text)))


def _union_of(lists: list) -> list[int]:
    spans: list[list[int]] = []
    for b, e in sorted((int(x[k]), int(x[k + 1])) for x in lists for k in range(0, len(x), 2)):
        if spans and b <= spans[-1][1]:
            spans[-1][1] = max(e, spans[-1][1])
        else:
            spans.append([b, e])
    return [x for s in spans for x in s]


def _scan_blocks(docs: DataFrame, blocks: list[DataFrame], text: str, width: int, into: str) -> DataFrame:
    """docs with a column `into` over several blocks: each is a pass of its own, whose hits meet by the text's hashes."""
    key, hit = free_name(docs, "_key"), free_name(docs, "_hit")
    docs = docs.withColumn(key, F.sha2(utf8(text), 256))
    parts = [_scan(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), [(r["item"], bytes(r["data"])) for r in block.collect()], "text", width, "found").select("key", "found").filter("size(found.items) > 0") for block in blocks]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)

    @F.pandas_udf("array<int>")
    def union(column: pd.Series) -> pd.Series:
        return pd.Series([_union_of(lists) for lists in column])

    kept = rows.groupBy("key").agg(F.first("found.n_words").alias("n_words"), F.collect_set("found.spans").alias("lists"), F.collect_set("found.items").alias("items"))
    kept = materialize(kept.select(F.col("key").alias(key), F.struct("n_words", union("lists").alias("spans"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items")).alias(hit)), "hits")
    nothing = _scan(docs, [], text, width, into)
    return nothing.join(kept, key, "left").withColumn(into, F.coalesce(hit, into)).drop(hit, key)


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, share: int = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated, spans and items (columns of these names are replaced, all others stay).

    Words are runs of a-z, 0-9 and non-ASCII code points after lower-casing A-Z. spans are the hit ranges of words, begin and end in turn.
    Null and empty texts have no words and no hits; so have items. Items of one id count once; an item with a null id is listed as an empty
    string. Repeated rows all stay. An empty benchmark hits nothing.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), utf8(item_text_col).alias("data"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("data") + 64), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_bytes))
    into = free_name(docs, "_found")
    if n_blocks == 1:
        rows = _scan(docs, [(r["item"], bytes(r["data"])) for r in items.collect()], text_col, width, into)
    else:
        rows = _scan_blocks(docs, [items.filter(F.pmod(F.xxhash64("item", "data"), F.lit(n_blocks)) == k) for k in range(n_blocks)], text_col, width, into)
    sign = F.transform(F.col(into)["spans"], lambda x, k: F.when(k % 2 == 1, x).otherwise(-x))
    n_hit = F.aggregate(sign, F.lit(0).cast("long"), lambda a, x: a + x)
    found = {
        "n_words": F.col(into)["n_words"],
        "n_hit": n_hit,
        "n_items": F.size(F.col(into)["items"]).cast("long"),
        "items_sha256": F.sha2(F.array_join(F.col(into)["items"], ","), 256),
        "contaminated": (n_hit > 0) & (share * n_hit >= F.col(into)["n_words"]),
        "spans": F.col(into)["spans"],
        "items": F.col(into)["items"],
    }
    return rows.withColumns(found).drop(into)

"""Quality by gradient-boosted trees over document statistics, grown on histograms and flattened into arrays.

Statistics are shares and means of a whole text, so they do not depend on its length alone. Trees are grown leaf-wise on binned
statistics from a bounded sample of labelled rows. The trees' nodes lie in flat arrays, and a batch of documents walks all
of them with numpy, one step of depth at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from contourflow.llm.common import broadcast, utf8
from contourflow.llm.toxicity import sample_labels
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the fit reads at most, and bytes of the longest text among them.
MOST_ROWS = 8000
BINS = 64
TREES = 80
LEAVES = 12
RATE = 0.15
LEAST_IN_LEAF = 5
L2 = 2.0

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "deviation_word", "share_upper", "share_lower", "share_digit", "share_space", "share_newline", "share_ascii_marks",
    "share_other_bytes", "byte_entropy", "distinct_words", "top_word", "word_entropy", "same_as_last", "words_without_letters", "words_with_marks", "long_words",
    "distinct_lines", "mean_line", "bars", "share_short_lines", "distinct_pairs",
)

_MARKS = np.array([33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 for b in range(256)])
_NO_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128))
_MARK_BYTES = bytes(b for b in range(256) if _MARKS[b] and b not in b".,;:!?'\"-()")


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum())


def statistics(data: bytes) -> list[float]:
    """STATISTICS of a UTF-8 text; zeros for one without bytes."""
    n = len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    hist = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = data.split()
    m = max(1, len(words))
    counted = Counter(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    frequency = np.fromiter(counted.values(), dtype=np.int64, count=len(counted)) if counted else np.ones(1, dtype=np.int64)
    letterless = sum(c for w, c in counted.items() if not w.translate(None, _NO_LETTERS))
    marked = sum(c for w, c in counted.items() if len(w.translate(None, _MARK_BYTES)) != len(w))
    lines = [x for x in data.split(b"\n") if x]
    k = max(1, len(lines))
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(lengths.mean()), float(lengths.std()),
        float(hist[65:91].sum() / n), float(hist[97:123].sum() / n), float(hist[48:58].sum() / n), float(hist[32] / n), float(hist[10] / n), float(hist[_MARKS].sum() / n),
        float(hist[128:].sum() / n), _entropy(hist), len(counted) / m, float(frequency.max() / m), _entropy(frequency) / float(np.log2(m + 1)), sum(map(eq, words, words[1:])) / m,
        letterless / m, marked / m, float((lengths > 20).sum() / m), len(set(lines)) / k, float(np.log1p(n / k)), float(hist[124] / m), sum(len(x) < 20 for x in lines) / k,
        len(set(zip(words, words[1:], strict=False))) / m,
    ]


@dataclass
class Forest:
    """All trees' nodes in flat arrays; a leaf is its own child. roots: each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        """x: rows by statistics."""
        if not len(self.roots):
            return np.full(len(x), self.base)
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -50, 50)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, leaves: int = LEAVES, rate: float = RATE, bins: int = BINS, least: int = LEAST_IN_LEAF, l2: float = L2) -> Forest:
    """Boost the log loss with trees of at most `leaves` leaves, each split the best over histograms of gradients."""
    n, m = x.shape
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(m)], axis=1)
    offset = np.arange(m) * bins
    feature, threshold, left, right, value, roots, deepest = [], [], [], [], [], [], 0
    z = np.full(n, base)

    def node() -> int:
        feature.append(0), threshold.append(np.inf), left.append(len(left)), right.append(len(right)), value.append(0.0)
        return len(feature) - 1

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
        keys = (binned[rows] + offset).ravel()
        sums = [np.bincount(keys, weights=np.repeat(a, m) if a is not None else None, minlength=m * bins).reshape(m, bins).cumsum(axis=1) for a in (g[rows], h[rows], None)]
        gl, hl, cl = sums
        gt, ht, ct = gl[:, -1:], hl[:, -1:], cl[:, -1:]
        gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
        gain[(cl < least) | (ct - cl < least)] = -np.inf
        at = int(gain.argmax())
        return float(gain.flat[at]), at // bins, at % bins

    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        root = node()
        roots.append(root)
        open_leaves = {root: (np.arange(n), 0)}
        splits = {root: best(np.arange(n), g, h)}
        while len(open_leaves) < leaves:
            at = max(splits, key=lambda k: (splits[k][0], -k))
            gain, f, b = splits[at]
            if gain <= 1e-6:
                break
            rows, depth = open_leaves.pop(at)
            del splits[at]
            goes_left = binned[rows, f] <= b
            feature[at], threshold[at] = f, float(edges[f][b])
            left[at], right[at] = node(), node()
            for child, part in ((left[at], rows[goes_left]), (right[at], rows[~goes_left])):
                open_leaves[child], splits[child] = (part, depth + 1), best(part, g, h)
            deepest = max(deepest, depth + 1)
        for leaf, (rows, _) in open_leaves.items():
            value[leaf] = -rate * float(g[rows].sum()) / (float(h[rows].sum()) + l2)
            z[rows] += value[leaf]
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), deepest, base)


def statistics_column(text: str | Column) -> Column:
    """array<double> of STATISTICS; null counts as empty."""

    def of(batch: pd.Series) -> pd.Series:
        return pd.Series([statistics(x) for x in batch])

    return F.pandas_udf(of, "array<double>")(utf8(text))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "quality", held_out_of: int = 5, most_rows: int = MOST_ROWS) -> Forest:
    """Learn from `most_rows` labelled rows at most, their whole texts; ids whose crc32 mod held_out_of is 0 are never read.

    Null ids and labels are left out; a null text has all statistics zero. Documents that repeat a labelled id are all learned from. Of splits of equal gain
    the first by statistic and bin is taken. Without both labels the forest is a constant: low where label 1 is missing. Other columns are not looked at.
    """
    chosen = F.broadcast(sample_labels(labels, target, id_col, held_out_of, most_rows, balanced=False))
    own = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"))
    rows = own.join(chosen, "label_id").select("label_id", "label", statistics_column("text").alias("x")).limit(2 * most_rows).collect()
    rows.sort(key=lambda r: (str(r["label_id"]), r["x"]))
    y = np.array([r["label"] for r in rows], dtype=float)
    if not len(rows) or y.min() == y.max():
        none = np.zeros(0, dtype=np.int64)
        return Forest(none, none.astype(float), none, none, none.astype(float), none, 0, 4.0 if len(rows) and y[0] else -4.0)
    return grow(np.array([r["x"] for r in rows]), y)


def scores(forest: Forest, texts: Sequence[bytes]) -> np.ndarray:
    """Each UTF-8 text's score."""
    x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS))
    return np.concatenate([forest.score(x[k : k + 4096]) for k in range(0, max(1, len(x)), 4096)])


def score(docs: DataFrame, forest: Forest, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with a score in [0, 1] of each whole text, 1 for good; null and empty texts have all statistics zero.

    A column named as `into` is replaced, all others stay. Repeated rows all stay, with equal scores; an empty table stays empty; a very long text is in memory once.
    """
    shared = broadcast(docs.sparkSession, forest)

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(scores(shared(), batch))

    return docs.withColumn(into, F.pandas_udf(of, "double")(utf8(text_col)))

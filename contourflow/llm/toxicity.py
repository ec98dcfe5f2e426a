"""Toxicity by a counterfactually regularised linear classifier.

Features are the words of a text and their beginnings (which catch inflected forms). The classifier is a logistic regression; for each
labelled text that names a group, texts with the identity terms swapped are scored as well, and the squared change of
the score is added to the loss, so that the mention of a group as such carries no weight. Fitting uses a bounded sample
of labelled rows; scoring reads whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from contourflow.llm.common import broadcast, fold, materialize, unit_hash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identity terms by kind; a term is swapped for the others of its kind.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "citizens", "locals"),
    ("deaf", "blind", "disabled", "autistic"),
    ("femmes", "hommes", "filles"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulman", "chrétien", "juif"),
    ("muslimisch", "christlich", "jüdisch"),
    ("musulmanes", "cristianos", "judíos"),
)
#: Labelled rows that the fit reads at most, and code points of the longest text among them.
MOST_ROWS = 8000
MOST_FEATURES = 4096
LEAST_DOCUMENTS = 3
BEGINNINGS = (4, 5, 6)
PENALTY = 4.0
L2 = 0.02

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(words: set[str]) -> set[str]:
    """Words, and their beginnings with an ellipsis."""
    out = set(words)
    for n in BEGINNINGS:
        out.update(w[:n] + "…" for w in words if len(w) >= n)
    return out


def swaps(terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> dict[str, tuple[str, ...]]:
    return {t: tuple(x for x in kind if x != t) for kind in terms for t in kind}


def counterfactuals(words: set[str], table: dict[str, tuple[str, ...]], most: int = 3) -> list[set[str]]:
    """Word sets with every identity term swapped for the k-th other of its kind, k = 0 .. most - 1."""
    named = sorted(words & table.keys())
    if not named:
        return []
    rest = words.difference(named)
    return [rest | {table[t][k % len(table[t])] for t in named} for k in range(most)]


class Model:
    """Weights of features and a bias; a text's score is the logistic function of their sum."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.words = {w for w in weights if not w.endswith("…")}
        self.stems = [{w for w in weights if w.endswith("…") and len(w) == n + 1} for n in BEGINNINGS]

    def logit(self, words: set[str]) -> float:
        total, weights = self.bias, self.weights
        for w in sorted(words & self.words):
            total += weights[w]
        for n, stems in zip(BEGINNINGS, self.stems, strict=True):
            if stems:
                for w in sorted(stems.intersection({w[:n] + "…" for w in words if len(w) >= n})):
                    total += weights[w]
        return total

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.logit(words_of(text)), -500, 500))))


def solve(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], n_features: int, penalty: float = PENALTY, l2: float = L2, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on the class-balanced log loss, with penalty * mean squared change over
    pairs (features of a text, features of its counterfactual) and an l2 term."""
    n = len(rows)
    lengths = np.array([len(r) for r in rows])
    at = np.repeat(np.arange(n), lengths)
    cols = np.concatenate(rows) if lengths.sum() else np.zeros(0, dtype=np.int64)
    n_pos = max(1, int(labels.sum()))
    n_neg = max(1, n - int(labels.sum()))
    share = np.where(labels == 1, 0.5 / n_pos, 0.5 / n_neg)
    # A pair's change of score is linear in the weights: +1 for a text's features, -1 for its counterfactual's.
    p_at = np.concatenate([np.full(len(a) + len(b), k) for k, (a, b) in enumerate(pairs)]) if pairs else np.zeros(0, dtype=np.int64)
    p_cols = np.concatenate([np.concatenate(p) for p in pairs]) if pairs else np.zeros(0, dtype=np.int64)
    p_sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in pairs]) if pairs else np.zeros(0)
    w, v, bias, v_bias = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    widest = max(1.0, float(lengths.max(initial=1)))
    rate = 1.0 / (0.25 * (np.sqrt(widest) + 1) + l2 + 2 * penalty * (np.bincount(p_at, minlength=1).max() if len(p_at) else 0))
    for step in range(steps):
        momentum = step / (step + 3)
        look, look_bias = w + momentum * v, bias + momentum * v_bias
        z = np.bincount(at, weights=look[cols], minlength=n) + look_bias
        error = share * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels)
        slope = np.bincount(cols, weights=error[at], minlength=n_features) + l2 / 100 * look
        if len(pairs):
            change = np.bincount(p_at, weights=p_sign * look[p_cols], minlength=len(pairs))
            slope += 2 * penalty / len(pairs) * np.bincount(p_cols, weights=p_sign * change[p_at], minlength=n_features)
        v, v_bias = momentum * v - rate * slope, momentum * v_bias - rate * error.sum()
        w, bias = w + v, bias + v_bias
    return w, float(bias)


def sample_labels(labels: DataFrame, target: str, id_col: str, held_out_of: int, most: int, balanced: bool = True) -> DataFrame:
    """(label_id, label): labelled ids outside the held-out fold, `most` at most, chosen by a hash of the id.

    balanced: half of them of either label, as far as there are enough; else as many of each as there are in all labels.
    """
    known = labels.filter(F.col(target).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("label_id")).agg((F.max(target) > 0).cast("int").alias("label"))
    known = known.filter(fold(F.col("label_id"), held_out_of) != 0)
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not balanced:
        chosen = known.filter(unit_hash(F.col("label_id"), seed=target) < most / max(1, sum(counts.values())))
        return chosen.orderBy(unit_hash(F.col("label_id"), seed=target), "label_id").limit(most)
    room = {k: max(most // 2, most - counts.get(1 - k, 0)) for k in (0, 1)}
    rate = F.when(F.col("label") == 1, F.lit(room[1] / max(1, counts.get(1, 0)))).otherwise(F.lit(room[0] / max(1, counts.get(0, 0))))
    chosen = known.filter(unit_hash(F.col("label_id"), seed=target) < rate)
    return chosen.orderBy(unit_hash(F.col("label_id"), seed=target), "label_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "toxic", held_out_of: int = 5, most_rows: int = MOST_ROWS, most_features: int = MOST_FEATURES, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, penalty: float = PENALTY) -> Model:
    """Learn from `most_rows` labelled rows at most, their whole texts; ids whose crc32 mod held_out_of is 0 are never read.

    Null ids, labels and texts are left out. Documents that repeat a labelled id are all learned from. Ties between features go by their names. Without
    both labels the model is a constant: low where label 1 is missing. Other columns are not looked at.
    """
    chosen = F.broadcast(sample_labels(labels, target, id_col, held_out_of, most_rows))
    own = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    train = materialize(own.join(chosen, "label_id").select("label_id", "label", "text"), "labelled")
    table = swaps(terms)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter[str], Counter[str]] = Counter(), Counter()
        for pdf in batches:
            for label, text in zip(pdf["label"].tolist(), pdf["text"], strict=True):
                seen[label].update(features(words_of(text)))
        both = list(seen[0] | seen[1])
        for at in range(0, len(both), 20_000):
            part = both[at : at + 20_000]
            yield pd.DataFrame({"feature": part, "neg": [seen[0][f] for f in part], "pos": [seen[1][f] for f in part]}).astype({"neg": "int64", "pos": "int64"})

    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return Model({}, 4.0 if n_pos else -4.0)
    counts = train.mapInPandas(count, "feature string, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    # How far the shares of the two classes are apart, in standard errors; features within two are left out.
    share = (F.col("pos") + F.col("neg") + 1) / (n_pos + n_neg + 2)
    apart = F.abs(F.col("pos") / n_pos - F.col("neg") / n_neg) / F.sqrt(share * (1 - share) * (1 / n_pos + 1 / n_neg))
    frequent = counts.filter(F.col("pos") + F.col("neg") >= LEAST_DOCUMENTS).withColumn("apart", apart)
    best = frequent.filter("apart > 2").orderBy(F.desc("apart"), "feature").limit(most_features).select("feature").collect()
    named = [r["feature"] for r in frequent.filter(F.col("feature").isin(list(table))).select("feature").orderBy("feature").collect()]
    index = {f: k for k, f in enumerate(dict.fromkeys([*(r["feature"] for r in best), *named]))}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [words_of(t) for t in pdf["text"]]
            ids = [sorted(index[f] for f in features(w) & index.keys()) for w in words]
            other = [[sorted(index[f] for f in features(c) & index.keys()) for c in counterfactuals(w, table)] for w in words]
            yield pd.DataFrame({"label_id": pdf["label_id"], "label": pdf["label"], "ids": ids, "other": other})

    kind = train.schema["label_id"].dataType.simpleString()
    rows = train.mapInPandas(encode, f"label_id {kind}, label int, ids array<int>, other array<array<int>>").limit(2 * most_rows).collect()
    rows.sort(key=lambda r: (str(r["label_id"]), r["ids"]))
    ids = [np.array(r["ids"], dtype=np.int64) for r in rows]
    pairs = [(a, np.array(b, dtype=np.int64)) for a, r in zip(ids, rows, strict=True) for b in r["other"]]
    w, bias = solve(ids, np.array([r["label"] for r in rows]), pairs, len(index), penalty)
    return Model({f: float(w[k]) for f, k in index.items() if abs(w[k]) > 1e-6}, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with a score in [0, 1] of each whole text, 1 for toxic; null and empty texts get the score of the bias alone.

    A column named as `into` is replaced, all others stay. Repeated rows all stay, with equal scores; an empty table stays empty; a very long text is a set of its distinct words.
    """
    shared = broadcast(docs.sparkSession, model)

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared()
        for batch in batches:
            yield pd.Series([m.score(t) for t in batch], dtype="float64")

    return docs.withColumn(into, F.pandas_udf(of, "double")(F.col(text_col)))

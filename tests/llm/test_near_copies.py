"""The pipeline's near-duplicate stage against plain likeness of all pairs."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute
import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    return sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").collect()), key=str)


def test_edited_copies_go_and_texts_less_alike_stay(spark):
    rng, rows = np.random.default_rng(5), []
    stock = [f"stock{k}" for k in range(12)]
    for k in range(80):
        words = [f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(8, 200)))]
        rows.append((10 * k, " ".join(words + stock * (k % 3 == 0))))
        for edits in range(1, int(rng.integers(1, 6))):
            copy = list(words)
            for at in rng.integers(0, len(copy), edits):
                copy[at] = "Edited"
            rows.append((10 * k + edits, " ".join(copy + stock * (k % 3 == 0))))
    rows += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A  b"), (2004, "a c")]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    likeness = {(a, b): brute.shingle_likeness(rows[a][1] or "", rows[b][1] or "") for a in range(len(rows)) for b in range(a)}
    for (a, b), x in likeness.items():
        if x >= 0.8 and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert sum(0.8 <= x < 0.95 for x in likeness.values()) > 20 and sum(0.5 < x < 0.8 for x in likeness.values()) > 20
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    assert [i for i, _ in kept(spark, rows)] == sorted(least.values(), key=str)


def test_repeated_and_null_ids_go_by_their_own_texts(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(None, a), (None, b), (5, b), (7, c), (7, d), (6, d), (8, a + " more"), (None, "alone"), (9, c), (9, c)]
    # 8 stands for a, 5 for b, 7 for c, 6 for d; the null id for its lone text.
    assert kept(spark, rows) == sorted([(8, a + " more"), (5, b), (7, c), (6, d), (None, "alone")], key=str)

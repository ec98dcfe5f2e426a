"""The pipeline's stages against plain versions on a small corpus, the whole run, and the SQL of the operators that have one."""

import os
import sys
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute
import corpus_pipeline
from contourflow.llm import queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FILLER = [f"{a}{b}" for a in ("ba", "co", "du", "fi", "ge", "ho", "ki", "lu", "mo", "ne") for b in ("rat", "sel", "tin", "vos", "wen", "xir", "yal", "zup")]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Plain, toxic, copied and contaminated documents, nulls, repeated rows; where they lie and their rows."""
    rng, folder = np.random.default_rng(11), tmp_path_factory.mktemp("corpus")
    items = [(k, " ".join(rng.choice(FILLER, 30))) for k in range(4)] + [(9, "short bench item")]
    rows, toxic = [], set()
    for k in range(300):
        words = list(rng.choice(FILLER, int(rng.integers(20, 90))))
        if k % 6 == 1:
            words.insert(5, "idiot" if k % 12 == 1 else "moron")
            toxic.add(k)
        if k % 25 == 3:
            words[3:3] = items[k % 4][1].split()[:20]
        rows.append((k, " ".join(words), "en", None if k % 11 == 0 else f"s{k % 3}", k))
    rows += [(400 + k, rows[k][1], "en", "s1", 1) for k in range(0, 30, 2)] + [(500, "x short bench item y", "en", "s0", 1), (501, None, None, None, None), (502, "", "en", "s0", 0), (502, "", "en", "s0", 0), (None, "only a null id here", "en", "s2", 3)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    return f"file://{folder}", rows, toxic, items


@pytest.fixture(scope="module")
def staged(spark, corpus):
    """Rows after each stage, the documents first."""
    docs, out = spark.createDataFrame(corpus[1], DOCS), [corpus[1]]
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, corpus[0])
        out.append([tuple(r) for r in made.collect()])
        docs = spark.createDataFrame(out[-1], made.schema)
    return out


def test_toxic_documents_go_and_clean_ones_stay(corpus, staged):
    copies = {400 + k for k in range(0, 30, 2) if k in corpus[2]}
    assert Counter(staged[1]) == Counter(r for r in corpus[1] if r[0] not in corpus[2] | copies)


def test_one_of_each_group_stays(staged):
    rows = [(r[0], brute.simhash(r[1])) for r in staged[1]]
    keep = {(i, f) for (i, f), c in zip(rows, brute.components(rows), strict=True) if i == c}
    assert Counter((r[0], brute.simhash(r[1])) for r in staged[2]) == Counter(dict.fromkeys(keep, 1))


def test_contaminated_documents_go(corpus, staged):
    assert Counter(staged[3]) == Counter(r for r in staged[2] if not brute.contamination(r[1], corpus[3])[4])
    assert len(staged[3]) < len(staged[2])


def test_sources_come_near_their_targets(staged):
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in staged[3]:
        n = len(brute.words(r[1]))
        sizes[r[3]] += n
        largest[r[3]] = max(largest[r[3]], n)
    for r in staged[4]:
        taken[r[3]] += len(brute.words(r[1]))
    aims = brute.targets(dict(sizes))
    assert all(abs(taken[s] - aims[s]) <= largest[s] for s in sizes)
    assert max(Counter(staged[4]).values()) <= 3 and set(staged[4]) <= set(staged[3])


def test_all_rows_get_slots(staged):
    slots = defaultdict(list)
    for r in staged[5]:
        slots[r[4]].append(r[5])
    assert sum(map(len, slots.values())) == len(staged[4]) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_gives_what_the_stages_give(spark, corpus, staged):
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, corpus[0]).select("doc_id", "shard").collect()) == Counter((r[0], r[4]) for r in staged[5])


def test_stages_of_nothing(spark, corpus):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus[0]).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_operator_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    expect = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF).select(*expect.columns)
    assert Counter(map(tuple, got.collect())) == Counter(expect.fetchall())

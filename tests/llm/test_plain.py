"""Operators against versions of their own that share no code with them: hashes, keys, weights and sizes worked out row by row."""

import math
import struct
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
import zstandard

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute
import corpus_pipeline
from contourflow.llm import decontam, langid, mixing, quality, queries, sketch, suffix_tree, toxicity, warc
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def chained(*values):
    """XXH64 of values in turn, each seeded by the hash before it; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", v) if isinstance(v, int) else v.encode(), h)
    return signed(h)


def test_sketches_hold_the_smallest_shingle_hashes(spark, documents):
    texts = [t for _, t, _ in documents[:60]] + ["one two", "", "Ein Wort ÄÖ viel"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, t string")
    got = {r["id"]: list(r["sketch"]) for r in sketch.with_sketch(df, F.col("t"), "sketch").collect()}
    for k, t in enumerate(texts):
        ws = [chained(w) for w in brute.words((t or "").lower())]
        hs = {chained(*ws[a : a + 5]) for a in range(len(ws) - 4)} if len(ws) >= 5 else ({chained(*ws)} if ws else set())
        assert got[k] == sorted(hs)[:128]


def test_the_mix_takes_rows_in_the_order_of_their_keys(spark, documents):
    weights = {i: 2.0 if i % 3 == 0 else 0.5 for i, _, _ in documents if i % 2}
    docs = spark.createDataFrame([(i, t, s) for i, t, s in documents], "doc_id long, text string, source string")
    weight_of = spark.createDataFrame(list(weights.items()), "label_id long, quality_weight double")
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, weight_of=weight_of).collect()}
    sizes, keys = defaultdict(int), defaultdict(list)
    for i, t, s in documents:
        n = len(brute.words(t))
        u = (((chained(i, chained(t), "mix")) & 0xFFFFFFFFFFFFFFFF) >> 11) + 0.5
        keys[s].append((-math.log(u / (1 << 53)) / weights.get(i, 1.0), i, n))
        sizes[s] += n
    for s, aim in brute.targets(dict(sizes)).items():
        whole = int(aim // sizes[s])
        left = math.floor(aim) - whole * sizes[s]
        for _, i, n in sorted(keys[s]):
            assert got[i] == whole * n + max(0, min(n, left))
            left -= n


def test_languages_equal_plain_compression(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    how = zstandard.ZstdCompressionParameters(**langid.COMPRESSION, write_checksum=False, write_content_size=False, write_dict_id=False)
    got = {r["doc_id"]: (r["lang_pred"], r["margin"]) for r in langid.predict(docs, model).collect()}
    for i, t, _ in documents[:40]:
        if not any(c.isalpha() for c in t or ""):
            assert got[i][0] == "und"
            continue
        data = langid.letters(t)
        sizes = {}
        for lang, content in model.dictionaries.items():
            made = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)
            sizes[lang] = sum(len(made.compress(data[k : k + langid.CHUNK])) for k in range(0, len(data), langid.CHUNK))
        least, second = sorted(sizes.values())[:2]
        assert sizes[got[i][0]] == least and got[i][1] == pytest.approx((second - least) / second)


def test_dictionaries_hold_the_most_frequent_words_of_whole_texts(spark):
    rows = [(k, "1234 " * 200 + "foreign " * 100 + "middle " * 200 + "ending " * 150, "en") for k in range(1, 40)]
    rows += [(k, "5678 " * 200 + "späteres Wort", "de") for k in range(100, 140)] + [(k, f"only {k}", f"l{k}") for k in range(1000, 1300)]
    made = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).dictionaries
    assert made["en"] == b"foreign ending middle" and set(made["de"].split()) == {"späteres".encode(), b"wort"} and len(made) > 220


def test_toxicity_is_the_logistic_of_a_plain_sum(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for r in docs.limit(60).collect():
        found = toxicity.features(toxicity.words_of(r["text"]))
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-(model.bias + sum(model.weights.get(f, 0.0) for f in sorted(found))))), abs=1e-9)


def test_columns_of_the_caller_stay(spark):
    docs = spark.createDataFrame([(1, "a short bench item here", 7, 8, 9)], "doc_id long, text string, _found long, _key long, _hit long")
    items = spark.createDataFrame([(1, "short bench item"), (2, "nothing of it")], "item_id long, text string")
    for block in (1 << 20, 8):
        row = decontam.annotate(docs, items, block_bytes=block).first()
        assert (row["_found"], row["_key"], row["_hit"], row["n_hit"], row["n_words"]) == (7, 8, 9, 3, 5)


def test_equal_ids_of_two_sources_are_mixed_apart(spark):
    rows = [(k, f"word{k} " * 8, "en", s, 1) for k in range(40) for s in ("a", "b")]
    made = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, DOCS), SF)
    taken = Counter()
    for r in made.collect():
        taken[r["source"]] += len(r["text"].split())
    aims = brute.targets({"a": 320, "b": 320})
    assert all(abs(taken[s] - aims[s]) <= 8 for s in "ab")


def test_stages_with_repeats_ties_nulls_and_clashing_names(spark):
    rows = [(1, "same text of some words here", "en", "a", 1)] * 3 + [(None, "same text of some words here", None, None, None), (2, None, None, "a", 0), (2, None, None, "a", 0), (3, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("_key", "chosen", "_found", "_toxic", "n", "id", "times", "_hash", "_k")})
    sizes = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sizes.append(docs.count())
    assert sizes[:3] == [7, 2, 2] and sizes[3] >= 1  # one of the texts, one without words


def test_shards_of_equal_bytes_and_files_that_do_not_hang_on_partitions(spark, tmp_path):
    rng = np.random.default_rng(2)
    pages = spark.createDataFrame([(k, f"http://x/{k}", "".join(rng.choice(list("abcdef"), 4000 if k < 20 else 40))) for k in range(400)], "page_id long, url string, html string")
    made = [warc.write(pages.repartition(n), f"file://{tmp_path}/{n}", shard_bytes=20_000).orderBy("file").collect() for n in (1, 7)]
    assert made[0] == made[1] and len(made[0]) > 10
    assert max(r["records"] for r in made[0]) < 60 and sum(r["records"] for r in made[0]) == 400

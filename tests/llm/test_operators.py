"""Each operator against its plain version, on the smallest tables and on small odd ones."""

import hashlib
import math
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute
from contourflow.llm import common, decontam, langid, mixing, quality, queries, sharding, simhash, sketch, suffix_tree, toxicity, warc
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


#: Nulls in every column, empty and blank texts, ties, repeated rows, a long text, unusual letters.
ODD = [
    (5, "the same words stand here twice over and over", "en", "b", 1),
    (5, "the same words stand here twice over and over", "en", "b", 1),
    (2, "the same words stand here twice over and over", "en", None, 1),
    (None, "the same words stand here twice over and over", None, "a", None),
    (None, None, None, None, None),
    (7, None, "en", "b", 0),
    (8, "", "fr", "", 0),
    (9, " \t\n ", None, "a", 4),
    (10, "ÉTÉ\x0b\x0cΩmega ß İstanbul 𝛼𝛽 12 %%", "fr", "a", 3),
    (11, "12 %% 34", "fr", "ä", 3),
    (12, "long " * 40_000 + "end", "en", "b", 3),
    (-3, "one", "en", "z", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    # A clashing column of each name that the operators use within.
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("x") for c in ("id", "fp", "key", "size", "score", "bucket", "data", "_found", "n_words", "block", "shard", "t")}).repartition(3)


def bag(rows):
    return Counter(tuple(r) for r in rows)


# -- simhash ----------------------------------------------------------------------------------------------------------------


def test_op9_equals_all_pairs(spark, documents):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, SF).collect()}
    rows = [(i, brute.simhash(t)) for i, t in documents]
    assert got == {i: (f"{fp:016x}", c) for (i, fp), c in zip(rows, brute.components(rows), strict=True)}


def test_simhash_of_odd_rows(spark, odd):
    got = bag(simhash.near_duplicates(odd).select("doc_id", "fingerprint", "component_id").collect())
    rows = [(r[0], brute.simhash(r[1])) for r in ODD]
    assert got == Counter((i, f"{fp:016x}", c) for (i, fp), c in zip(rows, brute.components(rows), strict=True))


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("largest_tree", [512, 4])
def test_links_of_a_dense_group_in_large_and_split_shards(spark, largest_tree):
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 60)}
    for centre in list(fps)[:4]:
        for _ in range(40):
            x = centre
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    rows = [(k, f) for k, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(simhash._signed(f),) for _, f in rows], "fp long")
    roots = {r["node"] & (1 << 64) - 1: r["root"] for r in simhash.components(simhash.link_edges(df, 4, largest_tree)).collect()}
    groups = defaultdict(set)
    for (k, f), least in zip(rows, brute.components(rows), strict=True):
        groups[least].add(f)
    for members in groups.values():
        assert len({roots.get(f) for f in members}) == 1
        assert (None in {roots.get(f) for f in members}) == (len(members) == 1)
    assert len({r for r in roots.values()}) == sum(len(m) > 1 for m in groups.values())


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)}


def test_bk_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    values = [int(x) for x in rng.integers(0, 1 << 16, 300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.values[k] for k in tree.within(q, 3)) == sorted(v for v in set(values) if (v ^ q).bit_count() <= 3)


@pytest.mark.parametrize("m", [5, 6, 8])
def test_blocks_meet_every_near_pair(m):
    masks, rng = simhash.block_masks(m, 4), np.random.default_rng(m)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flips & mask == 0 for mask in masks)


# -- decontamination --------------------------------------------------------------------------------------------------------


COLUMNS5 = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_op5_equals_a_plain_search(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = bag(queries.op5_decontamination(spark, SF).select(*COLUMNS5).collect())
    assert got == Counter((i, *brute.contamination(t, items)) for i, t in documents)
    assert sum(r[5] for r in got) > 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_contamination_of_odd_rows_in_one_and_many_blocks(spark, odd, block_bytes):
    items = [(1, "The SAME words"), (1, "stand here"), (10, "stand here twice"), (2, None), (3, ""), (None, "over and over"), (4, "été Ωmega"), (5, "long " * 20), (6, "absent " * 30)]
    got = bag(decontam.annotate(odd, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).select(*COLUMNS5).collect())
    assert got == Counter((r[0], *brute.contamination(r[1], items)) for r in ODD)


def test_contamination_by_nothing(spark, odd):
    got = decontam.annotate(odd, spark.createDataFrame([], "item_id long, text string")).agg(F.sum("n_hit"), F.count("*")).first()
    assert tuple(got) == (0, len(ODD))
    assert decontam.annotate(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# -- mixing -----------------------------------------------------------------------------------------------------------------


def check_mix(rows, got):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(brute.words(text))
    aims, taken = brute.targets(dict(sizes)), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], aims[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] >= r["epochs"] * r["size"]
        taken[r["source"]] += r["taken"]
    for source, n in taken.items():
        assert abs(n - aims[source]) <= 1
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(brute.words(t))) for i, t, _ in rows)


def test_op4_meets_its_targets_and_reruns_agree(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    first = queries.op4_mixing(spark, SF).collect()
    check_mix(rows, first)
    assert bag(first) == bag(queries.op4_mixing(spark, SF).collect())


def test_mix_of_odd_rows(spark, odd):
    check_mix([(r[0], r[1], r[3]) for r in ODD], mixing.mix(odd).collect())


def test_the_mix_by_quality_equals_the_mix_by_weights_and_holds_no_text_for_its_score(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for rows in (docs, odd, odd.limit(0)):
        weighed, weight = mixing.quality_weights(rows, labels)
        assert bag(mixing.mix_by_quality(rows, labels).collect()) == bag(mixing.mix(weighed, weight=weight).collect())
    plan = mixing.measured(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan  # it keeps the rows, texts and all, until their scores are there


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_the_mix_weighs_all_documents_by_their_quality(spark, odd):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    weighed, weight = mixing.quality_weights(docs, labels)
    got = {r["doc_id"]: r["w"] for r in weighed.select("doc_id", weight.alias("w")).collect()}
    assert len(got) == docs.count() and all(0.5 <= w <= 2.0 for w in got.values())
    known = {r["doc_id"]: r["quality"] for r in labels.filter("quality IS NOT NULL").collect()}
    mean = [sum(got[i] for i in part) / len(part) for part in ([i for i, q in known.items() if i in got and q == k] for k in (0, 1))]
    assert mean[1] > mean[0] + 0.5
    assert len({w > 1.0 for i, w in got.items() if i not in known}) == 2
    none = labels.limit(0)
    rows, weight = mixing.quality_weights(odd.withColumn("quality_weight", F.lit("x")), none)
    assert {r["quality_weight"] for r in rows.collect()} == {"x"}
    check_mix([(r[0], r[1], r[3]) for r in ODD], mixing.mix(rows, weight=weight).collect())


def test_weights_shift_what_the_last_epoch_takes(spark):
    rows = [(k, "w " * 10, "en", "s" if k < 900 else "t", 0) for k in range(1000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), F.when(F.col("doc_id") % 2 == 0, 8.0).otherwise(1.0), weights=(1.0, 3.0)).collect()
    part = [r for r in got if r["source"] == "s" and r["part"] > 0]
    assert 0 < len(part) < 900
    assert sum(r["doc_id"] % 2 == 0 for r in part) > 0.6 * len(part)


# -- sharding ---------------------------------------------------------------------------------------------------------------


def check_shards(rows, got, n):
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], n)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    import zlib

    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)


def test_op10_is_the_jump_hash(spark, documents):
    got = queries.op10_sharding(spark, SF).collect()
    check_shards(documents, got, 40)
    keys = {r["doc_id"]: r["k"] & (1 << 64) - 1 for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.xxhash64("doc_id").alias("k")).collect()}
    for r in got:
        assert (r["shard"], r["grown_shard"]) == (brute.jump(keys[r["doc_id"]], 40), brute.jump(keys[r["doc_id"]], 41))


def test_shards_of_odd_rows_and_of_nothing(spark, odd):
    check_shards([(r[0], r[1]) for r in ODD], sharding.shard(odd, 3).collect(), 3)
    assert sharding.shard(spark.createDataFrame([], DOCS), 3).count() == 0


@pytest.mark.parametrize("n", [1, 2, 1000])
def test_jump_hash_of_any_key(spark, n):
    rng = np.random.default_rng(n)
    keys = [0, -1, 1 << 62, -(1 << 63), *map(int, rng.integers(-(1 << 63), (1 << 63) - 1, 50))]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), n).alias("j")).collect()
    for r in got:
        assert (r["j"]["shard"], r["j"]["grown"]) == (brute.jump(r["k"] & (1 << 64) - 1, n), brute.jump(r["k"] & (1 << 64) - 1, n + 1))


# -- sketches ---------------------------------------------------------------------------------------------------------------


def edited_of(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        out[i] = (t[: len(t) - cut] + following[:cut], following)
    return out


def test_op3_edits_and_estimates(spark, documents):
    edits = edited_of(documents)
    texts = dict(documents)
    got = queries.op3_fingerprints(spark, SF).collect()
    assert len(got) == len(documents)
    prints, off = {}, []
    for r in got:
        text, (edited, following) = texts[r["doc_id"]], edits[r["doc_id"]]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        off.append(abs(r["near_edited"] - brute.shingle_likeness(text, edited)))
        assert abs(r["near_next"] - brute.shingle_likeness(text, following)) < 0.2
    assert np.mean(off) < 0.03 and max(off) < 0.2


def test_sketches_of_odd_rows_and_of_nothing(spark, odd):
    got = sketch.fingerprints(odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ODD)
    assert all(r["fingerprint"] == "" for r in got if r["doc_id"] in (7, 8, 9))
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    ids = sorted([r for r in ODD if r[0] is not None], key=lambda r: -r[0])
    for k, r in enumerate(ids[:-1]):  # the last one is followed by a null id
        if r[0] not in (5, 2):
            cut = len(r[1] or "") // 3
            text = (r[1] or "")[: len(r[1] or "") - cut] + (ids[k + 1][1] or "")[:cut]
            assert next(g for g in got if g["doc_id"] == r[0])["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert sketch.fingerprints(spark.createDataFrame([], DOCS)).count() == 0
    alone = sketch.fingerprints(spark.createDataFrame([(1, "abc def", "en", "s", 7)], DOCS)).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"abc dab").hexdigest()


def test_merged_parts_are_the_sketch_of_the_whole(spark):
    words = [f"w{k}" for k in range(3000)]
    rows = [("a", " ".join(words)), ("b", " ".join(words[1500:]))]
    whole = {r["k"]: r["s"] for r in sketch.with_sketch(spark.createDataFrame(rows, "k string, t string"), F.col("t"), "s").collect()}
    parts = [(k, " ".join(t.split()[x : x + 104])) for k, t in rows for x in range(0, len(t.split()), 100)]
    made = sketch.with_sketch(spark.createDataFrame(parts, "k string, t string"), F.col("t"), "s")
    got = {r["k"]: r["s"] for r in sketch.merge_groups(made, "k", "s", fan_in=4).collect()}
    assert got == whole
    pair = spark.createDataFrame([(whole["a"], whole["b"])], "a array<long>, b array<long>")
    r = pair.select(sketch.resemblance(F.col("a"), F.col("b")), sketch.containment(F.col("b"), F.col("a")), sketch.containment(F.col("a"), F.col("b")), sketch.distinct_shingles(F.col("a"))).first()
    assert abs(r[0] - 0.5) < 0.15 and r[1] > 0.85 and abs(r[2] - 0.5) < 0.15 and abs(r[3] / 2996 - 1) < 0.3
    assert pair.select(sketch.from_text(sketch.as_text(F.col("a"))).alias("x")).first()["x"] == whole["a"]


# -- WARC -------------------------------------------------------------------------------------------------------------------


def check_pages(rows, got):
    first, expect = {}, Counter()
    for i, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    for i, html in rows:
        data = (html or "").encode()
        least = first.get(html or "")
        revisit = least is not None and i != least
        expect[(i, len(data), brute.base32_sha1(data), "revisit" if revisit else "response", least if revisit else None)] += 1
    assert bag(got) == expect


COLUMNS8 = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_op8_round_trip(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    check_pages(rows, queries.op8_warc(spark, SF).select(*COLUMNS8).collect())


PAGES = "page_id long, url string, html string"


def test_warc_of_odd_pages_rolls_and_reruns_alike(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"<p>{k % 7}</p>" * 50) for k in range(60)] + [(None, None, "<p>alone</p>"), (3, "a\r\nb", None), (90, None, ""), (91, "x", "é\r\n\r\n" * 9), (91, "x", "é\r\n\r\n" * 9)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("n", F.lit(1)).withColumn("id", F.lit("x"))
    made = [warc.write(pages.repartition(k + 1), f"file://{tmp_path}/w{k}", roll=600).collect() for k in (1, 4)]
    assert bag(made[0]) == bag(made[1]) and max(r["part"] for r in made[0]) > 0
    assert not [p for p in (tmp_path / "w1").rglob("*") if p.name.endswith(".tmp")]
    assert {p.name for p in (tmp_path / "w1").glob("*.gz")} == {r["file"] for r in made[0]}
    got = warc.read(spark, f"file://{tmp_path}/w1")
    check_pages([(r[0], r[2]) for r in rows], got.select(*COLUMNS8).collect())
    assert Counter(bytes(r["payload"]).decode() for r in got.filter("record_type = 'response'").collect()) == Counter({f"<p>{k}</p>" * 50: 1 for k in range(7)} | {"<p>alone</p>": 1, "": 1, "é\r\n\r\n" * 9: 2})


def test_warc_keeps_small_payloads_and_nothing(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "same"), (2, "b", "same")], PAGES)
    warc.write(pages, f"file://{tmp_path}/a", least_revisit=5)
    assert {r["record_type"] for r in warc.read(spark, f"file://{tmp_path}/a").collect()} == {"response"}
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


# -- suffix tree ------------------------------------------------------------------------------------------------------------


def check_base(rows, got):
    expect = Counter()
    for (i, _), (held, n, known, total, base) in zip(rows, brute.unigrams(rows), strict=True):
        expect[(i, held, n, known, total, round(base, 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expect


def test_op7_counts_and_beats_the_unigrams(spark, documents):
    got = queries.op7_suffix_tree(spark, SF).collect()
    check_base(documents, got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)  # both are negative
    assert sum(r["score"] > r["base_score"] for r in held) > 0.5 * len(held)


def test_suffix_tree_of_odd_rows_and_of_nothing(spark, odd):
    got = suffix_tree.score(odd).collect()
    check_base([(r[0], r[1]) for r in ODD], got)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert suffix_tree.score(spark.createDataFrame([], DOCS)).count() == 0
    assert suffix_tree.score(spark.createDataFrame([(None, "a b", "en", "s", 3)], DOCS).select("doc_id", "text")).first()["train_tokens"] == 0


@pytest.mark.parametrize("options", [{}, {"block_bytes": 3000, "hot_from": 40}, {"depth": 1}])
def test_scores_equal_a_plain_tree(spark, documents, options):
    rows = documents[:60] + [(1000 + k, documents[k][1]) for k in range(0, 60, 7)] + [(None, "the last one"), (2000, None), (2000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in suffix_tree.score(docs, **options).collect())
    expect = sorted((str(i), n, round(x, 6)) for (i, _), (n, x) in zip(rows, brute.suffix_tree(rows, options.get("depth", 3)), strict=True))
    assert len(got) == len(expect)
    for (i, n, x), (j, m, y) in zip(got, expect, strict=True):
        assert (i, n) == (j, m) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6)


def test_a_level_is_sorted_once_and_a_block_for_good(spark, documents):
    rng = np.random.default_rng(5)
    context, symbol = rng.integers(0, 40, 3000).astype(np.uint64), (rng.integers(0, 3, 3000) * 65_537 + rng.integers(0, 3, 3000)).astype(np.uint32)
    for n in (0, 1, 3000):  # symbols that differ in their lower bits only
        order, c, s = suffix_tree._sorted_by(context[:n], symbol[:n])
        expect = np.lexsort((symbol[:n], context[:n]))
        assert sorted(order) == list(range(n))
        assert (c == context[expect]).all() and (s == symbol[expect]).all() and (c == context[order]).all() and (s == symbol[order]).all()
    docs = spark.createDataFrame(documents[:40], "doc_id long, text string")
    row = suffix_tree.blocks_of(docs, "doc_id", "text", 7, 2, 1 << 20).first()
    hashes, codes = np.frombuffer(bytes(row["hashes"]), dtype=np.uint64), suffix_tree.unpack(row["codes"], np.int32)
    assert (hashes[1:] > hashes[:-1]).all() and set(codes) == set(range(len(hashes)))
    # Nothing occurs twice: all levels are empty. Then a hot context, of whose parts some have no symbol here.
    block = suffix_tree.Block(np.array(row["lengths"]), np.array(row["learn"]), hashes, codes)
    none = block.layout(1, np.ones(len(codes)), 100)
    assert len(none.at) == len(none.contexts) == len(none.symbols) == 0
    hot = block.layout(1, np.where(np.arange(len(codes)) == 1, 5000.0, 0.0), 100)
    assert len(hot.at) == 1 and len(hot.contexts) == 50 and hot.hot.all() and hot.kinds.sum() == 1 and hot.kinds[hot.owner[0]] == 1


def test_texts_that_occur_twice_stand_apart(spark):
    rng, words = np.random.default_rng(8), [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words, 120)) for _ in range(80)]
    rows = [(k, texts[k % 70]) for k in range(80)]
    rows = [(i, t) for i, t in rows if brute.fold(i, 7) != 2]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = Counter(t for _, t in rows)
    twice, once = ([got[i] for i, t in rows if seen[t] == n] for n in (2, 1))
    assert min(twice) > max(once) + 0.5


# -- classifiers ------------------------------------------------------------------------------------------------------------


def held_out_rows(got, labels):
    return [(r, labels[r["doc_id"]]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]


@pytest.mark.parametrize("query, target", [("op1_toxicity", "toxic"), ("op2_quality", "quality")])
def test_classifiers_on_held_out_rows(spark, query, target):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES[query](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (brute.fold(r["doc_id"], 5) == 0) for r in got)
    rows = held_out_rows(got, {r["doc_id"]: r[target] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()})
    assert np.mean([r["predicted"] == label for r, label in rows]) > 0.9


def test_op6_on_held_out_rows(spark):
    got = queries.op6_language(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]) > 0.95


def test_identity_terms_carry_no_weight(spark):
    rng, rows, labels = np.random.default_rng(0), [], []
    filler = ["tree", "river", "stone", "cloud", "market", "train", "winter", "paper"]
    for k in range(600):
        toxic = int(k % 2)
        # The term goes with the label in the sample, as in biased data.
        term = "muslims" if rng.random() < (0.9 if toxic else 0.1) else "christians"
        words = [*rng.choice(filler, 6), term] + (["idiots"] if toxic and rng.random() < 0.9 else [])
        rows.append((k, " ".join(rng.permutation(words))))
        labels.append((k, 0, toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain, fair = (toxicity.fit(docs, labels, penalty=p) for p in (0.0, 20.0))

    def gap(m):
        return m.score("the muslims met in winter") - m.score("the christians met in winter")

    assert gap(plain) > 0.2 and abs(gap(fair)) < 0.3 * gap(plain)
    assert fair.score("idiots met in winter") > 0.5 > fair.score("the muslims met in winter")


def test_classifiers_on_odd_rows_and_nothing(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (2, 0, 1), (None, 1, 1), (7, None, None), (10, 1, 0), (12, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for module in (toxicity, quality):
            got = module.score(odd, module.fit(odd, labels)).collect()
            assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.score(empty, toxicity.fit(empty, some)).count() == 0
    assert quality.score(empty, quality.fit(empty, some)).count() == 0


def test_forest_splits_what_one_statistic_splits():
    x = np.random.default_rng(0).normal(size=(400, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.2) ^ (x[:, 7] > 0)).astype(float)
    forest = quality.grow(x, y)
    assert np.mean((forest.score(x) >= 0.5) == y) > 0.97
    plain = []
    for row in x[:20]:
        z = forest.base
        for root in forest.roots:
            node = root
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            z += forest.value[node]
        plain.append(z)
    assert np.allclose(forest.logit(x[:20]), plain)


def test_languages_of_odd_rows_and_nothing(spark, odd):
    model = langid.fit(odd)
    got = langid.predict(odd.withColumn("_language", F.lit(1)), model).collect()
    for r in got:
        assert (r["lang_pred"] == "und") == (not r["text"] or not any(c.isalpha() for c in r["text"]))
        assert 0 <= r["score"] <= 1
    empty = spark.createDataFrame([], DOCS)
    assert langid.predict(empty.select("doc_id", "text"), langid.fit(empty)).count() == 0
    narrow = langid.Model({"a": b"same words " * 9, "b": b"same words " * 9}).predict("same words")
    assert narrow[0] == "a" and narrow[3]


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")

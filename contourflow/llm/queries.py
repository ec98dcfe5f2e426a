"""The operators' queries over the given tables, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from contourflow.llm import decontam, langid, mixing, quality, sharding, simhash, sketch, suffix_tree, toxicity, warc
from contourflow.llm.common import fold, table
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 40


def _held_out() -> Column:
    return F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", _held_out(), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", _held_out(), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", _held_out(), "lang_pred", "score", "margin", "rejected")


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_quality, op3_fingerprints, op4_mixing, op5_decontamination, op6_language, op7_suffix_tree, op8_warc, op9_simhash, op10_sharding)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _bench_words(column: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _base32(hexadecimal: str) -> str:
    """Base32 of 20 bytes in hexadecimal: four letters for every five digits."""
    letter = f"substr('{_BASE32}', (CAST(CAST('0x' || substr({hexadecimal}, 5 * g + 1, 5) AS INT) AS INT) >> (15 - 5 * k)) % 32 + 1, 1)"
    letters = "".join(f" || {letter.replace('5 * g + 1', str(5 * g + 1)).replace('(15 - 5 * k)', str(15 - 5 * k))}" for g in range(8) for k in range(4))
    return letters.removeprefix(" || ")


ORACLES: dict[str, str] = {
    "op5_decontamination": f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_bench_words('text')} AS w FROM documents),
  items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_bench_words('text')} AS w FROM benchmark),
  windows AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[k:k + 12], ' ') AS gram FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM items WHERE len(w) > 0)),
  places AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
  found AS (SELECT p.r, p.k, p.n, v.item FROM places p JOIN windows v ON v.n = p.n AND v.gram = p.gram),
  hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM found) GROUP BY 1),
  named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY 1)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
    "op8_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages), h AS (SELECT *, sha1(html) AS x FROM p)
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_base32('x')} AS payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to FROM h""",
}

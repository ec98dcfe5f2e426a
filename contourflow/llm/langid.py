"""Language by compression: the language whose dictionary lets zstandard make the text smallest.

Each language has a raw-content dictionary of the words that are most frequent in a sample of documents in it, taken from their whole texts, the most
frequent last. A text is cut into chunks, each compressed with every dictionary; the language with the
smallest sum of sizes is predicted, and a narrow margin to the second marks the prediction as rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from contourflow.llm.common import broadcast, fold, free_name, unit_hash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Documents sampled for a language's dictionary (about), bytes of the dictionary at most, and bytes of all of them.
SAMPLE = 400
DICTIONARY_BYTES = 48 << 10
ALL_BYTES = 64 << 20
CHUNK = 2048
#: Languages up to which their table of one row each is broadcast.
BROADCAST_LANGUAGES = 10_000
LEAST_MARGIN = 0.01
#: Short matches tell languages apart, so the search is a thorough one for matches from three bytes on.
COMPRESSION = {"strategy": zstandard.STRATEGY_BTOPT, "min_match": 3, "search_log": 5, "window_log": 17, "hash_log": 15, "chain_log": 16}

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_REST = regex.compile(r"[^\p{L}]+")


def letters(text: str) -> bytes:
    """Lower-cased letters with single spaces between; digits and marks cost as much in any language."""
    return _REST.sub(" ", text.lower()).encode("utf-8", "replace")


class Model:
    """dictionaries: language -> raw content, the most frequent language first (it wins ties)."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.dictionaries = dictionaries
        self._made: dict[str, zstandard.ZstdCompressor] | None = None

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries, "_made": None}

    def sizes(self, data: bytes) -> dict[str, int]:
        if self._made is None:
            self._made, how = {}, zstandard.ZstdCompressionParameters(**COMPRESSION, write_checksum=False, write_content_size=False, write_dict_id=False)
            for lang, content in self.dictionaries.items():
                trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                trained.precompute_compress(compression_params=how)
                self._made[lang] = zstandard.ZstdCompressor(dict_data=trained, compression_params=how)
        chunks = [data[k : k + CHUNK] for k in range(0, len(data), CHUNK)]
        return {lang: sum(len(made.compress(c)) for c in chunks) for lang, made in self._made.items()}

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin (the second size's excess over the best, as a share of it) and whether the margin is too narrow."""
        if not text or not _LETTER.search(text) or not self.dictionaries:
            return UNKNOWN, 0.0, 0.0, True
        sizes = self.sizes(letters(text))
        ranked = sorted(sizes.items(), key=lambda kv: kv[1])
        best, least = ranked[0]
        second = ranked[1][1] if len(ranked) > 1 else 2 * least
        likely = 1.0 / sum(2.0 ** -min(1000, n - least) for n in sizes.values())
        margin = (second - least) / max(1, second)
        return best, likely, margin, margin < LEAST_MARGIN


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_of: int = 5, sample: int = SAMPLE) -> Model:
    """Dictionaries from the whole texts of about `sample` documents a language; ids whose crc32 mod held_out_of is 0 are never read.

    Null ids, null languages and texts without a letter are left out. Rows that repeat an id are sampled together, and each counts. Words of equal frequency go
    by their bytes. A language without a sampled word has a blank dictionary. Any number of languages is allowed: beyond ALL_BYTES in all, each dictionary is smaller.
    An empty table gives a model without languages, which predicts `und`.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("id").isNotNull()).filter(fold(F.col("id"), held_out_of) != 0)
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    of = {r["lang"]: r["n"] for r in counts.collect()}
    if not of:
        return Model({})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                seen.setdefault(lang, Counter()).update(letters(text).split())
        for lang, words in seen.items():
            yield pd.DataFrame({"lang": lang, "word": list(words), "n": list(words.values())}).astype({"n": "int64"})

    each = max(256, min(DICTIONARY_BYTES, ALL_BYTES // len(of)))
    # One row a language: broadcast while they are few, so that no text is shuffled.
    chosen = known.join(F.broadcast(counts) if len(of) <= BROADCAST_LANGUAGES else counts, "lang").filter(unit_hash(F.col("id"), seed="lang") < F.lit(float(sample)) / F.col("n")).filter(F.col("text").isNotNull()).select("lang", "text")
    words = chosen.mapInPandas(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    upto = F.sum(F.octet_length("word") + 1).over(W.partitionBy("lang").orderBy(F.desc("n"), "word").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = words.withColumn("upto", upto).filter(F.col("upto") <= each).select("lang", "word", "upto").collect()
    listed: dict[str, list[tuple[int, bytes]]] = {lang: [] for lang in of}
    for r in rows:
        listed[r["lang"]].append((-r["upto"], bytes(r["word"])))
    dictionaries = {lang: b" ".join(w for _, w in sorted(listed[lang])) or b" " * 8 for lang in sorted(of, key=lambda x: (-of[x], x))}
    return Model(dictionaries)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score, margin and rejected; columns of these names are replaced, all others stay.

    Texts that are null or have no letter are `und` with score 0, and rejected. Of languages with equal sizes the one with more training documents wins, then the first by name.
    Repeated rows all stay, with equal results; a very long text is compressed chunk by chunk.
    """
    shared = broadcast(docs.sparkSession, model)

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([shared().predict(t) for t in batch], columns=["lang_pred", "score", "margin", "rejected"]).astype({"rejected": "bool"})

    found, into = F.pandas_udf(of, "lang_pred string, score double, margin double, rejected boolean"), free_name(docs, "_language")
    made = docs.withColumn(into, found(F.col(text_col)))
    return made.withColumns({c: F.col(into)[c] for c in ("lang_pred", "score", "margin", "rejected")}).drop(into)

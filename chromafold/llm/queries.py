"""The thin queries over the standard tables, one per operator, and their SQL equivalents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromafold.llm.byte_bpe import encode
from chromafold.llm.html_text import main_text
from chromafold.llm.language import identify
from chromafold.llm.neighbours import search
from chromafold.llm.packing import pack
from chromafold.llm.pii import find_spans
from chromafold.llm.quality import verdicts
from chromafold.llm.rules import classify
from chromafold.llm.simhash import near_duplicates
from chromafold.llm.substring import remove_spans


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo ``n``; null where doc_id is."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document when runs of 35 words that occur elsewhere are removed."""
    return remove_spans(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the four fifths that are not held out."""
    found = identify(table(spark, sf_dir, "documents"), learn=remainder(5) != 0, rejected_as=None)
    return found.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the bytes they decode to."""
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return verdicts(table(spark, sf_dir, "documents")).drop("host", "text_hash", "removed")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and secrets in every document."""
    return find_spans(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels that are not held out."""
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=remainder(4) != 2)
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op1_substring": op1_substring, "op2_simhash": op2_simhash, "op3_html": op3_html, "op4_language": op4_language, "op5_byte_bpe": op5_byte_bpe, "op6_quality": op6_quality, "op7_neighbours": op7_neighbours, "op8_pii": op8_pii, "op9_quality_classifier": op9_quality_classifier, "op10_packing": op10_packing}
#: The other operators' hashes, models, tokenizers and searches have no SQL form; they are tested against brute force.
ORACLES: dict[str, str] = {"op1_substring": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM d),
runs AS (SELECT doc_id, k, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS h,
         count(*) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS n FROM w),
again AS (SELECT h FROM runs WHERE n = 35 GROUP BY h HAVING count(*) > 1),
starts AS (SELECT doc_id, k FROM runs SEMI JOIN again USING (h) WHERE n = 35),
last AS (SELECT w.doc_id, w.k, w.word, max(s.k) OVER (PARTITION BY w.doc_id ORDER BY w.k) AS s FROM w LEFT JOIN starts s ON s.doc_id = w.doc_id AND s.k = w.k),
marked AS (SELECT doc_id, k, word, coalesce(k - s < 35, false) AS gone FROM last)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, count(m.k) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY m.k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id, len(d.ws)""".strip()}

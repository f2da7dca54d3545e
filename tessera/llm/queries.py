"""The ``opN_<name>`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import pii
from tessera.llm.common import documents
from tessera.llm.exact_dedup import exact_groups
from tessera.llm.fill_middle import fill_in_middle, restored
from tessera.llm.filter_audit import audit_filters
from tessera.llm.langid import held_out, predict_language, train
from tessera.llm.licenses import scan_licenses
from tessera.llm.line_dedup import line_dedup
from tessera.llm.mixing import mix_sources
from tessera.llm.ngram_join import ngram_join
from tessera.llm.packing import pack
from tessera.llm.pieces import encode_pieces, ids_digest
from tessera.llm.quality import judge
from tessera.llm.sql import (AUDIT_SQL, EXACT_DEDUP_SQL, FILL_MIDDLE_SQL, LICENSE_SQL, LINE_DEDUP_SQL, MIX_SQL,
                             SUBSTRING_SQL)
from tessera.llm.substring_dedup import substring_dedup

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@_query("op1_ngram_join")
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, copies and number of links of every document: word five-grams, similarity 0.8 or more."""
    return ngram_join(documents(spark, sf_dir))


@_query("op2_line_dedup", LINE_DEDUP_SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text left of every document after removing later occurrences of three-line windows."""
    return line_dedup(documents(spark, sf_dir))


@_query("op3_mix_sources", MIX_SQL)
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture with shares proportional to the square root of each source's characters."""
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "source", "copy", "mix_key", "text")


@_query("op4_substring_dedup", SUBSTRING_SQL)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document without the 13-word windows that start in a smaller id too."""
    return substring_dedup(documents(spark, sf_dir), with_text=False)


@_query("op5_exact_dedup", EXACT_DEDUP_SQL)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts and the row that stays, one row per document."""
    return exact_groups(documents(spark, sf_dir))


@_query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence of at most 1024 tokens."""
    import public_tokenizers
    return pack(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


@_query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from the documents that are not held out."""
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out()))
    return predict_language(docs, model, ["doc_id", held_out().alias("held_out")])


@_query("op10_personal_data")
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: pattern spans and those the trained segment model adds."""
    docs = documents(spark, sf_dir)
    return pii.detect(docs, pii.train(docs))


@_query("op8_license_scan", LICENSE_SQL)
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences and licences of every document."""
    return scan_licenses(documents(spark, sf_dir))


@_query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, by thresholds learned per language and source."""
    return judge(documents(spark, sf_dir))


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@_query("op11_piece_codec")
def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's SentencePiece ids and of the text decoded from them."""
    import public_tokenizers
    out = encode_pieces(documents(spark, sf_dir), public_tokenizers.path(PIECES))
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), ids_digest().alias("ids_sha256"),
                      _sha256(F.col("decoded")).alias("decoded_sha256"))


@_query("op12_fill_in_middle", FILL_MIDDLE_SQL)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at lines into prefix, middle and suffix; digests of the output and of the text rebuilt from it."""
    out = fill_in_middle(documents(spark, sf_dir))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _sha256(F.col("output")).alias("output_sha256"),
                      _sha256(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


@_query("op13_filter_audit", AUDIT_SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep and remove in all 120 orders, per language."""
    folder = sf_dir.rstrip("/")
    return audit_filters(spark, f"{folder}/documents.parquet", spark.read.parquet(f"{folder}/labels.parquet"))

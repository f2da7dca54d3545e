"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept; stages are written as Parquet and read again between one another, so a
lost executor costs at most the running stage.  All stages but the last return
the columns of ``documents``.

Defined cases, for every stage: a null or empty text is in no language and goes in the
first; null languages and sources are values of their own; very long texts are read
whole; rows without an id stay where only ids are compared (the n-gram join) and draw
as the empty id; rows that repeat an id with its text leave one row (exact dedup); an
id with several texts goes with the text that another class keeps; ties go to
the smallest id; an empty table gives an empty result of the same columns; other columns
pass through to the mixture, whatever their names, and the last stage returns its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.exact_dedup import drop_copies
from tessera.llm.langid import keep_identified, train
from tessera.llm.mixing import mix_sources
from tessera.llm.ngram_join import one_of_each_class
from tessera.llm.packing import pack
from tessera.session import checkpoint_dir

TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language: not empty, with letters, and shorter in a language's code than plain."""
    return keep_identified(docs, train(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by similarity 0.8 or more."""
    return one_of_each_class(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks, in global random order."""
    return mix_sources(docs, copy_col="_copy", key_col="_mix_key").drop("_copy", "_mix_key")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture as sequences of at most 1024 tokens."""
    import public_tokenizers
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("ngram_join", ngram_join),
          ("mix_sources", mix), ("best_fit_packing", best_fit_packing)]

#: The stages score byte contexts, sample paths and solve a linear program: no SQL statement gives their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

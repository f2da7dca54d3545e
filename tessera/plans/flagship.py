"""Flagship plan: V1 codes -> prefix hierarchy -> SKOS terms -> TTL blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import hierarchy as H
from tessera.operators.fields import concept_uri, melt_fields, typed_terms
from tessera.plans import testbed as T
from tessera.sources.ttl import concept_blocks

BASE = "http://ex.org/vocab/"
MAPPING = {"uri": "uri", "prefLabel": "label", "notation": "notation", "broader": "broader"}


def flagship_wide(spark: SparkSession, d: str) -> DataFrame:
    """V1 with absolute URIs and the broader URI found by the prefix rule."""
    v = T.v1(spark, d)
    e = H.edges_from_prefix(v)
    return (v.join(e, v.id == e.child, "left")
             .select(concept_uri("id", BASE, F.col("pos").cast("string")).alias("uri"), "pos", "label", "notation",
                     F.when(F.col("parent").isNotNull(), F.concat(F.lit(BASE), "parent")).alias("broader")))


def vocabulary_blocks(spark: SparkSession, d: str) -> DataFrame:
    """One TTL block per concept of V1, with broader links from the prefix rule."""
    w = flagship_wide(spark, d)
    terms = typed_terms(melt_fields(w, MAPPING, "uri", "pos"), "en")
    return concept_blocks(terms, "uri", "pos").select("uri", "block")

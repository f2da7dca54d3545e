"""SKOS documentation properties (N1-N7) as ``docs(concept_uri, doc_type, lang, content, pos, k)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.terms import escape_literal
from tessera.functions.text import strip_ws

# The seven SKOS documentation properties.
DOC_TYPES = ["note", "definition", "example", "scopeNote", "changeNote", "editorialNote", "historyNote"]


def melt_documentation(df: DataFrame, mapping: dict, uri_col: str, pos_col: str = "pos",
                       default_lang: str = "en") -> DataFrame:
    """Wide rows -> one row per documentation entry.

    A mapping value is one column, a list of columns, or {lang: column}.
    Content is stripped; empty values and rows without a concept URI give no
    entry; ``k`` keeps the entry order within a row.
    """
    items = []
    for doc_type, fields in mapping.items():
        if not fields:
            continue
        if isinstance(fields, dict):
            pairs = [(lang, f) for lang, f in fields.items()]
        elif isinstance(fields, (list, tuple)):
            pairs = [(default_lang, f) for f in fields]
        else:
            pairs = [(default_lang, fields)]
        for lang, f in pairs:
            if f in df.columns:
                items.append(F.struct(F.lit(len(items)).alias("k"), F.lit(doc_type).alias("doc_type"),
                                      F.lit(lang).alias("lang"), strip_ws(F.col(f"`{f}`")).alias("content")))
    rows = df.where(F.col(uri_col).isNotNull()).select(
        F.col(uri_col).cast("string").alias("concept_uri"), F.col(pos_col).alias("pos"),
        F.explode(F.array(*items)).alias("x"))
    return (rows.select("concept_uri", "x.doc_type", "x.lang", "x.content", "pos", "x.k")
                .where(F.col("content").isNotNull() & (F.col("content") != "")))


def doc_quality(docs: DataFrame) -> DataFrame:
    """Short (< 10 characters), long (> 1000) and markup-bearing entries."""
    n = F.length("content")
    checks = [("short", n < 10, F.format_string("Very short %s for concept %s", "doc_type", "concept_uri")),
              ("long", n > 1000, F.format_string("Very long %s for concept %s (%d chars)", "doc_type", "concept_uri", n)),
              ("markup", F.col("content").rlike("<[^>]+>"),
               F.format_string("Potential HTML markup in %s for concept %s", "doc_type", "concept_uri"))]
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(name).alias("check"), msg.alias("message")))
                               for name, c, msg in checks]), lambda x: x.isNotNull())
    return docs.select("concept_uri", "doc_type", "pos", "k", F.explode(found).alias("x")).select(
        "concept_uri", "doc_type", "pos", "k", "x.check", "x.message")


def concepts_of(df: DataFrame, uri_col: str) -> DataFrame:
    """Every concept URI of the input rows (a concept may have no entry)."""
    return df.where(F.col(uri_col).isNotNull()).groupBy(F.col(uri_col).cast("string").alias("concept_uri")).agg(
        F.min("pos").alias("pos"))


def doc_stats(concepts: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: concepts, concepts with entries, coverage, entries, average, languages,
    definition and example entry counts."""
    per = docs.groupBy("concept_uri").agg(F.count("*").alias("n"))
    j = concepts.join(per, "concept_uri", "left")
    a = j.agg(F.count("*").alias("total_concepts"), F.count("n").alias("concepts_with_documentation"),
              F.coalesce(F.sum("n"), F.lit(0)).alias("total_documentation_entries"))
    b = docs.agg(F.count_distinct("lang").alias("multilingual_coverage"),
                 F.count_if(F.col("doc_type") == "definition").alias("concepts_with_definitions"),
                 F.count_if(F.col("doc_type") == "example").alias("concepts_with_examples"))
    long = reduce(DataFrame.unionByName, [
        p.select(F.explode(F.create_map(*[x for c in p.columns for x in (F.lit(c), F.col(c).cast("long"))]))
                 .alias("k", "v")) for p in (a, b)])
    w = long.groupBy().pivot("k", sorted(a.columns + b.columns)).agg(F.first("v"))
    tot = F.col("total_concepts")
    return w.select("*",
                    F.round(F.when(tot > 0, F.col("concepts_with_documentation") / tot).otherwise(0.0), 6)
                     .alias("documentation_coverage"),
                    F.round(F.when(tot > 0, F.col("total_documentation_entries") / tot).otherwise(0.0), 6)
                     .alias("average_docs_per_concept"))


def doc_type_counts(docs: DataFrame) -> DataFrame:
    """Entries per documentation type, zero for absent types."""
    spark = docs.sparkSession
    types = spark.createDataFrame([(t,) for t in DOC_TYPES], "doc_type string")
    c = docs.groupBy("doc_type").agg(F.count("*").alias("n"))
    return types.join(c, "doc_type", "left").select("doc_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def doc_field_coverage(concepts: DataFrame, docs: DataFrame) -> DataFrame:
    """Per type, concepts with at least one entry and their share of all concepts."""
    per = docs.groupBy("doc_type").agg(F.count_distinct("concept_uri").alias("concepts"))
    total = concepts.count()  # one number
    return per.select("doc_type", "concepts",
                      F.round(F.col("concepts") / F.lit(max(total, 1)), 6).alias("coverage"))


def doc_languages(docs: DataFrame) -> DataFrame:
    """Entries per language."""
    return docs.groupBy("lang").agg(F.count("*").alias("n"))


def doc_gaps(concepts: DataFrame, docs: DataFrame, doc_type: str, k: int = 10) -> DataFrame:
    """The first k concepts (input order) without an entry of ``doc_type``, with the total."""
    have = docs.where(F.col("doc_type") == doc_type).select("concept_uri").distinct()
    missing = concepts.join(have, "concept_uri", "left_anti")
    total = missing.count()  # one number, attached as a literal
    first = missing.orderBy("pos", "concept_uri").limit(k)
    return first.select("concept_uri", F.lit(total).cast("long").alias("n_missing"))


def doc_short(docs: DataFrame, min_len: int = 20, k: int = 5) -> DataFrame:
    """The first k entries shorter than ``min_len`` characters, with their total."""
    short = docs.where(F.length("content") < min_len)
    total = short.count()  # one number, attached as a literal
    first = short.orderBy("pos", "k").limit(k)
    return first.select("concept_uri", "doc_type", "content", F.lit(total).cast("long").alias("n_short"))


def merge_documentation(parts: list[DataFrame]) -> DataFrame:
    """Union; per (concept, type) a content seen before is dropped (first entry kept)."""
    u = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    return (u.groupBy("concept_uri", "doc_type", "content")
             .agg(F.min_by(F.struct("lang", "pos", "k"), F.struct("_part", "pos", "k")).alias("r"))
             .select("concept_uri", "doc_type", "r.lang", "content", "r.pos", "r.k"))


def doc_triples(docs: DataFrame, modified: str | None = None) -> DataFrame:
    """(concept_uri, k, triple): a type line per concept, one line per entry as a long
    literal, and dct:modified when the concept has a changeNote and a timestamp is given."""
    heads = docs.select("concept_uri").distinct()
    lines = [heads.select("concept_uri", F.lit(-1).alias("k"),
                          F.concat(F.lit("<"), "concept_uri", F.lit("> rdf:type skos:Concept .")).alias("triple")),
             docs.select("concept_uri", "k", F.concat(
                 F.lit("<"), "concept_uri", F.lit("> skos:"), "doc_type", F.lit(' """'), escape_literal("content"),
                 F.lit('"""'), F.when(F.col("lang").isNotNull() & (F.col("lang") != "none"),
                                      F.concat(F.lit("@"), "lang")).otherwise(F.lit("")), F.lit(" .")).alias("triple"))]
    if modified:
        ch = docs.where(F.col("doc_type") == "changeNote").select("concept_uri").distinct()
        lines.append(ch.select("concept_uri", F.lit(999).alias("k"),
                               F.concat(F.lit("<"), "concept_uri",
                                        F.lit(f'> dct:modified "{modified}"^^xsd:dateTime .')).alias("triple")))
    return reduce(DataFrame.unionByName, lines)

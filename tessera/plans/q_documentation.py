"""Registered documentation queries (N1-N7) over V5."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import documentation as N
from tessera.plans import testbed as T
from tessera.plans.registry import query
from tessera.plans.sqlfrag import esc

MAPPING = {"definition": {"en": "def_en", "fr": "def_fr", "de": "def_de", "es": "def_es"},
           "example": "example", "note": ["note"], "changeNote": "changeNote"}
V5 = ("v5d",)
CONCEPTS_SQL = "SELECT uri AS concept_uri, min(pos) AS pos FROM v5 WHERE uri IS NOT NULL GROUP BY uri"


def _docs(spark, d):
    return N.melt_documentation(T.v5(spark, d), MAPPING, "uri")


def _concepts(spark, d):
    return N.concepts_of(T.v5(spark, d), "uri")


@query("doc_melt", "SELECT concept_uri, doc_type, lang, content FROM v5d", V5)
def doc_melt(spark, d):
    return _docs(spark, d).select("concept_uri", "doc_type", "lang", "content")


@query("doc_quality", """
SELECT concept_uri, doc_type, pos, k, 'short' AS "check", printf('Very short %s for concept %s', doc_type, concept_uri) AS message
FROM v5d WHERE length(content) < 10
UNION ALL SELECT concept_uri, doc_type, pos, k, 'long', printf('Very long %s for concept %s (%d chars)', doc_type, concept_uri,
  length(content)) FROM v5d WHERE length(content) > 1000
UNION ALL SELECT concept_uri, doc_type, pos, k, 'markup', printf('Potential HTML markup in %s for concept %s', doc_type,
  concept_uri) FROM v5d WHERE regexp_matches(content, '<[^>]+>')""", V5)
def doc_quality(spark, d):
    return N.doc_quality(_docs(spark, d))


@query("doc_stats", f"""
WITH c AS ({CONCEPTS_SQL}), per AS (SELECT concept_uri, count(*) AS n FROM v5d GROUP BY 1),
j AS (SELECT c.concept_uri, per.n FROM c LEFT JOIN per ON c.concept_uri = per.concept_uri)
SELECT (SELECT count(*) FROM j) AS total_concepts, (SELECT count(n) FROM j) AS concepts_with_documentation,
       CAST((SELECT coalesce(sum(n), 0) FROM j) AS BIGINT) AS total_documentation_entries,
       (SELECT count(DISTINCT lang) FROM v5d) AS multilingual_coverage,
       (SELECT count(*) FROM v5d WHERE doc_type = 'definition') AS concepts_with_definitions,
       (SELECT count(*) FROM v5d WHERE doc_type = 'example') AS concepts_with_examples,
       round((SELECT count(n) FROM j) / (SELECT count(*) FROM j), 6) AS documentation_coverage,
       round((SELECT coalesce(sum(n), 0) FROM j) / (SELECT count(*) FROM j), 6) AS average_docs_per_concept""",
       ("v5", "v5d"))
def doc_stats(spark, d):
    return N.doc_stats(_concepts(spark, d), _docs(spark, d))


@query("doc_type_counts", f"""
SELECT t.doc_type, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (VALUES {", ".join(f"('{t}')" for t in N.DOC_TYPES)}) t(doc_type)
LEFT JOIN (SELECT doc_type, count(*) AS n FROM v5d GROUP BY 1) c ON t.doc_type = c.doc_type""", V5)
def doc_type_counts(spark, d):
    return N.doc_type_counts(_docs(spark, d))


@query("doc_field_coverage", f"""
SELECT doc_type, count(DISTINCT concept_uri) AS concepts,
       round(count(DISTINCT concept_uri) / (SELECT count(*) FROM ({CONCEPTS_SQL})), 6) AS coverage
FROM v5d GROUP BY doc_type""", ("v5", "v5d"))
def doc_field_coverage(spark, d):
    return N.doc_field_coverage(_concepts(spark, d), _docs(spark, d))


@query("doc_languages", "SELECT lang, count(*) AS n FROM v5d GROUP BY lang", V5)
def doc_languages(spark, d):
    return N.doc_languages(_docs(spark, d))


def _gap_sql(t: str) -> str:
    return f"""
WITH m AS (SELECT * FROM ({CONCEPTS_SQL}) c
           WHERE concept_uri NOT IN (SELECT concept_uri FROM v5d WHERE doc_type = '{t}'))
SELECT concept_uri, (SELECT count(*) FROM m) AS n_missing FROM m ORDER BY pos, concept_uri LIMIT 10"""


@query("doc_missing_definition", _gap_sql("definition"), ("v5", "v5d"))
def doc_missing_definition(spark, d):
    return N.doc_gaps(_concepts(spark, d), _docs(spark, d), "definition")


@query("doc_missing_example", _gap_sql("example"), ("v5", "v5d"))
def doc_missing_example(spark, d):
    return N.doc_gaps(_concepts(spark, d), _docs(spark, d), "example")


@query("doc_short", """
WITH s AS (SELECT * FROM v5d WHERE length(content) < 20)
SELECT concept_uri, doc_type, content, (SELECT count(*) FROM s) AS n_short FROM s ORDER BY pos, k LIMIT 5""", V5)
def doc_short(spark, d):
    return N.doc_short(_docs(spark, d))


@query("doc_merge", """
WITH u AS (SELECT *, 0 AS part FROM v5d WHERE lang IN ('en', 'fr') UNION ALL SELECT *, 1 FROM v5d)
SELECT concept_uri, doc_type, lang, content, pos, k FROM u
QUALIFY row_number() OVER (PARTITION BY concept_uri, doc_type, content ORDER BY part, pos, k) = 1""", V5)
def doc_merge(spark, d):
    docs = _docs(spark, d)
    return N.merge_documentation([docs.where(F.col("lang").isin("en", "fr")), docs])


@query("doc_triples", f"""
SELECT DISTINCT concept_uri, -1 AS k, '<' || concept_uri || '> rdf:type skos:Concept .' AS triple FROM v5d
UNION ALL SELECT concept_uri, k, '<' || concept_uri || '> skos:' || doc_type || ' \"\"\"' || {esc('content')}
  || '\"\"\"' || CASE WHEN lang IS NOT NULL AND lang <> 'none' THEN '@' || lang ELSE '' END || ' .' FROM v5d
UNION ALL SELECT DISTINCT concept_uri, 999,
  '<' || concept_uri || '> dct:modified \"2024-01-01T00:00:00\"^^xsd:dateTime .' FROM v5d WHERE doc_type = 'changeNote'""",
       V5)
def doc_triples(spark, d):
    return N.doc_triples(_docs(spark, d), "2024-01-01T00:00:00")

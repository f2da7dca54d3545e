"""Registered enrichment queries (J9-J13) over V6 and V1."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.terms import typed_term
from tessera.operators import enrich as EN
from tessera.operators import hierarchy as H
from tessera.plans import testbed as T
from tessera.plans.registry import query
from tessera.plans.sqlfrag import esc
from tessera.sources import ttl as TT
from tessera.sources.files import scratch_path

BASE = "http://ex.org/c/"
V6 = ("v6l", "v6r")
PROPS = {"label": "altLabel", "segment": "related"}

_NORM = f"""CASE WHEN starts_with(uri, 'http') THEN uri ELSE '{BASE}' || uri END"""
_URI_SQL = f"""
SELECT r.pos AS row_pos, {_NORM.replace('uri', 'r.uri')} AS row_uri,
       CASE WHEN k.uri IS NOT NULL THEN 'enriched' ELSE 'added' END AS status
FROM v6r r LEFT JOIN (SELECT DISTINCT uri FROM v6l) k ON {_NORM.replace('uri', 'r.uri')} = k.uri"""


@query("enrich_by_uri", _URI_SQL, V6)
def enrich_by_uri(spark, d):
    v = T.v6(spark, d)
    return EN.enrich_by_uri(v["literals"], v["rows"], "uri", BASE)


@query("enrich_stats", f"""
SELECT 'with_base' AS run, count(*) FILTER (WHERE status = 'enriched') AS concepts_enriched,
       count(*) FILTER (WHERE status = 'added') AS concepts_added, CAST(0 AS BIGINT) AS rows_skipped FROM ({_URI_SQL})
UNION ALL
SELECT 'no_base', count(*) FILTER (WHERE starts_with(uri, 'http') AND uri IN (SELECT uri FROM v6l)),
       count(*) FILTER (WHERE starts_with(uri, 'http') AND uri NOT IN (SELECT uri FROM v6l)),
       count(*) FILTER (WHERE NOT starts_with(uri, 'http')) FROM v6r""", V6)
def enrich_stats(spark, d):
    v = T.v6(spark, d)
    a = EN.enrich_stats(EN.enrich_by_uri(v["literals"], v["rows"], "uri", BASE))
    b = EN.enrich_stats(EN.enrich_by_uri(v["literals"], v["rows"], "uri", None))
    return a.select(F.lit("with_base").alias("run"), "*").unionByName(b.select(F.lit("no_base").alias("run"), "*"))


_LABEL_IDX = """
SELECT lower(value) AS label, arg_max(uri, {'p': pos, 'k': CASE WHEN prop = 'prefLabel' THEN 0 ELSE 1 END, 'v': vpos}) AS uri
FROM v6l WHERE prop IN ('prefLabel', 'altLabel') GROUP BY 1"""


@query("enrich_by_label", f"""
SELECT r.pos AS row_pos, lower(r.label) AS label, i.uri AS matched_uri
FROM v6r r LEFT JOIN ({_LABEL_IDX}) i ON lower(r.label) = i.label""", V6)
def enrich_by_label(spark, d):
    v = T.v6(spark, d)
    return EN.enrich_by_label(v["literals"], v["rows"], "label")


@query("enrich_by_mapping", """
WITH r AS (SELECT lower(label) AS v0, lower(segment) AS v1, min(pos) AS row_pos FROM v6r GROUP BY 1, 2),
p AS (SELECT DISTINCT uri, lower(value) AS v0 FROM v6l WHERE prop = 'prefLabel'),
a AS (SELECT DISTINCT uri, lower(value) AS v1 FROM v6l WHERE prop = 'altLabel')
SELECT p.uri, min(r.row_pos) AS row_pos FROM p JOIN a ON p.uri = a.uri JOIN r ON r.v0 = p.v0 AND r.v1 = a.v1
GROUP BY p.uri""", V6)
def enrich_by_mapping(spark, d):
    v = T.v6(spark, d)
    return EN.enrich_by_mapping(v["literals"], v["rows"], {"prefLabel": "label", "altLabel": "segment"})


@query("enrich_add_properties", f"""
WITH m AS (SELECT {_NORM} AS concept_uri, pos, uri, label, segment, spend FROM v6r
           WHERE {_NORM} IN (SELECT uri FROM v6l)),
l AS (SELECT concept_uri AS uri, pos AS row_pos, 'uri' AS prop, uri AS value FROM m
      UNION ALL SELECT concept_uri, pos, 'altLabel', label FROM m
      UNION ALL SELECT concept_uri, pos, 'related', segment FROM m
      UNION ALL SELECT concept_uri, pos, 'spend', CAST(spend AS VARCHAR) FROM m),
l2 AS (SELECT * FROM l WHERE value IS NOT NULL AND trim(value) <> '')
SELECT DISTINCT uri, prop, value, CASE WHEN prop = 'altLabel' THEN 'de' END AS lang,
       CASE WHEN prop = 'altLabel' THEN 'literal' ELSE 'relation' END AS kind
FROM l2 WHERE prop IN ('altLabel', 'related') AND (uri, prop, value) NOT IN (SELECT (uri, prop, value) FROM v6l)
UNION ALL
SELECT uri, prop, arg_max(value, row_pos), CAST(NULL AS VARCHAR), 'other' FROM l2 WHERE prop IN ('uri', 'spend')
GROUP BY uri, prop""", V6)
def enrich_add_properties(spark, d):
    v = T.v6(spark, d)
    m = EN.enrich_by_uri(v["literals"], v["rows"], "uri", BASE).where("status = 'enriched'")
    rows = v["rows"].join(m.select(F.col("row_pos").alias("pos"), F.col("row_uri").alias("concept_uri")), "pos")
    rows = rows.withColumn("spend", F.col("spend").cast("string"))
    return EN.add_properties(v["literals"], rows, PROPS, lang="de")


# Flow C: a vocabulary in TTL and a table of rows in, the enriched vocabulary out.
FLOW_PROPS = {"label": "altLabel", "segment": "related", "spend": "notation"}
_FLOW_SQL = f"""
m AS (SELECT {_NORM} AS uri, pos, label, segment, CAST(spend AS VARCHAR) AS spend, uri AS raw,
             {_NORM} IN (SELECT uri FROM v6l) AS known FROM v6r),
u AS (SELECT * FROM m WHERE known OR pos IN (SELECT max(pos) FROM m WHERE NOT known GROUP BY uri)),
l AS (SELECT uri, pos, known, 'altLabel' AS prop, label AS value FROM u
      UNION ALL SELECT uri, pos, known, 'related', segment FROM u
      UNION ALL SELECT uri, pos, known, 'notation', spend FROM u
      UNION ALL SELECT uri, pos, known, 'uri', raw FROM u),
f AS (SELECT * FROM l WHERE value IS NOT NULL AND trim(value) <> ''),
e AS (SELECT uri, prop, value, CASE WHEN prop <> 'related' THEN lang END AS lang, 'literal' AS kind, 'kept' AS origin FROM v6l
      UNION ALL
      SELECT DISTINCT uri, prop, value, CASE WHEN prop = 'altLabel' THEN 'de' END,
             CASE WHEN prop = 'altLabel' THEN 'literal' ELSE 'relation' END, CASE WHEN known THEN 'enriched' ELSE 'added' END
      FROM f WHERE prop IN ('altLabel', 'related') AND (uri, prop, value) NOT IN (SELECT (uri, prop, value) FROM v6l)
      UNION ALL
      SELECT uri, prop, arg_max(value, pos), NULL, 'other', CASE WHEN bool_or(known) THEN 'enriched' ELSE 'added' END
      FROM f WHERE prop IN ('uri', 'notation') GROUP BY uri, prop)"""


def _written_customers(spark, d) -> str:
    """The V6 concepts as TTL files in the shared folder."""
    lit = T.v6(spark, d)["literals"].withColumn("term", typed_term("prop", "value", F.col("lang")))
    path = scratch_path(spark, "flow-c")
    TT.write_ttl(TT.concept_blocks(lit, "uri", "pos"), path, TT.header_text(BASE, "Customers", "V6", "en", "2024-01-01"))
    return f"{path}/concepts"


def _flow(spark, d):
    blocks = TT.read_ttl(spark, _written_customers(spark, d)).withColumn("uri", F.regexp_replace("raw_uri", "^<|>$", ""))
    lit = TT.parse_literals(blocks).select("uri", "prop", F.col("text").alias("value"), "lang", "pos", "vpos")
    rows = T.v6(spark, d)["rows"].withColumn("spend", F.col("spend").cast("string"))
    return EN.enrich_vocabulary(lit, rows, "uri", BASE, FLOW_PROPS)


@query("enrich_vocabulary", f"WITH {_FLOW_SQL} SELECT uri, prop, value, lang, kind, origin FROM e", V6)
def enrich_vocabulary(spark, d):
    """Read TTL, match rows by URI, return every statement of the enriched vocabulary."""
    return _flow(spark, d)


@query("enrich_to_ttl", f"""
WITH {_FLOW_SQL},
t AS (SELECT uri, CASE prop WHEN 'prefLabel' THEN 0 WHEN 'altLabel' THEN 1 WHEN 'notation' THEN 2 ELSE 3 END AS r,
             '    skos:' || prop || ' ' || CASE prop WHEN 'related' THEN '<' || value || '>'
               WHEN 'notation' THEN '"' || {esc('value')} || '"^^xsd:string'
               ELSE '"' || {esc('value')} || '"@' || coalesce(lang, 'de') END AS s
      FROM e WHERE prop <> 'uri')
SELECT uri, '<' || uri || '> a skos:Concept ;' || chr(10) || '    skos:inScheme <> ;' || chr(10)
       || string_agg(s, ' ;' || chr(10) ORDER BY r, s) || ' .' AS block
FROM t GROUP BY uri""", V6)
def enrich_to_ttl(spark, d):
    """The enriched vocabulary as one block per concept, new concepts included."""
    e = _flow(spark, d).where("prop <> 'uri'")
    terms = e.select("uri", "prop", F.lit(0).alias("vpos"),
                     typed_term("prop", "value", F.coalesce(F.col("lang"), F.lit("de"))).alias("term"))
    return TT.concept_blocks(terms, "uri").select("uri", "block")


@query("apply_hierarchy", """
WITH n AS (SELECT DISTINCT trim(id) AS id, CAST(level AS DOUBLE) AS level FROM v1),
e AS (SELECT c.id AS child, arg_max(p.id, length(p.id)) AS parent
      FROM n c JOIN n p ON p.level = c.level - 1 AND starts_with(c.id, p.id) WHERE c.level > 1 GROUP BY c.id),
k AS (SELECT parent, count(DISTINCT child) AS n FROM e GROUP BY parent)
SELECT v.id, v.parent_id, v.level, v.label, v.path, v.notation, v.pos, e.parent AS broader,
       CAST(coalesce(k.n, 0) AS BIGINT) AS n_narrower
FROM v1 v LEFT JOIN e ON v.id = e.child LEFT JOIN k ON v.id = k.parent""", ("v1",))
def apply_hierarchy(spark, d):
    v = T.v1(spark, d)
    return EN.apply_hierarchy(v, H.edges_from_prefix(v), "id")

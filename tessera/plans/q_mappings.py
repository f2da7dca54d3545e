"""Registered mapping queries (M1-M10) over V3."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import MAPPING_SYNONYMS, MAPPING_TYPES, mapping_type
from tessera.operators import mappings as M
from tessera.plans import testbed as T
from tessera.plans.registry import query
from tessera.plans.views_sql import _v
from tessera.sources.tables import table

BASE = "http://ex.org/"


def _abs_sql(x: str) -> str:
    t = f"trim({x})"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN starts_with({t}, 'http://') OR starts_with({t}, 'https://') "
            f"OR starts_with({t}, 'urn:') OR starts_with({t}, '/') THEN {t} ELSE '{BASE.rstrip('/')}/' || {t} END")


def _type_sql(x: str) -> str:
    low = f"lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"
    whens = " ".join(f"WHEN '{t.lower()}' THEN '{t}'" for t in MAPPING_TYPES)
    whens += " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MAPPING_SYNONYMS)
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'closeMatch' ELSE (CASE {low} {whens} ELSE {low} END) END"


_v("v3n", f"""
SELECT {_abs_sql('source_uri')} AS source_uri, {_abs_sql('target_uri')} AS target_uri,
       {_type_sql('mapping_type')} AS mapping_type, confidence, pos
FROM v3 WHERE source_uri IS NOT NULL AND target_uri IS NOT NULL""", ("v3",))


def _v3n(spark, d):
    return M.normalise_mappings(T.v3(spark, d), BASE)


@query("map_normalise", "SELECT * FROM v3n", ("v3n",))
def map_normalise(spark, d):
    return _v3n(spark, d)


_PAIRS = "SELECT source_uri, target_uri, list_distinct(list(mapping_type)) AS types FROM v3n GROUP BY ALL"


@query("map_conflicts_exact", f"""
WITH g AS ({_PAIRS}),
c AS (SELECT source_uri, target_uri,
             list_filter([CASE WHEN list_contains(types, 'broadMatch') THEN 'broadMatch' END,
                          CASE WHEN list_contains(types, 'narrowMatch') THEN 'narrowMatch' END,
                          CASE WHEN list_contains(types, 'relatedMatch') THEN 'relatedMatch' END],
                         lambda x: x IS NOT NULL) AS conflicting
      FROM g WHERE list_contains(types, 'exactMatch'))
SELECT source_uri, target_uri, 'exactMatch_conflict' AS conflict_type,
       array_to_string(conflicting, ', ') AS conflicting_types,
       'exactMatch conflicts with ' || array_to_string(conflicting, ', ') AS description
FROM c WHERE len(conflicting) > 0""", ("v3n",))
def map_conflicts_exact(spark, d):
    return M.mapping_conflicts_exact(_v3n(spark, d))


_HIER = f"""
SELECT source_uri, target_uri, 'hierarchical_associative_conflict' AS conflict_type,
       'Hierarchical and associative mappings are disjoint' AS description
FROM ({_PAIRS}) WHERE (list_contains(types, 'broadMatch') OR list_contains(types, 'narrowMatch'))
  AND list_contains(types, 'relatedMatch')"""


@query("map_conflicts_hier", _HIER, ("v3n",))
def map_conflicts_hier(spark, d):
    return M.mapping_conflicts_hier_assoc(_v3n(spark, d))


@query("map_validation", f"""
WITH t AS (SELECT source_uri, target_uri, {_type_sql('mapping_type')} AS mapping_type FROM v3),
g AS (SELECT source_uri, target_uri, list_distinct(list(mapping_type)) AS types FROM t GROUP BY ALL),
k AS (SELECT count(*) FILTER (WHERE list_contains(types, 'exactMatch') AND (list_contains(types, 'broadMatch')
          OR list_contains(types, 'narrowMatch') OR list_contains(types, 'relatedMatch')))
        + count(*) FILTER (WHERE (list_contains(types, 'broadMatch') OR list_contains(types, 'narrowMatch'))
          AND list_contains(types, 'relatedMatch')) AS conflicts FROM g)
SELECT (SELECT conflicts FROM k) AS conflicts,
       count(*) FILTER (WHERE source_uri IS NULL) AS missing_source_uris,
       count(*) FILTER (WHERE target_uri IS NULL) AS missing_target_uris,
       count(*) FILTER (WHERE source_uri = target_uri) AS self_mappings,
       count(*) AS total_mappings, count(DISTINCT source_uri) AS unique_source_concepts,
       count(DISTINCT target_uri) AS unique_target_concepts, (SELECT conflicts FROM k) = 0 AS is_valid
FROM t""", ("v3",))
def map_validation(spark, d):
    v = T.v3(spark, d)
    return M.mapping_validation(v.withColumn("mapping_type", mapping_type("mapping_type")))


@query("map_type_distribution", "SELECT mapping_type, count(*) AS n FROM v3n GROUP BY 1", ("v3n",))
def map_type_distribution(spark, d):
    return M.mapping_type_distribution(_v3n(spark, d))


@query("map_bidirectional", """
WITH p AS (SELECT DISTINCT source_uri, target_uri FROM v3n)
SELECT DISTINCT least(source_uri, target_uri) AS uri_a, greatest(source_uri, target_uri) AS uri_b FROM p
WHERE (target_uri, source_uri) IN (SELECT (source_uri, target_uri) FROM p)""", ("v3n",))
def map_bidirectional(spark, d):
    return M.bidirectional_mappings(_v3n(spark, d))


@query("map_coverage", """
SELECT count(DISTINCT source_uri) AS source_concepts_with_mappings, count(DISTINCT target_uri) AS target_concepts_mapped
FROM v3n""", ("v3n",))
def map_coverage(spark, d):
    return M.mapping_coverage(_v3n(spark, d))


def _inference_sql() -> str:
    parts = ["SELECT source_uri, target_uri, mapping_type, false AS inferred FROM v3n"]
    for t, rev, new in M.INFERENCE_RULES:
        s, o = ("target_uri", "source_uri") if rev else ("source_uri", "target_uri")
        parts.append(f"SELECT {s}, {o}, '{new}', true FROM v3n WHERE mapping_type = '{t}'")
    for t, rel in M.SUPER_RELATIONS:
        parts.append(f"SELECT source_uri, target_uri, '{rel}', true FROM v3n WHERE mapping_type = '{t}'")
    u = "\nUNION ALL ".join(parts)
    return f"SELECT source_uri, target_uri, mapping_type, bool_and(inferred) AS inferred FROM ({u}) GROUP BY ALL"


@query("map_inference", _inference_sql(), ("v3n",))
def map_inference(spark, d):
    return M.mapping_inference(_v3n(spark, d))


# Chains of up to 500 customers whose names fall along the chain, the worst order for label propagation.
_v("v3chain", """
SELECT 'http://ex.org/chain/' || b || '/' || lpad(CAST(CASE WHEN i = 0 THEN 0 ELSE 500 - i END AS VARCHAR), 4, '0') AS source_uri,
       'http://ex.org/chain/' || b || '/' || lpad(CAST(499 - i AS VARCHAR), 4, '0') AS target_uri, 'exactMatch' AS mapping_type
FROM (SELECT c_custkey // 500 AS b, c_custkey % 500 AS i FROM customer) WHERE i < 499""")


def _chains(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(F.floor(k / 500).cast("string").alias("b"), (k % 500).cast("int").alias("i"))
    name = lambda n: F.concat(F.lit("http://ex.org/chain/"), "b", F.lit("/"), F.lpad(n.cast("string"), 4, "0"))
    return c.where("i < 499").select(name(F.when(F.col("i") == 0, 0).otherwise(500 - F.col("i"))).alias("source_uri"),
                                     name(499 - F.col("i")).alias("target_uri"), F.lit("exactMatch").alias("mapping_type"))


@query("map_clusters", """
WITH RECURSIVE p AS (
  SELECT source_uri AS a, target_uri AS b FROM (SELECT source_uri, target_uri, mapping_type FROM v3n UNION ALL FROM v3chain)
  WHERE mapping_type = 'exactMatch' AND source_uri IS NOT NULL AND target_uri IS NOT NULL),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
lab(uri, cluster) USING KEY (uri) AS (
  SELECT a, a FROM (SELECT DISTINCT a FROM e)
  UNION
  SELECT e.b, min(l.cluster) FROM lab l JOIN e ON e.a = l.uri JOIN recurring.lab r ON r.uri = e.b
  WHERE l.cluster < r.cluster GROUP BY e.b)
SELECT uri, cluster FROM lab""", ("v3n", "v3chain"))
def map_clusters(spark, d):
    """Clusters of the exact matches among the mappings and of chains in adverse label order."""
    stated = _v3n(spark, d).select("source_uri", "target_uri", "mapping_type")
    return M.exact_match_clusters(stated.unionByName(_chains(spark, d)))


MAPPING_CLUSTERS = """
WITH RECURSIVE stated AS (SELECT source_uri, target_uri, mapping_type FROM v3n UNION ALL FROM v3chain),
p AS (SELECT source_uri AS a, target_uri AS b FROM stated WHERE mapping_type = 'exactMatch' AND source_uri IS NOT NULL AND target_uri IS NOT NULL),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
lab(uri, cluster) USING KEY (uri) AS (
  SELECT a, a FROM (SELECT DISTINCT a FROM e)
  UNION
  SELECT e.b, min(l.cluster) FROM lab l JOIN e ON e.a = l.uri JOIN recurring.lab r ON r.uri = e.b
  WHERE l.cluster < r.cluster GROUP BY e.b)"""


@query("map_inference_closed", MAPPING_CLUSTERS + """,
every AS (SELECT source_uri AS s, target_uri AS t, mapping_type AS m, false AS star FROM stated
  UNION ALL SELECT uri, cluster, 'exactMatch', true FROM lab WHERE uri <> cluster
  UNION ALL SELECT cluster, uri, 'exactMatch', true FROM lab WHERE uri <> cluster),
rules(m, rev, new) AS (VALUES ('exactMatch', true, 'exactMatch'), ('exactMatch', false, 'closeMatch'), ('closeMatch', true, 'closeMatch'),
  ('relatedMatch', true, 'relatedMatch'), ('broadMatch', true, 'narrowMatch'), ('narrowMatch', true, 'broadMatch'),
  ('broadMatch', false, 'broader'), ('narrowMatch', false, 'narrower'), ('relatedMatch', false, 'related'),
  ('exactMatch', false, 'mappingRelation'), ('closeMatch', false, 'mappingRelation'), ('broadMatch', false, 'mappingRelation'),
  ('narrowMatch', false, 'mappingRelation'), ('relatedMatch', false, 'mappingRelation'),
  ('exactMatch', true, 'mappingRelation'), ('closeMatch', true, 'mappingRelation'), ('broadMatch', true, 'mappingRelation'),
  ('narrowMatch', true, 'mappingRelation'), ('relatedMatch', true, 'mappingRelation')),
x AS (SELECT s, t, m, star AS inferred FROM every
  UNION ALL SELECT CASE WHEN rev THEN t ELSE s END, CASE WHEN rev THEN s ELSE t END, new, true FROM every JOIN rules USING (m))
SELECT s AS source_uri, t AS target_uri, m AS mapping_type, bool_and(inferred) AS inferred FROM x GROUP BY ALL""", ("v3n", "v3chain"))
def map_inference_closed(spark, d):
    """Inference with the transitivity of exactMatch, written as a star per cluster."""
    stated = _v3n(spark, d).select("source_uri", "target_uri", "mapping_type")
    return M.mapping_inference_closed(stated.unionByName(_chains(spark, d)))


@query("map_triples", """
SELECT DISTINCT source_uri, 0 AS k, '<' || source_uri || '> rdf:type skos:Concept .' AS triple FROM v3n
UNION ALL SELECT DISTINCT source_uri, 1, '<' || source_uri || '> skos:inScheme <http://ex.org/scheme> .' FROM v3n
UNION ALL SELECT source_uri, 2, '<' || source_uri || '> skos:' || coalesce(mapping_type, 'closeMatch') || ' <'
  || target_uri || '> .' FROM v3n WHERE target_uri IS NOT NULL""", ("v3n",))
def map_triples(spark, d):
    return M.mapping_triples(_v3n(spark, d), "http://ex.org/scheme")

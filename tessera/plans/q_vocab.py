"""Flagship query and the serialisation queries."""

from __future__ import annotations

from tessera.plans import flagship
from tessera.plans.registry import query
from tessera.plans.sqlfrag import NL, esc, melt

_W = """
n AS (SELECT DISTINCT trim(id) AS id, CAST(level AS DOUBLE) AS level FROM v1),
e AS (SELECT c.id AS child, arg_max(p.id, length(p.id)) AS parent
      FROM n c JOIN n p ON p.level = c.level - 1 AND starts_with(c.id, p.id)
      WHERE c.level > 1 GROUP BY c.id),
w AS (SELECT 'http://ex.org/vocab/' || v.id AS uri, v.pos, v.label, v.notation,
             CASE WHEN e.parent IS NOT NULL THEN 'http://ex.org/vocab/' || e.parent END AS broader
      FROM v1 v LEFT JOIN e ON v.id = e.child)"""

_LONG = f"""
l AS ({melt('w', 'uri, pos', 'prefLabel', 'label')}
  UNION ALL {melt('w', 'uri, pos', 'notation', 'notation')}
  UNION ALL {melt('w', 'uri, pos', 'broader', 'broader')}),
t AS (SELECT uri, pos, prop, vpos, value,
        CASE WHEN prop = 'broader' THEN '<' || value || '>'
             WHEN prop = 'notation' THEN '"' || {esc('value')} || '"^^xsd:string'
             ELSE '"' || {esc('value')} || '"@en' END AS term,
        CASE prop WHEN 'prefLabel' THEN 0 WHEN 'notation' THEN 3 WHEN 'broader' THEN 11 END AS r
      FROM l)"""


@query("vocab_ttl", f"""
WITH {_W}, {_LONG}
SELECT uri, '<' || uri || '> a skos:Concept ;' || {NL} || '    skos:inScheme <> ;' || {NL}
  || string_agg('    skos:' || prop || ' ' || term, ' ;' || {NL} ORDER BY r, vpos, '    skos:' || prop || ' ' || term)
  || ' .' AS block
FROM t GROUP BY uri, pos""", ("v1",))
def vocab_ttl(spark, d):
    return flagship.vocabulary_blocks(spark, d)


@query("melt_fields", f"WITH {_W}, {_LONG} SELECT uri, pos, prop, vpos, value FROM l", ("v1",))
def melt_fields_q(spark, d):
    from tessera.operators.fields import melt_fields
    return melt_fields(flagship.flagship_wide(spark, d), flagship.MAPPING, "uri", "pos")


@query("typed_terms", f"WITH {_W}, {_LONG} SELECT uri, pos, prop, vpos, value, term FROM t", ("v1",))
def typed_terms_q(spark, d):
    from tessera.operators.fields import melt_fields, typed_terms
    return typed_terms(melt_fields(flagship.flagship_wide(spark, d), flagship.MAPPING, "uri", "pos"), "en")


# ---------------------------------------------------------------- P1, P4, P7 over V7 / V1
@query("map_fields", """
SELECT c_custkey AS uri, c_name AS prefLabel, c_mktsegment AS altLabel, CAST(c_nationkey AS VARCHAR) AS notation
FROM (SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, c_nationkey FROM customer)""")
def map_fields_q(spark, d):
    from tessera.operators.fields import map_fields
    from tessera.sources.tables import table
    c = table(spark, d, "customer")
    mapping = {"uri": "c_custkey", "prefLabel": "c_name", "altLabel": "c_mktsegment", "notation": "c_nationkey",
               "definition": "c_comment", "unknownProp": "c_acctbal"}
    return map_fields(c, mapping)


@query("concept_uri", """
SELECT id, CASE WHEN id IS NULL OR trim(id) = '' THEN 'http://ex.org/base/' || sha256(coalesce(name, ''))
                WHEN starts_with(trim(id), 'http') THEN trim(id)
                ELSE 'http://ex.org/base/' || trim(id) END AS uri
FROM (SELECT CASE WHEN id LIKE 'k1%' THEN 'http://ex.org/abs/' || id ELSE id END AS id, name FROM v7a)""", ("v7a",))
def concept_uri_q(spark, d):
    from pyspark.sql import functions as F
    from tessera.operators.fields import concept_uri
    from tessera.plans import testbed as T
    a = T.v7(spark, d)["a"]
    a = a.withColumn("id", F.when(F.col("id").like("k1%"), F.concat(F.lit("http://ex.org/abs/"), "id"))
                     .otherwise(F.col("id")))
    return a.select("id", concept_uri("id", "http://ex.org/base", F.coalesce(F.col("name"), F.lit(""))).alias("uri"))


@query("join_preview", """
WITH ab AS (SELECT coalesce(a.id, b.id) AS id, a.name, b.nation FROM v7a a FULL JOIN v7b b ON a.id = b.id)
SELECT * FROM ab ORDER BY id NULLS LAST, name NULLS LAST, nation NULLS LAST LIMIT 100""", ("v7a", "v7b"))
def join_preview(spark, d):
    from pyspark.sql import functions as F
    from tessera.operators import combine as C
    from tessera.operators.fields import preview
    from tessera.plans import testbed as T
    v = T.v7(spark, d)
    j = C.distributed_join([("a.csv", v["a"].drop("pos")), ("b.csv", v["b"].drop("pos"))], "id", "outer")
    return preview(j, 100, [F.col("id").asc_nulls_last(), F.col("name").asc_nulls_last(),
                            F.col("nation").asc_nulls_last()])


@query("sample_check")
def sample_check_q(spark, d):
    from tessera.operators.fields import sample_check
    from tessera.plans import testbed as T
    return sample_check(T.v3(spark, d), 1000, ["pos"])

"""Registered collection queries (G1-G8) over V4."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import collections as G
from tessera.plans import testbed as T
from tessera.plans.registry import query
from tessera.sources.tables import table

V4 = ("v4c", "v4p")
CURI = ("'http://example.org/collections/collection/' || "
        "regexp_replace(translate(collection, ' /', '__'), '[^\\p{L}\\p{N}_-]', '', 'g')")


def _colls_sql(src: str, typ: str, label: bool) -> str:
    lab = ("coalesce(arg_min(label, pos) FILTER (WHERE label IS NOT NULL), collection)" if label else "collection")
    return (f"SELECT collection, {CURI} AS coll_uri, '{typ}' AS type, {lab} AS label, count(member) AS member_count "
            f"FROM {src} WHERE collection IS NOT NULL GROUP BY collection")


def _conv(spark, d, ordered=False):
    return G.build_collections(T.v4(spark, d)["conv"], "collection", "member", "label",
                               "ord" if ordered else None, ordered=ordered)


def _part(spark, d, ordered=False, with_order=True):
    return G.build_collections(T.v4(spark, d)["part"], "collection", "member", None,
                               "ord" if with_order else None, ordered=ordered)


@query("coll_build", _colls_sql("v4c", "Collection", True), V4)
def coll_build(spark, d):
    return _conv(spark, d)[0]


@query("coll_ordered", f"""
SELECT collection, {CURI} AS coll_uri, member, ord,
       row_number() OVER (PARTITION BY collection ORDER BY ord, member) AS position
FROM v4c""", V4)
def coll_ordered(spark, d):
    from tessera.sources.ttl import number_rows
    _, m = _conv(spark, d, ordered=True)
    num = number_rows(m.select("collection", "coll_uri", "member", "ord"), ["collection", "ord", "member"], "i")
    first = num.groupBy("collection").agg(F.min("i").alias("i0"))
    return num.join(first, "collection").select("collection", "coll_uri", "member", "ord",
                                                (F.col("i") - F.col("i0") + 1).alias("position"))


@query("coll_thematic", _colls_sql("v4p", "Collection", False), V4)
def coll_thematic(spark, d):
    p = T.v4(spark, d)["part"]
    return G.thematic_collections(p, "member", "collection")[0]


@query("coll_merge", f"""
WITH a AS ({_colls_sql("(SELECT * FROM v4c WHERE label = 'user')", "Collection", True)}),
b AS ({_colls_sql("(SELECT * FROM v4c WHERE label <> 'user')", "Collection", True)}),
f AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE collection NOT IN (SELECT collection FROM a)),
m AS (SELECT collection, count(DISTINCT member) AS n FROM v4c GROUP BY collection)
SELECT f.collection, f.coll_uri, f.type, f.label, coalesce(m.n, 0) AS member_count
FROM f LEFT JOIN m ON f.collection = m.collection""", V4)
def coll_merge(spark, d):
    conv = T.v4(spark, d)["conv"]
    a = G.build_collections(conv.where("label = 'user'"), "collection", "member", "label")
    b = G.build_collections(conv.where("label <> 'user'"), "collection", "member", "label")
    return G.merge_collections([a, b])[0]


@query("coll_validation", """
WITH c AS (SELECT collection, count(member) AS n, count(DISTINCT member) AS nd FROM v4c GROUP BY collection)
SELECT collection, 'warning' AS severity, printf('Collection ''%s'' has duplicate members', collection) AS message
FROM c WHERE n <> nd
UNION ALL SELECT collection, 'warning', printf('Collection ''%s'' has no members', collection) FROM c WHERE n = 0
UNION ALL SELECT DISTINCT collection, 'issue', printf('Ordered collection ''%s'' has no member list', collection)
FROM v4p""", V4)
def coll_validation(spark, d):
    cc, cm = _conv(spark, d, ordered=True)
    pc, pm = _part(spark, d, ordered=True, with_order=False)
    return G.collection_validation(cc, cm).unionByName(G.collection_validation(pc, pm))


@query("coll_stats", f"""
WITH c AS ({_colls_sql("v4c", "OrderedCollection", True)} UNION ALL {_colls_sql("v4p", "Collection", False)})
SELECT count(*) AS total_collections, CAST(sum(member_count) AS BIGINT) AS total_members,
       round(avg(member_count), 6) AS average_members_per_collection,
       max(member_count) AS largest_collection_size, min(member_count) AS smallest_collection_size,
       count(*) FILTER (WHERE type = 'OrderedCollection') AS ordered_collections,
       count(*) FILTER (WHERE type = 'Collection') AS unordered_collections FROM c""", V4)
def coll_stats(spark, d):
    cc, _ = _conv(spark, d, ordered=True)
    pc, _ = _part(spark, d)
    return G.collection_stats(cc.unionByName(pc))


@query("coll_top5", f"""
SELECT collection, member_count FROM ({_colls_sql("v4c", "Collection", True)})
ORDER BY member_count DESC, collection LIMIT 5""", V4)
def coll_top5(spark, d):
    return G.collection_top(_conv(spark, d)[0], 5)


@query("coll_suggest", """
WITH l AS (SELECT 'p_name' AS field, p_name AS value FROM part UNION ALL SELECT 'p_brand', p_brand FROM part
           UNION ALL SELECT 'p_type', p_type FROM part),
s AS (SELECT field, value, count(*) AS n FROM l GROUP BY ALL),
p AS (SELECT field, sum(n) AS total_rows, count(*) FILTER (WHERE value IS NOT NULL) AS unique_groups,
             var_samp(n) FILTER (WHERE value IS NOT NULL) AS size_variance FROM s GROUP BY field)
SELECT field, unique_groups, round(total_rows / unique_groups, 6) AS average_group_size,
       round(size_variance, 6) AS size_variance,
       round((total_rows / unique_groups) / (1 + size_variance / (total_rows / unique_groups)), 6) AS quality_score
FROM p WHERE unique_groups >= 2 AND unique_groups <= least(50, floor(total_rows / 2))
ORDER BY quality_score DESC, field LIMIT 5""")
def coll_suggest(spark, d):
    p = table(spark, d, "part")
    return G.suggest_groupings(p, "p_partkey")


@query("coll_triples", f"""
WITH oc AS ({_colls_sql("v4c", "OrderedCollection", True)}),
pc AS ({_colls_sql("v4p", "Collection", False)}),
c AS (SELECT * FROM oc UNION ALL SELECT * FROM pc),
n AS (SELECT collection, {CURI} AS coll_uri, member, row_number() OVER (ORDER BY collection, ord, member) AS i
      FROM v4c),
h AS (SELECT collection, coll_uri, min(i) AS i FROM n GROUP BY ALL)
SELECT coll_uri, 0 AS k, '<' || coll_uri || '> rdf:type skos:' || type || ' .' AS triple FROM c
UNION ALL SELECT coll_uri, 1, '<' || coll_uri || '> rdfs:label "' || label || '"@en .' FROM c
UNION ALL SELECT DISTINCT coll_uri, 3, '<' || coll_uri || '> skos:member <' || member || '> .' FROM (
  SELECT {CURI} AS coll_uri, member FROM v4c UNION ALL SELECT {CURI}, member FROM v4p)
UNION ALL SELECT coll_uri, 4, '_:l' || i || ' rdf:first <' || member || '> .' FROM n
UNION ALL SELECT a.coll_uri, 5, '_:l' || a.i || ' rdf:rest ' || coalesce('_:l' || b.i, 'rdf:nil') || ' .'
  FROM n a LEFT JOIN n b ON a.collection = b.collection AND b.i = a.i + 1
UNION ALL SELECT coll_uri, 6, '<' || coll_uri || '> skos:memberList _:l' || i || ' .' FROM h""", V4)
def coll_triples(spark, d):
    cc, cm = _conv(spark, d, ordered=True)
    pc, pm = _part(spark, d)
    return G.collection_triples(cc.unionByName(pc), cm.unionByName(pm))

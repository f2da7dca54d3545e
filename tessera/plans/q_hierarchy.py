"""Registered hierarchy queries (H1-H18) over test-bed views V1 / V1x."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import hierarchy as H
from tessera.plans import testbed as T
from tessera.plans.registry import query

BLANK = "(parent_id IS NULL OR trim(parent_id) = '')"
EDGES_V1X = f"SELECT id AS child, parent_id AS parent FROM v1x WHERE NOT {BLANK}"


@query("hier_parent", f"SELECT id AS child, parent_id AS parent FROM v1 WHERE NOT {BLANK}", ("v1",))
def hier_parent(spark, d):
    return H.edges_from_parent(T.v1(spark, d))


@query("hier_concepts", f"""
SELECT DISTINCT concept FROM (SELECT id AS concept FROM v1x
  UNION ALL SELECT parent_id FROM v1x WHERE NOT {BLANK})""", ("v1x",))
def hier_concepts(spark, d):
    v = T.v1x(spark, d)
    return H.concepts_of(v, H.edges_from_parent(v))


@query("hier_level", """
SELECT v.id AS child, l.parent FROM v1 v
JOIN (SELECT CAST(level AS DOUBLE) AS level, max(id) AS parent FROM v1 GROUP BY 1) l
  ON CAST(v.level AS DOUBLE) - 1 = l.level
WHERE v.level > 1""", ("v1",))
def hier_level(spark, d):
    return H.edges_from_level(T.v1(spark, d))


@query("hier_level_first", """
SELECT v.id AS child, l.parent FROM v1 v
JOIN (SELECT CAST(level AS DOUBLE) AS level, arg_min(id, pos) AS parent FROM v1 GROUP BY 1) l
  ON CAST(v.level AS DOUBLE) - 1 = l.level
WHERE v.level - 1 > 0""", ("v1",))
def hier_level_first(spark, d):
    return H.edges_from_level_first(T.v1(spark, d))


@query("hier_prefix", """
WITH n AS (SELECT DISTINCT trim(id) AS id, CAST(level AS DOUBLE) AS level FROM v1)
SELECT c.id AS child, arg_max(p.id, length(p.id)) AS parent
FROM n c JOIN n p ON p.level = c.level - 1 AND starts_with(c.id, p.id)
WHERE c.level > 1
GROUP BY c.id""", ("v1",))
def hier_prefix(spark, d):
    return H.edges_from_prefix(T.v1(spark, d))


@query("hier_path", """
WITH b AS (
  SELECT id AS child, pos,
         list_filter(list_transform(string_split(path, '/'), lambda x: trim(x)), lambda x: x <> '') AS parts
  FROM v1),
o AS (SELECT array_to_string(parts, '/') AS path, arg_max(id_, pos) AS parent
      FROM (SELECT child AS id_, pos, parts FROM b) GROUP BY 1)
SELECT b.child, o.parent FROM b
JOIN o ON array_to_string(b.parts[1:len(b.parts) - 1], '/') = o.path
WHERE len(b.parts) > 1 AND o.parent <> b.child""", ("v1",))
def hier_path(spark, d):
    return H.edges_from_path(T.v1(spark, d))


@query("hier_notation", """
WITH o AS (SELECT notation, arg_min(id, pos) AS parent FROM v1 GROUP BY notation)
SELECT v.id AS child, o.parent FROM v1 v
JOIN o ON regexp_replace(v.notation, '\\.[^.]*$', '') = o.notation
WHERE contains(v.notation, '.')""", ("v1",))
def hier_notation(spark, d):
    return H.edges_from_notation(T.v1(spark, d))


@query("hier_pairs", """
SELECT id AS child, parent_id AS parent FROM v1x
WHERE id IS NOT NULL AND id <> '' AND parent_id IS NOT NULL AND parent_id <> ''""", ("v1x",))
def hier_pairs(spark, d):
    return H.edges_from_pairs(T.v1x(spark, d), "id", "parent_id")


SKOS_REL_SQL = """
SELECT parent_id AS uri, 'narrower' AS prop, id AS target, pos FROM v1 WHERE level = 2
UNION ALL SELECT id, 'broader', substring(parent_id, 1, 2), pos * 2 FROM v1 WHERE level = 3
UNION ALL SELECT id, 'broader', parent_id, pos * 2 + 1 FROM v1 WHERE level = 3"""


def _skos_relations(spark, d):
    v = T.v1(spark, d)
    nar = v.where("level = 2").select(F.col("parent_id").alias("uri"), F.lit("narrower").alias("prop"),
                                      F.col("id").alias("target"), "pos")
    b1 = v.where("level = 3").select(F.col("id").alias("uri"), F.lit("broader").alias("prop"),
                                     F.substring("parent_id", 1, 2).alias("target"), (F.col("pos") * 2).alias("pos"))
    b2 = v.where("level = 3").select(F.col("id").alias("uri"), F.lit("broader").alias("prop"),
                                     F.col("parent_id").alias("target"), (F.col("pos") * 2 + 1).alias("pos"))
    return nar.unionByName(b1).unionByName(b2)


@query("hier_skos", f"""
WITH r AS ({SKOS_REL_SQL})
SELECT DISTINCT child, parent FROM (
  SELECT uri AS child, arg_max(target, pos) AS parent FROM r WHERE prop = 'broader' GROUP BY uri
  UNION ALL SELECT target, uri FROM r WHERE prop = 'narrower')""", ("v1",))
def hier_skos(spark, d):
    return H.edges_from_skos(_skos_relations(spark, d))


@query("hier_auto", """
SELECT 'level' AS source, v.id AS child, l.parent FROM v1 v
JOIN (SELECT CAST(level AS DOUBLE) AS level, max(id) AS parent FROM v1 GROUP BY 1) l
  ON CAST(v.level AS DOUBLE) - 1 = l.level
WHERE v.level > 1""", ("v1",))
def hier_auto(spark, d):
    source, edges = H.extract_hierarchy(T.v1(spark, d))
    return edges.select(F.lit(source).alias("source"), "child", "parent")


@query("hier_narrower", f"""
WITH e AS (SELECT DISTINCT parent_id AS parent, id AS child FROM v1 WHERE NOT {BLANK})
SELECT parent, child, count(*) OVER (PARTITION BY parent) AS n_children FROM e""", ("v1",))
def hier_narrower(spark, d):
    return H.narrower_lists(H.edges_from_parent(T.v1(spark, d)))


@query("hier_missing_parents", f"""
SELECT id AS concept_id, parent_id AS missing_parent FROM v1x
WHERE NOT {BLANK} AND parent_id NOT IN (SELECT id FROM v1x)""", ("v1x",))
def hier_missing_parents(spark, d):
    return H.missing_parents(T.v1x(spark, d))


@query("hier_cycles", f"""
WITH RECURSIVE p AS (
  SELECT id AS node, arg_min({{'p': CASE WHEN {BLANK} THEN NULL ELSE parent_id END}}, pos).p AS ptr
  FROM v1x GROUP BY id),
q AS (SELECT p.node, CASE WHEN k.node IS NOT NULL THEN p.ptr END AS ptr
      FROM p LEFT JOIN (SELECT node FROM p) k ON p.ptr = k.node),
walk(start, cur, depth) AS (
  SELECT node, ptr, 1 FROM q WHERE ptr IS NOT NULL
  UNION ALL
  SELECT w.start, q.ptr, w.depth + 1 FROM walk w JOIN q ON q.node = w.cur
  WHERE q.ptr IS NOT NULL AND w.depth <= (SELECT count(*) FROM q))
SELECT DISTINCT start AS concept_id FROM walk WHERE depth > (SELECT count(*) FROM q)""", ("v1x",))
def hier_cycles(spark, d):
    return H.circular_references(T.v1x(spark, d))


@query("hier_mutual", f"""
WITH e AS (SELECT DISTINCT child, parent FROM ({EDGES_V1X}))
SELECT a.child AS source, a.parent AS target FROM e a
WHERE EXISTS (SELECT 1 FROM e b WHERE b.child = a.parent AND b.parent = a.child)""", ("v1x",))
def hier_mutual(spark, d):
    return H.mutual_broader(H.edges_from_parent(T.v1x(spark, d)))


@query("hier_closure", f"""
WITH RECURSIVE e AS (SELECT DISTINCT child, parent FROM ({EDGES_V1X})),
c(child, parent) AS (SELECT child, parent FROM e
  UNION SELECT c.child, e.parent FROM c JOIN e ON c.parent = e.child)
SELECT child, parent FROM c""", ("v1x",))
def hier_closure(spark, d):
    return H.transitive_closure(H.edges_from_parent(T.v1x(spark, d)))


GRAPH_CLOSURE = """
WITH RECURSIVE g AS (SELECT DISTINCT child, parent FROM v1g),
c(child, parent) AS (SELECT child, parent FROM g
  UNION SELECT c.child, g.parent FROM c JOIN g ON c.parent = g.child)"""
#: Mutual reachability on the chains of orders alone: no other part of V1g reaches an order.
GRAPH_MEMBERS = """,
m AS (SELECT a.child AS member, min(a.parent) AS component FROM c a JOIN c b ON b.child = a.parent AND b.parent = a.child GROUP BY 1)"""


@query("hier_components", GRAPH_CLOSURE + GRAPH_MEMBERS + """,
f AS (SELECT x.component, min({'a': g.child, 'b': g.parent}) AS e FROM g JOIN m x ON x.member = g.child JOIN m y ON y.member = g.parent
      WHERE x.component = y.component GROUP BY 1)
SELECT m.component, m.member, count(*) OVER (PARTITION BY m.component) AS n_members, f.e.a AS cycle_child, f.e.b AS cycle_parent
FROM m JOIN f ON f.component = m.component""", ("v1g",))
def hier_components(spark, d):
    """H12 over concepts with several parents: cycles as strongly connected components."""
    return G.strong_components(T.v1g(spark, d))


@query("hier_cycle_edges", GRAPH_CLOSURE + GRAPH_MEMBERS + """
SELECT x.component, g.child, g.parent FROM g JOIN m x ON x.member = g.child JOIN m y ON y.member = g.parent
WHERE x.component = y.component""", ("v1g",))
def hier_cycle_edges(spark, d):
    return G.cycle_edges(T.v1g(spark, d))


@query("hier_closure_graph", GRAPH_CLOSURE + """
SELECT child, parent FROM c""", ("v1g",))
def hier_closure_graph(spark, d):
    """H14 over concepts with several parents, chains and cycles."""
    return G.closure_by_doubling(T.v1g(spark, d))


@query("hier_reachable", GRAPH_CLOSURE.replace("v1g", "v1s") + """
SELECT p.child, p.ancestor, c.child IS NOT NULL AS reachable FROM v1p p
LEFT JOIN c ON c.child = p.child AND c.parent = p.ancestor""", ("v1s", "v1p"))
def hier_reachable(spark, d):
    """H14 without a closure: pairs of concepts asked for."""
    return G.AncestorIndex(T.v1s(spark, d)).reachable(T.v1p(spark, d))


@query("hier_top_concepts", f"SELECT id AS concept FROM v1x WHERE {BLANK}", ("v1x",))
def hier_top_concepts(spark, d):
    return H.top_concepts(T.v1x(spark, d))


@query("hier_orphans", f"""
SELECT DISTINCT id AS concept FROM v1x
WHERE id NOT IN (SELECT child FROM ({EDGES_V1X})) AND id NOT IN (SELECT parent FROM ({EDGES_V1X}))""",
       ("v1x",))
def hier_orphans(spark, d):
    v = T.v1x(spark, d)
    return H.orphans(v, H.edges_from_parent(v))


@query("hier_stats", f"""
SELECT count(*) AS total_concepts,
       count(*) FILTER (WHERE {BLANK}) AS top_level_concepts,
       count(*) FILTER (WHERE id IN (SELECT parent_id FROM v1x WHERE NOT {BLANK})) AS concepts_with_children,
       max(CAST(level AS DOUBLE)) AS max_depth
FROM v1x""", ("v1x",))
def hier_stats(spark, d):
    return H.hierarchy_stats(T.v1x(spark, d))


@query("hier_triples", """
WITH n AS (SELECT DISTINCT trim(id) AS id, CAST(level AS DOUBLE) AS level FROM v1),
e AS (SELECT c.id AS child, arg_max(p.id, length(p.id)) AS parent
      FROM n c JOIN n p ON p.level = c.level - 1 AND starts_with(c.id, p.id)
      WHERE c.level > 1 GROUP BY c.id)
SELECT child, parent, '<http://ex.org/v/' || child || '> skos:broader <http://ex.org/v/' || parent || '> .' AS triple
FROM e""", ("v1",))
def hier_triples(spark, d):
    return H.relations_to_triples(H.edges_from_prefix(T.v1(spark, d)), "http://ex.org/v/")


@query("hier_outline", """
WITH t AS (SELECT id, CAST(level AS INTEGER) AS level, path FROM v1),
p AS (SELECT a.id, a.level,
             (SELECT arg_max(b.id, b.path) FROM t b WHERE b.path < a.path AND b.level <= a.level - 1) AS pid,
             (SELECT max(b.path) FROM t b WHERE b.path < a.path AND b.level <= a.level - 1) AS ppath
      FROM t a WHERE a.level > 1)
SELECT p.id AS child, p.pid AS parent FROM p JOIN t ON t.path = p.ppath AND t.id = p.pid
WHERE t.level = p.level - 1""", ("v1",))
def hier_outline(spark, d):
    return H.edges_from_outline(T.v1(spark, d), order_col="path", block=64)


@query("hier_auto_parent", f"""
SELECT 'parent' AS source, id AS child, parent_id AS parent FROM v1 WHERE NOT {BLANK}""", ("v1",))
def hier_auto_parent(spark, d):
    """H9 when the table has no level column: the parent column is used."""
    source, edges = H.extract_hierarchy(T.v1(spark, d).drop("level"))
    return edges.select(F.lit(source).alias("source"), "child", "parent")


@query("hier_auto_path", """
WITH b AS (
  SELECT id AS child, pos,
         list_filter(list_transform(string_split(path, '/'), lambda x: trim(x)), lambda x: x <> '') AS parts
  FROM v1),
o AS (SELECT array_to_string(parts, '/') AS path, arg_max(id_, pos) AS parent
      FROM (SELECT child AS id_, pos, parts FROM b) GROUP BY 1)
SELECT 'path' AS source, b.child, o.parent FROM b
JOIN o ON array_to_string(b.parts[1:len(b.parts) - 1], '/') = o.path
WHERE len(b.parts) > 1 AND o.parent <> b.child""", ("v1",))
def hier_auto_path(spark, d):
    """H9 when only a path column is present."""
    source, edges = H.extract_hierarchy(T.v1(spark, d).drop("level", "parent_id"))
    return edges.select(F.lit(source).alias("source"), "child", "parent")

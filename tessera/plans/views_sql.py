"""DuckDB text of the test-bed views, the same rows as ``tessera.plans.testbed``.

Each entry is ``name -> (dependencies, SELECT ...)``; ``with_views`` puts the
needed ones, dependencies first, in a WITH clause in front of an oracle.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _v(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    VIEWS[name] = (deps, sql)


def with_views(body: str, names: tuple[str, ...]) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n][1]}\n)" for n in order)
    body = body.strip()
    head = body.upper()
    if head.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if head.startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


# V1: region / nation / customer as a three-level code vocabulary
_v("v1", """
SELECT lpad(CAST(r_regionkey AS VARCHAR), 2, '0') AS id, CAST(NULL AS VARCHAR) AS parent_id,
       CAST(1 AS INTEGER) AS level, r_name AS label,
       lpad(CAST(r_regionkey AS VARCHAR), 2, '0') AS path, CAST(r_regionkey AS VARCHAR) AS notation,
       CAST(1000000000000 + r_regionkey AS BIGINT) AS pos
FROM region
UNION ALL
SELECT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 2, '0'),
       lpad(CAST(n_regionkey AS VARCHAR), 2, '0'), CAST(2 AS INTEGER), n_name,
       lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || '/' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0'),
       CAST(n_regionkey AS VARCHAR) || '.' || CAST(n_nationkey AS VARCHAR),
       CAST(2000000000000 + n_nationkey AS BIGINT)
FROM nation
UNION ALL
SELECT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')
         || lpad(CAST(c_custkey AS VARCHAR), 12, '0'),
       lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 2, '0'),
       CAST(3 AS INTEGER), c_name,
       lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || '/' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')
         || '/' || lpad(CAST(c_custkey AS VARCHAR), 12, '0'),
       CAST(n_regionkey AS VARCHAR) || '.' || CAST(n_nationkey AS VARCHAR) || '.' || CAST(c_custkey AS VARCHAR),
       CAST(3000000000000 + c_custkey AS BIGINT)
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")

# V1x: V1 plus a self loop, a two-node cycle, a chain into it, a missing parent, blank parents
_v("v1x", """
SELECT * FROM v1
UNION ALL
SELECT * FROM (VALUES
  ('zz01', 'zz01', 2, 'Self loop', 'zz01', 'zz01', CAST(9000000000001 AS BIGINT)),
  ('zz02', 'zz03', 2, 'Cycle a', 'zz02', 'zz02', CAST(9000000000002 AS BIGINT)),
  ('zz03', 'zz02', 2, 'Cycle b', 'zz03', 'zz03', CAST(9000000000003 AS BIGINT)),
  ('zz04', 'zz02', 3, 'Into cycle', 'zz04', 'zz04', CAST(9000000000004 AS BIGINT)),
  ('zz05', '99', 2, 'Missing parent', 'zz05', 'zz05', CAST(9000000000005 AS BIGINT)),
  ('zz06', '', 1, 'Blank parent', 'zz06', 'zz06', CAST(9000000000006 AS BIGINT)),
  ('zz07', '  ', 1, 'Space parent', 'zz07', 'zz07', CAST(9000000000007 AS BIGINT))
) AS t(id, parent_id, level, label, path, notation, pos)
""", ("v1",))

# V1g: a broader graph with several parents: V1x, segments as second parents of customers, and orders below their customer and
# the order before (chains of up to 50); every fourth chain is closed to a cycle
_v("v1s", """
SELECT id AS child, parent_id AS parent FROM v1x WHERE parent_id IS NOT NULL AND trim(parent_id) <> ''
UNION ALL SELECT id, 'seg/' || c_mktsegment FROM v1x JOIN customer ON level = 3 AND label = c_name
UNION ALL SELECT 'seg/' || c_mktsegment, '00' FROM customer""", ("v1x",))
_v("v1g", """
SELECT child, parent FROM v1s
UNION ALL SELECT 'ord/' || CAST(o_orderkey AS VARCHAR), id FROM orders JOIN customer ON o_custkey = c_custkey JOIN v1x ON level = 3 AND label = c_name
UNION ALL SELECT 'ord/' || CAST(o_orderkey AS VARCHAR), 'ord/' || CAST(o_orderkey - 1 AS VARCHAR) FROM orders WHERE o_orderkey % 50 <> 0
UNION ALL SELECT 'ord/' || CAST(o_orderkey - 9 AS VARCHAR), 'ord/' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 200 = 10
""", ("v1s",))
# V1p: pairs to ask V1s for
_v("v1p", """
SELECT id AS child, 'seg/BUILDING' AS ancestor FROM v1x
UNION SELECT id, '0' || CAST(pos % 5 AS VARCHAR) FROM v1x
UNION SELECT id, substring(id, 1, 4) FROM v1x
UNION SELECT id, 'zz02' FROM v1x""", ("v1x",))

# V7: overlapping sources with null keys and repeated ids
_v("v7a", """
SELECT CASE WHEN c_acctbal < -900 THEN NULL ELSE 'k' || CAST(c_custkey AS VARCHAR) END AS id,
       c_name AS name, CAST(c_custkey AS BIGINT) AS pos FROM customer""")
_v("v7b", """
SELECT 'k' || CAST(c_custkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS nation, CAST(c_custkey AS BIGINT) AS pos
FROM customer WHERE c_acctbal >= 0
UNION ALL
SELECT 'k' || CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS VARCHAR), CAST(c_custkey + 1000000000000 AS BIGINT)
FROM customer WHERE c_acctbal >= 0 AND c_mktsegment = 'BUILDING'""")
_v("v7c", """
SELECT 'k' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, s_acctbal AS balance, CAST(s_suppkey AS BIGINT) AS pos
FROM supplier""")

# V2: literals from documents; two documents per URI
_v("v2", """
SELECT 'http://ex.org/doc/' || CAST(doc_id // 2 AS VARCHAR) AS uri, 'prefLabel' AS prop, split_part(text, chr(10), 1) AS text,
       lang, CAST(doc_id * 10 AS BIGINT) AS pos FROM documents
UNION ALL SELECT 'http://ex.org/doc/' || CAST(doc_id // 2 AS VARCHAR), 'altLabel', split_part(text, chr(10), -1), lang,
       CAST(doc_id * 10 + 1 AS BIGINT) FROM documents
UNION ALL SELECT 'http://ex.org/doc/' || CAST(doc_id // 2 AS VARCHAR), 'definition', text, lang,
       CAST(doc_id * 10 + 2 AS BIGINT) FROM documents""")


_v("v1r", """
SELECT id AS uri, 'broader' AS prop, parent_id AS target FROM v1x WHERE parent_id IS NOT NULL AND trim(parent_id) <> ''
UNION ALL SELECT id, 'related', substring(parent_id, 1, 2) FROM v1x WHERE level = 3
UNION ALL SELECT id, 'related', parent_id FROM v1x WHERE level = 3 AND label LIKE '%7'
UNION ALL SELECT id, 'xlPrefLabel', id || '#l' FROM v1x WHERE level = 2
UNION ALL SELECT id, 'xlAltLabel', parent_id FROM v1x WHERE level = 3
UNION ALL SELECT id || '#l', 'literalForm', label FROM v1x WHERE level = 2
UNION ALL SELECT id || '#x', 'literalForm', label FROM v1x WHERE level = 1""", ("v1x",))

# V3: mappings from lineitem
_v("v3", """
SELECT 'part/' || CAST(l_partkey AS VARCHAR) AS source_uri, 'supplier/' || CAST(l_suppkey AS VARCHAR) AS target_uri,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'exact'
            WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'Broader'
            WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'related'
            WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'narrower'
            WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'exactMatch' END AS mapping_type,
       l_discount AS confidence, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS pos
FROM lineitem
UNION ALL SELECT 'supplier/' || CAST(l_suppkey AS VARCHAR), 'part/' || CAST(l_partkey AS VARCHAR), 'exactMatch',
       l_discount, CAST(l_orderkey * 10 + l_linenumber + 1000000000000 AS BIGINT) FROM lineitem WHERE l_linenumber = 1
UNION ALL SELECT 'part/' || CAST(l_partkey AS VARCHAR), 'part/' || CAST(l_partkey AS VARCHAR), 'related',
       l_discount, CAST(l_orderkey * 10 + l_linenumber + 2000000000000 AS BIGINT) FROM lineitem WHERE l_linenumber = 7
UNION ALL SELECT 'http://ex.org/part/' || CAST(l_partkey AS VARCHAR), NULL, 'close',
       l_discount, CAST(l_orderkey * 10 + l_linenumber + 3000000000000 AS BIGINT) FROM lineitem WHERE l_quantity < 2""")

# V4: collection rows
_v("v4c", """
SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS collection, 'http://ex.org/text/' || substring(md5(text), 1, 16) AS member,
       turn AS ord, role AS label, CAST(conv_id * 1000 + turn AS BIGINT) AS pos FROM conversations""")
_v("v4p", """
SELECT p_brand AS collection, 'http://ex.org/part/' || CAST(p_partkey AS VARCHAR) AS member, CAST(p_size AS BIGINT) AS ord,
       CAST(NULL AS VARCHAR) AS label, CAST(p_partkey AS BIGINT) AS pos FROM part""")

# V5: documentation rows
_v("v5", """
SELECT 'http://ex.org/doc/' || CAST(d.doc_id AS VARCHAR) AS uri, CAST(d.doc_id AS BIGINT) AS pos,
       CASE WHEN lang = 'en' AND coalesce(l.toxic, 0) = 0 THEN text END AS def_en, CASE WHEN lang = 'fr' AND coalesce(l.toxic, 0) = 0 THEN text END AS def_fr,
       CASE WHEN lang = 'de' AND coalesce(l.toxic, 0) = 0 THEN text END AS def_de, CASE WHEN lang = 'es' AND coalesce(l.toxic, 0) = 0 THEN text END AS def_es,
       CASE WHEN l.quality = 1 THEN regexp_extract(text, '^[^.!?]*[.!?]', 0) END AS example,
       CASE WHEN l.toxic = 1 THEN 'Flagged in review' END AS changeNote,
       p.html AS note
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN pages p ON d.doc_id = p.page_id""")
_v("v5d", """
SELECT uri AS concept_uri, doc_type, lang, content, pos, k FROM (
  SELECT uri, 'definition' AS doc_type, 'en' AS lang, regexp_replace(def_en, '^\\s+|\\s+$', '', 'g') AS content, pos, 0 AS k FROM v5
  UNION ALL SELECT uri, 'definition', 'fr', regexp_replace(def_fr, '^\\s+|\\s+$', '', 'g'), pos, 1 FROM v5
  UNION ALL SELECT uri, 'definition', 'de', regexp_replace(def_de, '^\\s+|\\s+$', '', 'g'), pos, 2 FROM v5
  UNION ALL SELECT uri, 'definition', 'es', regexp_replace(def_es, '^\\s+|\\s+$', '', 'g'), pos, 3 FROM v5
  UNION ALL SELECT uri, 'example', 'en', regexp_replace(example, '^\\s+|\\s+$', '', 'g'), pos, 4 FROM v5
  UNION ALL SELECT uri, 'note', 'en', regexp_replace(note, '^\\s+|\\s+$', '', 'g'), pos, 5 FROM v5
  UNION ALL SELECT uri, 'changeNote', 'en', regexp_replace(changeNote, '^\\s+|\\s+$', '', 'g'), pos, 6 FROM v5)
WHERE uri IS NOT NULL AND content IS NOT NULL AND content <> ''""", ("v5",))

# V6: enrichment concepts and rows
_v("v6l", """
SELECT 'http://ex.org/c/' || CAST(c_custkey AS VARCHAR) AS uri, 'prefLabel' AS prop, c_name AS value, 'en' AS lang,
       CAST(c_custkey AS BIGINT) AS pos, 0 AS vpos FROM customer
UNION ALL SELECT 'http://ex.org/c/' || CAST(c_custkey AS VARCHAR), 'altLabel', c_mktsegment, 'en',
       CAST(c_custkey AS BIGINT), 0 FROM customer""")
_v("v6r", """
SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'http://ex.org/c/x' || CAST(o_custkey AS VARCHAR)
            WHEN o_custkey % 2 = 0 THEN 'http://ex.org/c/' || CAST(o_custkey AS VARCHAR)
            ELSE CAST(o_custkey AS VARCHAR) END AS uri,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN upper(c_mktsegment) ELSE upper(c_name) END AS label,
       c_mktsegment AS segment, spend,
       CAST(o_custkey * 10 + CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS BIGINT) AS pos
FROM (SELECT o_custkey, o_orderpriority, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY ALL) g
LEFT JOIN customer ON o_custkey = c_custkey""")

"""Registered catalogue queries (K1-K7) over V9, and vector matching over V8 (embeddings)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import catalog as K
from tessera.plans import testbed as T
from tessera.plans.registry import query
from tessera.plans.views_sql import _v
from tessera.sources.tables import TABLES, table

# Column lists of the driver tables (FIXTURES.md section 2), for the DuckDB text of V9.
TABLE_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}
ARRAY_COLUMNS = {"embedding"}
V1_COLUMNS = ["id", "parent_id", "level", "label", "path", "notation", "pos"]
V5_COLUMNS = ["uri", "pos", "def_en", "def_fr", "def_de", "def_es", "example", "changeNote", "note"]

# Two small catalogue entries of our own (a plant checklist and a tool register) with a dotted code,
# a parent column and namespaced names, which the driver tables lack.
FIXTURE_CATALOG = [
    ("plants.csv", 1, "Code", "4.2.1"),
    ("plants.csv", 2, "PrefLabel", "Meadow sage"),
    ("plants.csv", 3, "Definition", "A perennial herb of dry grassland"),
    ("plants.csv", 4, "Level", "3"),
    ("plants.csv", 5, "ParentCode", "4.2"),
    ("plants.csv", 6, "Synonyms", "Salvia pratensis"),
    ("plants.csv", 7, "ScopeNote", "Lowland populations only"),
    ("plants.csv", 8, "Example", "Herbarium sheet 118"),
    ("tools.json", 1, "properties.cclom:title", "Torque wrench"),
    ("tools.json", 2, "properties.sys:node-uuid", "tool-77"),
    ("tools.json", 3, "properties.cclom:general_description", "Tightens bolts to a set torque"),
    ("tools.json", 4, "properties.cm:name", "wrench-77"),
    ("tools.json", 5, "ebene", "2"),
    ("tools.json", 6, "broader_tool", None),
    ("tools.json", 7, "examples", None),
    ("tools.json", 8, "history_note_fr", None),
]


def _profile(df: DataFrame, name: str) -> DataFrame:
    """(dataset, ordinal, colname, sample): sample = largest value as text (none for arrays).

    One global aggregate row per table (partial max in every task), unpivoted
    afterwards, so no cell is exploded into its own row.
    """
    fields = list(df.schema.fields)
    aggs = [(F.lit(None).cast("string") if f.dataType.typeName() == "array"
             else F.max(F.col(f"`{f.name}`").cast("string"))).alias(f"c{i}") for i, f in enumerate(fields)]
    one = df.agg(*aggs)
    items = [F.struct(F.lit(i + 1).alias("ordinal"), F.lit(f.name).alias("colname"), F.col(f"c{i}").alias("sample"))
             for i, f in enumerate(fields)]
    return one.select(F.explode(F.array(*items)).alias("x")).select(
        F.lit(name).alias("dataset"), "x.ordinal", "x.colname", "x.sample")


def v9_catalog(spark, d) -> DataFrame:
    """V9: a catalogue row per column of every driver table, of V1 and V5, and of two small entries."""
    parts = [_profile(table(spark, d, t), t) for t in TABLES]
    parts.append(_profile(T.v1(spark, d), "vocab"))
    parts.append(_profile(T.v5(spark, d), "documentation"))
    parts.append(spark.createDataFrame(FIXTURE_CATALOG, "dataset string, ordinal int, colname string, sample string"))
    return reduce(DataFrame.unionByName, parts)


def _catalog_sql() -> str:
    parts = []

    def prof(src: str, name: str, cols: list[str]) -> str:
        sel = " UNION ALL ".join(
            f"SELECT {i + 1} AS ordinal, '{c}' AS colname, "
            + ("CAST(NULL AS VARCHAR)" if c in ARRAY_COLUMNS else f"CAST(\"{c}\" AS VARCHAR)")
            + f" AS value FROM {src}" for i, c in enumerate(cols))
        return f"SELECT '{name}' AS dataset, ordinal, colname, max(value) AS sample FROM ({sel}) GROUP BY ordinal, colname"

    for t in TABLES:
        parts.append(prof(t, t, TABLE_COLUMNS[t]))
    parts.append(prof("v1", "vocab", V1_COLUMNS))
    parts.append(prof("v5", "documentation", V5_COLUMNS))
    vals = ", ".join("({}, {}, {}, {})".format(
        f"'{a}'", b, "'" + c.replace("'", "''") + "'", "NULL" if s is None else "'" + s.replace("'", "''") + "'")
        for a, b, c, s in FIXTURE_CATALOG)
    parts.append(f"SELECT * FROM (VALUES {vals}) v(dataset, ordinal, colname, sample)")
    return "\nUNION ALL ".join(parts)


_v("v9", _catalog_sql(), ("v1", "v5"))
V9 = ("v9",)


def _flat_values(patterns) -> str:
    return ", ".join(f"('{p}', '{kw}', {i})" for p, kw, i in K._flat(patterns))


@query("match_keyword", f"""
WITH k AS (SELECT * FROM (VALUES {_flat_values(K.KEYWORD_PATTERNS)}) t(prop, kw, i)),
s AS (SELECT dataset, colname, prop, i,
             length(kw) / length(lower(colname)) + CASE WHEN lower(colname) = kw THEN 0.5 ELSE 0 END AS score
      FROM v9, k WHERE contains(lower(colname), kw)),
b AS (SELECT dataset, colname, arg_max(prop, {{'s': score, 'o': -i}}) AS prop, max(score) AS score FROM s GROUP BY ALL)
SELECT dataset, colname, prop, round(score, 6) AS score FROM b WHERE score > 0.3""", V9)
def match_keyword(spark, d):
    return K.keyword_field_match(v9_catalog(spark, d))


@query("match_role", f"""
WITH k AS (SELECT * FROM (VALUES {_flat_values(K.ROLE_PATTERNS)}) t(role, kw, i)),
h AS (SELECT dataset, role, arg_min(colname, {{'r': i, 'o': ordinal}}) AS colname
      FROM v9, k WHERE lower(colname) = kw GROUP BY ALL)
SELECT * FROM h
UNION ALL
SELECT dataset, 'id', arg_min(colname, ordinal) FROM v9
WHERE dataset NOT IN (SELECT dataset FROM h WHERE role = 'id') GROUP BY dataset""", V9)
def match_role(spark, d):
    return K.field_role_match(v9_catalog(spark, d))


def _doc_sql() -> str:
    langs = " ".join(f"WHEN list_contains(rest, '{ind}') THEN '{lang}'" for lang, ind, _ in K._flat(K.LANGUAGE_PATTERNS))
    return f"""
WITH k AS (SELECT * FROM (VALUES {_flat_values(K.DOC_PATTERNS)}) t(doc_type, kw, i)),
h AS (SELECT dataset, doc_type, colname, arg_min(kw, i) AS pattern, min(i) AS rank
      FROM v9, k WHERE contains(lower(colname), kw) GROUP BY ALL)
SELECT dataset, doc_type, colname, pattern, rank,
       CASE {langs} ELSE 'en' END AS lang
FROM (SELECT *, string_split_regex(replace(lower(colname), pattern, ' '), '[^\\p{{L}}]+') AS rest FROM h)"""


@query("match_doc_field", _doc_sql(), V9)
def match_doc_field(spark, d):
    return K.doc_field_match(v9_catalog(spark, d))


_PAIRS = """
WITH c AS (SELECT DISTINCT dataset, lower(colname) AS c FROM v9),
s AS (SELECT dataset, count(*) AS n, string_agg(c, chr(1) ORDER BY c) AS sig FROM c GROUP BY dataset),
i AS (SELECT a.dataset AS ds_a, b.dataset AS ds_b, count(*) AS overlap FROM c a JOIN c b
      ON a.c = b.c AND a.dataset < b.dataset GROUP BY ALL),
p AS (SELECT ds_a, ds_b, overlap, overlap / (sa.n + sb.n - overlap) AS j, sa.sig AS sig_a, sb.sig AS sig_b
      FROM i JOIN s sa ON ds_a = sa.dataset JOIN s sb ON ds_b = sb.dataset),
k AS (SELECT sig, min(dataset) AS ds, count(*) AS w FROM s GROUP BY sig)"""


@query("dataset_overlap", _PAIRS + """
SELECT p.ds_a, p.ds_b, ka.w AS n_a, kb.w AS n_b, p.overlap, round(p.j, 6) AS jaccard
FROM p JOIN k ka ON ka.ds = p.ds_a JOIN k kb ON kb.ds = p.ds_b WHERE ka.sig <> kb.sig AND p.j > 0""", V9)
def dataset_overlap(spark, d):
    """Every pair of column sets that share a name."""
    return K.dataset_overlap(v9_catalog(spark, d), threshold=0.0)[0]


@query("dataset_scenario", _PAIRS + """
, n AS (SELECT count(*) AS nd FROM s), m AS (SELECT coalesce(sum(j), 0) / (nd * (nd - 1) / 2) AS mean, nd FROM n LEFT JOIN p ON true GROUP BY nd)
SELECT nd AS datasets, round(mean, 6) AS avg_overlap,
       CASE WHEN mean > 0.3 THEN 'distributed' ELSE 'complete' END AS scenario FROM m""", V9)
def dataset_scenario(spark, d):
    return K.dataset_overlap(v9_catalog(spark, d))[1]


@query("assign_roles", f"""
SELECT dataset, CASE WHEN bool_or(lower(colname) IN ({", ".join(f"'{x}'" for x in K.PRIMARY_ID)}))
                      AND bool_or(lower(colname) IN ({", ".join(f"'{x}'" for x in K.PRIMARY_LABEL)})) THEN 'primary'
                     WHEN bool_or(lower(colname) IN ({", ".join(f"'{x}'" for x in K.HIERARCHY_COLS)})) THEN 'hierarchy'
                     ELSE 'secondary' END AS role
FROM v9 GROUP BY dataset""", V9)
def assign_roles(spark, d):
    return K.assign_roles(v9_catalog(spark, d))


@query("hierarchy_signals", """
SELECT dataset, 'level' AS signal, colname FROM v9 WHERE contains(lower(colname), 'level') OR contains(lower(colname), 'ebene')
UNION ALL SELECT dataset, 'parent', colname FROM v9 WHERE contains(lower(colname), 'parent')
  OR contains(lower(colname), 'broader') OR contains(lower(colname), 'übergeordnet')
UNION ALL SELECT dataset, 'dotted_codes', arg_min(colname, ordinal) FROM v9
  WHERE contains(sample, '.') AND regexp_matches(sample, '^[0-9.]*[0-9][0-9.]*$') GROUP BY dataset""", V9)
def hierarchy_signals(spark, d):
    return K.hierarchy_signals(v9_catalog(spark, d))


# ---------------------------------------------------------------- K6 on V8
_VEC = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, label, v, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS uv FROM e),
x AS (SELECT label, i, v[i] AS vi, uv[i] AS ui FROM (
        SELECT label, v, uv, unnest(generate_series(1, len(v))) AS i FROM u WHERE label < 3)),
pe AS (SELECT label, i, avg(vi) AS c, avg(ui) AS m FROM x GROUP BY label, i),
p AS (SELECT CAST(label AS VARCHAR) AS prop, list(c ORDER BY i) AS c, list(m ORDER BY i) AS m FROM pe GROUP BY label),
f AS (SELECT 'f' || CAST(vec_id AS VARCHAR) AS field, vec_id, uv FROM u),
s AS (SELECT prop, field, vec_id, list_dot_product(c, uv) / sqrt(list_dot_product(c, c)) AS single,
             list_dot_product(m, uv) AS mean FROM p, f)"""


@query("match_vector_best", _VEC + """
SELECT prop, 'single' AS scoring, arg_max(field, {'s': single, 'o': -vec_id}) AS best_field, round(max(single), 6) AS score
FROM s GROUP BY prop HAVING max(single) > 0.3""")
def match_vector_best(spark, d):
    v = T.v8(spark, d)
    props = K.property_vectors(v["props"], "label", "embedding")
    return K.vector_field_match(props, v["fields"], "field", "vec_id", "embedding")


@query("match_vector_mean", _VEC + """
SELECT prop, 'mean' AS scoring, arg_max(field, {'s': mean, 'o': -vec_id}) AS best_field, round(max(mean), 6) AS score
FROM s GROUP BY prop HAVING max(mean) > 0.03""")
def match_vector_mean(spark, d):
    v = T.v8(spark, d)
    props = K.property_vectors(v["props"], "label", "embedding")
    return K.vector_field_match(props, v["fields"], "field", "vec_id", "embedding", "mean", threshold=0.03)

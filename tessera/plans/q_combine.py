"""Registered join / stack / de-duplication queries (J1-J8, J14, C1-C5, C8, C9) over V7."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import combine as C
from tessera.plans import testbed as T
from tessera.plans.registry import query
from tessera.sources.tables import table

V7 = ("v7a", "v7b", "v7c")


def _src(spark, d, with_pos=False):
    v = T.v7(spark, d)
    if not with_pos:
        v = {k: df.drop("pos") for k, df in v.items()}
    return [("a.csv", v["a"]), ("b.csv", v["b"]), ("c.csv", v["c"])]


def _join_sql(how: str) -> str:
    return f"""
WITH ab AS (SELECT coalesce(a.id, b.id) AS id, a.name, b.nation FROM v7a a {how} JOIN v7b b ON a.id = b.id)
SELECT coalesce(ab.id, c.id) AS id, ab.name, ab.nation, c.name AS name_c, c.balance
FROM ab {how} JOIN v7c c ON ab.id = c.id"""


@query("join_outer", _join_sql("FULL"), V7)
def join_outer(spark, d):
    return C.distributed_join(_src(spark, d), "id", "outer")


@query("join_inner", _join_sql("INNER"), V7)
def join_inner(spark, d):
    return C.distributed_join(_src(spark, d), "id", "inner")


@query("join_left", _join_sql("LEFT"), V7)
def join_left(spark, d):
    return C.distributed_join(_src(spark, d), "id", "left")


def _keyed(spark, d):
    s = dict(_src(spark, d))
    return [("a", s["a.csv"], "id"),
            ("b", s["b.csv"].withColumnRenamed("id", "cust"), "cust"),
            ("c", s["c.csv"].withColumnRenamed("id", "sid"), "sid")]


@query("join_keys_left", """
SELECT a.id, a.name, b.id AS cust, b.nation, c.id AS sid, c.name AS name_c, c.balance
FROM v7a a LEFT JOIN v7b b ON a.id = b.id LEFT JOIN v7c c ON a.id = c.id""", V7)
def join_keys_left(spark, d):
    return C.merge_with_join_keys(_keyed(spark, d))[0]


@query("join_match_counts", """
SELECT 'b' AS source, (SELECT count(b.id) FROM v7a a LEFT JOIN v7b b ON a.id = b.id) AS matched,
       (SELECT count(*) FROM v7a) AS before
UNION ALL
SELECT 'c', (SELECT count(c.id) FROM v7a a LEFT JOIN v7b b ON a.id = b.id LEFT JOIN v7c c ON a.id = c.id),
       (SELECT count(*) FROM v7a a LEFT JOIN v7b b ON a.id = b.id)""", V7)
def join_match_counts(spark, d):
    return C.merge_with_join_keys(_keyed(spark, d))[1]


@query("append_new_keys", """
SELECT id, name, CAST(NULL AS DOUBLE) AS balance FROM v7a
UNION ALL
SELECT id, name, balance FROM v7c WHERE id IS NOT NULL
  AND id NOT IN (SELECT id FROM v7a WHERE id IS NOT NULL)""", V7)
def append_new_keys(spark, d):
    s = dict(_src(spark, d))
    return C.append_new_keys(s["a.csv"], s["c.csv"], "id")


@query("merge_or_concat", """
SELECT 'concat' AS strategy, id, nation, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS DOUBLE) AS balance FROM v7b
UNION ALL SELECT 'concat', id, NULL, name, balance FROM v7c""", V7)
def merge_or_concat(spark, d):
    s = dict(_src(spark, d))
    how, df = C.merge_or_concat(s["b.csv"], s["c.csv"], "nation")
    return df.select(F.lit(how).alias("strategy"), "*")


@query("normalise_join_key", """
SELECT page_id, url,
  CASE WHEN starts_with(url, 'http') THEN
    CASE WHEN regexp_extract(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1),
                             '([^/;]*)(?:;[^/]*)?$', 1) <> ''
         THEN regexp_extract(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1),
                             '([^/;]*)(?:;[^/]*)?$', 1)
         ELSE regexp_extract(url, '^[^#]*#(.*)$', 1) END
  ELSE url END AS key
FROM pages""")
def normalise_join_key(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", "url", C.normalise_join_key("url").alias("key"))


@query("join_key_profile", """
SELECT source, total_values, non_null_values, unique_values,
       round((total_values - non_null_values) * 100.0 / total_values, 6) AS null_percentage
FROM (SELECT 'a.csv' AS source, count(*) AS total_values, count(id) AS non_null_values,
             count(DISTINCT id) AS unique_values FROM v7a
      UNION ALL SELECT 'b.csv', count(*), count(id), count(DISTINCT id) FROM v7b
      UNION ALL SELECT 'c.csv', count(*), count(id), count(DISTINCT id) FROM v7c)""", V7)
def join_key_profile(spark, d):
    return C.join_key_profile(_src(spark, d), "id")


@query("join_key_overlap", """
WITH p AS (SELECT DISTINCT id FROM v7a WHERE id IS NOT NULL),
o AS (SELECT 'b.csv' AS source, (SELECT count(*) FROM p WHERE id IN (SELECT id FROM v7b)) AS overlap_count
      UNION ALL SELECT 'c.csv', (SELECT count(*) FROM p WHERE id IN (SELECT id FROM v7c)))
SELECT source, overlap_count,
       round(CASE WHEN (SELECT count(*) FROM p) > 0 THEN overlap_count * 100.0 / (SELECT count(*) FROM p) ELSE 0.0 END, 6)
         AS overlap_percentage,
       (CASE WHEN (SELECT count(*) FROM p) > 0 THEN overlap_count * 100.0 / (SELECT count(*) FROM p) ELSE 0.0 END) < 10
         AS low_overlap
FROM o""", V7)
def join_key_overlap(spark, d):
    s = _src(spark, d)
    return C.join_key_overlap(s[0][1], s[1:], "id")


@query("combination_stats", f"""
WITH j AS ({_join_sql("FULL")}),
per AS (SELECT 'a.csv' AS file, count(*) AS rows, 2 AS columns FROM v7a
        UNION ALL SELECT 'b.csv', count(*), 2 FROM v7b UNION ALL SELECT 'c.csv', count(*), 3 FROM v7c)
SELECT file, rows, columns, CAST(3 AS BIGINT) AS input_files, CAST((SELECT sum(rows) FROM per) AS BIGINT) AS input_total_rows,
       (SELECT count(*) FROM j) AS output_rows,
       round(((SELECT sum(rows) FROM per) - (SELECT count(*) FROM j)) * 100.0 / (SELECT sum(rows) FROM per), 6)
         AS data_loss_percentage,
       1 AS columns_added
FROM per""", V7)
def combination_stats(spark, d):
    s = _src(spark, d)
    return C.combination_stats(s, C.distributed_join(s, "id", "outer"))


@query("priority_merge", """
SELECT id, name, pos, balance FROM (
  SELECT id, name, pos, CAST(NULL AS DOUBLE) AS balance, 1 AS prio FROM v7a
  UNION ALL SELECT id, name, pos, balance, 2 FROM v7c)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY prio DESC, pos) = 1""", V7)
def priority_merge(spark, d):
    s = dict(_src(spark, d, with_pos=True))
    return C.priority_merge([("a", s["a.csv"], 1), ("c", s["c.csv"], 2)], "id")


_CONCAT = """
SELECT id, name, CAST(NULL AS VARCHAR) AS nation, CAST(NULL AS DOUBLE) AS balance, pos, 'a.csv' AS _source_file FROM v7a
UNION ALL SELECT id, NULL, nation, NULL, 10000000000000 + pos, 'b.csv' FROM v7b
UNION ALL SELECT id, name, NULL, balance, 20000000000000 + pos, 'c.csv' FROM v7c"""


@query("concat_aligned", """
SELECT id, name, pos, NULL::VARCHAR AS nation, NULL::DOUBLE AS balance FROM v7a
UNION ALL SELECT id, NULL, pos, nation, NULL FROM v7b
UNION ALL SELECT id, name, pos, NULL, balance FROM v7c""", V7)
def concat_aligned(spark, d):
    s = _src(spark, d, with_pos=True)
    return C.concat_aligned([df for _, df in s])


def _flat_pos(df):
    """The (source, row) position as one number, for the comparison with SQL on these small row numbers."""
    return df.withColumn("pos", F.col("pos.source") * F.lit(10 ** 13) + F.col("pos.row"))


@query("concat_dedupe", f"""
SELECT id, name, nation, balance, pos, _source_file FROM ({_CONCAT})
QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1""", V7)
def concat_dedupe(spark, d):
    return _flat_pos(C.concat_dedupe(_src(spark, d, with_pos=True)))


@query("concat_keep_all", f"SELECT id, name, nation, balance, pos, _source_file FROM ({_CONCAT})", V7)
def concat_keep_all(spark, d):
    return _flat_pos(C.concat_dedupe(_src(spark, d, with_pos=True), remove_duplicates=False))


@query("dedupe_keep_first", """
SELECT id, nation, pos FROM v7b QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1""", V7)
def dedupe_keep_first(spark, d):
    return C.dedupe_keep_first(T.v7(spark, d)["b"], None)


@query("dedupe_keep_last", """
SELECT id, nation, pos FROM v7b QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1""", V7)
def dedupe_keep_last(spark, d):
    return C.dedupe_keep_first(T.v7(spark, d)["b"], "id", last=True)


@query("dedupe_rows", """
SELECT id, nation, min(pos) AS pos FROM v7b GROUP BY id, nation""", V7)
def dedupe_rows(spark, d):
    return C.dedupe_rows(T.v7(spark, d)["b"], exclude=["pos"])


@query("dedupe_merge_properties", """
SELECT DISTINCT id, property, value FROM (
  SELECT id, 'name' AS property, name AS value FROM v7a UNION ALL SELECT id, 'nation', nation FROM v7b)
WHERE value IS NOT NULL""", V7)
def dedupe_merge_properties(spark, d):
    s = dict(_src(spark, d))
    u = C.concat_aligned([s["a.csv"], s["b.csv"]])
    return C.dedupe_merge_properties(u, "id")


@query("key_intersect", "SELECT id FROM v7a INTERSECT SELECT id FROM v7c", V7)
def key_intersect(spark, d):
    s = dict(_src(spark, d))
    return C.key_intersect(s["a.csv"], s["c.csv"], ["id"])


@query("key_except", "SELECT id FROM v7a EXCEPT SELECT id FROM v7b", V7)
def key_except(spark, d):
    s = dict(_src(spark, d))
    return C.key_except(s["a.csv"], s["b.csv"], ["id"])


@query("merge_or_concat_key", """
SELECT 'merge' AS strategy, coalesce(a.id, c.id) AS id, a.name, c.name AS name_right, c.balance
FROM v7a a FULL JOIN v7c c ON a.id = c.id""", V7)
def merge_or_concat_key(spark, d):
    """J4 when both sides carry the key: an outer merge, clashing columns suffixed."""
    s = dict(_src(spark, d))
    how, df = C.merge_or_concat(s["a.csv"], s["c.csv"], "id")
    return df.select(F.lit(how).alias("strategy"), "*")

"""Registered cleaner queries: C6, C7, P6, rules R1-R6, report R7, numbered lines S10."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import cleaner as CL
from tessera.operators import rules as R
from tessera.operators.fields import drop_unlabelled
from tessera.plans import testbed as T
from tessera.plans.registry import query
from tessera.plans.sqlfrag import replace_chain
from tessera.plans.views_sql import _v
from tessera.sources.tables import table
from tessera.sources.ttl import report_lines

_INJ = [(b, a) for a, b in X.MOJIBAKE]

_v("cl_concepts", """
SELECT CASE WHEN source = 'src3' THEN 'doc/' ELSE 'http://ex.org/doc/' END || CAST(doc_id // 2 AS VARCHAR) AS raw_uri,
       doc_id AS pos FROM documents""")
_v("cl_literals", f"""
SELECT doc_id AS pos, 'prefLabel' AS prop, 0 AS vpos,
       CASE WHEN lang = 'de' THEN {replace_chain("CASE WHEN source = 'src7' THEN '   ' ELSE split_part(text, chr(10), 1) END", _INJ)}
            ELSE CASE WHEN source = 'src7' THEN '   ' ELSE split_part(text, chr(10), 1) END END AS text,
       CASE WHEN source = 'src5' THEN upper(lang) ELSE lang END AS lang FROM documents
UNION ALL
SELECT doc_id, 'altLabel', 1, CASE WHEN lang = 'de' THEN {replace_chain('split_part(text, chr(10), -1)', _INJ)} ELSE split_part(text, chr(10), -1) END,
       CASE WHEN source = 'src5' THEN upper(lang) ELSE lang END FROM documents
UNION ALL
SELECT doc_id, 'definition', 2, text, CASE WHEN source = 'src5' THEN upper(lang) ELSE lang END FROM documents""")

V2_CONCEPTS_SQL = "SELECT DISTINCT uri, CAST(pos // 10 AS BIGINT) AS pos FROM v2"


def _v2_concepts(spark, d):
    return T.v2(spark, d).select("uri", (F.floor(F.col("pos") / 10)).cast("long").alias("pos")).distinct()


@query("dedupe_concepts", f"""
SELECT uri, min(pos) AS pos FROM ({V2_CONCEPTS_SQL}) GROUP BY uri""", ("v2",))
def dedupe_concepts(spark, d):
    return CL.dedupe_concepts(_v2_concepts(spark, d))[0]


@query("change_log", f"""
SELECT uri, pos, 'duplicate_removed' AS action, 'Duplicate removed: ' || uri AS detail
FROM ({V2_CONCEPTS_SQL}) c
WHERE pos > (SELECT min(pos) FROM ({V2_CONCEPTS_SQL}) x WHERE x.uri = c.uri)""", ("v2",))
def change_log(spark, d):
    return CL.dedupe_concepts(_v2_concepts(spark, d))[1]


@query("merge_duplicate_concepts", """
SELECT DISTINCT uri, prop, text, lang FROM v2 WHERE prop IN ('prefLabel', 'altLabel')""", ("v2",))
def merge_duplicate_concepts(spark, d):
    return CL.merge_duplicate_concepts(T.v2(spark, d))


@query("drop_unlabelled", f"""
SELECT uri, pos, (pos IN (SELECT doc_id FROM labels WHERE quality = 1)) AS kept
FROM (SELECT DISTINCT 'http://ex.org/doc/' || CAST(doc_id AS VARCHAR) AS uri, doc_id AS pos FROM documents)""")
def drop_unlabelled_q(spark, d):
    doc = table(spark, d, "documents")
    lab = table(spark, d, "labels").where("quality = 1")
    concepts = doc.select(F.concat(F.lit("http://ex.org/doc/"), F.col("doc_id").cast("string")).alias("uri"),
                          F.col("doc_id").alias("pos"))
    lits = (doc.join(lab, "doc_id", "left_semi")
               .select(F.concat(F.lit("http://ex.org/doc/"), F.col("doc_id").cast("string")).alias("uri"),
                       F.lit("prefLabel").alias("prop"), F.substring_index("text", "\n", 1).alias("text")))
    kept, dropped = drop_unlabelled(concepts, lits)
    return kept.withColumn("kept", F.lit(True)).unionByName(dropped.withColumn("kept", F.lit(False)))


@query("rule_s14", """
SELECT uri, 'S14' AS rule, 'violation' AS severity,
       printf('S14 Violation: <%s> has %d prefLabels for language ''%s''', uri, n, lang) AS detail
FROM (SELECT uri, lang, count(*) AS n FROM v2 WHERE prop = 'prefLabel' GROUP BY uri, lang HAVING count(*) > 1)""",
       ("v2",))
def rule_s14(spark, d):
    return R.rule_s14(T.v2(spark, d))


#: One violation per concept and pair of label kinds, with the number of shared labels and the first of them.
S13_SQL = """
  SELECT a.uri, printf('S13 Violation: <%s> has %d overlapping %s, first "%s"@%s', a.uri, count(*), a.prop || '/' || b.prop,
         arg_min(a.text, a.text || chr(1) || a.lang), arg_min(a.lang, a.text || chr(1) || a.lang)) AS detail
  FROM (SELECT DISTINCT uri, prop, text, lang FROM {src}) a
  JOIN (SELECT DISTINCT uri, prop, text, lang FROM {src}) b ON a.uri = b.uri AND a.text = b.text AND a.lang = b.lang
  WHERE (a.prop, b.prop) IN (('prefLabel', 'altLabel'), ('prefLabel', 'hiddenLabel'), ('altLabel', 'hiddenLabel'))
  GROUP BY a.uri, a.prop, b.prop"""


@query("rule_s13", f"""
SELECT uri, 'S13' AS rule, 'violation' AS severity, detail FROM ({S13_SQL.format(src='v2')})""", ("v2",))
def rule_s13(spark, d):
    return R.rule_s13(T.v2(spark, d))


@query("rule_s27", """
WITH b AS (SELECT DISTINCT uri, target FROM v1r WHERE prop = 'broader'),
r AS (SELECT DISTINCT uri, target FROM v1r WHERE prop = 'related')
SELECT uri, 'S27' AS rule, 'violation' AS severity,
       printf('S27 Violation: <%s> has both skos:broader and skos:related to <%s>', uri, target) AS detail
FROM b WHERE (uri, target) IN (SELECT (uri, target) FROM r)""", ("v1r",))
def rule_s27(spark, d):
    return R.rule_s27(T.v1_relations(spark, d))


@query("rule_mutual_broader", """
WITH b AS (SELECT DISTINCT uri, target FROM v1r WHERE prop = 'broader')
SELECT x.uri, 'mutual_broader' AS rule, 'warning' AS severity,
       printf('Simple cycle detected: <%s> and <%s> are mutually broader', x.uri, x.target) AS detail
FROM b x JOIN b y ON x.uri = y.target AND x.target = y.uri""", ("v1r",))
def rule_mutual_broader(spark, d):
    return R.rule_mutual_broader(T.v1_relations(spark, d))


_LQ = """
SELECT uri, 'long_label' AS rule, 'warning' AS severity,
       printf('Very long label (%d chars) in <%s>', length(t), uri) AS detail FROM l WHERE length(t) > 500
UNION ALL SELECT uri, 'empty_label', 'warning', printf('Empty label in <%s>', uri) FROM l WHERE t = ''
UNION ALL SELECT uri, 'encoding', 'warning', printf('Potential encoding issue in <%s>', uri) FROM l
  WHERE contains(t, 'Ã¤') OR contains(t, 'Ã¶') OR contains(t, 'Ã¼') OR contains(t, 'ÃŸ')
UNION ALL SELECT uri, 'uri_label', 'warning', printf('Label looks like URI in <%s>', uri) FROM l
  WHERE starts_with(lower(t), 'http://') OR starts_with(lower(t), 'https://')"""


@query("rule_label_quality", f"""
WITH l AS (SELECT 'http://ex.org/doc/' || CAST(pos AS VARCHAR) AS uri, coalesce(text, '') AS t
           FROM cl_literals WHERE prop IN ('prefLabel', 'altLabel'))
{_LQ}""", ("cl_literals",))
def rule_label_quality(spark, d):
    lit = T.cleaner_input(spark, d)["literals"].where(F.col("prop").isin("prefLabel", "altLabel"))
    lit = lit.withColumn("uri", F.concat(F.lit("http://ex.org/doc/"), F.col("pos").cast("string")))
    return R.rule_label_quality(lit)


@query("rule_uri_lang", """
SELECT raw_uri AS uri, 'invalid_uri' AS rule, 'violation' AS severity, 'Invalid URI format: ' || raw_uri AS detail
FROM cl_concepts WHERE NOT coalesce(regexp_matches(regexp_replace(raw_uri, '^[<>]+|[<>]+$', '', 'g'),
                                                   '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+'), false)
UNION ALL
SELECT c.raw_uri, 'invalid_lang', 'warning', printf('Potentially invalid language tag ''%s'' in %s', l.lang, c.raw_uri)
FROM cl_literals l JOIN cl_concepts c ON l.pos = c.pos
WHERE l.prop IN ('prefLabel', 'altLabel') AND l.lang IS NOT NULL AND l.lang <> ''
  AND NOT coalesce(regexp_matches(l.lang, '^[a-z]{2,3}(-[A-Za-z0-9]{1,8})*$'), false)""",
       ("cl_concepts", "cl_literals"))
def rule_uri_lang(spark, d):
    ci = T.cleaner_input(spark, d)
    c = ci["concepts"].select(F.col("raw_uri").alias("uri"), "pos")
    lit = ci["literals"].join(c, "pos")
    return R.rule_uri_lang(c, lit)


@query("rule_skosxl_conflict", """
SELECT uri, 'skosxl_conflict' AS rule, 'warning' AS severity,
       printf('SKOS-XL label URI <%s> conflicts with concept URI in <%s>', target, uri) AS detail
FROM v1r WHERE prop IN ('xlPrefLabel', 'xlAltLabel', 'xlHiddenLabel') AND target IN (SELECT id FROM v1x)""",
       ("v1r",))
def rule_skosxl_conflict(spark, d):
    c = T.v1x(spark, d).select(F.col("id").alias("uri"))
    return R.rule_skosxl(c, T.v1_relations(spark, d))[0]


@query("rule_skosxl_orphan", """
SELECT DISTINCT uri, 'skosxl_orphan' AS rule, 'warning' AS severity,
       printf('Orphaned SKOS-XL label <%s> not referenced by any concept', uri) AS detail
FROM v1r WHERE prop = 'literalForm'
  AND uri NOT IN (SELECT target FROM v1r WHERE prop IN ('xlPrefLabel', 'xlAltLabel', 'xlHiddenLabel'))""",
       ("v1r",))
def rule_skosxl_orphan(spark, d):
    c = T.v1x(spark, d).select(F.col("id").alias("uri"))
    return R.rule_skosxl(c, T.v1_relations(spark, d))[1]


@query("report_lines", f"""
WITH i AS (
  SELECT 'violation' AS severity, uri, 'S14' AS rule,
         printf('S14 Violation: <%s> has %d prefLabels for language ''%s''', uri, n, lang) AS detail
  FROM (SELECT uri, lang, count(*) AS n FROM v2 WHERE prop = 'prefLabel' GROUP BY uri, lang HAVING count(*) > 1)
  UNION ALL
  SELECT 'violation', uri, 'S13', detail FROM ({S13_SQL.format(src='v2')})
  UNION ALL
  SELECT 'warning', uri, 'long_label', printf('Very long label (%d chars) in <%s>', length(text), uri)
  FROM v2 WHERE prop IN ('prefLabel', 'altLabel') AND length(text) > 500)
SELECT severity, line_no, printf('%4d. %s', line_no, detail) AS line
FROM (SELECT severity, detail, row_number() OVER (PARTITION BY severity ORDER BY rule, uri, detail) AS line_no FROM i)""", ("v2",))
def report_lines_q(spark, d):
    """Violations and warnings of the V2 labels, each numbered from 1."""
    v = T.v2(spark, d)
    long = R.rule_label_quality(v).where("rule = 'long_label'")
    return report_lines(R.rule_s14(v).unionByName(R.rule_s13(v)).unionByName(long), ["rule", "uri", "detail"])


def _x4_sql(x: str) -> str:
    v = f"regexp_replace(regexp_replace({replace_chain(x, X.MOJIBAKE)}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
    return f"(CASE WHEN {v} <> '' THEN {v} END)"


def _x5_sql(x: str) -> str:
    from tessera.plans.sqlfrag import punct_sql
    v = punct_sql(replace_chain(replace_chain(x, X.MOJIBAKE), X.ENTITIES), "+")
    return f"(CASE WHEN {v} <> '' THEN {v} END)"


def _x3_sql(x: str) -> str:
    from tessera.plans.sqlfrag import punct_sql
    return punct_sql(x)


_X3 = _x3_sql("text")

_REPORT_SQL = f"""
WITH c AS (SELECT raw_uri, pos,
                  CASE WHEN starts_with(trim(raw_uri), 'http') THEN trim(raw_uri)
                       WHEN NOT contains(raw_uri, ':') THEN 'http://ex.org/' || trim(raw_uri) END AS uri
           FROM cl_concepts),
l AS (SELECT pos, prop, text, lang,
             CASE WHEN prop IN ('prefLabel', 'altLabel', 'hiddenLabel') THEN {_x4_sql('text')}
                  ELSE {_x5_sql('text')} END AS clean
      FROM cl_literals),
lf AS (SELECT *, prop IN ('prefLabel', 'altLabel', 'hiddenLabel') AS is_label,
              (CASE WHEN prop IN ('prefLabel', 'altLabel', 'hiddenLabel')
                    THEN {replace_chain('text', X.MOJIBAKE)} <> text
                    ELSE coalesce(clean, '') <> text END) AND text <> '' AS enc,
              clean IS NULL AND text <> '' AS emptied
       FROM l),
lab AS (SELECT DISTINCT pos FROM l WHERE prop = 'prefLabel' AND clean IS NOT NULL),
cl AS (SELECT c.* FROM c WHERE pos IN (SELECT pos FROM lab)),
kept AS (SELECT uri, min(pos) AS pos FROM cl GROUP BY uri),
fl AS (SELECT k.uri, l.prop, l.clean AS text, l.lang FROM l JOIN kept k ON l.pos = k.pos WHERE l.clean IS NOT NULL),
wr AS (SELECT prop, text, {_X3} AS written FROM fl),
s13 AS (SELECT uri, detail FROM ({S13_SQL.format(src='fl')})),
s14 AS (SELECT uri FROM fl WHERE prop = 'prefLabel' GROUP BY uri, lang HAVING count(*) > 1),
badu AS (SELECT uri FROM kept WHERE NOT coalesce(regexp_matches(regexp_replace(uri, '^[<>]+|[<>]+$', '', 'g'),
                                                  '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+'), false)),
lq2 AS (SELECT uri FROM fl WHERE prop IN ('prefLabel', 'altLabel') AND length(coalesce(text, '')) > 500
        UNION ALL SELECT uri FROM fl WHERE prop IN ('prefLabel', 'altLabel') AND coalesce(text, '') = ''
        UNION ALL SELECT uri FROM fl WHERE prop IN ('prefLabel', 'altLabel') AND (contains(text, 'Ã¤')
          OR contains(text, 'Ã¶') OR contains(text, 'Ã¼') OR contains(text, 'ÃŸ'))
        UNION ALL SELECT uri FROM fl WHERE prop IN ('prefLabel', 'altLabel')
          AND (starts_with(lower(text), 'http://') OR starts_with(lower(text), 'https://'))),
badl AS (SELECT uri FROM fl WHERE prop IN ('prefLabel', 'altLabel') AND lang IS NOT NULL AND lang <> ''
         AND NOT coalesce(regexp_matches(lang, '^[a-z]{{2,3}}(-[A-Za-z0-9]{{1,8}})*$'), false)),
n AS (SELECT
  (SELECT count(*) FROM c) AS total_concepts,
  (SELECT count(*) FROM cl) - (SELECT count(*) FROM kept) AS duplicates_removed,
  (SELECT count(*) FROM c WHERE uri <> raw_uri) AS malformed_uris_fixed,
  (SELECT count(*) FROM c) - (SELECT count(*) FROM cl) AS concepts_without_preflabel,
  (SELECT count(*) FROM lf WHERE enc) AS encoding_issues_fixed,
  (SELECT count(*) FROM lf WHERE emptied) AS empty_labels_removed,
  (SELECT count(*) FROM wr WHERE prop NOT IN ('prefLabel', 'altLabel', 'hiddenLabel')) AS text_fields_cleaned,
  (SELECT count(*) FROM wr WHERE written <> text) AS comma_fixes,
  (SELECT count(*) FROM wr WHERE prop IN ('prefLabel', 'altLabel', 'hiddenLabel')) AS labels_processed,
  (SELECT count(*) FROM wr WHERE prop = 'definition') AS definitions_processed,
  (SELECT count(*) FROM wr WHERE prop IN ('note', 'scopeNote', 'editorialNote', 'historyNote', 'changeNote'))
    AS notes_processed,
  (SELECT count(*) FROM kept) AS final_concepts,
  (SELECT count(*) FROM c) - (SELECT count(*) FROM cl) AS invalid_concepts_removed,
  (SELECT count(*) FROM s13) + (SELECT count(*) FROM s14) + (SELECT count(*) FROM badu) AS violations,
  (SELECT count(*) FROM lq2) + (SELECT count(*) FROM badl) AS warnings)
SELECT counter, CAST(value AS BIGINT) AS value FROM n UNPIVOT (value FOR counter IN (
  total_concepts, duplicates_removed, malformed_uris_fixed, concepts_without_preflabel, encoding_issues_fixed,
  empty_labels_removed, text_fields_cleaned, comma_fixes, labels_processed, definitions_processed,
  notes_processed, final_concepts, invalid_concepts_removed, violations, warnings))"""


@query("clean_report", _REPORT_SQL, ("cl_concepts", "cl_literals"))
def clean_report(spark, d):
    ci = T.cleaner_input(spark, d)
    return CL.clean_vocabulary(ci["concepts"], ci["literals"], base="http://ex.org/")["report"]


_ISSUES_SQL = _REPORT_SQL[:_REPORT_SQL.index("n AS (SELECT")].rstrip().rstrip(",") + """
SELECT uri, 'S13' AS rule, 'violation' AS severity, detail FROM s13
UNION ALL SELECT uri, 'S14', 'violation', printf('S14 Violation: <%s> has %d prefLabels for language ''%s''', uri, count(*), lang)
  FROM fl WHERE prop = 'prefLabel' GROUP BY uri, lang HAVING count(*) > 1
UNION ALL SELECT uri, 'invalid_uri', 'violation', 'Invalid URI format: ' || uri FROM badu
UNION ALL SELECT uri, rule, severity, detail FROM (
  WITH l AS (SELECT uri, coalesce(text, '') AS t FROM fl WHERE prop IN ('prefLabel', 'altLabel'))""" + _LQ + """)
UNION ALL SELECT uri, 'invalid_lang', 'warning', printf('Potentially invalid language tag ''%s'' in %s', lang, uri)
  FROM fl WHERE prop IN ('prefLabel', 'altLabel') AND lang IS NOT NULL AND lang <> ''
    AND NOT coalesce(regexp_matches(lang, '^[a-z]{2,3}(-[A-Za-z0-9]{1,8})*$'), false)"""


@query("clean_issues", _ISSUES_SQL, ("cl_concepts", "cl_literals"))
def clean_issues(spark, d):
    ci = T.cleaner_input(spark, d)
    return CL.clean_vocabulary(ci["concepts"], ci["literals"], base="http://ex.org/")["issues"]

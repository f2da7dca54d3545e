"""Registered cleaning queries (X1-X9) on whole texts of documents, pages and V1/V2."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import terms as TM
from tessera.functions import text as X
from tessera.plans import testbed as T
from tessera.plans.registry import query
from tessera.plans.sqlfrag import esc, punct_sql, replace_chain
from tessera.sources.tables import table

INJECT_SQL = replace_chain("text", [(b, a) for a, b in X.MOJIBAKE])
FIX = X.MOJIBAKE
ENT = X.ENTITIES


@query("clean_mojibake", f"""
SELECT pos, {replace_chain('bad', FIX)} AS text, bad <> {replace_chain('bad', FIX)} AS changed
FROM (SELECT pos, {INJECT_SQL} AS bad FROM v2 WHERE prop = 'definition')""", ("v2",))
def clean_mojibake(spark, d):
    v = T.v2(spark, d).where("prop = 'definition'").select("pos", X.inject_mojibake("text").alias("bad"))
    fixed = X.fix_mojibake("bad")
    return v.select("pos", fixed.alias("text"), (F.col("bad") != fixed).alias("changed"))


@query("clean_entities", f"SELECT page_id, {replace_chain('html', ENT)} AS html FROM pages")
def clean_entities(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", X.unescape_entities("html").alias("html"))


@query("clean_punctuation", f"SELECT doc_id, {punct_sql('text')} AS text FROM documents")
def clean_punctuation(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", X.space_after_punctuation("text").alias("text"))


@query("clean_label", f"""
SELECT pos, prop, CASE WHEN c <> '' THEN c END AS label FROM (
  SELECT pos, prop, regexp_replace(regexp_replace({replace_chain('text', FIX)}, '\\s+', ' ', 'g'),
                                   '^\\s+|\\s+$', '', 'g') AS c
  FROM v2 WHERE prop IN ('prefLabel', 'altLabel'))""", ("v2",))
def clean_label(spark, d):
    v = T.v2(spark, d).where(F.col("prop").isin("prefLabel", "altLabel"))
    return v.select("pos", "prop", X.clean_label("text").alias("label"))


@query("clean_text", f"""
SELECT doc_id, CASE WHEN c <> '' THEN c END AS text FROM (
  SELECT doc_id, {punct_sql(replace_chain(replace_chain('text', FIX), ENT), '+')} AS c FROM documents)""")
def clean_text(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", X.clean_text("text").alias("text"))


RAW_URI_SQL = """
SELECT id, CASE level WHEN 1 THEN '<http://ex.org/v/' || id || '>' WHEN 2 THEN 'esco:' || id
                ELSE CASE WHEN label LIKE '%7' THEN 'p:' || id ELSE ' ' || id || ' ' END END AS raw FROM v1"""


def _raw_uris(spark, d):
    v = T.v1(spark, d)
    raw = (F.when(F.col("level") == 1, F.concat(F.lit("<http://ex.org/v/"), "id", F.lit(">")))
            .when(F.col("level") == 2, F.concat(F.lit("esco:"), "id"))
            .when(F.col("label").like("%7"), F.concat(F.lit("p:"), "id"))
            .otherwise(F.concat(F.lit(" "), "id", F.lit(" "))))
    return v.select("id", raw.alias("raw"))


def _clean_uri_sql(base: str | None) -> str:
    u0 = "regexp_replace(raw, '^\\s+|\\s+$', '', 'g')"
    u = (f"(CASE WHEN starts_with({u0}, '<') AND ends_with({u0}, '>') "
         f"THEN substring({u0}, 2, greatest(length({u0}) - 2, 0)) ELSE {u0} END)")
    prefixed = (f"(CASE WHEN split_part({u}, ':', 1) = 'esco' THEN '{X.ESCO_SKILL_NS}' || regexp_extract({u}, '^[^:]*:(.*)$', 1) "
                f"ELSE '{X.EXAMPLE_NS}' || split_part({u}, ':', 1) || '/' || regexp_extract({u}, '^[^:]*:(.*)$', 1) END)")
    if base:
        rel = f"(CASE WHEN NOT contains({u}, ':') THEN '{base.rstrip('/')}/' || {u} ELSE {prefixed} END)"
    else:
        rel = f"(CASE WHEN contains({u}, ':') THEN {prefixed} ELSE '{X.ESCO_SKILL_NS}' || {u} END)"
    return f"CASE WHEN starts_with({u}, 'http') THEN {u} ELSE {rel} END"


@query("clean_uri", f"""
WITH r AS ({RAW_URI_SQL})
SELECT id, raw, {_clean_uri_sql(None)} AS uri, {_clean_uri_sql('http://ex.org/base/')} AS uri_based FROM r""",
       ("v1",))
def clean_uri(spark, d):
    r = _raw_uris(spark, d)
    return r.select("id", "raw", X.clean_uri("raw").alias("uri"),
                    X.clean_uri("raw", "http://ex.org/base/").alias("uri_based"))


@query("valid_uri", f"""
WITH r AS ({RAW_URI_SQL})
SELECT raw AS value, coalesce(regexp_matches(regexp_replace(raw, '^[<>]+|[<>]+$', '', 'g'),
                              '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+'), false) AS valid FROM r
UNION ALL
SELECT url, coalesce(regexp_matches(regexp_replace(url, '^[<>]+|[<>]+$', '', 'g'),
                     '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+'), false) FROM pages""", ("v1",))
def valid_uri(spark, d):
    r = _raw_uris(spark, d).select(F.col("raw").alias("value"))
    p = table(spark, d, "pages").select(F.col("url").alias("value"))
    u = r.unionByName(p)
    return u.select("value", X.is_valid_uri("value").alias("valid"))


_LANG = "'^[a-z]{2,3}(-[A-Za-z0-9]{1,8})*$'"


@query("valid_lang", f"""
SELECT doc_id, lang, coalesce(regexp_matches(lang, {_LANG}), false) AS valid,
       coalesce(regexp_matches(upper(lang), {_LANG}), false) AS valid_upper,
       coalesce(regexp_matches(lang || '-' || source, {_LANG}), false) AS valid_tagged
FROM documents""")
def valid_lang(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", "lang", X.is_valid_lang("lang").alias("valid"),
                      X.is_valid_lang(F.upper("lang")).alias("valid_upper"),
                      X.is_valid_lang(F.concat_ws("-", "lang", "source")).alias("valid_tagged"))


@query("escape_literal", f"SELECT doc_id, {esc('text')} AS text FROM documents")
def escape_literal(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", TM.escape_literal("text").alias("text"))

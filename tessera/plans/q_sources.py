"""Registered source/sink queries: CSV (S1, S2), JSON (S3), TTL round trip.

The TTL queries write a vocabulary built from documents to the shared
scratch folder and read it back, so reading and writing both run on data
that grows with the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.terms import typed_term
from tessera.plans.registry import query
from tessera.plans.sqlfrag import NL, esc
from tessera.plans.views_sql import _v
from tessera.session import tidy_shuffles
from tessera.sources import files as S
from tessera.sources import ttl as TT
from tessera.sources.tables import table

# ---------------------------------------------------------------- S1


@query("read_csv_roundtrip", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
       CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer""")
def read_csv_roundtrip(spark, d):
    path = S.scratch_path(spark, "csv")
    table(spark, d, "customer").write.option("header", True).option("sep", ";").csv(path)
    return S.read_csv(spark, path, sep=";", multi_line=False)


@query("read_csv_texts", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(text, '') AS text, lang, source FROM documents""")
def read_csv_texts(spark, d):
    """Whole texts, line ends and quotes included, written as CSV and read back."""
    path = S.scratch_path(spark, "csv")
    doc = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    (doc.write.option("header", True).option("sep", ";").option("quoteAll", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return S.read_csv(spark, path, sep=";")


@query("read_csv_uneven", """
SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS customer,
       CASE WHEN o_orderkey % 3 <> 1 THEN o_orderstatus END AS status FROM orders WHERE o_orderkey % 3 <> 2""")
def read_csv_uneven(spark, d):
    """A file whose rows have as many fields as the header, one fewer (padded) or one more (skipped)."""
    path = S.scratch_path(spark, "csv")
    o = table(spark, d, "orders")
    key, cust, status = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    line = (F.when(F.col("o_orderkey") % 3 == 1, F.concat_ws(";", key, cust))
             .when(F.col("o_orderkey") % 3 == 2, F.concat_ws(";", key, cust, status, F.lit("over")))
             .otherwise(F.concat_ws(";", key, cust, status)))
    # part files written in parallel, each with its own header line in front of its rows
    parts = spark.sparkContext.defaultParallelism
    rows = o.select(F.pmod(F.xxhash64("o_orderkey"), F.lit(parts)).cast("int").alias("p"), F.lit(1).alias("o"), line.alias("value"))
    head = spark.range(parts).select(F.col("id").cast("int").alias("p"), F.lit(0).alias("o"), F.lit("key;customer;status").alias("value"))
    rows.unionByName(head).repartition("p").sortWithinPartitions("p", "o").select("p", "value").write.partitionBy("p").text(path + "/t")
    return S.read_csv(spark, path + "/t/p=*", sep=";", multi_line=False)


@query("read_csv_quoted", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(text, '') || '"; "' || chr(10) || ';' || source || '\\' AS text, source FROM documents""")
def read_csv_quoted(spark, d):
    """Texts that hold separators, quotes, line ends and backslashes in every mixture, written as CSV and read back."""
    path = S.scratch_path(spark, "csv")
    doc = table(spark, d, "documents")
    text = F.concat(F.nullif(F.col("text"), F.lit("")), F.lit('"; "\n;'), F.col("source"), F.lit("\\"))
    quoted = [F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('""')), F.lit('"'))
              for c in (F.col("doc_id").cast("string"), text, F.col("source"))]
    parts = spark.sparkContext.defaultParallelism
    rows = doc.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("p"), F.lit(1).alias("o"), F.concat_ws(";", *quoted).alias("value"))
    head = spark.range(parts).select(F.col("id").cast("int").alias("p"), F.lit(0).alias("o"), F.lit("doc_id;text;source").alias("value"))
    rows.unionByName(head).repartition("p").sortWithinPartitions("p", "o").select("p", "value").write.partitionBy("p").text(path + "/t")
    return S.read_csv(spark, path + "/t/p=*", sep=";")


LIST_OF = 10_000  # events in one JSON list: files of a megabyte or two, so their number stays small


@query("json_list_inferred", """
SELECT event_id, event_type, value AS "metrics.value", user_id AS "metrics.user.id", event_type || '}"' || chr(92) || '[{' AS "metrics.user.tag" FROM events""")
def json_list_inferred(spark, d):
    """Lists of nested objects whose strings hold braces, brackets, quotes and backslashes; the types come from the records."""
    path = S.scratch_path(spark, "json")
    ev = table(spark, d, "events").select("event_id", "event_type", F.struct("value", F.struct(
        F.col("user_id").alias("id"), F.concat("event_type", F.lit('}"\\[{')).alias("tag")).alias("user")).alias("metrics"))
    rows = ev.select(F.floor(F.col("event_id") / LIST_OF).alias("g"), F.to_json(F.struct(*ev.columns)).alias("j"))
    lists = rows.groupBy("g").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ", "), F.lit("]")).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return S.read_json_flat(spark, path, multi_line=True)


# ---------------------------------------------------------------- S2 on V9 text lines
def v9_lines(spark, d) -> DataFrame:
    """V9 lines (file, line_no, line): nation and customer tables rendered with four separators."""
    n = table(spark, d, "nation")
    c = table(spark, d, "customer")

    def render(df, name, sep, cols, header):
        body = df.select(F.lit(name).alias("file"), (F.col(cols[0]) + 1).cast("long").alias("line_no"),
                         F.concat_ws(sep, *[F.col(x).cast("string") for x in cols]).alias("line"))
        head = df.sparkSession.createDataFrame([(name, 0, header)], "file string, line_no long, line string")
        return head.unionByName(body)

    ncols = ["n_nationkey", "n_name", "n_regionkey"]
    parts = [render(n, "nation_semicolon.csv", ";", ncols, ";".join(ncols)),
             render(n, "nation_comma.csv", ",", ncols, ",".join(ncols)),
             render(n, "nation_tab.csv", "\t", ncols, "\t".join(ncols)),
             render(c, "customer_pipe.csv", "|", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
                    "c_custkey|c_name|c_nationkey|c_acctbal|c_mktsegment")]
    mixed = c.select(F.lit("customer_mixed.csv").alias("file"), (F.col("c_custkey") + 1).cast("long").alias("line_no"),
                     F.concat(F.col("c_custkey").cast("string"), F.lit(";"), F.col("c_name"), F.lit(";"),
                              F.col("c_mktsegment"), F.lit(","), F.col("c_nationkey").cast("string")).alias("line"))
    mixed = spark.createDataFrame([("customer_mixed.csv", 0, "c_custkey;c_name;c_mktsegment,c_nationkey")],
                                  "file string, line_no long, line string").unionByName(mixed)
    return reduce(DataFrame.unionByName, parts + [mixed])


_v("v9_lines", f"""
SELECT 'nation_semicolon.csv' AS file, CAST(0 AS BIGINT) AS line_no, 'n_nationkey;n_name;n_regionkey' AS line
UNION ALL SELECT 'nation_semicolon.csv', n_nationkey + 1, concat_ws(';', n_nationkey, n_name, n_regionkey) FROM nation
UNION ALL SELECT 'nation_comma.csv', 0, 'n_nationkey,n_name,n_regionkey'
UNION ALL SELECT 'nation_comma.csv', n_nationkey + 1, concat_ws(',', n_nationkey, n_name, n_regionkey) FROM nation
UNION ALL SELECT 'nation_tab.csv', 0, 'n_nationkey' || chr(9) || 'n_name' || chr(9) || 'n_regionkey'
UNION ALL SELECT 'nation_tab.csv', n_nationkey + 1, concat_ws(chr(9), n_nationkey, n_name, n_regionkey) FROM nation
UNION ALL SELECT 'customer_pipe.csv', 0, 'c_custkey|c_name|c_nationkey|c_acctbal|c_mktsegment'
UNION ALL SELECT 'customer_pipe.csv', c_custkey + 1,
  concat_ws('|', c_custkey, c_name, c_nationkey, CAST(c_acctbal AS VARCHAR), c_mktsegment) FROM customer
UNION ALL SELECT 'customer_mixed.csv', 0, 'c_custkey;c_name;c_mktsegment,c_nationkey'
UNION ALL SELECT 'customer_mixed.csv', c_custkey + 1,
  CAST(c_custkey AS VARCHAR) || ';' || c_name || ';' || c_mktsegment || ',' || CAST(c_nationkey AS VARCHAR)
  FROM customer""")


@query("csv_dialect_scores", """
WITH seps AS (SELECT * FROM (VALUES (0, ';'), (1, ','), (2, chr(9)), (3, '|')) t(k, sep)),
h AS (SELECT l.file, s.k, s.sep, CAST(len(string_split(l.line, s.sep)) AS INTEGER) AS columns
      FROM v9_lines l, seps s WHERE l.line_no = (SELECT min(line_no) FROM v9_lines x WHERE x.file = l.file)),
b AS (SELECT l.file, s.k, len(string_split(l.line, s.sep)) AS nf
      FROM v9_lines l, seps s WHERE l.line_no > (SELECT min(line_no) FROM v9_lines x WHERE x.file = l.file)
        AND trim(l.line) <> ''),
c AS (SELECT h.file, h.k, h.sep, h.columns, count(*) FILTER (WHERE b.nf <= h.columns) AS rows
      FROM h LEFT JOIN b ON h.file = b.file AND h.k = b.k GROUP BY ALL),
s AS (SELECT *, CAST(columns * rows * CASE WHEN columns > 2 THEN 2 ELSE 1 END AS BIGINT) AS score FROM c),
a AS (SELECT *, coalesce(max(CASE WHEN columns > 1 AND rows > 0 THEN score END) OVER (
                 PARTITION BY file ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best_before
      FROM s),
f AS (SELECT *, columns > 1 AND rows > 0 AND score > best_before AS accepted FROM a)
SELECT file, sep, columns, rows, score,
       coalesce(k = coalesce(min(CASE WHEN accepted AND columns >= 5 THEN k END) OVER (PARTITION BY file),
                             max(CASE WHEN accepted THEN k END) OVER (PARTITION BY file)), false) AS chosen
FROM f""", ("v9_lines",))
def csv_dialect_scores_q(spark, d):
    return S.csv_dialect_scores(v9_lines(spark, d))


@query("csv_quote_scores", """
WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN chr(34) WHEN 1 THEN chr(39) ELSE '' END AS q FROM documents),
n AS (SELECT 'f' || CAST(doc_id % 3 AS VARCHAR) AS file, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT * FROM (VALUES (0, ';'), (1, ','), (2, chr(9)), (3, '|')) s(i, sep), (VALUES (0, chr(34)), (1, chr(39)), (2, NULL)) u(j, quote)),
-- a data line is q || id || ',' || ',x' || q || ';' || source: 2 fields by ';', 3 by ',' unless the quotes hide the commas
v AS (SELECT n.file, c.sep, c.quote, c.i * 3 + c.j AS k, CASE c.sep WHEN ';' THEN 2 ELSE 1 END AS columns,
        CASE WHEN c.sep = ',' AND NOT ((n.file = 'f0' AND c.j = 0) OR (n.file = 'f1' AND c.j = 1)) THEN 0 ELSE n.n END AS rows
      FROM n, c WHERE n.n > 0)
SELECT file, sep, quote, columns, rows, CAST(columns * rows AS BIGINT) AS score, k = 0 AS chosen FROM v""")
def csv_quote_scores(spark, d):
    """Files whose fields are quoted by double quotes, single quotes or not at all, scored for every separator and quote character."""
    q = F.element_at(F.array(F.lit('"'), F.lit("'"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int"))
    doc = table(spark, d, "documents").where("doc_id is not null").select(
        F.concat(F.lit("f"), (F.col("doc_id") % 3).cast("string")).alias("file"), (F.col("doc_id") + 1).alias("line_no"),
        F.concat(q, F.col("doc_id").cast("string"), F.lit(",,x"), q, F.lit(";"), F.coalesce("source", F.lit(""))).alias("line"))
    head = doc.select("file").distinct().select("file", F.lit(0).cast("long").alias("line_no"), F.lit("id;source").alias("line"))
    return S.csv_dialect_scores(head.unionByName(doc), quotes=S.CSV_QUOTES)


@query("csv_encoding", """
SELECT CAST(doc_id % 32 AS INTEGER) AS part,
       CASE doc_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'cp1252' ELSE 'latin1' END AS encoding
FROM documents WHERE doc_id IS NOT NULL GROUP BY ALL""")
def csv_encoding(spark, d):
    """Texts written as bytes of four encodings; the last with a byte that cp1252 does not know."""
    path = S.scratch_path(spark, "csv")
    kind = F.col("doc_id") % 4
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7f\xa0-\xff]", "?")
    latin = F.encode(F.concat(text, F.when(kind == 3, F.lit("é\x81")).otherwise(F.lit("é"))), "ISO-8859-1").cast("string")
    doc = table(spark, d, "documents").where("doc_id is not null").select(
        F.pmod("doc_id", F.lit(32)).cast("int").alias("p"), F.col("doc_id").alias("o"), F.when(kind < 2, F.col("text")).otherwise(latin).alias("value"))
    mark = doc.where(F.col("p") % 4 == 1).select("p", F.lit(-1).cast("long").alias("o"), F.lit("\ufeffid").alias("value")).distinct()
    doc.unionByName(mark).repartition("p").sortWithinPartitions("p", "o").select("p", "value").write.partitionBy("p").text(path + "/t")
    found = S.choose_encoding(spark, path + "/t/p=*")
    return found.select(F.regexp_extract("file", "/p=([0-9]+)/", 1).cast("int").alias("part"), "encoding")


# ---------------------------------------------------------------- S3
@query("json_flatten", """
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k",
       value AS "metrics.value", user_id AS "metrics.user.id" FROM events""")
def json_flatten(spark, d):
    path = S.scratch_path(spark, "json")
    ev = table(spark, d, "events")
    nested = ev.select("event_id", "event_type", F.from_json("props", "k long").alias("props"),
                       F.struct(F.col("value"), F.struct(F.col("user_id").alias("id")).alias("user")).alias("metrics"))
    nested.write.json(path)
    schema = "event_id long, event_type string, props struct<k: long>, metrics struct<value: double, user: struct<id: long>>"
    return S.read_json_flat(spark, path, schema=schema)


@query("json_list", """
SELECT event_id, event_type, value AS "metrics.value", user_id AS "metrics.user.id" FROM events""")
def json_list(spark, d):
    """Files that hold one list of nested objects each, read and flattened."""
    path = S.scratch_path(spark, "json")
    ev = table(spark, d, "events").select("event_id", "event_type", F.struct(
        F.col("value"), F.struct(F.col("user_id").alias("id")).alias("user")).alias("metrics"))
    # a list of consecutive events, one to a line of its own file part
    rows = ev.select(F.floor(F.col("event_id") / LIST_OF).alias("g"), F.to_json(F.struct(*ev.columns)).alias("j"))
    lists = rows.groupBy("g").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ", "), F.lit("]")).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)
    schema = "event_id long, event_type string, metrics struct<value: double, user: struct<id: long>>"
    return S.read_json_flat(spark, path, multi_line=True, schema=schema)


# ---------------------------------------------------------------- S4-S9 round trip
BASE = "http://ex.org/d/"


def doc_terms(spark, d) -> DataFrame:
    """Long rows (uri, pos, prop, vpos, value, lang) of a vocabulary with one concept per document."""
    doc = table(spark, d, "documents")
    uri = F.concat(F.lit(BASE), F.col("doc_id").cast("string"))
    rows = [("prefLabel", 0, F.substring_index("text", "\n", 1), None),
            ("altLabel", 0, F.substring_index("text", "\n", -1), None), ("altLabel", 1, F.col("source"), None), ("definition", 0, F.col("text"), None),
            ("broader", 0, F.concat(F.lit(BASE), F.floor(F.col("doc_id") / 2).cast("long").cast("string")),
             F.col("doc_id") >= 2)]
    parts = []
    for prop, vpos, value, cond in rows:
        src = doc if cond is None else doc.where(cond)
        parts.append(src.select(uri.alias("uri"), F.col("doc_id").alias("pos"), F.lit(prop).alias("prop"),
                                F.lit(vpos).alias("vpos"), value.alias("value"), "lang"))
    return reduce(DataFrame.unionByName, parts)


_v("doc_terms", f"""
SELECT '{BASE}' || CAST(doc_id AS VARCHAR) AS uri, doc_id AS pos, 'prefLabel' AS prop, 0 AS vpos,
       split_part(text, chr(10), 1) AS value, lang, 0 AS r FROM documents
UNION ALL SELECT '{BASE}' || CAST(doc_id AS VARCHAR), doc_id, 'altLabel', 0, split_part(text, chr(10), -1), lang, 1 FROM documents
UNION ALL SELECT '{BASE}' || CAST(doc_id AS VARCHAR), doc_id, 'altLabel', 1, source, lang, 1 FROM documents
UNION ALL SELECT '{BASE}' || CAST(doc_id AS VARCHAR), doc_id, 'definition', 0, text, lang, 6 FROM documents
UNION ALL SELECT '{BASE}' || CAST(doc_id AS VARCHAR), doc_id, 'broader', 0, '{BASE}' || CAST(doc_id // 2 AS VARCHAR), lang, 11
  FROM documents WHERE doc_id >= 2""")

_STMT = (f"'    skos:' || prop || ' ' || CASE WHEN prop = 'broader' THEN '<' || value || '>' "
         f"ELSE '\"' || {esc('value')} || '\"@' || lang END")
_BLOCKS = f"""
SELECT uri, '<' || uri || '> a skos:Concept ;' || {NL} || '    skos:inScheme <> ;' || {NL}
  || string_agg({_STMT}, ' ;' || {NL} ORDER BY r, vpos, {_STMT}) || ' .' AS block
FROM doc_terms GROUP BY uri, pos"""


def doc_blocks(spark, d) -> DataFrame:
    t = doc_terms(spark, d)
    t = t.withColumn("term", typed_term("prop", "value", F.col("lang")))
    return TT.concept_blocks(t, "uri", "pos")


def written_vocabulary(spark, d) -> str:
    path = S.scratch_path(spark, "ttl")
    n = table(spark, d, "documents").count()
    TT.write_ttl(doc_blocks(spark, d), path,
                 TT.header_text("http://ex.org/d/", "Documents", f"{n} concepts", "en", "2024-01-01"))
    return path


def _read_back(spark, d):
    path = written_vocabulary(spark, d)
    b = TT.read_ttl(spark, f"{path}/concepts")
    return b.withColumn("uri", F.regexp_replace("raw_uri", r"^<|>$", ""))


@query("ttl_serialise", _BLOCKS, ("doc_terms",))
def ttl_serialise(spark, d):
    return doc_blocks(spark, d).select("uri", "block")


@query("ttl_blocks", f"""
SELECT '<' || uri || '>' AS raw_uri, replace(block, {NL} || '    ', {NL}) AS block FROM ({_BLOCKS})""",
       ("doc_terms",))
def ttl_blocks(spark, d):
    return _read_back(spark, d).select("raw_uri", "block")


@query("ttl_literals", """
SELECT uri, prop, value AS text, lang FROM doc_terms WHERE prop <> 'broader'""", ("doc_terms",))
def ttl_literals(spark, d):
    return TT.parse_literals(_read_back(spark, d)).select("uri", "prop", "text", "lang")


@query("ttl_relations", """
SELECT uri, prop, value AS target FROM doc_terms WHERE prop = 'broader'
UNION ALL SELECT uri, 'inScheme', '' FROM doc_terms WHERE prop = 'prefLabel'""", ("doc_terms",))
def ttl_relations(spark, d):
    return TT.parse_relations(_read_back(spark, d)).select("uri", "prop", "target")


@query("ttl_lines", """
SELECT uri, prop, value, CASE WHEN prop <> 'broader' THEN lang END AS lang FROM doc_terms""", ("doc_terms",))
def ttl_lines(spark, d):
    """The vocabulary written and read statement by statement, no concept gathered in between."""
    path = S.scratch_path(spark, "ttl")
    terms = doc_terms(spark, d).select("uri", "pos", "prop", "vpos", typed_term("prop", "value", F.col("lang")).alias("term"))
    TT.write_ttl_lines(terms, path, TT.header_text(BASE, "Documents", "by statement", "en", "2024-01-01"), row_col="pos")
    b = TT.read_statements(spark, f"{path}/concepts").withColumn("uri", F.regexp_replace("raw_uri", r"^<|>$", ""))
    literals = TT.parse_literals(b).select("uri", "prop", F.col("text").alias("value"), "lang")
    relations = TT.parse_relations(b).where("prop <> 'inScheme'").select("uri", "prop", F.col("target").alias("value"), F.lit(None).cast("string").alias("lang"))
    return literals.unionByName(relations)


@query("ttl_concept_table", """
SELECT uri,
       max(CASE WHEN prop = 'prefLabel' THEN value END) AS prefLabel,
       max(CASE WHEN prop = 'prefLabel' THEN lang END) AS language,
       string_agg(CASE WHEN prop = 'altLabel' THEN value END, ' | ' ORDER BY vpos) AS altLabel,
       max(CASE WHEN prop = 'definition' THEN value END) AS definition,
       max(CASE WHEN prop = 'broader' THEN value END) AS broader
FROM doc_terms GROUP BY uri""", ("doc_terms",))
def ttl_concept_table(spark, d):
    b = _read_back(spark, d)
    return TT.concept_table(TT.parse_literals(b), TT.parse_relations(b))


@query("ttl_header", """
SELECT 'base' AS kind, '@base <http://ex.org/d/> .' AS text
UNION ALL SELECT 'prefix', t FROM (VALUES
  ('@prefix skos: <http://www.w3.org/2004/02/skos/core#> .'), ('@prefix dct: <http://purl.org/dc/terms/> .'),
  ('@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .'),
  ('@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .'),
  ('@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .'),
  ('@prefix esco: <http://data.europa.eu/esco/skill/> .'),
  ('@prefix isced: <http://data.europa.eu/esco/isced-f/> .'),
  ('@prefix isothes: <http://purl.org/iso25964/skos-thes#> .')) v(t)
UNION ALL SELECT 'scheme', '<> a skos:ConceptScheme ;' || chr(10) || '    dct:title "Documents"@en ;' || chr(10)
  || '    dct:description "' || (SELECT count(*) FROM documents) || ' concepts"@en ;' || chr(10)
  || '    dct:created "2024-01-01"^^xsd:date .'""")
def ttl_header(spark, d):
    path = written_vocabulary(spark, d)
    return TT.read_header(spark, [f"{path}/header", f"{path}/concepts"]).select("kind", "text")


# ---------------------------------------------------------------- streaming cleaner
@query("stream_clean", """
SELECT uri, text FROM (
  SELECT uri, regexp_replace(regexp_replace(value, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text
  FROM doc_terms WHERE prop = 'prefLabel') WHERE text <> ''""", ("doc_terms",))
def stream_clean(spark, d):
    """The document vocabulary arrives twice as files, the second time with other labels; the stream
    keeps the first block of a URI and writes cleaned labels; the result is the prefLabels read back."""
    from tessera.streaming.cleaner_stream import clean_stream
    src = S.scratch_path(spark, "stream-src")
    value = F.concat("block", F.lit("\n"))
    copies = F.array(F.struct(F.lit("1").alias("copy"), value.alias("value")),
                     F.struct(F.lit("2").alias("copy"), F.regexp_replace(value, 'skos:prefLabel "', 'skos:prefLabel "Later ').alias("value")))
    with tidy_shuffles(spark):  # the blocks are built once
        doc_blocks(spark, d).select(F.inline(copies)).write.partitionBy("copy").text(src, compression="gzip")
    sink = S.scratch_path(spark, "stream-sink")
    q = clean_stream(spark, f"{src}/*", sink, S.scratch_path(spark, "stream-ckpt"))
    q.awaitTermination()
    labels = spark.read.parquet(f"{sink}/labels")
    return labels.where("prop = 'prefLabel'").select("uri", "text")

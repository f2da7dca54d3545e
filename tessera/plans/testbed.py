"""Test-bed views built from the driver tables (FIXTURES.md section 3).

These functions only shape rows of the driver tables into the schemas the
operators expect; they do none of an operator's work.  ``views_sql`` holds
the same definitions for DuckDB.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table


def _pad(c, n):
    return F.lpad(F.col(c).cast("string"), n, "0")


def v1(spark: SparkSession, d: str) -> DataFrame:
    """V1: id, parent_id, level, label, path, notation, pos."""
    r = table(spark, d, "region")
    n = table(spark, d, "nation")
    c = table(spark, d, "customer")
    lvl1 = r.select(_pad("r_regionkey", 2).alias("id"), F.lit(None).cast("string").alias("parent_id"),
                    F.lit(1).alias("level"), F.col("r_name").alias("label"),
                    _pad("r_regionkey", 2).alias("path"), F.col("r_regionkey").cast("string").alias("notation"),
                    (F.lit(1000000000000) + F.col("r_regionkey")).cast("long").alias("pos"))
    lvl2 = n.select(F.concat(_pad("n_regionkey", 2), _pad("n_nationkey", 2)).alias("id"),
                    _pad("n_regionkey", 2).alias("parent_id"), F.lit(2).alias("level"),
                    F.col("n_name").alias("label"),
                    F.concat_ws("/", _pad("n_regionkey", 2), _pad("n_nationkey", 2)).alias("path"),
                    F.concat_ws(".", F.col("n_regionkey").cast("string"),
                                F.col("n_nationkey").cast("string")).alias("notation"),
                    (F.lit(2000000000000) + F.col("n_nationkey")).cast("long").alias("pos"))
    cn = c.join(n.select("n_nationkey", "n_regionkey"), c.c_nationkey == n.n_nationkey)
    lvl3 = cn.select(F.concat(_pad("n_regionkey", 2), _pad("n_nationkey", 2), _pad("c_custkey", 12)).alias("id"),
                     F.concat(_pad("n_regionkey", 2), _pad("n_nationkey", 2)).alias("parent_id"),
                     F.lit(3).alias("level"), F.col("c_name").alias("label"),
                     F.concat_ws("/", _pad("n_regionkey", 2), _pad("n_nationkey", 2),
                                 _pad("c_custkey", 12)).alias("path"),
                     F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"),
                                 F.col("c_custkey").cast("string")).alias("notation"),
                     (F.lit(3000000000000) + F.col("c_custkey")).cast("long").alias("pos"))
    return lvl1.unionByName(lvl2).unionByName(lvl3)


_FAULTS = [
    ("zz01", "zz01", 2, "Self loop", 9000000000001),
    ("zz02", "zz03", 2, "Cycle a", 9000000000002),
    ("zz03", "zz02", 2, "Cycle b", 9000000000003),
    ("zz04", "zz02", 3, "Into cycle", 9000000000004),
    ("zz05", "99", 2, "Missing parent", 9000000000005),
    ("zz06", "", 1, "Blank parent", 9000000000006),
    ("zz07", "  ", 1, "Space parent", 9000000000007),
]


def v1x(spark: SparkSession, d: str) -> DataFrame:
    """V1x: V1 plus a self loop, a two-node cycle, a chain into it, a missing parent, blank parents."""
    faults = spark.createDataFrame(
        [(i, p, lv, lab, i, i, pos) for i, p, lv, lab, pos in _FAULTS],
        "id string, parent_id string, level int, label string, path string, notation string, pos long")
    return v1(spark, d).unionByName(faults)


def _customers_of(v: DataFrame, c: DataFrame) -> DataFrame:
    ids = v.where("level = 3").select("id", F.col("label").alias("c_name"))
    return c.select("c_custkey", "c_name", "c_mktsegment").join(ids, "c_name")


def v1s(spark: SparkSession, d: str) -> DataFrame:
    """V1s: (child, parent): V1x with market segments as second parents of customers."""
    v, c = v1x(spark, d), table(spark, d, "customer")
    seg = F.concat(F.lit("seg/"), F.col("c_mktsegment"))
    parts = [v.where("parent_id is not null and trim(parent_id) <> ''").select("id", "parent_id"),
             _customers_of(v, c).select("id", seg), c.select(seg, F.lit("00"))]
    return reduce(DataFrame.union, [p.toDF("child", "parent") for p in parts])


def v1g(spark: SparkSession, d: str) -> DataFrame:
    """V1g: V1s and orders below their customer and the order before, in chains of which some are closed to cycles."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey")

    def order(k):
        return F.concat(F.lit("ord/"), k.cast("string"))
    cust = _customers_of(v1x(spark, d), table(spark, d, "customer"))
    parts = [o.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(order(key), "id"),
             o.where(key % 50 != 0).select(order(key), order(key - 1)), o.where(key % 200 == 10).select(order(key - 9), order(key))]
    return reduce(DataFrame.union, [v1s(spark, d), *[p.toDF("child", "parent") for p in parts]])


def v1p(spark: SparkSession, d: str) -> DataFrame:
    """V1p: different pairs (child, ancestor) to ask V1s for."""
    v = v1x(spark, d)
    parts = [v.select("id", F.lit("seg/BUILDING")), v.select("id", F.concat(F.lit("0"), (F.col("pos") % 5).cast("string"))),
             v.select("id", F.substring("id", 1, 4)), v.select("id", F.lit("zz02"))]
    return reduce(DataFrame.union, [p.toDF("child", "ancestor") for p in parts]).distinct()


def v7(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """V7: three overlapping sources a (id, name), b (id, nation; repeated ids), c (id, name, balance).

    a has null keys for strongly negative balances; b repeats the rows of one
    market segment; c comes from supplier with the same key space prefix.
    """
    c = table(spark, d, "customer")
    s = table(spark, d, "supplier")
    kid = F.concat(F.lit("k"), F.col("c_custkey").cast("string"))
    a = c.select(F.when(F.col("c_acctbal") < -900, F.lit(None)).otherwise(kid).alias("id"),
                 F.col("c_name").alias("name"), F.col("c_custkey").cast("long").alias("pos"))
    b1 = c.where(F.col("c_acctbal") >= 0).select(kid.alias("id"), F.col("c_nationkey").cast("string").alias("nation"),
                                                F.col("c_custkey").cast("long").alias("pos"))
    b2 = (c.where((F.col("c_acctbal") >= 0) & (F.col("c_mktsegment") == "BUILDING"))
           .select(kid.alias("id"), F.col("c_nationkey").cast("string").alias("nation"),
                   (F.col("c_custkey") + F.lit(1000000000000)).cast("long").alias("pos")))
    cc = s.select(F.concat(F.lit("k"), F.col("s_suppkey").cast("string")).alias("id"),
                  F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"),
                  F.col("s_suppkey").cast("long").alias("pos"))
    return {"a": a, "b": b1.unionByName(b2), "c": cc}


def v2(spark: SparkSession, d: str) -> DataFrame:
    """V2 literals (uri, prop, text, lang, pos) from documents.

    prefLabel = first line, altLabel = last line, definition = the whole text; two documents share each URI so that URIs repeat.
    """
    doc = table(spark, d, "documents")
    uri = F.concat(F.lit("http://ex.org/doc/"), F.floor(F.col("doc_id") / 2).cast("long").cast("string"))
    rows = [("prefLabel", F.substring_index("text", "\n", 1), 0), ("altLabel", F.substring_index("text", "\n", -1), 1),
            ("definition", F.col("text"), 2)]
    out = None
    for prop, txt, k in rows:
        part = doc.select(uri.alias("uri"), F.lit(prop).alias("prop"), txt.alias("text"), F.col("lang"),
                          (F.col("doc_id") * 10 + k).cast("long").alias("pos"))
        out = part if out is None else out.unionByName(part)
    return out


def cleaner_input(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Flow-B input from documents: one concept block per document.

    concepts(raw_uri, pos): V2's URI, written relative ('doc/<n>') for source
    src3.  literals(pos, prop, vpos, text, lang): V2's three literals; labels
    of German documents carry mis-decoded characters, source src7 has a
    blank prefLabel, and source src5 an upper-case language tag.
    """
    from tessera.functions.text import inject_mojibake
    doc = table(spark, d, "documents")
    n = F.floor(F.col("doc_id") / 2).cast("long").cast("string")
    raw = F.when(F.col("source") == "src3", F.concat(F.lit("doc/"), n)).otherwise(
        F.concat(F.lit("http://ex.org/doc/"), n))
    concepts = doc.select(raw.alias("raw_uri"), F.col("doc_id").alias("pos"))
    lang = F.when(F.col("source") == "src5", F.upper("lang")).otherwise(F.col("lang"))
    pref = F.when(F.col("source") == "src7", F.lit("   ")).otherwise(F.substring_index("text", "\n", 1))
    rows = [("prefLabel", pref, True), ("altLabel", F.substring_index("text", "\n", -1), True),
            ("definition", F.col("text"), False)]
    lits = None
    for k, (prop, txt, is_label) in enumerate(rows):
        t = F.when(F.col("lang") == "de", inject_mojibake(txt)).otherwise(txt) if is_label else txt
        part = doc.select(F.col("doc_id").alias("pos"), F.lit(prop).alias("prop"), F.lit(k).alias("vpos"),
                          t.alias("text"), lang.alias("lang"))
        lits = part if lits is None else lits.unionByName(part)
    return {"concepts": concepts, "literals": lits}


def v1_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations (uri, prop, target) over V1x: broader = parent; every customer is related
    to its region and those with a label ending in 7 also to their parent; xl labels for
    nations and customers, literal forms for nations and (unreferenced) regions."""
    v = v1x(spark, d)
    lvl = F.col("level")
    broader = v.where(F.col("parent_id").isNotNull() & (F.trim("parent_id") != "")).select(
        F.col("id").alias("uri"), F.lit("broader").alias("prop"), F.col("parent_id").alias("target"))
    rel_region = v.where(lvl == 3).select("id", F.lit("related"), F.substring("parent_id", 1, 2))
    rel_parent = v.where((lvl == 3) & F.col("label").like("%7")).select("id", F.lit("related"), "parent_id")
    xl_n = v.where(lvl == 2).select("id", F.lit("xlPrefLabel"), F.concat("id", F.lit("#l")))
    xl_c = v.where(lvl == 3).select("id", F.lit("xlAltLabel"), "parent_id")
    form_n = v.where(lvl == 2).select(F.concat("id", F.lit("#l")), F.lit("literalForm"), "label")
    form_r = v.where(lvl == 1).select(F.concat("id", F.lit("#x")), F.lit("literalForm"), "label")
    out = broader
    for p in (rel_region, rel_parent, xl_n, xl_c, form_n, form_r):
        out = out.union(p)
    return out


def v3(spark: SparkSession, d: str) -> DataFrame:
    """V3 mappings (source_uri, target_uri, mapping_type, confidence, pos) from lineitem.

    part -> supplier with a type chosen by (returnflag, linestatus) in assorted
    spellings; first lines of orders add the reversed pair, seventh lines a
    self pair, and quantities below 2 an absolute source without a target.
    """
    li = table(spark, d, "lineitem")
    part = F.concat(F.lit("part/"), F.col("l_partkey").cast("string"))
    supp = F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string"))
    # type by (returnflag, linestatus) as one literal-map lookup; (N, O) has none
    spellings = {"RF": "exact", "AF": "Broader", "RO": "related", "AO": "narrower", "NF": "exactMatch"}
    typ = F.try_element_at(F.create_map(*[F.lit(x) for kv in spellings.items() for x in kv]),
                           F.concat("l_returnflag", "l_linestatus"))
    pos = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    cols = ["source_uri", "target_uri", "mapping_type", "confidence", "pos"]
    main = li.select(part, supp, typ, F.col("l_discount"), pos.cast("long")).toDF(*cols)
    rev = li.where("l_linenumber = 1").select(supp, part, F.lit("exactMatch"), F.col("l_discount"),
                                              (pos + F.lit(1000000000000)).cast("long")).toDF(*cols)
    selfp = li.where("l_linenumber = 7").select(part, part, F.lit("related"), F.col("l_discount"),
                                                (pos + F.lit(2000000000000)).cast("long")).toDF(*cols)
    dang = li.where("l_quantity < 2").select(F.concat(F.lit("http://ex.org/part/"), F.col("l_partkey").cast("string")),
                                             F.lit(None).cast("string"), F.lit("close"), F.col("l_discount"),
                                             (pos + F.lit(3000000000000)).cast("long")).toDF(*cols)
    return main.unionByName(rev).unionByName(selfp).unionByName(dang)


def v4(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """V4 collection rows (collection, member, ord, label, pos).

    conv: one collection per conversation, members are hashed message texts
    (repeated texts repeat members), order = turn, label = role.
    part: one collection per brand, members are part URIs, order = size.
    """
    cv = table(spark, d, "conversations")
    conv = cv.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("collection"),
                     F.concat(F.lit("http://ex.org/text/"), F.substring(F.md5("text"), 1, 16)).alias("member"),
                     F.col("turn").alias("ord"), F.col("role").alias("label"),
                     (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("pos"))
    p = table(spark, d, "part")
    part = p.select(F.col("p_brand").alias("collection"),
                    F.concat(F.lit("http://ex.org/part/"), F.col("p_partkey").cast("string")).alias("member"),
                    F.col("p_size").cast("long").alias("ord"), F.lit(None).cast("string").alias("label"),
                    F.col("p_partkey").cast("long").alias("pos"))
    return {"conv": conv, "part": part}


def v5(spark: SparkSession, d: str) -> DataFrame:
    """V5 documentation rows: documents left-joined with labels and pages.

    def_<lang> = the text in the column of its language; example = first
    sentence when quality = 1; changeNote when toxic = 1; note = the page
    with the same id (HTML markup).
    """
    doc = table(spark, d, "documents")
    lab = table(spark, d, "labels")
    pg = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "html")
    j = doc.join(lab, "doc_id", "left").join(pg, "doc_id", "left")
    cols = [F.concat(F.lit("http://ex.org/doc/"), F.col("doc_id").cast("string")).alias("uri"),
            F.col("doc_id").cast("long").alias("pos")]
    shown = F.coalesce(F.col("toxic"), F.lit(0)) == 0  # flagged texts are withheld and leave a concept without definition
    cols += [F.when(shown & (F.col("lang") == lg), F.col("text")).alias(f"def_{lg}") for lg in ("en", "fr", "de", "es")]
    cols += [F.when(F.col("quality") == 1, F.regexp_extract("text", r"^[^.!?]*[.!?]", 0)).alias("example"),
             F.when(F.col("toxic") == 1, F.lit("Flagged in review")).alias("changeNote"),
             F.col("html").alias("note")]
    return j.select(*cols)


def v6(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """V6 enrichment input.

    literals (uri, prop, value, lang, pos, vpos): customers as concepts, prefLabel =
    name, altLabel = market segment (shared by many concepts).
    rows (uri, label, segment, spend, pos): orders rolled up per (customer, priority);
    even customer keys give absolute URIs, odd ones relative ids, priority 5-LOW
    rows point at unknown concepts; labels are upper-case names, or the upper-case
    segment for priority 4-NOT SPECIFIED.
    """
    c = table(spark, d, "customer")
    o = table(spark, d, "orders")
    uri = F.concat(F.lit("http://ex.org/c/"), F.col("c_custkey").cast("string"))
    pref = c.select(uri.alias("uri"), F.lit("prefLabel").alias("prop"), F.col("c_name").alias("value"),
                    F.lit("en").alias("lang"), F.col("c_custkey").cast("long").alias("pos"), F.lit(0).alias("vpos"))
    alt = c.select(uri.alias("uri"), F.lit("altLabel").alias("prop"), F.col("c_mktsegment").alias("value"),
                   F.lit("en").alias("lang"), F.col("c_custkey").cast("long").alias("pos"), F.lit(0).alias("vpos"))
    g = (o.groupBy("o_custkey", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("spend"))
          .join(c.select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left"))
    key = F.col("o_custkey").cast("string")
    ruri = (F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("http://ex.org/c/x"), key))
             .when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("http://ex.org/c/"), key)).otherwise(key))
    label = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.upper("c_mktsegment")).otherwise(F.upper("c_name"))
    rows = g.select(ruri.alias("uri"), label.alias("label"), F.col("c_mktsegment").alias("segment"), "spend",
                    (F.col("o_custkey") * 10 + F.substring("o_orderpriority", 1, 1).cast("int")).cast("long").alias("pos"))
    return {"literals": pref.unionByName(alt), "rows": rows}


def v8(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """V8: embeddings with label < 3 are property vectors (grouped by label); every embedding is a
    field vector named 'f<vec_id>'."""
    e = table(spark, d, "embeddings")
    props = e.where("label < 3").select(F.col("label").cast("string").alias("label"), "embedding")
    fields = e.select(F.concat(F.lit("f"), F.col("vec_id").cast("string")).alias("field"),
                                          "vec_id", "embedding")
    return {"props": props, "fields": fields}

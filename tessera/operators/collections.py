"""SKOS collections (G1-G8) kept as two long tables.

``collections(collection, coll_uri, type, label, member_count)`` and
``members(collection, coll_uri, member, ord, pos)``.  A collection's member
list is never gathered into one row: counts are partial aggregates, and the
ordered ``memberList`` is written as an RDF list whose links come from a
global numbering of the sorted members (no per-collection window).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.terms import escape_literal
from tessera.functions.text import collection_slug
from tessera.sources.ttl import number_rows

DEFAULT_BASE = "http://example.org/collections"


def collection_uri(name, base: str = "") -> F.Column:
    """URI of a collection: base + '/collection/' + slug of the name."""
    b = (base or DEFAULT_BASE).rstrip("/")
    return F.concat(F.lit(f"{b}/collection/"), collection_slug(name))


def build_collections(df: DataFrame, coll_col: str, member_col: str = "uri", label_col: str | None = None,
                      order_col: str | None = None, ordered: bool = False, base: str = "",
                      pos_col: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(collections, members).

    Rows without a collection name are skipped; members without a value are
    not members.  The label is the first non-null custom label (by position)
    or the name.  ``ordered`` marks OrderedCollections; their order is
    (order value, member).
    """
    rows = df.where(F.col(coll_col).isNotNull())
    name = F.col(coll_col).cast("string")
    members = rows.where(F.col(member_col).isNotNull()).select(
        name.alias("collection"), collection_uri(name, base).alias("coll_uri"),
        F.col(member_col).cast("string").alias("member"),
        (F.col(order_col) if order_col else F.lit(None)).alias("ord"), F.col(pos_col).alias("pos"))
    aggs = [F.count(F.col(member_col)).alias("member_count")]
    if label_col:
        aggs.append(F.min_by(F.col(label_col), F.when(F.col(label_col).isNotNull(), F.col(pos_col))).alias("custom"))
    g = rows.groupBy(name.alias("collection")).agg(*aggs)
    label = F.coalesce(F.col("custom"), F.col("collection")) if label_col else F.col("collection")
    colls = g.select("collection", collection_uri(F.col("collection"), base).alias("coll_uri"),
                     F.lit("OrderedCollection" if ordered else "Collection").alias("type"),
                     label.cast("string").alias("label"), "member_count")
    return colls, members


def thematic_collections(df: DataFrame, uri_col: str, field: str, base: str = "",
                         pos_col: str = "pos") -> tuple[DataFrame, DataFrame]:
    """One unordered collection per value of ``field``."""
    return build_collections(df, field, uri_col, base=base, pos_col=pos_col)


def merge_collections(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Per collection name the set union of members; counts recomputed; the first part's
    type and label win."""
    colls = reduce(DataFrame.unionByName,
                   [c.withColumn("_part", F.lit(i)) for i, (c, _) in enumerate(parts)])
    mem = reduce(DataFrame.unionByName, [m for _, m in parts])
    distinct = mem.groupBy("collection", "coll_uri", "member").agg(F.min("pos").alias("pos"))
    counts = distinct.groupBy("collection").agg(F.count("*").alias("member_count"))
    first = colls.groupBy("collection").agg(F.min_by(F.struct("coll_uri", "type", "label"), "_part").alias("c"))
    merged = (first.join(counts, "collection", "left")
                   .select("collection", "c.coll_uri", "c.type", "c.label",
                           F.coalesce("member_count", F.lit(0)).alias("member_count")))
    return merged, distinct


def collection_validation(colls: DataFrame, members: DataFrame) -> DataFrame:
    """(collection, severity, message) for empty collections, repeated members and
    ordered collections without an ordered member."""
    m = members.groupBy("collection").agg(F.count("*").alias("n"), F.count_distinct("member").alias("nd"),
                                          F.count(F.col("ord")).alias("n_ord"))
    j = colls.join(m, "collection", "left")
    checks = [
        (F.coalesce(F.col("member_count"), F.lit(0)) == 0, "warning", "Collection '%s' has no members"),
        (F.col("n") != F.col("nd"), "warning", "Collection '%s' has duplicate members"),
        ((F.col("type") == "OrderedCollection") & (F.coalesce(F.col("n_ord"), F.lit(0)) == 0), "issue",
         "Ordered collection '%s' has no member list"),
    ]
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(sev).alias("severity"),
                                                   F.format_string(msg, "collection").alias("message")))
                               for c, sev, msg in checks]), lambda x: x.isNotNull())
    return j.select("collection", F.explode(found).alias("x")).select(
        "collection", "x.severity", "x.message")


def collection_stats(colls: DataFrame) -> DataFrame:
    """Totals, average, largest, smallest, ordered and unordered counts (one row)."""
    return colls.agg(F.count("*").alias("total_collections"), F.sum("member_count").alias("total_members"),
                     F.round(F.avg("member_count"), 6).alias("average_members_per_collection"),
                     F.max("member_count").alias("largest_collection_size"),
                     F.min("member_count").alias("smallest_collection_size"),
                     F.count_if(F.col("type") == "OrderedCollection").alias("ordered_collections"),
                     F.count_if(F.col("type") == "Collection").alias("unordered_collections"))


def collection_top(colls: DataFrame, k: int = 5) -> DataFrame:
    """The k largest collections (ties by name) - a top-k report."""
    return colls.orderBy(F.col("member_count").desc(), "collection").limit(k).select("collection", "member_count")


def suggest_groupings(df: DataFrame, uri_col: str, k: int = 5, max_groups: int = 50) -> DataFrame:
    """String columns whose distinct count lies in [2, min(max_groups, rows // 2)], scored
    avg / (1 + var / avg) with avg = rows / distinct and var the sample variance of group sizes;
    the best k.

    One pass of distinct-count sketches (mergeable, a fixed size per column) finds the columns that can lie in the
    bounds, half above them for the sketch's error; only the values of those are grouped, so texts and names are
    never shuffled.
    """
    str_cols = [f.name for f in df.schema.fields if f.name != uri_col and f.dataType.simpleString() == "string"]
    if str_cols:
        about = df.agg(*[F.approx_count_distinct(f"`{c}`", 0.02).alias(str(i)) for i, c in enumerate(str_cols)]).first()
        str_cols = [c for i, c in enumerate(str_cols) if about[i] <= 1.5 * max_groups]
    if not str_cols:
        return df.sparkSession.createDataFrame([], "field string, unique_groups bigint, average_group_size double, size_variance double, quality_score double")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("value"))
                                         for c in str_cols])).alias("x")).select("x.field", "x.value")
    # one partial aggregate per (field, value); the null group carries the rows without a value
    sizes = long.groupBy("field", "value").agg(F.count("*").alias("n"))
    nn = F.col("value").isNotNull()
    per = sizes.groupBy("field").agg(F.sum("n").alias("total_rows"), F.count_if(nn).alias("unique_groups"),
                                     F.var_samp(F.when(nn, F.col("n"))).alias("size_variance"))
    avg = F.col("total_rows") / F.col("unique_groups")
    ok = (F.col("unique_groups") >= 2) & (F.col("unique_groups") <= F.least(F.lit(max_groups),
                                                                           F.floor(F.col("total_rows") / 2)))
    scored = per.where(ok).select("field", "unique_groups", F.round(avg, 6).alias("average_group_size"),
                                  F.round("size_variance", 6).alias("size_variance"),
                                  F.round(avg / (1 + F.col("size_variance") / avg), 6).alias("quality_score"))
    return scored.orderBy(F.col("quality_score").desc(), "field").limit(k)


def collection_triples(colls: DataFrame, members: DataFrame, scheme: str = "") -> DataFrame:
    """(coll_uri, k, triple) lines: type, label, scheme, one skos:member per member and,
    for ordered collections, the memberList as an RDF list of blank nodes."""
    lines = [colls.select("coll_uri", F.lit(0).alias("k"),
                          F.concat(F.lit("<"), "coll_uri", F.lit("> rdf:type skos:"), "type", F.lit(" .")).alias("triple")),
             colls.select("coll_uri", F.lit(1).alias("k"),
                          F.concat(F.lit("<"), "coll_uri", F.lit('> rdfs:label "'), escape_literal("label"),
                                   F.lit('"@en .')).alias("triple"))]
    if scheme:
        lines.append(colls.select("coll_uri", F.lit(2).alias("k"),
                                  F.concat(F.lit("<"), "coll_uri", F.lit(f"> skos:inScheme <{scheme}> .")).alias("triple")))
    lines.append(members.select("coll_uri", F.lit(3).alias("k"),
                                F.concat(F.lit("<"), "coll_uri", F.lit("> skos:member <"), "member", F.lit("> ."))
                                 .alias("triple")).distinct())
    ordered = members.join(colls.where(F.col("type") == "OrderedCollection").select("collection"), "collection",
                           "left_semi")
    num = number_rows(ordered.select("collection", "coll_uri", "member", "ord"), ["collection", "ord", "member"], "i")
    nxt = num.select("collection", (F.col("i") - 1).alias("i"), F.col("i").alias("next_i"))
    linked = num.join(nxt, ["collection", "i"], "left")
    node = F.concat(F.lit("_:l"), F.col("i").cast("string"))
    lines.append(linked.select("coll_uri", F.lit(4).alias("k"),
                               F.concat(node, F.lit(" rdf:first <"), "member", F.lit("> .")).alias("triple")))
    lines.append(linked.select("coll_uri", F.lit(5).alias("k"),
                               F.concat(node, F.lit(" rdf:rest "),
                                        F.coalesce(F.concat(F.lit("_:l"), F.col("next_i").cast("string")),
                                                   F.lit("rdf:nil")), F.lit(" .")).alias("triple")))
    heads = num.groupBy("collection", "coll_uri").agg(F.min("i").alias("i"))
    lines.append(heads.select("coll_uri", F.lit(6).alias("k"),
                              F.concat(F.lit("<"), "coll_uri", F.lit("> skos:memberList _:l"), F.col("i").cast("string"),
                                       F.lit(" .")).alias("triple")))
    return reduce(DataFrame.unionByName, lines)

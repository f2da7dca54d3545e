"""Enriching an existing vocabulary with table rows.

Existing concepts are long literals ``(uri, prop, value, lang, pos, vpos)``;
enrichment rows carry a position column.  Matching is always an equi-join
against a table already reduced to one row per key (first or last by
position), so a popular label or URI never multiplies rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.hierarchy import narrower_lists

LITERAL_PROPS = ["prefLabel", "altLabel", "definition"]
RELATION_PROPS = ["broader", "narrower", "related"]


def _norm_uri(c: str, base: str | None):
    u = F.col(c).cast("string")
    rel = F.concat(F.lit(base.rstrip("/") + "/"), u) if base else F.lit(None).cast("string")
    return F.when(u.startswith("http"), u).otherwise(rel)


def enrich_by_uri(concepts: DataFrame, rows: DataFrame, uri_field: str, base: str | None = None,
                  pos_col: str = "pos") -> DataFrame:
    """Per row the normalised URI and its fate: 'enriched' (known concept), 'added'
    (new concept) or 'skipped' (relative URI and no base)."""
    known = concepts.select(F.col("uri").alias("_k")).distinct()
    r = rows.withColumn("row_uri", _norm_uri(uri_field, base))
    j = r.join(known, r.row_uri == known._k, "left")
    status = (F.when(F.col("row_uri").isNull(), "skipped")
               .when(F.col("_k").isNotNull(), "enriched").otherwise("added"))
    return j.select(F.col(pos_col).alias("row_pos"), "row_uri", status.alias("status"))


def enrich_stats(matches: DataFrame) -> DataFrame:
    """concepts_enriched / concepts_added / rows_skipped counts of ``enrich_by_uri``."""
    return matches.agg(F.count_if(F.col("status") == "enriched").alias("concepts_enriched"),
                       F.count_if(F.col("status") == "added").alias("concepts_added"),
                       F.count_if(F.col("status") == "skipped").alias("rows_skipped"))


def label_index(literals: DataFrame) -> DataFrame:
    """Lower-cased pref and alt labels -> URI; a label used twice goes to the later entry
    (concept position, then pref before alt, then value order)."""
    lab = literals.where(F.col("prop").isin("prefLabel", "altLabel"))
    order = F.struct(F.col("pos"), F.when(F.col("prop") == "prefLabel", 0).otherwise(1), F.col("vpos"))
    return lab.groupBy(F.lower("value").alias("label")).agg(F.max_by("uri", order).alias("uri"))


def enrich_by_label(literals: DataFrame, rows: DataFrame, label_field: str, pos_col: str = "pos") -> DataFrame:
    """Per row the concept whose pref or alt label equals the row label, case-insensitively."""
    idx = label_index(literals)
    r = rows.select(F.col(pos_col).alias("row_pos"), F.lower(F.col(label_field).cast("string")).alias("label"))
    return r.join(idx, "label", "left").select("row_pos", "label", F.col("uri").alias("matched_uri"))


def enrich_by_mapping(literals: DataFrame, rows: DataFrame, field_mapping: dict[str, str],
                      pos_col: str = "pos") -> DataFrame:
    """Per concept the first row (by position) whose mapped fields all equal, case-
    insensitively, one of the concept's values of the mapped property (prefLabel, altLabel
    or uri).  Mappings to absent row columns are skipped.

    Rows are reduced to the first position per combination of mapped values;
    each concept contributes the product of its own value sets (bounded by the
    concept), and the two meet in one equi-join.
    """
    pairs = [(cf, df_) for cf, df_ in field_mapping.items() if df_ in rows.columns]
    concepts = literals.select("uri").distinct()
    if not pairs:
        # every concept matches the first row: one number, attached as a literal
        first = rows.agg(F.min(pos_col)).first()[0]
        return concepts.select("uri", F.lit(first).alias("row_pos"))
    keys = [f"v{i}" for i in range(len(pairs))]
    r = (rows.select(F.col(pos_col).alias("row_pos"),
                     *[F.lower(F.col(f"`{df_}`").cast("string")).alias(k) for k, (_, df_) in zip(keys, pairs)])
             .groupBy(*keys).agg(F.min("row_pos").alias("row_pos")))
    c = concepts
    for k, (cf, _) in zip(keys, pairs):
        if cf == "uri":
            vals = literals.select("uri", F.lower("uri").alias(k)).distinct()
        else:
            vals = literals.where(F.col("prop") == cf).select("uri", F.lower("value").alias(k)).distinct()
        c = c.join(vals, "uri")
    return c.join(r, keys).groupBy("uri").agg(F.min("row_pos").alias("row_pos"))


def add_properties(literals: DataFrame, matched_rows: DataFrame, property_mapping: dict[str, str],
                   lang: str = "de", pos_col: str = "pos", uri_col: str = "concept_uri") -> DataFrame:
    """Statements added to matched concepts: (uri, prop, value, lang, kind).

    Every non-blank cell of a matched row maps to a property (``property_mapping`` or the
    column name).  Labels and definitions are added with ``lang`` unless the concept has
    that value already; broader/narrower/related likewise; any other property keeps the
    value of the last row.
    """
    cols = [c for c in matched_rows.columns if c not in (uri_col, pos_col)]
    long = matched_rows.select(F.col(uri_col).alias("uri"), F.col(pos_col).alias("row_pos"), F.explode(F.array(*[
        F.struct(F.lit(property_mapping.get(c, c)).alias("prop"), F.col(f"`{c}`").cast("string").alias("value"))
        for c in cols])).alias("x")).select("uri", "row_pos", "x.prop", "x.value")
    long = long.where(F.col("value").isNotNull() & (F.trim("value") != ""))
    have = literals.select("uri", "prop", "value").distinct()
    listed = long.where(F.col("prop").isin(*(LITERAL_PROPS + RELATION_PROPS)))
    new = (listed.join(have, ["uri", "prop", "value"], "left_anti").select("uri", "prop", "value").distinct()
                 .select("uri", "prop", "value",
                         F.when(F.col("prop").isin(*LITERAL_PROPS), F.lit(lang)).alias("lang"),
                         F.when(F.col("prop").isin(*LITERAL_PROPS), F.lit("literal")).otherwise(F.lit("relation"))
                          .alias("kind")))
    other = (long.where(~F.col("prop").isin(*(LITERAL_PROPS + RELATION_PROPS)))
                 .groupBy("uri", "prop").agg(F.max_by("value", "row_pos").alias("value"))
                 .select("uri", "prop", "value", F.lit(None).cast("string").alias("lang"), F.lit("other").alias("kind")))
    return new.unionByName(other)


def enrich_vocabulary(literals: DataFrame, rows: DataFrame, uri_field: str, base: str | None = None,
                      property_mapping: dict[str, str] | None = None, lang: str = "de",
                      pos_col: str = "pos") -> DataFrame:
    """J9 + J12: the whole vocabulary after enrichment: (uri, prop, value, lang, kind, origin).

    Statements of the input keep origin 'kept'.  Rows of known concepts add
    theirs with origin 'enriched'.  A URI the vocabulary does not have becomes a
    new concept (origin 'added') from its last row by position.  Rows with a
    relative URI and no base are skipped.
    """
    fate = enrich_by_uri(literals, rows, uri_field, base, pos_col).where(F.col("status") != "skipped")
    # one row per new URI: the last one; known concepts take all their rows
    new = fate.where(F.col("status") == "added").groupBy("row_uri").agg(F.max("row_pos").alias("row_pos"))
    known = fate.where(F.col("status") == "enriched").select("row_uri", "row_pos")
    used = known.withColumn("origin", F.lit("enriched")).unionByName(new.withColumn("origin", F.lit("added")))
    matched = rows.join(used.select(F.col("row_pos").alias(pos_col), F.col("row_uri").alias("concept_uri")), pos_col)
    added = add_properties(literals, matched, property_mapping or {}, lang, pos_col)
    origin = used.select(F.col("row_uri").alias("uri"), "origin").distinct()
    is_rel = F.col("prop").isin(*RELATION_PROPS)
    kept = literals.select("uri", "prop", "value", F.when(~is_rel, F.col("lang")).alias("lang"),
                           F.when(is_rel, "relation").otherwise("literal").alias("kind"), F.lit("kept").alias("origin"))
    return kept.unionByName(added.join(origin, "uri").select("uri", "prop", "value", "lang", "kind", "origin"))


def apply_hierarchy(df: DataFrame, edges: DataFrame, uri_col: str = "id") -> DataFrame:
    """The table with its ``broader`` value and the number of narrower concepts.

    The narrower list itself stays a long table (``narrower_lists``): one
    parent's children can be a large share of the table and are never joined
    into one cell.
    """
    b = edges.groupBy("child").agg(F.max("parent").alias("broader"))
    n = narrower_lists(edges).groupBy("parent").agg(F.max("n_children").alias("n_narrower"))
    return (df.join(b, F.col(uri_col) == b.child, "left").drop("child")
              .join(n, F.col(uri_col) == n.parent, "left").drop("parent")
              .withColumn("n_narrower", F.coalesce("n_narrower", F.lit(0)).cast("long")))

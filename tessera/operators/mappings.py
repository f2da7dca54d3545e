"""Cross-vocabulary mappings (M1-M10) over ``mappings(source_uri, target_uri, mapping_type, confidence)``.

Per-pair checks group by (source, target): the set of mapping types of a
pair has at most six members, so a pair repeated a million times still
aggregates map-side into one small row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import absolute_uri, mapping_type
from tessera.operators.components import connected_components

# Implications of the SKOS mapping properties (reverse direction, type of the new
# statement): symmetric properties imply their reverse, broad/narrowMatch imply each other
# reversed, and exactMatch implies closeMatch (its super-property).
INFERENCE_RULES = [
    ("exactMatch", True, "exactMatch"),
    ("exactMatch", False, "closeMatch"),
    ("closeMatch", True, "closeMatch"),
    ("relatedMatch", True, "relatedMatch"),
    ("broadMatch", True, "narrowMatch"),
    ("narrowMatch", True, "broadMatch"),
]
# The semantic relation each mapping property specialises.
MAPPING_TYPES = ("exactMatch", "closeMatch", "broadMatch", "narrowMatch", "relatedMatch")
SUPER_RELATIONS = [("broadMatch", "broader"), ("narrowMatch", "narrower"), ("relatedMatch", "related")]


def normalise_mappings(df: DataFrame, base: str = "", source_col: str = "source_uri",
                       target_col: str = "target_uri", type_col: str | None = "mapping_type",
                       confidence_col: str | None = "confidence") -> DataFrame:
    """M1: absolute URIs, canonical types (X12), confidence 1.0 when there is no column,
    rows without a source or a target dropped."""
    # a missing end is seen before anything is worked out: a filter on the results would work them out once more for each use
    out = df.where(F.col(source_col).isNotNull() & F.col(target_col).isNotNull())
    out = out.withColumns({c: absolute_uri(c, base) for c in (source_col, target_col)})
    if type_col:
        out = out.withColumn(type_col, mapping_type(type_col))
    if not confidence_col or confidence_col not in out.columns:
        out = out.withColumn("mapping_confidence", F.lit(1.0))
    return out


CONFLICTING = ("broadMatch", "narrowMatch", "relatedMatch")


def _pair_flags(df: DataFrame) -> DataFrame:
    """Per (source, target): rows and which of the four mapping types occur, as flags of fixed size."""
    return df.groupBy("source_uri", "target_uri").agg(
        F.count(F.lit(1)).alias("n"), *[F.bool_or(F.col("mapping_type").eqNullSafe(t)).alias(t) for t in ("exactMatch", *CONFLICTING)])


def _exact_conflict() -> Column:
    return F.expr("exactMatch and (broadMatch or narrowMatch or relatedMatch)")


def _hier_assoc() -> Column:
    return F.expr("(broadMatch or narrowMatch) and relatedMatch")


def mapping_conflicts_exact(df: DataFrame) -> DataFrame:
    """M2: exactMatch together with broadMatch, narrowMatch or relatedMatch on one pair."""
    found = F.concat_ws(", ", *[F.when(F.col(t), F.lit(t)) for t in CONFLICTING])
    return _pair_flags(df).where(_exact_conflict()).select(
        "source_uri", "target_uri", F.lit("exactMatch_conflict").alias("conflict_type"), found.alias("conflicting_types"),
        F.concat(F.lit("exactMatch conflicts with "), found).alias("description"))


def mapping_conflicts_hier_assoc(df: DataFrame) -> DataFrame:
    """M3: a hierarchical (broad/narrowMatch) and an associative (relatedMatch) mapping on one pair."""
    return _pair_flags(df).where(_hier_assoc()).select(
        "source_uri", "target_uri", F.lit("hierarchical_associative_conflict").alias("conflict_type"),
        F.lit("Hierarchical and associative mappings are disjoint").alias("description"))


def mapping_validation(df: DataFrame) -> DataFrame:
    """M4: one row of counts: total, missing ends, self-mappings, distinct ends, conflicts.

    Everything comes from one aggregate over the pairs, so the mappings are read once.
    """
    def rows_where(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    src, dst = F.col("source_uri"), F.col("target_uri")
    return (_pair_flags(df).agg(
        (F.count_if(_exact_conflict()) + F.count_if(_hier_assoc())).alias("conflicts"),
        rows_where(src.isNull()).alias("missing_source_uris"), rows_where(dst.isNull()).alias("missing_target_uris"),
        rows_where(src == dst).alias("self_mappings"), rows_where(F.lit(True)).alias("total_mappings"),
        F.count_distinct(src).alias("unique_source_concepts"), F.count_distinct(dst).alias("unique_target_concepts"))
        .withColumn("is_valid", F.col("conflicts") == 0))


def mapping_type_distribution(df: DataFrame) -> DataFrame:
    """M5: rows per mapping type."""
    return df.groupBy("mapping_type").agg(F.count("*").alias("n"))


def bidirectional_mappings(df: DataFrame) -> DataFrame:
    """M6: unordered pairs {a, b} with a mapping in both directions (a self pair is its own reverse)."""
    p = df.select("source_uri", "target_uri").distinct()
    r = p.select(F.col("target_uri").alias("source_uri"), F.col("source_uri").alias("target_uri"))
    hit = p.join(r, ["source_uri", "target_uri"], "left_semi")
    return hit.select(F.least("source_uri", "target_uri").alias("uri_a"),
                      F.greatest("source_uri", "target_uri").alias("uri_b")).distinct()


def mapping_coverage(df: DataFrame) -> DataFrame:
    """M7: distinct source and target concepts."""
    return df.agg(F.count_distinct("source_uri").alias("source_concepts_with_mappings"),
                  F.count_distinct("target_uri").alias("target_concepts_mapped"))


# The types a statement can have by the rules, and a place for any other one; bits of the masks of a pair.
SLOTS = (*MAPPING_TYPES, *[rel for _, rel in SUPER_RELATIONS], "mappingRelation", "")


def _bit(reverse: bool, slot: str, inferred: bool) -> int:
    return 1 << (SLOTS.index(slot) + len(SLOTS) * (reverse + 2 * inferred))


def _inferred(rows: DataFrame, include_super_relations: bool, mapping_relation: bool) -> DataFrame:
    """``rows`` (source_uri, target_uri, mapping_type, given) and what they imply; a row not ``given`` counts as inferred.

    A rule leads from a pair of concepts to the same pair, in one direction or the other.  So all statements of a
    pair are bits of one number, combined in every task and shuffled once; only the result is exploded.  A type that no rule
    knows implies nothing and makes a group of its own (a missing one has its own bit).
    """
    rules = list(INFERENCE_RULES) + ([(t, False, rel) for t, rel in SUPER_RELATIONS] if include_super_relations else [])
    if mapping_relation:  # each type implies a reverse statement
        rules += [(t, rev, "mappingRelation") for t in MAPPING_TYPES for rev in (False, True)]
    masks = []
    for slot in SLOTS:
        for given in (False, True):
            for reverse in (False, True):
                mask = _bit(reverse, slot, not given)
                for _, rev, new in (r for r in rules if r[0] == slot):
                    mask |= _bit(reverse != rev, new, True)
                masks.append(F.lit(mask).cast("long"))
    n = len(SLOTS)
    src, dst, typ, slot = F.col("source_uri"), F.col("target_uri"), F.col("mapping_type"), F.col("_slot")
    slots = F.create_map(*[F.lit(x) for i, s in enumerate(SLOTS[:-1]) for x in (s, i)])
    x = rows.select(src, dst, typ, F.coalesce(F.try_element_at(slots, typ), F.lit(n - 1)).alias("_slot"), F.col("given").cast("int").alias("_g"),
                    F.coalesce(src > dst, src.isNull() & dst.isNotNull()).alias("_swapped"))  # a missing end goes last
    swapped = F.col("_swapped")
    mask = F.element_at(F.array(*masks), slot * 4 + F.col("_g") * 2 + swapped.cast("int") + 1)
    pairs = x.select(F.when(swapped, dst).otherwise(src).alias("_a"), F.when(swapped, src).otherwise(dst).alias("_b"),
                     F.when(slot == n - 1, typ).alias("_t"), mask.alias("_m"))
    pairs = pairs.groupBy("_a", "_b", "_t").agg(F.bit_or("_m").alias("_m"))

    low, half = F.lit((1 << 2 * n) - 1), F.lit((1 << n) - 1)

    def folded(m: Column) -> Column:
        """2n bits (reverse, slot); a self pair is its own reverse."""
        return F.when(F.col("_a") == F.col("_b"), m.bitwiseOR(F.shiftright(m, n)).bitwiseAND(half)).otherwise(m)
    x = pairs.select("_a", "_b", "_t", folded(F.col("_m").bitwiseAND(low)).alias("_given"),
                     folded(F.col("_m").bitwiseOR(F.shiftright("_m", 2 * n)).bitwiseAND(low)).alias("_there"))
    # every place and a filter after it: both are compiled, a filter inside an array is not
    places = F.array(*[F.struct(F.lit(1 << reverse * n + i).cast("long").alias("bit"), F.lit(bool(reverse)).alias("reverse"),
                                F.lit(s).alias("type"), F.lit(i == n - 1).alias("other")) for reverse in range(2) for i, s in enumerate(SLOTS)])
    x = x.select("_a", "_b", "_t", "_given", "_there", F.explode(places).alias("_p")).where(F.col("_there").bitwiseAND(F.col("_p.bit")) != 0)
    rev = F.col("_p.reverse")
    return x.select(F.when(rev, F.col("_b")).otherwise(F.col("_a")).alias("source_uri"), F.when(rev, F.col("_a")).otherwise(F.col("_b")).alias("target_uri"),
                    F.when(F.col("_p.other"), F.col("_t")).otherwise(F.col("_p.type")).alias("mapping_type"),
                    (F.col("_given").bitwiseAND(F.col("_p.bit")) == 0).alias("inferred"))


def mapping_inference(df: DataFrame, include_super_relations: bool = True, mapping_relation: bool = False) -> DataFrame:
    """M8: the stated mappings plus every statement the fixed rule table implies, distinct.

    ``mapping_relation`` adds the super-property of all mapping types.
    """
    rows = df.select("source_uri", "target_uri", "mapping_type", F.lit(True).alias("given"))
    return _inferred(rows, include_super_relations, mapping_relation)


def mapping_inference_closed(df: DataFrame) -> DataFrame:
    """M8 with transitivity: ``mapping_inference`` over the stated mappings and the closure of exactMatch as a star per cluster.

    Of a cluster of n concepts only the 2 (n - 1) statements with its representative are written, not its n (n - 1) pairs;
    two concepts match exactly where ``exact_match_clusters`` gives them the same cluster.  Both are inferred from in one pass.
    """
    stated = df.select("source_uri", "target_uri", "mapping_type")
    members = exact_match_clusters(stated).where("uri <> cluster")
    ends = F.array(F.struct(F.col("uri").alias("a"), F.col("cluster").alias("b")), F.struct(F.col("cluster").alias("a"), F.col("uri").alias("b")))
    star = members.select(F.explode(ends).alias("x")).select(F.col("x.a").alias("source_uri"), F.col("x.b").alias("target_uri"),
                                                            F.lit("exactMatch").alias("mapping_type"))
    return _inferred(stated.withColumn("given", F.lit(True)).unionByName(star.withColumn("given", F.lit(False))), True, True)


def exact_match_clusters(df: DataFrame) -> DataFrame:
    """M9: connected components of exactMatch (symmetric and transitive): (uri, cluster).

    The cluster is named by its smallest URI; mappings without a target name no cluster.
    """
    pairs = df.where(F.col("mapping_type") == "exactMatch").select("source_uri", "target_uri")
    found = connected_components(pairs, "source_uri", "target_uri")
    return found.select(F.col("node").alias("uri"), F.col("component").alias("cluster"))


def mapping_triples(df: DataFrame, scheme: str = "") -> DataFrame:
    """The mappings as triples: per source one type (and scheme) line, per mapping one line.

    The same graph as a block per source, but a source with many mappings is
    never gathered into one row.
    """
    heads = df.select("source_uri").distinct()
    lines = [heads.select("source_uri", F.lit(0).alias("k"),
                          F.concat(F.lit("<"), F.col("source_uri"), F.lit("> rdf:type skos:Concept .")).alias("triple"))]
    if scheme:
        lines.append(heads.select("source_uri", F.lit(1).alias("k"),
                                  F.concat(F.lit("<"), F.col("source_uri"), F.lit(f"> skos:inScheme <{scheme}> ."))
                                   .alias("triple")))
    lines.append(df.where(F.col("target_uri").isNotNull()).select(
        "source_uri", F.lit(2).alias("k"),
        F.concat(F.lit("<"), F.col("source_uri"), F.lit("> skos:"), F.coalesce(F.col("mapping_type"), F.lit("closeMatch")),
                 F.lit(" <"), F.col("target_uri"), F.lit("> .")).alias("triple")))
    return reduce(DataFrame.unionByName, lines)

"""Schema matching over a data-lake catalogue ``(dataset, ordinal, colname, sample)`` (K1-K7).

The pattern tables are fixed and small, so every matcher evaluates them as a
literal array inside one projection per catalogue row: no join with a
pattern table and no per-column loop on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import settled

# Keyword patterns of the field-mapping fallback, per SKOS property, in order.
KEYWORD_PATTERNS = [
    ("uri", ["id", "uri", "identifier", "uuid", "key", "schlüssel", "code", "nummer", "kennung", "node-uuid",
             "sys:node-uuid", "properties.sys:node-uuid"]),
    ("prefLabel", ["title", "name", "label", "term", "bezeichnung", "titel", "benennung", "cclom:title", "cm:name",
                   "properties.cclom:title", "properties.cm:name"]),
    ("definition", ["description", "definition", "desc", "note", "beschreibung", "erklärung", "inhalt", "text",
                    "general_description", "cclom:general_description", "properties.cclom:general_description"]),
    ("altLabel", ["alt", "alternative", "synonym", "alias", "alternativ", "andere", "altlabel"]),
    ("broader", ["parent", "broader", "super", "category", "oberbegriff", "kategorie", "gruppe", "level"]),
    ("narrower", ["child", "narrower", "sub", "subcategory", "unterbegriff", "untergruppe"]),
    ("notation", ["code", "notation", "number", "nr", "nummer", "kode", "zeichen"]),
    ("example", ["example", "beispiel", "sample", "muster"]),
    ("scopeNote", ["scope", "anwendung", "usage", "verwendung"]),
    ("note", ["note", "notiz", "bemerkung", "comment", "kommentar"]),
]

# Exact lower-case column names per role, first pattern wins.
ROLE_PATTERNS = [
    ("level", ["level", "depth", "tier", "ebene", "stufe", "hierarchy_level", "classification_level",
               "taxonomic_level", "rang"]),
    ("parent", ["parent", "parentid", "parent_id", "broader", "broaderid", "broader_id", "super", "superid",
                "category", "categoryid", "übergeordnet", "parent_code", "parent_key"]),
    ("path", ["path", "hierarchy_path", "classification_path", "breadcrumb", "pfad", "hierarchie_pfad"]),
    ("id", ["id", "uri", "concept_id", "conceptid", "identifier", "code", "key", "schlüssel", "uuid",
            "concept_uri", "iri"]),
    ("mapping_source", ["uri", "concepturi", "concept_uri", "id", "identifier", "url"]),
    ("mapping_target", ["target_uri", "target_concept", "mapped_uri", "equivalent_uri"]),
    ("mapping_type", ["mapping_type", "relation_type", "match_type"]),
    ("mapping_confidence", ["confidence", "score", "certainty", "strength"]),
    ("collection", ["collection", "group", "category", "theme", "cluster"]),
    ("member", ["member", "concept", "item", "element"]),
    ("order", ["order", "position", "sequence", "rank", "index"]),
    ("label", ["label", "title", "name", "description"]),
]

# Documentation column patterns (substring match) per documentation type.
DOC_PATTERNS = [
    ("note", ["note", "notes", "comment", "comments", "remark"]),
    ("definition", ["definition", "def", "meaning", "explanation"]),
    ("example", ["example", "examples", "sample", "instance"]),
    ("scopeNote", ["scope", "scopenote", "scope_note", "application", "usage"]),
    ("changeNote", ["change", "changenote", "change_note", "modification", "update"]),
    ("editorialNote", ["editorial", "editorialnote", "editorial_note", "editor_note"]),
    ("historyNote", ["history", "historynote", "history_note", "background"]),
]

# Language indicators in column names.
LANGUAGE_PATTERNS = [
    ("de", ["deutsch", "german", "de", "ger"]),
    ("en", ["english", "eng", "en"]),
    ("fr", ["french", "français", "fr", "fra"]),
    ("es", ["spanish", "español", "es", "spa"]),
    ("it", ["italian", "italiano", "it", "ita"]),
]

# Colname names that mark a primary source (id and label) or a hierarchy source.
PRIMARY_ID = ["uri", "id", "concepturi", "identifier"]
PRIMARY_LABEL = ["label", "name", "title", "preflabel"]
HIERARCHY_COLS = ["parent", "broader", "parentid", "level"]


def _flat(patterns):
    out = []
    for prop, kws in patterns:
        for kw in kws:
            out.append((prop, kw, len(out)))
    return out


def _patterns(patterns, key: str = "prop") -> F.Column:
    """The fixed pattern list as one constant array of (key, kw, rank) structs."""
    return F.array(*[F.struct(F.lit(p).alias(key), F.lit(kw).alias("kw"), F.lit(i).alias("rank"))
                     for p, kw, i in _flat(patterns)])


def keyword_field_match(catalog: DataFrame, threshold: float = 0.3) -> DataFrame:
    """K1: per column the property of the best keyword contained in the lower-cased name:
    score = len(keyword) / len(name), + 0.5 for equality; first best in pattern order; kept
    above ``threshold``.

    Each catalogue row is paired with the constant pattern array (a generator,
    not a join) and the best candidate is a grouped ``max_by``.
    """
    low = F.lower("colname")
    x = (catalog.select("dataset", "colname", low.alias("low"), F.explode(_patterns(KEYWORD_PATTERNS)).alias("p"))
                .where(F.col("low").contains(F.col("p.kw")))
                .select("dataset", "colname", F.col("p.prop").alias("prop"), F.col("p.rank").alias("rank"),
                        (F.length("p.kw") / F.length("low")
                         + F.when(F.col("low") == F.col("p.kw"), 0.5).otherwise(0.0)).alias("score")))
    best = x.groupBy("dataset", "colname").agg(
        F.max_by("prop", F.struct(F.col("score"), -F.col("rank"))).alias("prop"), F.max("score").alias("score"))
    return best.where(F.col("score") > threshold).select("dataset", "colname", "prop",
                                                         F.round("score", 6).alias("score"))


def field_role_match(catalog: DataFrame, with_id_fallback: bool = True) -> DataFrame:
    """K2: per dataset and role the column whose lower-case name equals the earliest pattern
    (the first such column); a dataset without an id pattern falls back to its first column."""
    h = (catalog.select("dataset", "ordinal", "colname", F.lower("colname").alias("low"),
                        F.explode(_patterns(ROLE_PATTERNS, "role")).alias("p"))
                .where(F.col("low") == F.col("p.kw")))
    best = (h.groupBy("dataset", F.col("p.role").alias("role"))
             .agg(F.min_by("colname", F.struct(F.col("p.rank"), F.col("ordinal"))).alias("colname")))
    if not with_id_fallback:
        return best
    first = catalog.groupBy("dataset").agg(F.min_by("colname", "ordinal").alias("colname"))
    has_id = best.where(F.col("role") == "id").select("dataset")
    fb = first.join(has_id, "dataset", "left_anti").select("dataset", F.lit("id").alias("role"), "colname")
    return best.unionByName(fb)


def doc_field_match(catalog: DataFrame) -> DataFrame:
    """K3: columns whose lower-case name contains a documentation pattern, with the first
    language whose indicator is a word of the rest of the name (without the pattern)."""
    h = (catalog.select("dataset", "ordinal", "colname", F.lower("colname").alias("low"),
                        F.explode(_patterns(DOC_PATTERNS, "doc_type")).alias("p"))
                .where(F.col("low").contains(F.col("p.kw"))))
    first = h.groupBy("dataset", "ordinal", "colname", "low", F.col("p.doc_type").alias("doc_type")).agg(
        F.min_by("p.kw", "p.rank").alias("pattern"), F.min("p.rank").alias("rank"))
    # indicators are matched as whole words of the rest of the name
    words = F.split(F.replace(F.col("low"), F.col("pattern"), F.lit(" ")), r"[^\p{L}]+")
    langs = F.filter(F.array(*[F.when(F.array_contains(words, ind), F.lit(lang)) for lang, ind, _ in
                               _flat(LANGUAGE_PATTERNS)]), lambda x: x.isNotNull())
    return first.select("dataset", "doc_type", "colname", "pattern", "rank",
                        F.coalesce(F.try_element_at(langs, F.lit(1)), F.lit("en")).alias("lang"))


def dataset_overlap(catalog: DataFrame, threshold: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """K4: (pairs, summary): Jaccard of the column-name sets of every two datasets, and its mean
    over all dataset pairs (pairs sharing nothing count as 0) with the scenario
    'distributed' above 0.3 else 'complete'.

    Datasets with the same column names are one class, named by its smallest
    dataset and weighted by their number, so a thousand exports of one table
    cost as much as one.  ``pairs`` has the class pairs above ``threshold``; the
    mean is exact over all datasets.
    """
    cols = catalog.select("dataset", F.lower("colname").alias("c")).distinct()
    sets = cols.groupBy("dataset").agg(F.sort_array(F.collect_set("c")).alias("cs"))  # bounded by one dataset's columns
    classes = sets.groupBy("cs").agg(F.min("dataset").alias("ds"), F.count(F.lit(1)).alias("w")).select(
        "ds", "w", F.size("cs").alias("n"), "cs")
    member = classes.select("ds", "w", "n", F.explode("cs").alias("c"))
    a, b = member.alias("a"), member.alias("b")
    inter = (a.join(b, (F.col("a.c") == F.col("b.c")) & (F.col("a.ds") < F.col("b.ds")))
              .groupBy(F.col("a.ds").alias("ds_a"), F.col("b.ds").alias("ds_b"), F.col("a.w").alias("n_a"), F.col("b.w").alias("n_b"),
                       (F.col("a.n") + F.col("b.n")).alias("both")).agg(F.count(F.lit(1)).alias("overlap")))
    pairs = inter.withColumn("j", F.col("overlap") / (F.col("both") - F.col("overlap")))
    inside = classes.agg(F.sum(F.col("w") * (F.col("w") - 1) / 2).alias("s"), F.sum("w").alias("d"))
    across = pairs.agg(F.sum(F.col("j") * F.col("n_a") * F.col("n_b")).alias("s")).select("s", F.lit(None).cast("long").alias("d"))
    total = inside.unionByName(across).agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"), F.coalesce(F.max("d"), F.lit(0)).alias("d"))
    mean = F.col("s") / F.greatest(F.col("d") * (F.col("d") - 1) / 2, F.lit(1.0))
    summary = total.select(F.col("d").alias("datasets"), F.round(mean, 6).alias("avg_overlap"),
                           F.when(mean > 0.3, "distributed").otherwise("complete").alias("scenario"))
    return (pairs.where(F.col("j") > threshold)
            .select("ds_a", "ds_b", "n_a", "n_b", "overlap", F.round("j", 6).alias("jaccard")), summary)


def assign_roles(catalog: DataFrame, scenario: str = "distributed") -> DataFrame:
    """K5: per dataset 'primary' (an id and a label colname), 'hierarchy' (a parent-like
    colname) or 'secondary'; in the complete-records scenario every dataset is primary."""
    low = F.lower("colname")
    g = catalog.groupBy("dataset").agg(F.bool_or(low.isin(*PRIMARY_ID)).alias("has_id"),
                                       F.bool_or(low.isin(*PRIMARY_LABEL)).alias("has_label"),
                                       F.bool_or(low.isin(*HIERARCHY_COLS)).alias("has_parent"))
    if scenario != "distributed":
        return g.select("dataset", F.lit("primary").alias("role"))
    role = (F.when(F.col("has_id") & F.col("has_label"), "primary")
             .when(F.col("has_parent"), "hierarchy").otherwise("secondary"))
    return g.select("dataset", role.alias("role"))


def hierarchy_signals(catalog: DataFrame) -> DataFrame:
    """K7: (dataset, signal, colname): level-like and parent-like columns, and the first
    colname (by ordinal) whose sample is a dotted numeric code such as 1.2.3."""
    low = F.lower("colname")
    level = catalog.where(low.contains("level") | low.contains("ebene")).select(
        "dataset", F.lit("level").alias("signal"), "colname")
    parent = catalog.where(low.contains("parent") | low.contains("broader") | low.contains("übergeordnet")).select(
        "dataset", F.lit("parent").alias("signal"), "colname")
    dotted = F.col("sample").contains(".") & F.col("sample").rlike(r"^[0-9.]*[0-9][0-9.]*$")
    codes = (catalog.where(dotted).groupBy("dataset").agg(F.min_by("colname", "ordinal").alias("colname"))
                    .select("dataset", F.lit("dotted_codes").alias("signal"), "colname"))
    return reduce(DataFrame.unionByName, [level, parent, codes])


# ---------------------------------------------------------------- K6
def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(v, lambda x: x / norm)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


#: Property vectors of one block, and up to how many the blocks are broadcast (else joined by a shuffle).
PROPS_PER_BLOCK, BROADCAST_PROPS = 128, 4096


def property_vectors(vectors: DataFrame, group_col: str, vec_col: str) -> DataFrame:
    """(prop, c, m) per property group: the centroid and the mean of unit vectors (dimension-wise averages)."""
    v = vectors.select(F.col(group_col).cast("string").alias("prop"), F.col(vec_col).cast("array<double>").alias("v"))
    v = v.withColumn("u", _unit(F.col("v")))
    e = v.select("prop", F.posexplode(F.arrays_zip("v", "u")).alias("i", "x"))
    per = e.groupBy("prop", "i").agg(F.avg("x.v").alias("c"), F.avg("x.u").alias("m"))
    agg = per.groupBy("prop").agg(F.array_sort(F.collect_list(F.struct("i", "c", "m"))).alias("xs"))
    return agg.select("prop", F.transform("xs", lambda x: x["c"]).alias("c"), F.transform("xs", lambda x: x["m"]).alias("m"))


def vector_field_match(props: DataFrame, fields: DataFrame, field_col: str, order_col: str, vec_col: str,
                       scoring: str = "single", threshold: float = 0.3) -> DataFrame:
    """K6: per property the field with the highest cosine, kept above ``threshold``.

    ``scoring``: 'single' = cosine(centroid, field vector); 'mean' = mean cosine over all pairs
    of property and field vectors, which equals dot(mean unit vector, unit field vector).  Ties
    go to the earlier field.  Properties are packed into blocks of bounded size; every field
    meets every block by its number, and the best field is a partial aggregate.
    """
    unit = F.col("c") if scoring == "single" else F.col("m")
    p = settled(props.select("prop", (_unit(unit) if scoring == "single" else unit).alias("v")))  # counted and joined
    n = p.count()
    blocks = max(1, -(-n // PROPS_PER_BLOCK))
    packed = p.groupBy(F.pmod(F.xxhash64("prop"), F.lit(blocks)).cast("int").alias("b")).agg(
        F.collect_list(F.struct("prop", "v")).alias("ps"))
    f = fields.select(F.col(field_col).alias("field"), F.col(order_col).alias("o"),
                      _unit(F.col(vec_col).cast("array<double>")).alias("u"),
                      F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    j = f.join(F.broadcast(packed) if n <= BROADCAST_PROPS else packed, "b")
    s = j.select("field", "o", F.explode(F.transform("ps", lambda x: F.struct(
        x["prop"].alias("prop"), _dot(x["v"], F.col("u")).alias("score")))).alias("s"))
    best = s.groupBy(F.col("s.prop").alias("prop")).agg(
        F.max_by("field", F.struct(F.col("s.score"), -F.col("o"))).alias("best_field"), F.max("s.score").alias("score"))
    return best.where(F.col("score") > threshold).select("prop", F.lit(scoring).alias("scoring"), "best_field",
                                                         F.round("score", 6).alias("score"))

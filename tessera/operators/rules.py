"""SKOS integrity rules; each emits ``issues(uri, rule, severity, detail)``.

Every rule is a grouped aggregate or an equi-join on the long tables
``literals(uri, prop, text, lang, ...)`` and ``relations(uri, prop, target, ...)``;
nothing loops over concepts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import MOJIBAKE_MARKERS, is_valid_lang, is_valid_uri

ISSUE_COLS = ["uri", "rule", "severity", "detail"]


def _issue(df: DataFrame, uri: Column, rule: str, severity: str, detail: Column) -> DataFrame:
    return df.select(uri.alias("uri"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
                     detail.alias("detail"))


def rule_s14(literals: DataFrame) -> DataFrame:
    """More than one prefLabel for one language tag of a concept."""
    g = (literals.where(F.col("prop") == "prefLabel").groupBy("uri", "lang")
                 .agg(F.count("*").alias("n")).where(F.col("n") > 1))
    return _issue(g, F.col("uri"), "S14", "violation",
                  F.format_string("S14 Violation: <%s> has %d prefLabels for language '%s'", "uri", "n", "lang"))


def rule_s13(literals: DataFrame) -> DataFrame:
    """R2: prefLabel/altLabel, prefLabel/hiddenLabel or altLabel/hiddenLabel share a (text, lang).

    One violation per concept and pair of kinds, naming how many labels are shared and the first
    of them.  Both aggregates combine flags, counts and a minimum in every task.
    """
    kinds = ("prefLabel", "altLabel", "hiddenLabel")
    g = (literals.where(F.col("prop").isin(*kinds)).groupBy("uri", "text", "lang")
                 .agg(*[F.bool_or(F.col("prop") == k).alias(k) for k in kinds]))
    pairs = F.array(*[F.when(F.col(a) & F.col(b), F.lit(f"{a}/{b}"))
                      for a, b in (("prefLabel", "altLabel"), ("prefLabel", "hiddenLabel"), ("altLabel", "hiddenLabel"))])
    hit = g.select("uri", F.concat_ws("\u0001", "text", "lang").alias("label"),
                   F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("pair"))
    per = hit.groupBy("uri", "pair").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("first"))
    return _issue(per, F.col("uri"), "S13", "violation",
                  F.format_string('S13 Violation: <%s> has %d overlapping %s, first "%s"@%s', "uri", "n", "pair",
                                  F.substring_index("first", "\u0001", 1), F.substring_index("first", "\u0001", -1)))


def rule_s27(relations: DataFrame) -> DataFrame:
    """Skos:broader and skos:related to the same target."""
    b = relations.where(F.col("prop") == "broader").select("uri", "target").distinct()
    r = relations.where(F.col("prop") == "related").select("uri", "target").distinct()
    hit = b.join(r, ["uri", "target"], "left_semi")
    return _issue(hit, F.col("uri"), "S27", "violation",
                  F.format_string("S27 Violation: <%s> has both skos:broader and skos:related to <%s>",
                                  "uri", "target"))


def rule_mutual_broader(relations: DataFrame) -> DataFrame:
    """Warning for two concepts that are each other's broader (self loops included)."""
    b = relations.where(F.col("prop") == "broader").select("uri", "target").distinct()
    rev = b.select(F.col("target").alias("uri"), F.col("uri").alias("target"))
    hit = b.join(rev, ["uri", "target"], "left_semi")
    return _issue(hit, F.col("uri"), "mutual_broader", "warning",
                  F.format_string("Simple cycle detected: <%s> and <%s> are mutually broader", "uri", "target"))


def rule_label_quality(literals: DataFrame) -> DataFrame:
    """Labels longer than 500 characters, empty, with mis-decoded characters, or URI-like.

    All four checks run in one pass; a label can raise several.
    """
    lab = literals.where(F.col("prop").isin("prefLabel", "altLabel"))
    t = F.coalesce(F.col("text"), F.lit(""))
    checks = [
        ("long_label", F.length(t) > 500, F.format_string("Very long label (%d chars) in <%s>", F.length(t), "uri")),
        ("empty_label", t == "", F.format_string("Empty label in <%s>", "uri")),
        ("encoding", reduce(lambda a, b: a | b, [t.contains(m) for m in MOJIBAKE_MARKERS]),
         F.format_string("Potential encoding issue in <%s>", "uri")),
        ("uri_label", F.lower(t).startswith("http://") | F.lower(t).startswith("https://"),
         F.format_string("Label looks like URI in <%s>", "uri")),
    ]
    found = F.filter(F.array(*[F.when(cond, F.struct(F.lit(rule).alias("rule"), detail.alias("detail")))
                               for rule, cond, detail in checks]), lambda x: x.isNotNull())
    hit = lab.select("uri", F.explode(found).alias("x"))
    return hit.select("uri", F.col("x.rule").alias("rule"), F.lit("warning").alias("severity"),
                      F.col("x.detail").alias("detail"))


def rule_uri_lang(concepts: DataFrame, literals: DataFrame) -> DataFrame:
    """Concept URIs without scheme and host (violation); bad language tags on labels (warning)."""
    bad_uri = concepts.where(~is_valid_uri("uri"))
    v = _issue(bad_uri, F.col("uri"), "invalid_uri", "violation",
               F.format_string("Invalid URI format: %s", "uri"))
    lab = literals.where(F.col("prop").isin("prefLabel", "altLabel") & F.col("lang").isNotNull()
                         & (F.col("lang") != "") & ~is_valid_lang("lang"))
    w = _issue(lab, F.col("uri"), "invalid_lang", "warning",
               F.format_string("Potentially invalid language tag '%s' in %s", "lang", "uri"))
    return v.unionByName(w)


def rule_skosxl(concepts: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conflicts, orphans).

    conflicts: an xl label URI (skosxl:prefLabel/altLabel/hiddenLabel target)
    that is also a concept URI.  orphans: a resource with skosxl:literalForm
    that no xl label statement references.
    """
    xl = relations.where(F.col("prop").isin("xlPrefLabel", "xlAltLabel", "xlHiddenLabel"))
    cu = concepts.select(F.col("uri").alias("cu")).distinct()
    conflict = xl.join(cu, xl.target == cu.cu, "left_semi")
    c = _issue(conflict, F.col("uri"), "skosxl_conflict", "warning",
               F.format_string("SKOS-XL label URI <%s> conflicts with concept URI in <%s>", "target", "uri"))
    forms = relations.where(F.col("prop") == "literalForm").select("uri").distinct()
    refd = xl.select(F.col("target").alias("t")).distinct()
    orphan = forms.join(refd, forms.uri == refd.t, "left_anti")
    o = _issue(orphan, F.col("uri"), "skosxl_orphan", "warning",
               F.format_string("Orphaned SKOS-XL label <%s> not referenced by any concept", "uri"))
    return c, o


def all_issues(concepts: DataFrame, literals: DataFrame, relations: DataFrame | None = None,
               skos_xl: bool = False) -> DataFrame:
    """Every rule over one vocabulary, as one issues table."""
    parts = [rule_s14(literals), rule_s13(literals), rule_label_quality(literals),
             rule_uri_lang(concepts, literals)]
    if relations is not None:
        parts += [rule_s27(relations), rule_mutual_broader(relations)]
        if skos_xl:
            parts += list(rule_skosxl(concepts, relations))
    return reduce(DataFrame.unionByName, parts)

"""The vocabulary cleaning job: clean literals and URIs, drop unlabelled and
duplicate concepts, run the rules, count what changed (C6, C7, R7).

Inputs are long tables keyed by the concept block position ``pos``:
``concepts(raw_uri, pos)``, ``literals(pos, prop, vpos, text, lang)`` and
optionally ``relations(pos, prop, vpos, target)``.  All steps are joins and
aggregates on those keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import clean_label, clean_text, clean_uri, fix_mojibake, space_after_punctuation
from tessera.operators.rules import all_issues
from tessera.session import checkpoint_dir

# Property groups of the cleaner.
LABEL_PROPS = ["prefLabel", "altLabel", "hiddenLabel"]
NOTE_PROPS = ["note", "scopeNote", "editorialNote", "historyNote", "changeNote"]
TEXT_PROPS = ["definition", "example"] + NOTE_PROPS


COUNTERS = ["total_concepts", "duplicates_removed", "malformed_uris_fixed", "concepts_without_preflabel",
            "encoding_issues_fixed", "empty_labels_removed", "text_fields_cleaned", "comma_fixes",
            "labels_processed", "definitions_processed", "notes_processed", "final_concepts",
            "invalid_concepts_removed", "violations", "warnings"]


def clean_literals(literals: DataFrame) -> DataFrame:
    """Add ``clean`` (X4 for labels, X5 for text fields) and change flags.

    The cleaned value is bound once inside a lambda and every flag is derived
    from that binding, so the regular-expression chain runs once per literal
    however the optimizer merges the projections.
    """
    is_label = F.col("prop").isin(*LABEL_PROPS)
    clean = F.when(is_label, clean_label("text")).otherwise(clean_text("text"))
    text = F.col("text")
    bound = F.transform(F.array(clean), lambda x: F.struct(
        x.alias("clean"),
        (F.when(is_label, fix_mojibake(text) != text).otherwise(~x.eqNullSafe(text)) & (text != ""))
        .alias("encoding_fixed"),
        (x.isNull() & (text != "")).alias("emptied")))
    return (literals.withColumn("_b", F.element_at(bound, 1))
                    .select(*literals.columns, "_b.clean", "_b.encoding_fixed", "_b.emptied"))


def dedupe_concepts(concepts: DataFrame, uri_col: str = "uri") -> tuple[DataFrame, DataFrame]:
    """First concept block per URI, and a change-log row for each later one.

    The kept row is a ``min_by`` aggregate; the removed rows are an anti-join
    on the unique (uri, pos) pair, so a URI repeated in a third of the blocks
    is still spread over all tasks.
    """
    cols = [c for c in concepts.columns if c != uri_col]
    kept = (concepts.groupBy(uri_col).agg(F.min_by(F.struct(*cols), "pos").alias("r"))
                    .select(uri_col, *[F.col("r")[c].alias(c) for c in cols]))
    removed = concepts.join(kept.select(uri_col, "pos"), [uri_col, "pos"], "left_anti")
    changes = removed.select(uri_col, "pos", F.lit("duplicate_removed").alias("action"),
                             F.concat(F.lit("Duplicate removed: "), F.col(uri_col)).alias("detail"))
    return kept, changes


def merge_duplicate_concepts(literals: DataFrame) -> DataFrame:
    """Per URI the distinct (prop, text, lang) labels of all its blocks."""
    return (literals.where(F.col("prop").isin("prefLabel", "altLabel"))
                    .select("uri", "prop", "text", "lang").distinct())


def clean_vocabulary(concepts: DataFrame, literals: DataFrame, relations: DataFrame | None = None,
                     base: str | None = None, skos_xl: bool = False) -> dict[str, DataFrame]:
    """Flow B end to end; returns kept concepts, written literals, changes, issues and counters.

    Labels are cleaned once and checkpointed (they feed the labelled test, every
    rule and the counters); text fields are cleaned once, for the written
    literals and the counters.  The rules see the cleaned labels; labels get
    their punctuation spacing when they are written (text fields have it already).
    """
    checkpoint_dir(concepts.sparkSession)
    c = concepts.withColumn("uri", clean_uri("raw_uri", base))
    is_label = F.coalesce(F.col("prop").isin(*LABEL_PROPS), F.lit(False))
    lab = clean_literals(literals.where(is_label)).checkpoint()
    txt = clean_literals(literals.where(~is_label))
    labelled = lab.where((F.col("prop") == "prefLabel") & F.col("clean").isNotNull()).select("pos").distinct()
    c_lab = c.join(labelled, "pos", "left_semi")
    kept, changes = dedupe_concepts(c_lab.select("uri", "raw_uri", "pos"))
    kept = kept.checkpoint()
    keys = kept.select("pos", "uri")

    def final(df: DataFrame) -> DataFrame:
        return (df.where(F.col("clean").isNotNull()).join(keys, "pos")
                  .select("uri", "pos", "prop", "vpos", F.col("clean").alias("text"), "lang"))

    labels = final(lab)
    written = labels.withColumn("text", space_after_punctuation("text")).unionByName(final(txt))
    rel = None
    if relations is not None:
        rel = relations.join(keys, "pos").select("uri", "pos", "prop", "vpos", "target")
    issues = all_issues(kept, labels, rel, skos_xl)
    return {"concepts": kept, "literals": written, "changes": changes, "issues": issues,
            "report": clean_report(c, lab.unionByName(txt), c_lab, kept, issues)}


def clean_report(concepts: DataFrame, cleaned_literals: DataFrame, labelled: DataFrame,
                 kept: DataFrame, issues: DataFrame) -> DataFrame:
    """The 13 cleaner counters plus violation and warning totals, as (counter, value) rows.

    Repairs and removals count over every literal read; labels, definitions, notes, text fields
    and punctuation fixes count over the literals written, those of the kept concepts.
    final_concepts = total - duplicates removed - concepts without prefLabel.
    """
    is_label = F.col("prop").isin(*LABEL_PROPS)
    lit = cleaned_literals.join(kept.select("pos", F.lit(True).alias("_kept")), "pos", "left")
    out = F.coalesce("_kept", F.lit(False)) & F.col("clean").isNotNull()
    parts = [
        concepts.agg(F.count("*").alias("total_concepts"),
                     F.count_if(F.col("uri") != F.col("raw_uri")).alias("malformed_uris_fixed")),
        lit.agg(F.count_if("encoding_fixed").alias("encoding_issues_fixed"),
                F.count_if("emptied").alias("empty_labels_removed"),
                F.count_if(out & ~is_label).alias("text_fields_cleaned"),
                F.count_if(out & is_label & (space_after_punctuation("clean") != F.col("clean"))).alias("comma_fixes"),
                F.count_if(out & is_label).alias("labels_processed"),
                F.count_if(out & (F.col("prop") == "definition")).alias("definitions_processed"),
                F.count_if(out & F.col("prop").isin(*NOTE_PROPS)).alias("notes_processed")),
        labelled.agg(F.count("*").alias("labelled")),
        kept.agg(F.count("*").alias("kept")),
        issues.agg(F.count_if(F.col("severity") == "violation").alias("violations"),
                   F.count_if(F.col("severity") == "warning").alias("warnings")),
    ]
    names = [c for p in parts for c in p.columns]
    long = reduce(DataFrame.unionByName, [
        p.select(F.explode(F.create_map(*[x for c in p.columns for x in (F.lit(c), F.col(c).cast("long"))]))
                 .alias("counter", "value")) for p in parts])
    wide = long.agg(*[F.max(F.when(F.col("counter") == c, F.col("value"))).alias(c) for c in names])
    derived = wide.select(
        *[F.col(c) for c in names if c not in ("labelled", "kept")],
        (F.col("labelled") - F.col("kept")).alias("duplicates_removed"),
        (F.col("total_concepts") - F.col("labelled")).alias("concepts_without_preflabel"),
        F.col("kept").alias("final_concepts"),
        (F.col("total_concepts") - F.col("labelled")).alias("invalid_concepts_removed"))
    return derived.select(F.explode(F.create_map(*[x for c in COUNTERS for x in (F.lit(c), F.col(c))]))
                          .alias("counter", "value"))

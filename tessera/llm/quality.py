"""Quality rules with adaptive thresholds, with built-in functions only.

Every document gets counts of words, symbols, shouts, capitals, repeated lines
and repeated three-word windows.  The rates derived from them are summarised by KLL
quantile sketches per (language, source).  Sketches are merged upwards per
language and over all documents, and a group takes its thresholds from the
finest level with at least ``min_rows`` rows.

A threshold is an outer fence of the group's own distribution: its ``OUTER``
quantile, carried on by ``STRETCH`` times its distance from the median; rates
that say something in both directions (word length, capitals) have a lower
fence from the opposite quantile as well.  No threshold is a fixed rate.  A
document is rejected where its count leaves the fence by more than ``NOISE``
standard deviations of a count with that mean (one, if the mean is below one),
so short documents are not rejected for a single symbol.  A kind of junk that
makes up more than a tenth of a group is part of what the group calls usual.

Sketches have a fixed size whatever the number of rows; only sketches are
shuffled, never texts or rates, and the table of thresholds is broadcast only
below ``BROADCAST_GROUPS`` groups.

Defined cases: a null or empty text has no words and fails the base rule; null
languages and sources are groups of their own; very long texts are counted
whole; repeated rows are each judged; an empty table gives an empty result;
other columns are ignored, whatever their names.  Three-word windows are
compared by a 64-bit hash within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_as_long, text_or_empty
from tessera.session import checkpoint_dir

# Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Groups up to which the thresholds are broadcast.
BROADCAST_GROUPS = 10_000
#: The outer quantile, how far the fence lies beyond it in distances from the median, and the noise a count is granted.
OUTER, STRETCH, NOISE = 0.9, 3.0, 3.0
#: Rate -> (counted, out of, has a lower fence).
RATES = {"symbols_per_word": ("n_symbols", "n_words", False), "shouts_per_word": ("_n_shouts", "n_words", False),
         "capitals": ("_n_upper", "word_chars", True), "repeated_lines": ("n_dup_lines", "_n_lines", False),
         "repeated_words": ("n_repeat_words", "n_words", False), "word_length": ("word_chars", "n_words", True)}


def document_counts(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rates need.

    Arrays that are used more than once are columns of their own, so they are worked out once.
    """
    d = docs.select(*keep, text_or_empty(text_col).alias("_t"))
    names = [F.col(f"`{c}`") for c in d.columns if c != "_t"]
    d = d.select(*names, "_t", F.array_remove(F.split("_t", r"[\x20\x09-\x0D]++", -1), "").alias("_w"),
                 F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    n = F.size("_w")
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3),
                                        lambda i: F.xxhash64(F.col("_w")[i], F.col("_w")[i + 1], F.col("_w")[i + 2])))
    d = d.select(*names, n.cast("bigint").alias("n_words"),
                 F.char_length(F.regexp_replace("_t", r"[\x20\x09-\x0D]++", "")).cast("bigint").alias("word_chars"),
                 F.regexp_count("_t", F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
                 (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
                 F.size("_lines").cast("bigint").alias("_n_lines"),
                 F.regexp_count("_t", F.lit("[!?]")).cast("bigint").alias("_n_shouts"),
                 F.char_length(F.regexp_replace("_t", r"[^\p{Lu}]++", "")).cast("bigint").alias("_n_upper"),
                 hashes.alias("_h"))
    counts = [F.col(f"`{c}`") for c in d.columns if c != "_h"]
    # windows in hash order, only where some hash occurs twice
    d = d.select(*counts, F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.sort_array(
        F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_at"))
    # a window is repeated if one beside it in that order has the same hash
    beside = F.zip_with("_at", F.slice("_at", 2, F.size("_at")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    d = d.select(*counts, F.array_distinct(F.flatten(F.filter(beside, lambda p: p.isNotNull()))).alias("_first"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_first", lambda i: F.array(i, i + 1, i + 2)))))
    return d.select(*counts, F.when(F.col("_first").isNull(), 0).otherwise(covered).cast("bigint").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def thresholds(counts: DataFrame, groups: list[str], min_rows: int = 100) -> DataFrame:
    """Fences per group of ``groups`` (finest grouping): ``max_<rate>`` and, for rates with a lower fence, ``min_<rate>``.

    They come from the finest level with ``min_rows`` rows; rows that fail the base rule do not count.
    """
    rates = {k: F.col(x) / F.greatest(F.col(n), F.lit(1)) for k, (x, n, _) in RATES.items()}
    fine = counts.where(~base_failed()).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_n"), *[F.kll_sketch_agg_double(c).alias(k) for k, c in rates.items()])

    def merged(by: list[str], name: str) -> DataFrame:
        return fine.groupBy(*by).agg(F.sum("_n").alias(f"_n{name}"),
                                     *[F.kll_merge_agg_double(k).alias(f"{k}{name}") for k in RATES])

    groups_n = fine.count()
    every = merged([], "_0").first()  # one sketch per rate
    lang = merged(groups[:1], "_1").withColumnRenamed(groups[0], "_g")
    joined = fine.join(F.broadcast(lang) if groups_n <= BROADCAST_GROUPS else lang,
                       F.col(groups[0]).eqNullSafe(F.col("_g")), "left")
    out = []
    for k, (_, _, lower) in RATES.items():
        whole = F.lit(bytes(every[f"{k}_0"])) if every[f"{k}_0"] is not None else F.lit(None).cast("binary")
        sketch = F.when(F.col("_n") >= min_rows, F.col(k)).when(F.col("_n_1") >= min_rows, F.col(f"{k}_1")).otherwise(whole)
        low, mid, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (1 - OUTER, 0.5, OUTER))
        out.append((high + STRETCH * (high - mid)).alias(f"max_{k}"))
        if lower:
            out.append(F.greatest(low - STRETCH * (mid - low), F.lit(0.0)).alias(f"min_{k}"))
    out = joined.select(*[F.col(g) for g in groups], *out)
    return F.broadcast(out) if groups_n <= BROADCAST_GROUPS else out


def within_fences() -> Column:
    """Whether the counts of a row lie inside the fences joined to it, noise granted."""
    good = F.lit(True)
    for k, (x, n, lower) in RATES.items():
        for side in ("max", "min") if lower else ("max",):
            mean = F.greatest(F.col(n), F.lit(1)) * F.col(f"{side}_{k}")
            noise = NOISE * F.sqrt(F.greatest(mean, F.lit(1.0)))
            inside = F.col(x) <= mean + noise if side == "max" else F.col(x) >= mean - noise
            good = good & F.coalesce(inside, F.lit(True))
    return good


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", min_rows: int = 100) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), one row per input row.

    The counts (a few numbers a document) are checkpointed, so texts are read once.
    """
    checkpoint_dir(docs.sparkSession)
    keep = [id_as_long(id_col).alias("_id"), F.col(f"`{lang_col}`").alias("_lang"), F.col(f"`{source_col}`").alias("_source")]
    counts = document_counts(docs, keep, text_col).checkpoint()
    limits = thresholds(counts, ["_lang", "_source"], min_rows).withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    joined = counts.join(limits, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    return joined.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         base_failed().alias("base_failed"), (~base_failed() & within_fences()).alias("kept"))

"""Line deduplication over overlapping three-line windows, with built-in functions only.

Every run of three consecutive lines that hold a word is hashed to 128 bits.
A window's first occurrence in the corpus, by (id, position), stays; the lines
covered by any later occurrence go, the covered positions of overlapping
windows being merged per document.  Windows are judged on the input.

Only 128-bit hashes and positions are shuffled; window counts are combined in
every task first, and adaptive execution can split a window that a third of all
documents share in the join with the repeated windows (``join_reduced``).

Defined cases: a null text counts as empty; an empty text is one line without a
word and stays empty; an id that stands on rows with different texts is one
document, too, and the positions found in any of them are taken from all; lines
without a word are no part of windows and always stay; texts under three such
lines stay whole; a row without an id stays whole and does not count; rows
that repeat an id with its text are one document, seen as one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_as_long, text_or_empty
from tessera.operators.skew import join_reduced

WINDOW = 3


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(_id, _k, _i, _h1, _h2): k-th window of a document, the line numbers it covers, its hash."""
    lines = F.split(text_or_empty(text_col), "\n", -1)
    full = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
                    lambda s: F.trim(F.translate(s["x"], "\t\x0b\x0c\r", "    ")) != "")
    d = docs.where(F.col(f"`{id_col}`").isNotNull()).select(id_as_long(id_col).alias("_id"), full.alias("_l"))
    d = d.where(F.size("_l") >= window)

    def one(k):
        parts = [F.col("_l")[k + j] for j in range(window)]
        texts = [p["x"] for p in parts]
        return F.struct(k.alias("k"), F.array(*[p["i"] for p in parts]).alias("i"),
                        F.xxhash64(*texts).alias("h1"), F.xxhash64(F.lit(window), *texts).alias("h2"))

    w = F.transform(F.sequence(F.lit(0), F.size("_l") - window), one)
    return (d.select("_id", F.explode(w).alias("_w"))
            .select("_id", F.col("_w.k").alias("_k"), F.col("_w.i").alias("_i"),
                    F.col("_w.h1").alias("_h1"), F.col("_w.h2").alias("_h2")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_lines, n_removed, text): the text left in each document, one row per input row."""
    w = line_windows(docs, id_col, text_col, window)
    first = (w.groupBy("_h1", "_h2")
             .agg(F.min(F.struct("_id", "_k")).alias("_first"), F.count(F.lit(1)).alias("_n"))
             .where("_n > 1").select("_h1", "_h2", "_first"))
    later = join_reduced(w, first, ["_h1", "_h2"]).where(F.struct("_id", "_k") > F.col("_first"))
    gone = later.select("_id", F.explode("_i").alias("_i")).groupBy("_id").agg(F.collect_set("_i").alias("_gone"))
    base = docs.select(id_as_long(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))
    lines = F.split("_t", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_gone", F.array().cast("array<int>")))
    return (base.join(gone, "_id", "left")
            .withColumn("_lines", lines).withColumn("_left", left)
            .select(F.col("_id").alias(id_col), F.size("_lines").cast("bigint").alias("n_lines"),
                    (F.size("_lines") - F.size("_left")).cast("bigint").alias("n_removed"),
                    F.array_join(F.transform("_left", lambda i: F.col("_lines")[i]), "\n").alias("text")))

"""Exact deduplication by 128-bit content hash with a byte comparison inside groups.

Texts are equal when they are identical after deleting blanks, tabs and line
ends (``common.WS``).  Rows are grouped by the 128-bit hash of that normalised
text *and* by its bytes, so two texts that only collide in the hash stay
apart.  Partial aggregation reduces every group to one row per input task
before the shuffle, so a group holding a third of all rows costs one row per
task and no task ever holds a group.

Defined cases: a null text counts as empty; all empty texts are one group; of
equal texts the one with the most code points in the original text stays, then
the smallest id (a null id comes last); a row repeated with id and text counts
as a copy of itself and only one of the repeated rows is kept; an empty table
gives an empty result; other columns are ignored by ``exact_groups`` and passed
through by ``drop_copies``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WS, id_as_long, text_or_empty


def content_hash(text: Column) -> Column:
    """128 bits of the normalised text, as 16 bytes."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def normalised(text: Column) -> Column:
    return F.translate(text, WS, "")


def _order(text: Column, ident: Column) -> Column:
    """One number per row, smallest for the row that stays: longest text first, then smallest id.

    A decimal keeps the aggregate a hash aggregate (a struct would make it a sort).
    """
    big = F.lit(2 ** 31).cast("decimal(38,0)") - F.char_length(text)
    shift = F.lit(str(2 ** 64)).cast("decimal(21,0)")
    low = F.coalesce(ident, F.lit(2 ** 63 - 1)).cast("decimal(20,0)") + F.lit(str(2 ** 63)).cast("decimal(20,0)")
    return (big.cast("decimal(11,0)") * shift + low).cast("decimal(38,0)")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per input row, dropped ones too.

    ``hash_fn`` is the content hash; a weak one changes speed only, never the groups.
    """
    text = text_or_empty(text_col)
    base = docs.select(id_as_long(id_col).alias("_id"), _order(text, id_as_long(id_col)).alias("_ord"),
                       normalised(text).alias("_norm"))
    base = base.withColumn("_h", hash_fn(F.col("_norm")))
    groups = (base.groupBy("_h", "_norm")
              .agg(F.min_by("_id", "_ord").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .select("_h", F.sha2("_norm", 256).alias("_sha"), "keep_id", "group_size"))
    rows = (base.select("_id", "_h", F.sha2("_norm", 256).alias("_sha"))
            .groupBy("_id", "_h", "_sha").agg(F.count(F.lit(1)).alias("_n")))
    return (rows.join(groups, ["_h", "_sha"])
            .select("_id", "keep_id", "group_size", "_sha", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_k"))
            .select(F.col("_id").alias(id_col), "keep_id", "group_size",
                    (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_k") == 1)).alias("kept"),
                    F.col("_sha").alias("text_sha256")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The kept row of every group, with all its columns.

    One aggregate by (hash, bytes) that carries the whole row: no join, one shuffle.
    """
    text = text_or_empty(text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("_row"), normalised(text).alias("_norm"),
                         _order(text, id_as_long(id_col)).alias("_ord"))
    kept = (packed.withColumn("_h", hash_fn(F.col("_norm"))).groupBy("_h", "_norm")
            .agg(F.min_by("_row", "_ord").alias("_row")))
    return kept.select("_row.*")

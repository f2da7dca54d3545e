"""Mixing sources to target weights by Poisson replication.

Every source has a target share of the mixture's characters.  A document of a
source with mean repetition rate r is taken Poisson(r) times: its id and the
seed are hashed to a uniform number and the Poisson distribution function is
inverted at it, so the draw needs no state, repeats exactly and is the same
however the table is partitioned.  Copies are exploded and brought into a
global random order by sorting on a hash of (seed, id, copy).

Defined cases: a null source is a source of its own; a null or empty text has
no characters, and a source without characters keeps rate 1; a null id draws
as the empty id; rows that repeat an id draw the same count; ties of the sort
key only occur between rows that repeat an id; very long texts move whole; an empty table gives an empty
result; the distribution of a source is an array of about its rate plus twelve of its roots; other columns pass through whatever their names, except that the two
added columns take the place of input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many sources, the table of rates is broadcast; above, it is joined by a shuffle.
BROADCAST_SOURCES = 10_000


def source_rates(docs: DataFrame, source_col: str = "source", text_col: str = "text",
                 weights: dict | None = None, exponent: float = 0.5) -> tuple[DataFrame, int]:
    """((_source, _chars, _rate), number of sources): mean repetitions per document of each source.

    ``weights`` names target shares by source (sources it leaves out get rate 0);
    without it the shares are proportional to ``chars ** exponent``.  The mixture has as many
    characters as the input.  Only the three totals come to the driver.
    """
    per = docs.groupBy(F.col(f"`{source_col}`").alias("_source")).agg(
        F.sum(F.coalesce(F.char_length(F.col(f"`{text_col}`")), F.lit(0))).cast("double").alias("_chars"))
    if weights is None:
        want = F.pow("_chars", F.lit(float(exponent)))
    else:
        want = F.lit(0.0)
        for name, w in weights.items():
            want = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(want)
    per = per.withColumn("_want", F.when(F.col("_chars") > 0, want).otherwise(0.0))
    want_all, chars_all, n = per.agg(F.sum("_want"), F.sum("_chars"), F.count(F.lit(1))).first()
    rate = F.col("_want") / F.lit(want_all or 1.0) * F.lit(chars_all or 0.0) / F.col("_chars")
    return per.select("_source", "_chars", F.when(F.col("_chars") > 0, rate).otherwise(1.0).alias("_rate")), n


def poisson_cdf(rate: Column) -> Column:
    """The distribution function at 0, 1, 2, ... as an array, up to where it is 1 in doubles."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 50).cast("int")
    start = F.struct((-rate).alias("lp"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc, k):
        lp = acc["lp"] + F.ln(rate / k)
        return F.struct(lp.alias("lp"),
                        F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(lp))).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), top), start, step)["cdf"]).otherwise(F.array(F.lit(1.0)))


def uniform(seed: int, ident: Column) -> Column:
    """A number in (0, 1) from 52 bits of the md5 of (seed, id)."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                weights: dict | None = None, exponent: float = 0.5, seed: int = 17,
                copy_col: str = "copy", key_col: str = "mix_key") -> DataFrame:
    """The input's columns plus copy number (from 0) and sort key, in global order of the key."""
    rates, n = source_rates(docs, source_col, text_col, weights, exponent)
    rates = rates.select("_source", poisson_cdf(F.col("_rate")).alias("_cdf"))
    if n <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    names = [c for c in docs.columns if c not in (copy_col, key_col)]
    src, ident = F.col("_row").getField(source_col), F.col("_row").getField(id_col)
    joined = rows.join(rates, src.eqNullSafe(F.col("_source")))
    count = F.size(F.filter("_cdf", lambda c: c < F.col("_u")))
    drawn = (joined.withColumn("_u", uniform(seed, ident)).withColumn("_n", count).where("_n > 0")
             .select("_row", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_copy")))
    key = F.md5(F.concat(F.lit(f"{seed}#"), F.coalesce(ident.cast("string"), F.lit("")), F.lit("#"),
                         F.col("_copy").cast("string")).cast("binary"))
    ordered = drawn.withColumn("_key", key).orderBy("_key")
    return ordered.select(*[F.col("_row").getField(c).alias(c) for c in names],
                          F.col("_copy").alias(copy_col), F.col("_key").alias(key_col))

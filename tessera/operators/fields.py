"""Projections and derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import PROPERTY_RANK, SKOS_PROPERTIES
from tessera.functions.terms import typed_term


def map_fields(df: DataFrame, mapping: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rename mapped columns to SKOS property names; unmapped columns drop.

    ``mapping`` is {property: column}; a property may be 'uri'.  Mappings to
    columns that are absent are skipped.
    """
    cols = [F.col(c) for c in keep]
    for prop, column in mapping.items():
        if column and column in df.columns and (prop == "uri" or prop in SKOS_PROPERTIES):
            cols.append(F.col(f"`{column}`").cast("string").alias(prop))
    return df.select(*cols)


def melt_fields(df: DataFrame, mapping: dict[str, str], uri_col: str = "uri",
                row_col: str | None = None) -> DataFrame:
    """Wide -> long (uri, [row,] prop, vpos, value) over the mapped properties.

    Values are split on '|', trimmed, and empty pieces removed; ``vpos`` keeps
    the order of the pieces.  Null cells give no rows.
    """
    props = [(p, c) for p, c in mapping.items()
             if p != "uri" and c and c in df.columns and p in SKOS_PROPERTIES]
    if not props:
        raise ValueError("no mapped SKOS property present")
    ids = [uri_col] + ([row_col] if row_col else [])
    wide = df.select(*[F.col(i) for i in ids],
                     *[F.col(f"`{c}`").cast("string").alias(p) for p, c in props])
    long = wide.unpivot(ids, [p for p, _ in props], "prop", "raw").where(F.col("raw").isNotNull())
    return (long.select(*ids, "prop", F.posexplode(F.split("raw", r"\|")).alias("vpos", "value"))
                .withColumn("value", F.trim("value"))
                .where(F.col("value") != ""))


def property_rank(prop: str | Column) -> Column:
    """Position of a property in the SKOS dictionary (write order)."""
    m = F.create_map(*[x for p, i in PROPERTY_RANK.items() for x in (F.lit(p), F.lit(i))])
    return F.coalesce(F.try_element_at(m, prop if isinstance(prop, Column) else F.col(prop)), F.lit(99))


def typed_terms(long: DataFrame, lang: str = "en") -> DataFrame:
    """Add the rendered RDF term for each (prop, value)."""
    return long.withColumn("term", typed_term("prop", "value", lang))


def concept_uri(uri: str | Column, base: str, row_key: Column) -> Column:
    """Absolute kept, relative prefixed with base, missing -> base + sha256 of ``row_key``.

    The row hash replaces a random UUID so reruns give the same URIs.  The key must tell rows
    apart, e.g. ``row_fingerprint``: rows with one key get one URI.
    """
    u = F.trim((F.col(uri) if isinstance(uri, str) else uri).cast("string"))
    b = base if base.endswith("/") else base + "/"
    missing = F.concat(F.lit(b), F.sha2(row_key, 256))
    return (F.when(u.isNull() | (u == ""), missing)
             .when(u.startswith("http"), u)
             .otherwise(F.concat(F.lit(b), u)))


def row_fingerprint(df: DataFrame, cols: list[str] | None = None) -> Column:
    """Deterministic content key of a row (columns joined by U+0001, nulls as empty)."""
    cols = cols or df.columns
    return F.concat_ws("\u0001", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cols])


def add_source(df: DataFrame, name: str | None = None, col: str = "_source_file") -> DataFrame:
    """P5: a constant source name, or the file each row was read from."""
    return df.withColumn(col, F.lit(name) if name is not None else F.col("_metadata.file_name"))


def drop_unlabelled(concepts: DataFrame, literals: DataFrame, uri_col: str = "uri") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) concepts by presence of a prefLabel literal."""
    labelled = literals.where(F.col("prop") == "prefLabel").select(F.col("uri").alias("_u")).distinct()
    cond = F.col(uri_col) == F.col("_u")
    kept = concepts.join(labelled, cond, "left_semi")
    dropped = concepts.join(labelled, cond, "left_anti")
    return kept, dropped


def preview(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first n rows in a total order (a top-n, not a sample)."""
    return df.orderBy(*order_by).limit(n)


def sample_check(df: DataFrame, n: int, key_cols: list[str], seed: int = 42) -> DataFrame:
    """A repeatable pseudo-random n rows: smallest xxhash64 of the key."""
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in key_cols])
    return df.withColumn("_h", h).orderBy("_h", *key_cols).limit(n).drop("_h")


def numeric_level(c: str | Column) -> Column:
    """Coerce to a number, bad values null."""
    return (F.col(c) if isinstance(c, str) else c).cast("string").try_cast("double")

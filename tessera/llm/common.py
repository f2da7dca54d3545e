"""Shared pieces of the operators: white space, tables, column-name clashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all operators: blank, tab, line feed, vertical tab, form feed, carriage return.
WS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def id_as_long(col: str) -> Column:
    return F.col(f"`{col}`").cast("bigint")


def raw(text: Column) -> Column:
    """UTF-8 bytes of a text, as ``binary`` (Arrow hands them to numpy without decoding)."""
    return F.encode(text, "UTF-8")

"""Column expressions that render RDF terms (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.model import URI_PROPERTIES


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def escape_literal(c: str | Column) -> Column:
    """Backslash, double quote, newline, carriage return and tab escaped, in that order."""
    s = _c(c).cast("string")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def typed_term(prop: str | Column, value: str | Column, lang: str | Column = "en") -> Column:
    """URI properties -> <v>; notation -> "v"^^xsd:string; others -> "v"@lang."""
    p, v = _c(prop), _c(value)
    lg = F.lit(lang) if isinstance(lang, str) else lang
    return (F.when(p.isin(*URI_PROPERTIES), F.concat(F.lit("<"), v, F.lit(">")))
             .when(p == "notation", F.concat(F.lit('"'), escape_literal(v), F.lit('"^^xsd:string')))
             .otherwise(F.concat(F.lit('"'), escape_literal(v), F.lit('"@'), lg)))


def statement(prop: str | Column, term: str | Column) -> Column:
    """One indented ``skos:prop term`` line of a concept block."""
    return F.concat(F.lit("    skos:"), _c(prop), F.lit(" "), _c(term))

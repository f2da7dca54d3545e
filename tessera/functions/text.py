"""Text, URI and tag cleaning as native Column expressions.

Java regular expressions differ from Python's in what ``\\s`` and ``\\d`` match, so the
patterns below spell out Python's whitespace set and use ``\\p{Nd}`` for digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mis-decoded UTF-8 sequences and their repair, applied in this order.
MOJIBAKE = [
    ("Ã¤", "ä"), ("Ã¶", "ö"), ("Ã¼", "ü"),
    ("Ã„", "Ä"), ("Ã–", "Ö"), ("Ãœ", "Ü"),
    ("ÃŸ", "ß"), ("Ã©", "é"), ("Ã¨", "è"),
    ("Ã¡", "á"), ("Ã ", "à"), ("Ã³", "ó"),
    ("Ã²", "ò"), ("Ãº", "ú"), ("Ã¹", "ù"),
]

# HTML entities and their characters, applied in this order.
ENTITIES = [
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
]

# Label fragments that signal an encoding problem.
MOJIBAKE_MARKERS = ["Ã¤", "Ã¶", "Ã¼", "ÃŸ"]

# Default namespaces of the URI cleaner.
ESCO_SKILL_NS = "http://data.europa.eu/esco/skill/"
EXAMPLE_NS = "http://example.org/"

# Mapping-type synonyms (lower case) and the canonical SKOS names.
MAPPING_TYPES = ["exactMatch", "closeMatch", "broadMatch", "narrowMatch", "relatedMatch", "mappingRelation"]
MAPPING_SYNONYMS = [
    ("exact", "exactMatch"), ("equivalent", "exactMatch"), ("same", "exactMatch"),
    ("identical", "exactMatch"), ("close", "closeMatch"), ("similar", "closeMatch"),
    ("related", "relatedMatch"), ("associated", "relatedMatch"), ("broader", "broadMatch"),
    ("narrower", "narrowMatch"), ("parent", "broadMatch"), ("child", "narrowMatch"),
]

# Whitespace as Python's str.isspace() sees it.  Java's Unicode \s (White_Space) is the
# same set minus U+001C..U+001F, so the class adds that range; a two-part class keeps the
# per-character test cheap.  PY_WHITESPACE (for trimming) is generated by rule.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
WS = r"(?U:[\s\x1c-\x1f])"

# The six spacing rules (a space after , and ; unless whitespace follows; after . unless
# whitespace, the end or a digit follows; after : ! ? unless whitespace or the end follows)
# only look at what follows a mark, so applying them one after another equals one pass.
PUNCT_GAP = rf"(?:[,;](?!{WS})|\.(?!{WS}|$|\p{{Nd}})|[:!?](?!{WS}|$))"


def _c(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _replace_all(s: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def strip_ws(c: str | Column) -> Column:
    """Python ``str.strip()``: whitespace off both ends (a character-set trim, no regex)."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def fix_mojibake(c: str | Column) -> Column:
    """The 15 mis-decoding repairs, in order.

    Every pattern starts with 'Ã' and no replacement produces one, so texts
    without 'Ã' skip the chain (one scan instead of fifteen).
    """
    s = _c(c)
    return F.when(s.contains("Ã"), _replace_all(s, MOJIBAKE)).otherwise(s)


def inject_mojibake(c: str | Column) -> Column:
    """Inverse of X1 (test input only): each repaired character back to its mis-decoded form."""
    return _replace_all(_c(c), [(b, a) for a, b in MOJIBAKE])


def unescape_entities(c: str | Column) -> Column:
    """The 7 entity replacements, in order.

    Every entity starts with '&', and '&' only ever comes out of '&amp;', so
    texts without '&' skip the chain.
    """
    s = _c(c)
    return F.when(s.contains("&"), _replace_all(s, ENTITIES)).otherwise(s)


def space_after_punctuation(c: str | Column, protect_urls: bool = False) -> Column:
    """A space after , ; always, after . unless before a digit, after : ! ? unless at the end;
    then runs of 2+ whitespace become one space and the ends are stripped.

    ``protect_urls`` leaves ``scheme://`` and times like 10:30 alone (D17).
    """
    colon = rf":(?!{WS}|$|//|\p{{Nd}})"
    pattern = PUNCT_GAP if not protect_urls else \
        rf"(?:[,;](?!{WS})|\.(?!{WS}|$|\p{{Nd}})|{colon}|[!?](?!{WS}|$))"
    s = F.regexp_replace(_c(c), pattern, "$0 ")
    s = F.regexp_replace(s, WS + "{2,}", " ")
    return strip_ws(s)


def collapse_ws(c: str | Column) -> Column:
    """Python ``' '.join(s.split())``."""
    return strip_ws(F.regexp_replace(_c(c), WS + "+", " "))


def clean_label(c: str | Column) -> Column:
    """X1, whitespace collapsed, empty -> null."""
    # nullif evaluates the chain once; when(s != "", s) would run it twice
    return F.nullif(collapse_ws(fix_mojibake(c)), F.lit(""))


def clean_text(c: str | Column) -> Column:
    """X1 + X2, punctuation spacing, whitespace runs to one space, stripped, empty -> null."""
    s = unescape_entities(fix_mojibake(c))
    s = F.regexp_replace(s, PUNCT_GAP, "$0 ")
    s = strip_ws(F.regexp_replace(s, WS + "+", " "))
    return F.nullif(s, F.lit(""))


def clean_uri(c: str | Column, base: str | None = None) -> Column:
    """Brackets off; http kept; relative ids joined to base; ``esco:x`` and ``p:x`` expanded."""
    u = strip_ws(c)
    u = F.when(u.startswith("<") & u.endswith(">"),
               F.substring(u, 2, F.greatest(F.length(u) - 2, F.lit(0)))).otherwise(u)
    has_colon = u.contains(":")
    prefix = F.substring_index(u, ":", 1)
    local = F.regexp_extract(u, r"^[^:]*:(.*)$", 1)
    prefixed = F.when(prefix == "esco", F.concat(F.lit(ESCO_SKILL_NS), local)).otherwise(
        F.concat(F.lit(EXAMPLE_NS), prefix, F.lit("/"), local))
    if base:
        b = base.rstrip("/") + "/"
        rel = F.when(~has_colon, F.concat(F.lit(b), u)).otherwise(prefixed)
    else:
        rel = F.when(has_colon, prefixed).otherwise(F.concat(F.lit(ESCO_SKILL_NS), u))
    return F.when(u.startswith("http"), u).otherwise(rel)


def is_valid_uri(c: str | Column) -> Column:
    """Scheme and host present (angle brackets ignored)."""
    u = F.regexp_replace(_c(c), r"^[<>]+|[<>]+$", "")
    return F.coalesce(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.lit(False))


def is_valid_lang(c: str | Column) -> Column:
    """Basic BCP 47 shape; empty or null is invalid."""
    return F.coalesce(_c(c).rlike(r"^[a-z]{2,3}(-[A-Za-z0-9]{1,8})*$"), F.lit(False))


def collection_slug(c: str | Column) -> Column:
    """Space and '/' to '_', then only letters, digits, '_' and '-' kept."""
    s = F.translate(_c(c), " /", "__")
    return F.regexp_replace(s, r"[^\p{L}\p{N}_-]", "")


def absolute_uri(c: str | Column, base: str | None = None) -> Column:
    """X11: http(s) and urn kept; other values joined to base unless they start with '/'."""
    u = F.trim(_c(c))
    keep = u.startswith("http://") | u.startswith("https://") | u.startswith("urn:")
    if not base:
        return u
    return F.when(keep | u.startswith("/"), u).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), u))


def mapping_type(c: str | Column) -> Column:
    """null/empty -> closeMatch; canonical names in any case; synonyms; unknown lower-cased.

    Canonical names and synonyms share one literal map (their keys do not
    overlap), so the input is referenced few times in the generated code.
    """
    raw = _c(c)
    low = F.lower(strip_ws(raw))
    names = F.create_map(*[x for k, v in [(t.lower(), t) for t in MAPPING_TYPES] + MAPPING_SYNONYMS
                           for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.when(F.coalesce(raw, F.lit("")) == "", F.lit("closeMatch")),
                      F.try_element_at(names, low), low)

"""DuckDB SQL fragments shared by oracle statements."""

NL = "chr(10)"


def esc(x: str) -> str:
    """DuckDB form of ``escape_literal`` (standard strings: backslash is literal)."""
    return (f"replace(replace(replace(replace(replace({x}, '\\', '\\\\'), '\"', '\\\"'), "
            f"chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')")


def melt(src: str, key_cols: str, prop: str, col: str) -> str:
    """Rows (keys, prop, vpos, value) of one column split on '|', trimmed, empties removed."""
    return (f"SELECT {key_cols}, '{prop}' AS prop, CAST(vpos - 1 AS INTEGER) AS vpos, trim(parts[vpos]) AS value FROM "
            f"(SELECT {key_cols}, parts, unnest(generate_series(1, len(parts))) AS vpos FROM "
            f"(SELECT {key_cols}, string_split({col}, '|') AS parts FROM {src} WHERE {col} IS NOT NULL)) "
            f"WHERE trim(parts[vpos]) <> ''")


def replace_chain(x: str, pairs) -> str:
    """Nested DuckDB replace() calls, applied in list order."""
    for a, b in pairs:
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def punct_sql(x: str, collapse: str = "{2,}") -> str:
    """DuckDB form of the punctuation-spacing rules (RE2 has no look-ahead).

    Each rule ``P(?!cls)`` is rewritten as ``P([^cls])`` with the follower put
    back, run twice so that runs of the same mark are all reached.
    """
    rules = [(",", r"\s", False), (r"\.", r"\s\d", True), (";", r"\s", False),
             (":", r"\s", True), ("!", r"\s", True), (r"\?", r"\s", True)]
    for mark, cls, end_ok in rules:
        out = mark.replace("\\", "")
        pat = f"{mark}([^{cls}])" if end_ok else f"{mark}([^{cls}]|$)"
        for _ in range(2):
            x = f"regexp_replace({x}, '{pat}', '{out} \\1', 'g')"
    x = f"regexp_replace({x}, '\\s{collapse}', ' ', 'g')"
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

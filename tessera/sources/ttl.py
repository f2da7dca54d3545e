"""Turtle (TTL) sources and sinks built from text columns.

Reading: files are read line by line (any line end), so a large file splits
across tasks.  Lines are trimmed, blank and comment lines dropped, and every
line is numbered with its concept block by a two-level count of start lines:
a running count inside each file split plus the counts of the splits before
it.  Blocks may hold blank lines, tabs and CRLF line ends, and a file may hold
any number of them.  One task holds one block at a time.

Writing: one text line-group per concept, built with ``concat``/``array_join``
inside the executors; the header is a one-row file of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.terms import statement
from tessera.functions.text import strip_ws as strip
from tessera.model import LITERAL_PROPERTIES, PREFIXES, RELATION_PROPERTIES
from tessera.operators.fields import property_rank
from tessera.operators.skew import join_reduced
from tessera.session import checkpoint_dir

# A concept block starts at "<uri> a skos:Concept" or "prefix:id a skos:Concept"
# (a following letter, as in ConceptScheme, does not start a concept).
CONCEPT_START = r"^(<[^>]+>|[a-zA-Z0-9_:/-]+)\s+a\s+skos:Concept(?![A-Za-z])"
# Possessive runs keep Java's matcher from recursing once per character on long texts.
_LIT_NC = r'"(?:[^"\\]++|\\.)*+"(?:@[A-Za-z]{2,3}(?:-[A-Za-z0-9]{1,8})*)?'
_TERM = r'(?:<[^>]*>|[A-Za-z][A-Za-z0-9_.-]*:[A-Za-z0-9_./#-]*[A-Za-z0-9_/#-])'


def read_lines(spark: SparkSession, path) -> DataFrame:
    """(file, split, mid, line): trimmed lines without blank and comment lines, in file order of (split, mid)."""
    return content_lines(spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value"))


def content_lines(lines: DataFrame) -> DataFrame:
    """The columns of ``read_lines`` from lines (file, split, value) that stand in file order within their partition."""
    numbered = lines.select("file", "split", F.monotonically_increasing_id().alias("mid"), strip("value").alias("line"))
    return numbered.where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))


def number_groups(lines: DataFrame, is_start: Column) -> DataFrame:
    """Add ``k``: how many start lines the file has up to and including the line.

    The windows are bounded by a file split and by the splits of a file.
    """
    own = Window.partitionBy("file", "split")
    marked = lines.withColumn("_s", is_start.cast("long"))
    per = marked.groupBy("file", "split").agg(F.sum("_s").alias("_n"))
    before = per.select("file", "split", F.coalesce(F.sum("_n").over(
        Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    run = F.sum("_s").over(own.orderBy("mid").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_run", run).join(before, ["file", "split"]).select(
        "file", "split", "mid", "line", (F.col("_run") + F.col("_off")).alias("k"))


def _first_lines(lines: Column, is_end) -> Column:
    """The array up to and including its first element that ``is_end`` accepts."""
    ends = F.filter(F.transform(lines, lambda x, i: F.when(is_end(x), i + 1)), lambda i: i.isNotNull())
    return F.slice(lines, 1, F.coalesce(F.try_element_at(ends, F.lit(1)), F.size(lines)))


def _block(lines: Column) -> Column:
    return F.array_join(_first_lines(lines, lambda x: x == "."), "\n")


def _gathered(numbered: DataFrame, keys: list[str]) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("split", "mid", "line")))
    return numbered.where("k > 0").groupBy(*keys).agg(F.transform(rows, lambda x: x["line"]).alias("lines"))


def _with_uri(blocks: DataFrame) -> DataFrame:
    """Add the raw URI and ``pos``, the order key (file, number of the block), which cannot overflow."""
    return (blocks.withColumn("raw_uri", F.regexp_extract("block", CONCEPT_START[1:], 1))
            .withColumn("pos", F.struct("file", "k")))


def read_ttl(spark: SparkSession, path) -> DataFrame:
    """(file, k, block, raw_uri, pos), one row per concept block of the TTL files.

    A block runs from its start line to the next start line or to a line that
    is exactly '.', whichever comes first.
    """
    return _with_uri(blocks_from_lines(read_lines(spark, path)))


def concept_heads(lines: DataFrame) -> DataFrame:
    """(file, k, raw_uri, pos) of the concept blocks, from their start lines alone."""
    heads = number_groups(lines.where(F.col("line").rlike(CONCEPT_START)), F.lit(True))
    return _with_uri(heads.select("file", "k", F.col("line").alias("block"))).drop("block")


def blocks_from_lines(lines: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """S4 on lines (file, split, mid, line), as ``read_lines`` and a stream deliver them: (file, k, block).

    With ``of`` (file, k, ...) only those blocks, with its columns; lines of others are dropped before they are gathered.
    """
    numbered, keys = number_groups(lines, F.col("line").rlike(CONCEPT_START)), ["file", "k"]
    if of is not None:
        numbered, keys = numbered.join(of, ["file", "k"]), [*keys, *[c for c in of.columns if c not in keys]]
    return _gathered(numbered, keys).select(*keys, _block(F.col("lines")).alias("block"))


def blocks_from_files(files: DataFrame) -> DataFrame:
    """S4 on whole small files (file, content): the columns of ``read_ttl``."""
    lines = F.filter(F.transform(F.split("content", "\r\n|\n|\r"), strip), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    f = files.select("file", lines.alias("lines"))
    starts = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(CONCEPT_START), i + 1)), lambda i: i.isNotNull())
    f = f.withColumn("starts", starts).withColumn("ends", F.concat(
        F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), F.array(F.size("lines") + 1)))
    f = f.where(F.size("starts") > 0).select("file", "lines", F.posexplode(F.arrays_zip("starts", "ends")).alias("i", "b"))
    return _with_uri(f.select("file", (F.col("i") + 1).cast("long").alias("k"), _block(
        F.slice("lines", F.col("b.starts"), F.col("b.ends") - F.col("b.starts"))).alias("block")))


def _unescape(c: Column) -> Column:
    s = F.replace(c, F.lit("\\\\"), F.lit("\u0000"))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.replace(s, F.lit("\u0000"), F.lit("\\"))


def parse_literals(blocks: DataFrame, default_lang: str = "en", uri_col: str = "uri",
                   props: list[str] | None = None) -> DataFrame:
    """Long literals (uri, pos, prop, vpos, text, lang) of label and note properties.

    Statements may hold comma lists of literals; escaped quotes stay inside
    the text; missing language tags get ``default_lang``.
    """
    props = props or LITERAL_PROPERTIES
    stmt = rf"skos:(?:{'|'.join(props)})\s+{_LIT_NC}(?:\s*,\s*{_LIT_NC})*+"
    s = blocks.select(uri_col, "pos", F.posexplode(F.regexp_extract_all("block", F.lit(stmt), 0)).alias("spos", "st"))
    lit = s.select(uri_col, "pos", "spos", F.regexp_extract("st", r"^skos:(\w+)", 1).alias("prop"),
                   F.posexplode(F.regexp_extract_all("st", F.lit(_LIT_NC), 0)).alias("opos", "o"))
    # a literal is quote, text, quote and then nothing or @tag: cut by position, no further pattern
    tag = F.substring_index("o", '"', -1)
    lit = lit.withColumn("tag", tag)
    return lit.select(
        uri_col, "pos", "prop", _value_pos("spos", "opos"),
        _unescape(F.substring("o", 2, F.length("o") - 2 - F.length("tag"))).alias("text"),
        F.when(F.col("tag") == "", F.lit(default_lang)).otherwise(F.substring("tag", 2, F.length("tag"))).alias("lang"))


def _value_pos(statement_no: str, value_no: str) -> Column:
    """``vpos``: statement number in the high and value number in the low 32 bits."""
    return F.shiftleft(F.col(statement_no).cast("long"), 32).bitwiseOR(F.col(value_no).cast("long")).alias("vpos")


def parse_relations(blocks: DataFrame, uri_col: str = "uri", props: list[str] | None = None) -> DataFrame:
    """Long URI statements (uri, pos, prop, vpos, target); comma lists and line breaks allowed."""
    props = props or RELATION_PROPERTIES
    stmt = rf"skos:(?:{'|'.join(props)})\s+{_TERM}(?:\s*,\s*{_TERM})*+"
    flat = F.regexp_replace("block", r"\s*\n\s*", " ")
    s = blocks.select(uri_col, "pos", F.posexplode(F.regexp_extract_all(flat, F.lit(stmt), 0)).alias("spos", "st"))
    s = s.select(uri_col, "pos", "spos", F.regexp_extract("st", r"^skos:(\w+)", 1).alias("prop"),
                 F.regexp_replace("st", r"^skos:\w+\s+", "").alias("objs"))
    t = s.select(uri_col, "pos", "spos", "prop",
                 F.posexplode(F.regexp_extract_all("objs", F.lit(_TERM), 0)).alias("opos", "t"))
    return t.select(uri_col, "pos", "prop", _value_pos("spos", "opos"),
                    F.regexp_replace("t", r"^<|>$", "").alias("target"))


def concept_table(literals: DataFrame, relations: DataFrame, uri_col: str = "uri") -> DataFrame:
    """One flat row per concept block: uri, prefLabel, language, altLabel, definition, broader.

    altLabel and broader join a block's values with ' | ' in statement order.
    Grouping is per block (uri, pos), so the lists are bounded by one block even
    when a URI is copied many times.
    """
    lit = literals.groupBy(uri_col, "pos").agg(
        F.min_by(F.struct("text", "lang"), F.when(F.col("prop") == "prefLabel", F.col("vpos"))).alias("pl"),
        F.array_join(F.transform(F.array_sort(F.collect_list(
            F.when(F.col("prop") == "altLabel", F.struct("vpos", "text")))), lambda x: x["text"]), " | ").alias("altLabel"),
        F.min_by("text", F.when(F.col("prop") == "definition", F.col("vpos"))).alias("definition"))
    rel = relations.where(F.col("prop") == "broader").groupBy(uri_col, "pos").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vpos", "target"))),
                                 lambda x: x["target"]), " | ").alias("broader"))
    return (lit.join(rel, [uri_col, "pos"], "full")
               .select(uri_col, F.col("pl.text").alias("prefLabel"), F.col("pl.lang").alias("language"),
                       F.when(F.col("altLabel") != "", F.col("altLabel")).alias("altLabel"),
                       "definition", "broader"))


def read_header(spark: SparkSession, path) -> DataFrame:
    """(file, kind, text) for @base, @prefix and the ConceptScheme statement."""
    lines = read_lines(spark, path)
    decl = lines.where(F.col("line").rlike(r"^@(base|prefix)\s")).select(
        "file", F.regexp_extract("line", r"^@(\w+)", 1).alias("kind"), F.col("line").alias("text"))
    is_scheme = F.contains("line", F.lit("a skos:ConceptScheme"))
    numbered = number_groups(lines, is_scheme | F.col("line").rlike(CONCEPT_START))
    schemes = numbered.where(is_scheme).select("file", "k").distinct()  # only their lines are gathered, no concept's
    scheme = _gathered(numbered.join(schemes, ["file", "k"], "left_semi"), ["file", "k"]).select(
        "file", F.lit("scheme").alias("kind"),
        F.array_join(_first_lines(F.col("lines"), lambda x: F.endswith(x, F.lit(" ."))), "\n    ").alias("text"))
    return decl.unionByName(scheme)


# ---------------------------------------------------------------- sinks
def concept_blocks(terms: DataFrame, uri_col: str = "uri", row_col: str | None = None) -> DataFrame:
    """(uri, [row,] block) - statements sorted by property order, then value order.

    One block per source row when ``row_col`` is given, so repeated URIs never
    merge into one unbounded group.
    """
    keys = [uri_col] + ([row_col] if row_col else [])
    st = terms.select(*keys, F.struct(property_rank("prop").alias("r"), F.col("vpos").alias("v"),
                                      statement("prop", "term").alias("s")).alias("x"))
    g = st.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    body = F.array_join(F.transform("xs", lambda x: x["s"]), " ;\n")
    return g.select(*keys, F.concat(F.lit("<"), F.col(uri_col), F.lit("> a skos:Concept ;\n    skos:inScheme <> ;\n"),
                                     body, F.lit(" .")).alias("block"))


def statement_lines(terms: DataFrame, uri_col: str = "uri", row_col: str | None = None) -> DataFrame:
    """(value) lines of a Turtle file, a statement a line, concept after concept in every partition.

    A secondary sort brings the statements of a concept together without gathering them, so a concept may have any
    number of them; its last line is a dot alone.
    """
    keys = [F.col(uri_col), F.col(row_col) if row_col else F.lit(0)]
    rows = terms.select(keys[0].alias("_u"), keys[1].alias("_w"), property_rank("prop").alias("_r"), F.col("vpos").alias("_v"),
                        F.concat(statement("prop", "term"), F.lit(" ;")).alias("value"))
    ends = terms.select(keys[0].alias("_u"), keys[1].alias("_w")).distinct()
    frame = F.array(F.struct(F.lit(-1).alias("r"), F.concat(F.lit("<"), F.col("_u"), F.lit("> a skos:Concept ;")).alias("s")),
                    F.struct(F.lit(0).alias("r"), F.lit("    skos:inScheme <> ;").alias("s")),
                    F.struct(F.lit(2**31 - 1).alias("r"), F.lit(".\n").alias("s")))
    framed = ends.select("_u", "_w", F.explode(frame).alias("x")).select(
        "_u", "_w", F.col("x.r").alias("_r"), F.lit(-1).alias("_v"), F.col("x.s").alias("value"))
    every = rows.select("_u", "_w", F.col("_r").cast("int"), F.col("_v").cast("int"), "value").unionByName(
        framed.select("_u", "_w", F.col("_r").cast("int"), F.col("_v").cast("int"), "value"))
    return every.repartition("_u", "_w").sortWithinPartitions("_u", "_w", "_r", "_v", "value").select("value")


def write_ttl_lines(terms: DataFrame, path: str, header: str, mode: str = "overwrite", uri_col: str = "uri", row_col: str | None = None) -> None:
    """S9 sink: as ``write_ttl``, statement by statement (``statement_lines``)."""
    terms.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/header")
    statement_lines(terms, uri_col, row_col).write.mode(mode).text(f"{path}/concepts")


def read_statements(spark: SparkSession, path) -> DataFrame:
    """S4 for files with a statement a line: (file, k, raw_uri, pos, block), one row per line, ``block`` the line.

    The parsers of blocks take the lines as they are; no concept is gathered, so one may have any number of statements.
    """
    numbered = number_groups(read_lines(spark, path), F.col("line").rlike(CONCEPT_START)).where("k > 0")
    names = numbered.where(F.col("line").rlike(CONCEPT_START)).select("file", "k", F.regexp_extract("line", CONCEPT_START[1:], 1).alias("raw_uri"))
    return (join_reduced(numbered, names, ["file", "k"]).where(F.col("line") != ".")
            .select("file", "k", "raw_uri", F.struct("file", "k").alias("pos"), F.col("line").alias("block")))


def header_text(base: str, title: str, description: str, lang: str = "en", created: str = "") -> str:
    """TTL header: @base, the standard prefixes and the ConceptScheme."""
    def esc(s):
        return s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    lines = [f"@base <{base}> ."] + [f"@prefix {p}: <{ns}> ." for p, ns in PREFIXES] + [""]
    lines += ["<> a skos:ConceptScheme ;", f'    dct:title "{esc(title)}"@{lang} ;',
              f'    dct:description "{esc(description)}"@{lang} ;',
              f'    dct:created "{created}"^^xsd:date .', ""]
    return "\n".join(lines)


def write_ttl(blocks: DataFrame, path: str, header: str, mode: str = "overwrite") -> None:
    """S9 sink: ``path/header`` (one row) and ``path/concepts`` (blank-line separated blocks)."""
    spark = blocks.sparkSession
    spark.createDataFrame([(header,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/header")
    blocks.select(F.concat("block", F.lit("\n")).alias("value")).write.mode(mode).text(f"{path}/concepts")


def number_rows(df: DataFrame, order_cols: list[str], col: str = "line_no") -> DataFrame:
    """Global 1-based numbering in a total order without a single-task window.

    Rows are range-sorted, tagged with ``monotonically_increasing_id`` (partition
    index in the high bits), checkpointed so the ids stay fixed, and offset by
    the running row count of the preceding partitions (a table with one row
    per partition).
    """
    checkpoint_dir(df.sparkSession)
    tagged = df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_mid", 33)
    counts = tagged.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    offs = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
                         .alias("_off"))
    low = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (tagged.join(F.broadcast(offs), part == F.col("_p"))
                  .withColumn(col, F.coalesce(F.col("_off"), F.lit(0)) + low + 1)
                  .drop("_mid", "_p", "_off"))


def report_lines(issues: DataFrame, order_cols: list[str], text_col: str = "detail",
                 section_col: str = "severity") -> DataFrame:
    """(section, line_no, line): report lines ``{n:4d}. text``, numbered from 1 in every section.

    One global numbering in (section, order); a section's first number (few rows) is taken off.
    """
    numbered = number_rows(issues, [section_col, *order_cols])
    first = numbered.groupBy(section_col).agg(F.min("line_no").alias("_first"))
    n = (F.col("line_no") - F.col("_first") + 1).alias("line_no")
    return (numbered.join(first, section_col).select(section_col, n, text_col)
            .select(section_col, "line_no", F.format_string("%4d. %s", "line_no", text_col).alias("line")))


def write_change_log(changes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S10 sink: numbered change-log lines ``{n:4d}. detail`` in (uri, pos) order, as text part
    files in line order (range-sorted, so every file holds a consecutive run of lines)."""
    lines = number_rows(changes, ["uri", "pos"]).select(
        "line_no", F.format_string("%4d. %s", "line_no", "detail").alias("value"))
    lines.orderBy("line_no").select("value").write.mode(mode).text(path)


def write_validation_report(issues: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S10 sink: violations, then warnings, each numbered from 1 as ``{n:4d}. detail``, as text."""
    lines = report_lines(issues, ["rule", "uri", "detail"])
    lines.orderBy("severity", "line_no").select(F.col("line").alias("value")).write.mode(mode).text(path)

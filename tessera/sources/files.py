"""CSV and JSON sources (S1-S3) and a shared scratch folder for written tables."""

from __future__ import annotations

import codecs
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import checkpoint_dir
from tessera.sources.splits import csv_records, json_records, parse_csv_records

# Separators tried for a CSV file, in order.
CSV_SEPARATORS = [";", ",", "\t", "|"]

# Encodings tried for a CSV file, in order.
CSV_ENCODINGS = ["utf-8", "utf-8-sig", "cp1252", "latin1", "iso-8859-1"]


# Bytes for which cp1252 has no character.
CP1252_UNDEFINED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)

# Quote characters tried for a CSV file, in order; None: no quotes.
CSV_QUOTES = ['"', "'", None]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never machine-local on a cluster)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", multi_line: bool = True) -> DataFrame:
    """CSV with every column a string; names from the header, empty fields null.

    Rows with fewer fields than the header are padded with nulls, rows with more
    are skipped (an empty field behind a last separator is not one more).  Fields may be quoted, hold doubled or backslash-escaped quotes
    and, with ``multi_line`` (the default), line ends; a large file of those is read by many tasks
    (``sources.splits``), which shuffles its records once.  ``multi_line=False`` saves that shuffle for files that
    have no line ends inside quotes.
    """
    windows = codecs.lookup(encoding).name == "cp1252"  # Spark's own reader does not know it; Latin-1 keeps its bytes apart
    r = (spark.read.option("sep", sep).option("encoding", "ISO-8859-1" if windows else encoding).option("quote", '"').option("escape", "\\")
              .option("charToEscapeQuoteEscaping", "\\").option("multiLine", multi_line).option("inferSchema", False)
              .option("unescapedQuoteHandling", "STOP_AT_CLOSING_QUOTE"))
    names = [n.lstrip("\ufeff") for n in r.option("header", True).csv(path).columns]
    if windows:
        names = [n.encode("latin-1").decode("cp1252") for n in names]
    if multi_line or windows:
        return parse_csv_records(csv_records(spark, path, sep, encoding), names, sep)
    # one field more than the header tells an over-long row
    spare = "_over"
    while spare in names:
        spare += "_"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, spare]])
    rows = (r.option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").schema(schema).csv(path))
    return rows.where(F.col(f"`{spare}`").isNull()).select(
        *[F.nullif(F.regexp_replace(F.col(f"`{n}`"), '""', '"'), F.lit("")).alias(n) for n in names])


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with the file name; the order key is kept per file."""
    return (spark.read.text(path)
                 .select(F.col("_metadata.file_name").alias("file"),
                         F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line")))


def csv_dialect_scores(lines: DataFrame, separators: list[str] | None = None, quotes: list[str | None] | None = None) -> DataFrame:
    """Score each candidate separator of each file; pick one per file.

    ``lines`` is (file, line_no, line).  For a separator: columns = fields of
    the header (first line), rows = non-blank data lines with no more fields
    than the header (longer ones are skipped, shorter ones padded); separators
    inside double quotes do not count.  Score = columns x rows, doubled above two
    columns.  Candidates are taken in separator order: a candidate with more than
    one column is accepted when its score beats every earlier accepted one; the
    first accepted one with at least five columns wins at once, else the last
    accepted one.  With ``quotes`` (such as ``CSV_QUOTES``) the candidates are the pairs of a separator and a quote
    character, quotes inside separators, and the result has a column ``quote``.

    Lines are reduced to counts per (file, separator, number of fields) in every
    task before anything is joined, so a file with most of the lines is no hot key.
    """
    seps = separators or CSV_SEPARATORS
    chars = quotes or ['"']

    def plain(q: str | None):
        # what is left of a line without its quoted parts (a doubled quote inside one is part of it)
        return F.col("line") if q is None else F.regexp_replace("line", f"{q}(?:[^{q}]++|{q}{q})*+{q}", "")
    fields = F.array(*[F.struct(F.lit(i * len(chars) + j).alias("k"), F.lit(s).alias("sep"), F.lit(q).cast("string").alias("quote"),
                                (F.length(f"plain{j}") - F.length(F.replace(F.col(f"plain{j}"), F.lit(s), F.lit(""))) + 1).alias("nf"))
                       for i, s in enumerate(seps) for j, q in enumerate(chars)])
    x = lines.select("file", "line_no", (F.trim("line") == "").alias("blank"), *[plain(q).alias(f"plain{j}") for j, q in enumerate(chars)])
    x = x.select("file", "line_no", "blank", F.explode(fields).alias("c"))
    per = x.groupBy("file", F.col("c.k").alias("k"), F.col("c.sep").alias("sep"), F.col("c.quote").alias("quote"), F.col("c.nf").alias("nf")).agg(
        F.min("line_no").alias("first_no"), F.count_if(~F.col("blank")).alias("n"),
        F.min(F.when(~F.col("blank"), F.col("line_no"))).alias("first_full"))
    # bounded windows: one row per number of fields of a (file, separator)
    w_sep = Window.partitionBy("file", "k")
    per = per.withColumn("head_no", F.min("first_no").over(w_sep))
    per = per.withColumn("columns", F.max(F.when(F.col("first_no") == F.col("head_no"), F.col("nf"))).over(w_sep))
    counted = per.groupBy("file", "k", "sep", "quote", "columns").agg(
        F.sum(F.when(F.col("nf") <= F.col("columns"), F.col("n")
                     - F.when(F.col("first_full").eqNullSafe(F.col("head_no")), 1).otherwise(0)).otherwise(0)).alias("rows"))
    score = F.col("columns") * F.col("rows") * F.when(F.col("columns") > 2, 2).otherwise(1)
    s = counted.withColumn("score", score.cast("long"))
    w = Window.partitionBy("file").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    ok = (F.col("columns") > 1) & (F.col("rows") > 0)
    s = s.withColumn("best_before", F.coalesce(F.max(F.when(ok, F.col("score"))).over(w), F.lit(0)))
    s = s.withColumn("accepted", ok & (F.col("score") > F.col("best_before")))
    # bounded windows: one row per candidate separator of a file
    wf = Window.partitionBy("file")
    early = F.min(F.when(F.col("accepted") & (F.col("columns") >= 5), F.col("k"))).over(wf)
    last = F.max(F.when(F.col("accepted"), F.col("k"))).over(wf)
    s = s.withColumn("chosen", F.col("k") == F.coalesce(early, last))
    return s.select("file", "sep", *(["quote"] if quotes else []), "columns", "rows", "score", F.coalesce("chosen", F.lit(False)).alias("chosen"))


def choose_encoding(spark: SparkSession, path: str, encodings: list[str] | None = None) -> DataFrame:
    """(file, encoding): the first candidate under which a file decodes, else null.

    Files are read line by line in parallel: a line feed is no part of a longer UTF-8 sequence, so a file is valid
    where all its lines are.  UTF-8 with a byte order mark is ``utf-8-sig``; cp1252 has no character for five
    bytes, Latin-1 has one for every byte.
    """
    names = encodings or CSV_ENCODINGS
    raw = F.col("value").cast("binary")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.octet_length("value").alias("bytes"),
        F.is_valid_utf8("value").alias("utf8"),
        F.decode(raw, "ISO-8859-1").rlike(f"[{''.join(f'\\x{b:02x}' for b in CP1252_UNDEFINED)}]").alias("undefined"))
    # the reader takes a byte order mark away: its three bytes are missing in the sum of the lines (the last line feed may be, too)
    per = lines.groupBy("file").agg(F.bool_and("utf8").alias("utf8"), F.bool_or("undefined").alias("undefined"),
                                    (F.max("size") - F.sum(F.col("bytes") + 1) >= 2).alias("mark"))
    signed = F.col("mark") if any(codecs.lookup(n).name == "utf-8-sig" for n in names) else F.lit(False)
    accepts = {"utf-8": F.col("utf8") & ~signed, "utf-8-sig": F.col("utf8") & F.col("mark"), "cp1252": ~F.col("undefined"),
               "iso8859-1": F.lit(True), "ascii": F.lit(False)}
    choice = F.lit(None).cast("string")
    for name in reversed(names):
        choice = F.when(accepts[codecs.lookup(name).name], F.lit(name)).otherwise(choice)
    return per.select("file", choice.alias("encoding"))


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Struct columns to dotted names, recursively; arrays and maps are kept as they are."""
    cols = []

    def walk(dtype: T.DataType, path: list[str]) -> None:
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(f.dataType, path + [f.name])
        else:
            ref = ".".join(f"`{p}`" for p in path)
            cols.append(F.col(ref).alias(sep.join(path)))

    walk(df.schema, [])
    return df.select(*cols)


def read_json_flat(spark: SparkSession, path: str, multi_line: bool = False,
                   schema: T.StructType | str | None = None) -> DataFrame:
    """S3: JSON records with nested objects flattened.

    JSON Lines (the default) split across tasks; ``multi_line`` reads lists of objects or one object per file,
    a large list by many tasks (``sources.splits``): its objects are written to the shared folder as JSON
    Lines first.  Without ``schema`` the types are those of all records (Spark merges the types of every
    record in a tree), so such records are read twice.
    """
    if multi_line:
        lines = scratch_path(spark, "json-lines")
        json_records(spark, path).select("record").write.text(lines)
        path = lines
    r = spark.read if schema is None else spark.read.schema(schema)
    return flatten(r.json(path))

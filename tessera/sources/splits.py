"""Quoted CSV and JSON lists read in parallel, file split by file split.

A split may begin inside a quoted field or a string, which its own bytes do not
tell.  So every line is a function of the state in front of it (outside or inside
a quote): it keeps the state, swaps it, or sets it.  Such functions compose to one
of the same kind, so a running composition inside each split, composed with those
of the splits before it, gives the state in front of every line.  Windows are
bounded by a split and by the splits of a file.
"""

from __future__ import annotations

import codecs
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import settled


def decoded(value: Column, encoding: str) -> Column:
    """Text from the bytes of a line; in the single-byte encodings a line feed and the separators are the bytes they are in ASCII."""
    name = codecs.lookup(encoding).name
    if name in ("utf-8", "utf-8-sig", "ascii"):
        return value
    if name not in ("iso8859-1", "cp1252"):
        raise ValueError(f"cannot split files in {encoding}")
    text = F.decode(value.cast("binary"), "ISO-8859-1")
    if name == "cp1252":  # differs from Latin-1 in the bytes 80 to 9f
        other = [(chr(b), c) for b in range(0x80, 0xA0) if (c := bytes([b]).decode(name, "ignore"))]
        text = F.translate(text, "".join(a for a, _ in other), "".join(c for _, c in other))
    return text


def pieces(spark: SparkSession, path, line_sep: str = "\n", encoding: str = "UTF-8") -> DataFrame:
    """(file, split, mid, line): what stands between the separators, in file order of (split, mid)."""
    return spark.read.option("lineSep", line_sep).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("mid"), decoded(F.col("value"), encoding).alias("line"))


def _composed(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Add what the functions of the earlier rows make of a state: ``_v`` (the value they set, or null) and ``_odd`` (swapped since).

    A row's function: ``_set`` (the value it sets, or null) or else ``_swap`` (0 or 1).
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_n", F.coalesce(F.sum("_swap").over(w), F.lit(0)))
    df = df.withColumn("_c", F.last(F.when(F.col("_set").isNotNull(), F.struct(F.col("_set").alias("v"), F.col("_n").alias("n"))),
                                    ignorenulls=True).over(w))
    return df.withColumn("_v", F.col("_c.v")).withColumn("_odd", (F.col("_n") - F.coalesce("_c.n", F.lit(0))) % 2 == 1)


def with_state(lines: DataFrame, from_outside: Column, from_inside: Column) -> DataFrame:
    """Add ``inside``: whether a line begins inside a quote.  The arguments tell whether it ends inside, by how it begins."""
    same = from_outside == from_inside
    own = lines.withColumn("_set", F.when(same, from_outside)).withColumn("_swap", F.when(~same & from_outside, 1).otherwise(0))
    own = _composed(own, ["file", "split"], "mid")
    # the function of a whole split, from its last line that sets the state
    last = F.max_by(F.when(F.col("_set").isNotNull(), F.struct(F.col("_set").alias("v"), F.col("_n").alias("n"))),
                    F.when(F.col("_set").isNotNull(), F.col("mid")))
    per = own.groupBy("file", "split").agg(F.sum("_swap").alias("_t"), last.alias("_l"))
    odd = (F.col("_t") - F.coalesce("_l.n", F.lit(0))) % 2 == 1
    per = per.select("file", "split", F.when(F.col("_l").isNotNull(), F.col("_l.v") != odd).alias("_set"),
                     F.when(F.col("_l").isNull() & odd, 1).otherwise(0).alias("_swap"))
    starts = _composed(per, ["file"], "split").select("file", "split", (F.coalesce("_v", F.lit(False)) != F.col("_odd")).alias("_start"))
    return (own.join(starts, ["file", "split"])
            .withColumn("inside", F.coalesce("_v", "_start") != F.col("_odd"))
            .drop("_set", "_swap", "_n", "_c", "_v", "_odd", "_start"))


def running(df: DataFrame, amount: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over the file's earlier rows, by a two-level sum."""
    w = Window.partitionBy("file", "split").orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_a", amount.cast("long"))
    per = df.groupBy("file", "split").agg(F.sum("_a").alias("_t"))
    before = per.select("file", "split", F.coalesce(F.sum("_t").over(
        Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (df.withColumn("_run", F.coalesce(F.sum("_a").over(w), F.lit(0))).join(before, ["file", "split"])
            .withColumn(name, F.col("_run") + F.col("_off")).drop("_a", "_run", "_off"))


def _joined(df: DataFrame, by: list[str], sep: str, what: str) -> DataFrame:
    """One row per group: its lines in file order.  A group is one record, so it is as large as a value may be."""
    parts = F.array_sort(F.collect_list(F.struct("split", "mid", what)))
    return df.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x[what]), sep).alias("record"))


# ---------------------------------------------------------------- CSV
def _ends_inside(text: Column, sep: str) -> Column:
    """Whether a text that begins outside a quote ends inside one: a field opens a quote that no field closes."""
    s = re.escape(sep)
    rest = F.regexp_replace(text, rf'(?s)(\A|{s})"(?:[^"\\]++|\\.|"")*+"', "$1x")
    return rest.rlike(rf'(?s)(\A|{s})"')


def csv_records(spark: SparkSession, path, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """(file, k, record): the records of CSV files in order, line ends inside quotes kept; blank lines are none.

    A record ends at a line feed outside quotes; a carriage return in front of it belongs to the line end.
    """
    lines = pieces(spark, path, encoding=encoding)
    closing = r'(?s)\A(?:[^"\\]++|\\.|"")*+"'
    behind = F.concat(F.lit("x"), F.regexp_replace("line", closing, ""))
    lines = with_state(lines, _ends_inside(F.col("line"), sep),
                       F.when(F.col("line").rlike(closing), _ends_inside(behind, sep)).otherwise(F.lit(True)))
    # a record is numbered by the record starts up to and including its first line
    numbered = running(lines, ~F.col("inside"), "_before").withColumn("k", F.col("_before") + F.when(F.col("inside"), 0).otherwise(1))
    records = _joined(numbered, ["file", "k"], "\n", "line")
    return records.select("file", "k", F.regexp_replace("record", r"\r\z", "").alias("record")).where(F.trim("record") != "")


def fields_of(record: Column, sep: str) -> Column:
    """The fields of a record.  In a quoted one a doubled quote and an escaped quote or backslash stand for the second character."""
    x = re.escape(sep)
    raw = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(rf'(?s){x}("(?:[^"\\]++|\\.|"")*+"[^{x}]*+|[^{x}]*+)'), F.lit(1))
    quoted = r'(?s)\A"(.*)"([^"]*)\z'
    return F.transform(raw, lambda f: F.when(f.rlike(quoted), F.concat(
        F.regexp_replace(F.regexp_extract(f, quoted, 1), r'\\(["\\])|"(")', "$1$2"), F.regexp_extract(f, quoted, 2))).otherwise(f))


def parse_csv_records(records: DataFrame, names: list[str], sep: str) -> DataFrame:
    """The fields of the records, all strings, without the first record of every file.

    Empty fields are null, missing ones too; a record with more fields than names is skipped, but for an empty one behind the last separator.
    """
    n = len(names)
    head = records.groupBy("file").agg(F.min("k").alias("_head"))
    rows = records.join(head, "file").where("k > _head").select(fields_of(F.col("record"), sep).alias("_f"))
    fits = (F.size("_f") <= n) | ((F.size("_f") == n + 1) & (F.try_element_at("_f", F.lit(n + 1)) == ""))
    return rows.where(fits).select(*[F.nullif(F.get("_f", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(names)])


# ---------------------------------------------------------------- JSON lists
_STRING = r'(?s)"(?:[^"\\]++|\\.)*+(?:"|\z)'
_REST = r'(?s)\A(?:[^"\\]++|\\.)*+(?:"|\z)'


def json_records(spark: SparkSession, path) -> DataFrame:
    """(file, k, record): the objects of files that hold one list of objects, or objects one after the other.

    Files are cut at every ``}``, wherever it stands.  Unescaped quotes tell which cuts lie inside a string, the
    brackets outside strings how deep a cut lies; a record ends where the depth is back to that of the list.
    Every cut is examined once, for a split that begins outside a string and for one that begins inside, and written to the
    shared folder; which of the two holds, and how deep a split begins, follows from the few rows of the splits.
    """
    cut = pieces(spark, path, "}")
    quotes = F.char_length(F.regexp_replace(F.regexp_replace("line", r"(?s)\\.", ""), '[^"]++', ""))
    own = Window.partitionBy("file", "split").orderBy("mid")
    cut = cut.withColumn("_odd", F.sum((quotes % 2).cast("long")).over(own) % 2 == 1).withColumn("_swap", quotes % 2 == 1)

    def change(inside: Column, after: Column) -> Column:
        plain = F.regexp_replace(F.when(inside, F.regexp_replace("line", _REST, "")).otherwise(F.col("line")), _STRING, "")
        opened, closed = (F.char_length(F.regexp_replace(plain, f"[^{c}]++", "")) for c in (r"\[{", r"\]}"))
        # the brace at the cut closes an object unless it stands in a string
        return (opened - closed - F.when(after, 0).otherwise(1)).cast("long")
    after = F.col("_odd")
    begins = after != F.col("_swap")
    cut = cut.withColumn("_out", change(begins, after)).withColumn("_in", change(~begins, ~after))
    cut = settled(cut.select("file", "split", "mid", "line", "_odd", F.sum("_out").over(own).alias("_out"), F.sum("_in").over(own).alias("_in")))

    head = F.ltrim(F.regexp_replace(F.regexp_replace("line", "^\ufeff", ""), r"\A\s++", ""))
    per = cut.groupBy("file", "split").agg(F.max_by(F.struct("_odd", "_out", "_in"), "mid").alias("_l"), F.min_by(head.startswith("["), "mid").alias("_list"))
    files = Window.partitionBy("file").orderBy("split")
    earlier = files.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_inside", F.coalesce(F.sum(F.col("_l._odd").cast("long")).over(earlier), F.lit(0)) % 2 == 1)
    per = per.withColumn("_deep", F.coalesce(F.sum(F.when(F.col("_inside"), F.col("_l._in")).otherwise(F.col("_l._out"))).over(earlier), F.lit(0)))
    # a file that begins with a bracket is a list: its objects end at depth 1
    per = per.select("file", "split", "_inside", "_deep", F.first("_list").over(files).cast("long").alias("_base"))
    cut = cut.join(per, ["file", "split"])
    ends = ((F.col("_odd") == F.col("_inside"))
            & (F.col("_deep") + F.when(F.col("_inside"), F.col("_in")).otherwise(F.col("_out")) == F.col("_base")))
    numbered = running(cut.select("file", "split", "mid", "line", ends.alias("_ends")), F.col("_ends"), "k").select("file", "split", "mid", "k", "line")
    records = _joined(numbered, ["file", "k"], "}", "line")
    # what stands in front of an object: the opening bracket, commas, white space, items that are no objects
    return (records.select("file", "k", F.concat(F.regexp_replace(F.regexp_extract("record", r"(?s)\A[^{]*+(\{.*)\z", 1), r"[\r\n]++", " "),
                                                 F.lit("}")).alias("record")).where("record <> '}'"))

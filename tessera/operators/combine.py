"""Joining, stacking and de-duplicating source tables.

Keep-first / keep-last are ``min_by`` / ``max_by`` aggregates over an explicit
position column: they combine map-side, so a key shared by a third of the
rows is reduced in every task before the shuffle instead of being sorted in
one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Candidate key columns for keep-first de-duplication, in the two
# orders the reference uses (combiner / application).
DEDUPE_KEYS = ["uri", "id", "conceptUri", "identifier", "uuid"]
DEDUPE_KEYS_APP = ["conceptUri", "uri", "id"]


# ---------------------------------------------------------------- J1
def _suffix_clashes(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    for c in clash:
        right = right.withColumnRenamed(c, f"{c}{suffix}")
    return right


#: Keys looked at per source, values the sketch tracks, and the least share of a source's rows that makes a key hot.
HOT_KEYS, HOT_TRACKED, HOT_SHARE = 200, 20_000, 0.001
#: Most copies that a hot key's rows on the other side are given; groups over which rows with a null key are spread.
MOST_SALTS, NULL_GROUPS = 1024, 4096


def hot_keys(sources: list[DataFrame], key: str) -> list[dict[str, int]]:
    """Per source: key (as text) -> how many partitions' worth of rows it has, for keys above four.

    One job over the key columns; a frequent-items sketch per source, merged from all tasks.
    """
    spark = sources[0].sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = reduce(DataFrame.union, [df.select(F.lit(i).alias("i"), F.col(key).cast("string").alias("k")) for i, df in enumerate(sources)])
    top = keys.where("k is not null").groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(k, {HOT_KEYS}, {HOT_TRACKED})").alias("top"))
    out: list[dict[str, int]] = [{} for _ in sources]
    for i, n, items in top.collect():  # at most HOT_KEYS values a source
        out[i] = {x["item"]: min(MOST_SALTS, -(-x["count"] * partitions // n)) for x in items if x["count"] > max(4 / partitions, HOT_SHARE) * n}
    return out


def _salted(df: DataFrame, key: str, side: int, hot: DataFrame | None) -> DataFrame:
    """Add ``_salt``: rows of a key that is hot on this side and rows without a key are spread by their content, rows of a key
    that is hot on the other side are repeated for every salt of it."""
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    nulls = F.when(F.col(f"`{key}`").isNull(), F.pmod(spread, F.lit(NULL_GROUPS))).otherwise(0).cast("int")
    if hot is None:
        return df.withColumn("_salt", nulls)
    out = df.join(F.broadcast(hot), F.col(f"`{key}`").cast("string") == F.col("_hot"), "left")
    salts = (F.when(F.col("_side") == side, F.array(F.pmod(spread, F.col("_salts")).cast("int")))
             .when(F.col("_side").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(nulls)))
    return out.withColumn("_salt", F.explode(salts)).withColumn(f"_in{side}", F.lit(True)).drop("_hot", "_salts", "_side")


def join_pair(left: DataFrame, right: DataFrame, key: str, how: str = "outer", suffix: str = "_right",
              null_keys: str = "keep", hot: list[dict[str, int]] | None = None) -> DataFrame:
    """Join on a same-name key; clashing right columns get ``suffix``; key coalesced.

    null_keys: 'keep' (null never matches; rows stay, SQL semantics, and are spread over the partitions),
    'drop' (null-key rows removed first), 'match' (null matches null, the
    pandas behaviour; the null group then joins all-pairs, so use it only
    where null keys are known to be few).

    Adaptive execution cannot split a full outer join.  There, rows of a hot key are spread over salts and the other side's
    rows of that key are repeated for every salt; a repeated row that meets nothing in its salt is no outer row,
    as its key is known to be on the hot side.  ``hot``: the keys of both sides from ``hot_keys``, if known.
    """
    right = _suffix_clashes(left, right, [key], suffix)
    if null_keys == "drop":
        left, right = left.where(F.col(key).isNotNull()), right.where(F.col(key).isNotNull())
    if null_keys != "match":
        if how not in ("outer", "full", "full_outer"):
            return _salted(left, key, 0, None).join(_salted(right, key, 1, None), on=[key, "_salt"], how=how).drop("_salt")
        hot = hot_keys([left, right], key) if hot is None else hot
        sides = {k: (0 if hot[0].get(k, 0) >= hot[1].get(k, 0) else 1, max(h.get(k, 0) for h in hot)) for h in hot for k in h}
        if not sides:
            return _salted(left, key, 0, None).join(_salted(right, key, 1, None), on=[key, "_salt"], how=how).drop("_salt")
        table = left.sparkSession.createDataFrame([(k, s, n) for k, (s, n) in sides.items()], "_hot string, _side int, _salts int")
        a, b = _salted(left, key, 0, table), _salted(right, key, 1, table)
        out = a.join(b, on=[key, "_salt"], how=how).drop("_salt")
        out = out.join(F.broadcast(table), F.col(f"`{key}`").cast("string") == F.col("_hot"), "left")
        # the hot side has the key: a row of the other side without a partner is a copy whose salt happens to be empty
        lost = ((F.col("_side") == 0) & F.col("_in0").isNull()) | ((F.col("_side") == 1) & F.col("_in1").isNull())
        return out.where(~F.coalesce(lost, F.lit(False))).drop("_hot", "_side", "_salts", "_in0", "_in1")
    r = right.withColumnRenamed(key, "__rkey")
    j = left.join(r, left[key].eqNullSafe(r["__rkey"]), how)
    cols = [F.coalesce(left[key], r["__rkey"]).alias(key)] + \
           [left[c] for c in left.columns if c != key] + [r[c] for c in r.columns if c != "__rkey"]
    return j.select(*cols)


def distributed_join(sources: list[tuple[str, DataFrame]], key: str, how: str = "outer",
                     null_keys: str = "keep") -> DataFrame:
    """Fold of key joins over (name, frame) pairs; suffix = '_' + file stem.

    Hot keys are looked up once, in all sources: an outer join keeps every key, so those of the earlier sources are
    keys of the left side of each step.
    """
    name0, result = sources[0]
    joined = [x for x in sources[1:] if key in result.columns and key in x[1].columns]
    full = how in ("outer", "full", "full_outer") and null_keys != "match" and bool(joined)
    hot = hot_keys([result, *[df for _, df in joined]], key) if full else None
    left = dict(hot[0]) if full else {}
    for i, (name, df) in enumerate(joined, 1):
        result = join_pair(result, df, key, how, f"_{name.split('.')[0]}", null_keys, [left, hot[i]] if full else None)
        if full:
            left = {k: max(left.get(k, 0), hot[i].get(k, 0)) for k in {*left, *hot[i]}}
    return result


# ---------------------------------------------------------------- J2
def merge_with_join_keys(sources: list[tuple[str, DataFrame, str]]) -> tuple[DataFrame, DataFrame]:
    """Left joins of the first source with each other one on its own key column.

    Returns (merged, counts); counts has one row per merged source:
    (source, matched, before) with matched = rows whose right key is present
    after that merge and before = rows before it.  The counts come from the
    number of rows per key in every source, not from the joins themselves.
    """
    name0, merged, key0 = sources[0]
    per_key = merged.groupBy(F.col(key0).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    rows, parts = F.col("_n"), []
    for i, (name, df, key) in enumerate(sources[1:]):
        if key0 not in merged.columns or key not in df.columns:
            continue
        own = (df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_k{i}")).agg(F.count(F.lit(1)).alias(f"_n{i}")))
        per_key = per_key.join(own, per_key["_k"] == own[f"_k{i}"], "left")
        hit = F.coalesce(F.col(f"_n{i}"), F.lit(0))
        parts.append(F.struct(F.lit(name).alias("source"), F.coalesce(F.sum(rows * hit), F.lit(0)).alias("matched"),
                              F.coalesce(F.sum(rows), F.lit(0)).alias("before")))
        rows = rows * F.greatest(hit, F.lit(1))
        right = _suffix_clashes(merged, df, [], f"_{name.split('(')[0].strip()}")
        rkey = key if key in right.columns else f"{key}_{name.split('(')[0].strip()}"
        merged = merged.join(right, merged[key0] == right[rkey], "left")
    return merged, per_key.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


# ---------------------------------------------------------------- J3, J4
def append_new_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """A plus the rows of b whose (non-null) key does not occur in a."""
    ka = a.select(F.col(key).alias("__k")).where(F.col("__k").isNotNull()).distinct()
    new = b.where(F.col(key).isNotNull()).join(ka, F.col(key) == F.col("__k"), "left_anti")
    return a.unionByName(new, allowMissingColumns=True)


def merge_or_concat(a: DataFrame, b: DataFrame, key: str, suffix: str = "_right") -> tuple[str, DataFrame]:
    """Outer merge on key when both sides have it, else a column-aligned stack."""
    if key in a.columns and key in b.columns:
        return "merge", join_pair(a, b, key, "outer", suffix)
    return "concat", a.unionByName(b, allowMissingColumns=True)


# ---------------------------------------------------------------- J5
def normalise_join_key(c: str | Column, base: str | None = None) -> Column:
    """Http URIs -> last path segment (params cut) or else the fragment;
    values starting with ``base`` lose it and leading slashes; others unchanged."""
    s = (F.col(c) if isinstance(c, str) else c).cast("string")
    path = F.regexp_extract(s, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    last = F.regexp_extract(path, r"([^/;]*)(?:;[^/]*)?$", 1)
    frag = F.regexp_extract(s, r"^[^#]*#(.*)$", 1)
    http = F.when(last != "", last).otherwise(frag)
    out = F.when(s.startswith("http"), http)
    if base:
        out = out.when(s.startswith(base), F.regexp_replace(F.substring(s, len(base) + 1, 1 << 30), "^/+", ""))
    return out.otherwise(s)


# ---------------------------------------------------------------- J6, J7, J8
def join_key_profile(sources: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Per source: total rows, non-null keys, distinct keys, null percentage."""
    frames = [df.agg(F.count("*").alias("total_values"), F.count(F.col(key)).alias("non_null_values"),
                     F.count_distinct(F.col(key)).alias("unique_values"))
                .select(F.lit(name).alias("source"), "*") for name, df in sources if key in df.columns]
    p = reduce(DataFrame.unionByName, frames)
    return p.withColumn("null_percentage",
                        F.round((F.col("total_values") - F.col("non_null_values")) * 100.0
                                / F.col("total_values"), 6))


def join_key_overlap(primary: DataFrame, others: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Distinct key strings shared with the primary source, count and % (warning < 10 %).

    One left join per source: the primary key count and the overlap come out
    of the same aggregate.
    """
    pk = primary.select(F.col(key).cast("string").alias("k")).where(F.col("k").isNotNull()).distinct()
    rows = []
    for name, df in others:
        ok = (df.select(F.col(key).cast("string").alias("k2")).where(F.col("k2").isNotNull()).distinct())
        rows.append(pk.join(ok, pk.k == ok.k2, "left")
                      .agg(F.count("*").alias("n_primary"), F.count("k2").alias("overlap_count"))
                      .select(F.lit(name).alias("source"), "n_primary", "overlap_count"))
    o = reduce(DataFrame.unionByName, rows)
    pct = F.when(F.col("n_primary") > 0, F.col("overlap_count") * 100.0 / F.col("n_primary")).otherwise(F.lit(0.0))
    return o.select("source", "overlap_count", F.round(pct, 6).alias("overlap_percentage"),
                    (pct < 10).alias("low_overlap"))


def combination_stats(inputs: list[tuple[str, DataFrame]], output: DataFrame) -> DataFrame:
    """One row per input file (rows, columns) with the totals and the loss %.

    The per-file counts are one-row aggregates; the totals are a window over
    that table of len(inputs) + 1 rows.
    """
    from pyspark.sql import Window
    per = reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("file"), "rows",
                                                  F.lit(len(df.columns)).alias("columns"))
        for name, df in inputs] + [
        output.agg(F.count("*").alias("rows")).select(F.lit(None).cast("string").alias("file"), "rows",
                                                      F.lit(len(output.columns)).alias("columns"))])
    w = Window.partitionBy(F.lit(0))
    all_cols = set().union(*[set(df.columns) for _, df in inputs])
    t = (per.withColumn("input_files", F.count("file").over(w))
            .withColumn("input_total_rows", F.sum(F.when(F.col("file").isNotNull(), F.col("rows"))).over(w))
            .withColumn("output_rows", F.max(F.when(F.col("file").isNull(), F.col("rows"))).over(w))
            .where(F.col("file").isNotNull()))
    loss = F.when(F.col("input_total_rows") > 0, (F.col("input_total_rows") - F.col("output_rows")) * 100.0
                  / F.col("input_total_rows")).otherwise(F.lit(0.0))
    return t.select("file", "rows", "columns", "input_files", "input_total_rows", "output_rows",
                    F.round(loss, 6).alias("data_loss_percentage"),
                    F.lit(len(output.columns) - len(all_cols)).alias("columns_added"))


# ---------------------------------------------------------------- J14
def priority_merge(sources: list[tuple[str, DataFrame, int]], key: str, pos_col: str = "pos") -> DataFrame:
    """Union of sources; per key the row of the highest priority wins (then the first position)."""
    u = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True),
               [df.withColumn("_prio", F.lit(p)) for _, df, p in sources])
    cols = [c for c in u.columns if c != key]
    best = u.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col("_prio"), -F.col(pos_col))).alias("r"))
    return best.select(key, *[F.col("r")[c].alias(c) for c in cols if c != "_prio"])


# ---------------------------------------------------------------- C1-C5
def concat_aligned(frames: list[DataFrame]) -> DataFrame:
    """Column-aligned stack; columns missing in a frame are null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def dedupe_key(df: DataFrame, order: list[str] | None = None) -> str | None:
    """First present candidate key column (schema test only)."""
    for k in order or DEDUPE_KEYS:
        if k in df.columns:
            return k
    return None


def dedupe_keep_first(df: DataFrame, key: str | None = None, pos_col: str = "pos",
                      last: bool = False) -> DataFrame:
    """One row per key, the first (or last) by position.

    Null keys form one group (the pandas behaviour).  Without any key column
    the whole row is the key (C4).
    """
    key = key or dedupe_key(df)
    if key is None:
        return dedupe_rows(df, exclude=[pos_col])
    cols = [c for c in df.columns if c != key]
    agg = F.max_by if last else F.min_by
    return (df.groupBy(key).agg(agg(F.struct(*cols), pos_col).alias("r"))
              .select(key, *[F.col("r")[c].alias(c) for c in cols]))


def dedupe_rows(df: DataFrame, exclude: list[str] | None = None, pos_col: str = "pos") -> DataFrame:
    """C4: whole-row duplicates removed; ``exclude`` columns (source, position) are not compared.

    The first row (by position) of each group keeps its excluded values.
    """
    exclude = [c for c in (exclude or []) if c in df.columns]
    same = [c for c in df.columns if c not in exclude]
    if not exclude:
        return df.dropDuplicates()
    order = pos_col if pos_col in df.columns else exclude[0]
    return (df.groupBy(*same).agg(F.min_by(F.struct(*exclude), order).alias("r"))
              .select(*same, *[F.col("r")[c].alias(c) for c in exclude]))


def concat_dedupe(sources: list[tuple[str, DataFrame]], remove_duplicates: bool = True,
                  pos_col: str = "pos") -> DataFrame:
    """Stack with a ``_source_file`` column, then keep-first on the first present key.

    Positions are made global as a struct (source index, row position), which no row number can overflow.
    """
    frames = [df.withColumn("_source_file", F.lit(name))
                .withColumn(pos_col, F.struct(F.lit(i).alias("source"), F.col(pos_col).cast("long").alias("row")))
              for i, (name, df) in enumerate(sources)]
    u = concat_aligned(frames)
    if not remove_duplicates:
        return u
    key = dedupe_key(u, ["uri", "id", "conceptUri", "identifier"])
    if key:
        return dedupe_keep_first(u, key, pos_col)
    return dedupe_rows(u, exclude=["_source_file", pos_col], pos_col=pos_col)


def dedupe_merge_properties(df: DataFrame, key: str, exclude: tuple[str, ...] = ("pos",)) -> DataFrame:
    """C5 merge_properties: per key the distinct non-null values of every other column, as
    long rows (key, property, value).

    The merged record of a key is the set of its rows here; a key shared by a
    third of the table is reduced by a distinct aggregate in every task and is
    never packed into one cell.
    """
    cols = [c for c in df.columns if c != key and c not in exclude]
    long = df.select(F.col(key), F.explode(F.array(*[
        F.struct(F.lit(c).alias("property"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols]))
        .alias("x")).select(key, "x.property", "x.value")
    return long.where(F.col("value").isNotNull()).distinct()


# ---------------------------------------------------------------- C8, C9
def key_intersect(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct rows of ``cols`` present in both."""
    return a.select(*cols).intersect(b.select(*cols))


def key_except(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct rows of ``cols`` in ``a`` but not in ``b``."""
    return a.select(*cols).subtract(b.select(*cols))

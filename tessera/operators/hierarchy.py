"""Broader/narrower hierarchies as edge tables ``(child, parent)``.

Every derivation is an equi-join or an aggregate; none scans the table once
per row.  Recursive questions (cycles, closure) run a bounded number of join
rounds, each cut from the lineage with ``checkpoint()``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import closure_by_doubling
from tessera.session import checkpoint_dir, settled


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _num(c: str | Column) -> Column:
    """pandas ``to_numeric(errors='coerce')``: bad values become null."""
    return _s(c).try_cast("double")


# ---------------------------------------------------------------- H1, H7
def edges_from_parent(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """H1: one edge per row whose parent is present and not blank."""
    p = _s(parent_col)
    return (df.where(~_blank(p))
              .select(_s(id_col).alias("child"), p.alias("parent")))


def concepts_of(df: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """H1: concept set = ids of the table plus every referenced parent."""
    return (df.select(_s(id_col).alias("concept"))
              .unionByName(edges.select(F.col("parent").alias("concept")))
              .distinct())


def edges_from_pairs(df: DataFrame, child_col: str = "child", parent_col: str = "parent") -> DataFrame:
    """H7: a separate hierarchy file of (child, parent) pairs."""
    c, p = _s(child_col), _s(parent_col)
    return df.where((c.isNotNull() & (c != "")) & (p.isNotNull() & (p != ""))).select(
        c.alias("child"), p.alias("parent"))


# ---------------------------------------------------------------- H2, H6
#: Rows up to which a per-level table is broadcast: levels are few, so rows are not shuffled by them.
BROADCAST_LEVELS = 10_000


def _if_small(per_level: DataFrame) -> DataFrame:
    """Broadcast hint for a table with a row per level, given only after counting it; worked out once."""
    per_level = settled(per_level)
    return F.broadcast(per_level) if per_level.limit(BROADCAST_LEVELS + 1).count() <= BROADCAST_LEVELS else per_level


def edges_from_level(df: DataFrame, id_col: str = "id", level_col: str = "level") -> DataFrame:
    """H2: rows sorted by (level, id); each row hangs under the last row of level-1.

    The "last row" of a level is ``max(id)``, a partial aggregate, so a level
    holding most of the rows costs no more than any other.
    """
    base = df.select(_s(id_col).alias("child"), _num(level_col).alias("level")).where(
        F.col("level").isNotNull())
    last = base.groupBy("level").agg(F.max("child").alias("parent"))
    return (base.where(F.col("level") > 1)
                .join(_if_small(last.withColumnRenamed("level", "plevel")), F.col("level") - 1 == F.col("plevel"))
                .select("child", "parent"))


def edges_from_level_first(df: DataFrame, id_col: str = "id", level_col: str = "level",
                           pos_col: str = "pos") -> DataFrame:
    """H6: parent = first row (input order) at level-1; level-1 must be > 0."""
    base = df.select(_s(id_col).alias("child"), _num(level_col).alias("level"), F.col(pos_col).alias("pos"))
    first = (base.where(F.col("level").isNotNull()).groupBy("level")
                 .agg(F.min_by("child", "pos").alias("parent")))
    return (base.where(F.col("level") - 1 > 0)
                .join(_if_small(first.withColumnRenamed("level", "plevel")), F.col("level") - 1 == F.col("plevel"))
                .select("child", "parent"))


# ---------------------------------------------------------------- H3
def edges_from_prefix(df: DataFrame, id_col: str = "id", level_col: str = "level") -> DataFrame:
    """H3: parent = the longest id of level-1 that is a prefix of the id.

    Rewritten from a theta join to an equi-join: the id lengths found at each
    level form a tiny table; every child is paired with the lengths of its
    parent level, cut to that prefix, and equi-joined on (level, prefix).
    """
    base = (df.select(F.trim(_s(id_col)).alias("id"), _num(level_col).alias("level"))
              .where(F.col("id").isNotNull() & F.col("level").isNotNull()))
    parents = base.select(F.col("level").alias("plevel"), F.col("id").alias("parent")).distinct()
    lengths = parents.select("plevel", F.length("parent").alias("plen")).distinct()
    kids = base.where(F.col("level") > 1).select(F.col("id").alias("child"), "level").distinct()
    cand = (kids.join(_if_small(lengths), (F.col("level") - 1 == F.col("plevel"))
                      & (F.col("plen") <= F.length("child")))
                .select("child", "plevel", "plen",
                        F.substring("child", 1, F.col("plen")).alias("prefix")))
    hit = cand.join(parents, (cand.plevel == parents.plevel) & (cand.prefix == parents.parent))
    return (hit.groupBy("child").agg(F.max_by("parent", "plen").alias("parent")))


# ---------------------------------------------------------------- H4, H5
def edges_from_path(df: DataFrame, id_col: str = "id", path_col: str = "path", sep: str = "/",
                    pos_col: str = "pos") -> DataFrame:
    """H4: parent = row whose path equals all but the last part (last duplicate wins)."""
    parts = F.filter(F.transform(F.split(_s(path_col), _re_quote(sep)), lambda x: F.trim(x)),
                     lambda x: x != "")
    base = df.select(_s(id_col).alias("child"), F.array_join(parts, sep).alias("path"),
                     F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))).alias("pparts"),
                     F.size(parts).alias("n"), F.col(pos_col).alias("pos"))
    owner = base.groupBy("path").agg(F.max_by("child", "pos").alias("parent"))
    kids = base.where(F.col("n") > 1).select("child", F.array_join("pparts", sep).alias("ppath"))
    return (kids.join(owner, kids.ppath == owner.path)
                .where(F.col("parent") != F.col("child"))
                .select("child", "parent"))


def _re_quote(s: str) -> str:
    import re
    return re.escape(s)


def edges_from_notation(df: DataFrame, id_col: str = "id", notation_col: str = "notation",
                        pos_col: str = "pos") -> DataFrame:
    """H5: dotted notation "1.2.3" is a child of "1.2"; first row holding a notation wins."""
    n = _s(notation_col)
    base = df.select(_s(id_col).alias("child"), n.alias("notation"), F.col(pos_col).alias("pos"))
    owner = base.groupBy("notation").agg(F.min_by("child", "pos").alias("parent"))
    kids = (base.where(F.col("notation").contains("."))
                .select("child", F.regexp_replace("notation", r"\.[^.]*$", "").alias("pnotation")))
    return kids.join(owner, kids.pnotation == owner.notation).select("child", "parent")


# ---------------------------------------------------------------- H8, H9
def edges_from_skos(relations: DataFrame) -> DataFrame:
    """H8: broader statements (last per concept wins) plus reversed narrower ones.

    ``relations`` is the long table (uri, prop, target, pos).
    """
    broader = (relations.where(F.col("prop") == "broader").groupBy("uri")
                        .agg(F.max_by("target", "pos").alias("parent"))
                        .select(F.col("uri").alias("child"), "parent"))
    narrower = (relations.where(F.col("prop") == "narrower")
                         .select(F.col("target").alias("child"), F.col("uri").alias("parent")))
    return broader.unionByName(narrower).distinct()


# Exact lower-case column names that hold a hierarchy.
LEVEL_FIELDS = ["level", "depth", "tier", "ebene", "stufe", "hierarchy_level", "classification_level", "taxonomic_level", "rang"]
PARENT_FIELDS = ["parent", "parentid", "parent_id", "broader", "broaderid", "broader_id", "super", "superid", "category",
                 "categoryid", "übergeordnet", "parent_code", "parent_key"]
PATH_FIELDS = ["path", "hierarchy_path", "classification_path", "breadcrumb", "pfad", "hierarchie_pfad"]


def extract_hierarchy(df: DataFrame | None = None, relations: DataFrame | None = None,
                      pairs: DataFrame | None = None, id_col: str = "id") -> tuple[str, DataFrame]:
    """H9: the first source that has edges, in the order SKOS, level, parent, path, pairs file.

    A source without a single edge is passed over (one existence test each, no
    full evaluation); if none has an edge the last candidate is returned empty.
    """
    cand: list[tuple[str, DataFrame]] = []
    if relations is not None:
        cand.append(("skos", edges_from_skos(relations)))
    if df is not None:
        cols = {c.lower(): c for c in df.columns}
        for name, fields, fn in (("level", LEVEL_FIELDS, edges_from_level), ("parent", PARENT_FIELDS, edges_from_parent),
                                 ("path", PATH_FIELDS, edges_from_path)):
            found = next((cols[k] for k in fields if k in cols), None)
            if found is not None:
                cand.append((name, fn(df, id_col, found)))
    if pairs is not None:
        cand.append(("file", edges_from_pairs(pairs)))
    if not cand:
        raise ValueError("no hierarchy source found")
    return next((c for c in cand[:-1] if not c[1].isEmpty()), cand[-1])


# ---------------------------------------------------------------- H10, J13
def narrower_lists(edges: DataFrame) -> DataFrame:
    """Children per parent, kept long: (parent, child, n_children).

    The list of a parent can be as large as the table, so it is never
    gathered into one row; the count is a partial aggregate joined back.
    """
    e = edges.select("parent", "child").distinct()
    counts = e.groupBy("parent").agg(F.count("*").alias("n_children"))
    return e.join(counts, "parent")


# ---------------------------------------------------------------- H11, H13, H15, H16
def missing_parents(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """Rows whose non-blank parent is not an id of the table."""
    ids = df.select(_s(id_col).alias("pid")).distinct()
    e = edges_from_parent(df, id_col, parent_col)
    return (e.join(ids, e.parent == ids.pid, "left_anti")
             .select(F.col("child").alias("concept_id"), F.col("parent").alias("missing_parent")))


def mutual_broader(edges: DataFrame) -> DataFrame:
    """(a, b) where (b, a) is also an edge; self loops pair with themselves."""
    e = edges.select("child", "parent").distinct()
    r = e.select(F.col("child").alias("r_child"), F.col("parent").alias("r_parent"))
    return (e.join(r, (e.child == r.r_parent) & (e.parent == r.r_child), "left_semi")
             .select(F.col("child").alias("source"), F.col("parent").alias("target")))


def top_concepts(df: DataFrame, id_col: str = "id", broader_col: str = "parent_id") -> DataFrame:
    """Concepts whose broader value is missing or blank."""
    return df.where(_blank(_s(broader_col))).select(_s(id_col).alias("concept"))


def orphans(df: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """Concepts that are neither a child nor a parent of any edge."""
    ids = df.select(_s(id_col).alias("concept")).distinct()
    kids = edges.select(F.col("child").alias("k"))
    pars = edges.select(F.col("parent").alias("p"))
    return (ids.join(kids, ids.concept == kids.k, "left_anti")
               .join(pars, F.col("concept") == pars.p, "left_anti"))


# ---------------------------------------------------------------- H17
def hierarchy_stats(df: DataFrame, id_col: str = "id", broader_col: str = "parent_id",
                    level_col: str = "level") -> DataFrame:
    """Total, top-level, concepts with children, max level (one row).

    "With children" counts rows whose id is the parent of at least one row.
    """
    b = _s(broader_col)
    with_kids = (df.where(~_blank(b)).select(b.alias("pid")).distinct())
    flagged = df.join(with_kids, _s(id_col) == with_kids.pid, "left")
    return flagged.agg(
        F.count("*").alias("total_concepts"),
        F.count_if(_blank(b)).alias("top_level_concepts"),
        F.count_if(F.col("pid").isNotNull()).alias("concepts_with_children"),
        F.max(_num(level_col)).alias("max_depth"))


# ---------------------------------------------------------------- H18
def relations_to_triples(edges: DataFrame, base: str = "") -> DataFrame:
    """One ``<child> skos:broader <parent> .`` line per edge."""
    def uri(c):
        return F.when(F.col(c).startswith("http"), F.col(c)).otherwise(F.concat(F.lit(base), F.col(c)))
    return edges.select("child", "parent",
                        F.concat(F.lit("<"), uri("child"), F.lit("> skos:broader <"), uri("parent"),
                                 F.lit("> .")).alias("triple"))


# ---------------------------------------------------------------- H12
def _parent_pointers(df: DataFrame, id_col: str, parent_col: str, pos_col: str | None) -> DataFrame:
    """One parent per id (the first row of a repeated id); blank parents are none."""
    p = _s(parent_col)
    rows = df.select(_s(id_col).alias("node"),
                     F.when(_blank(p), F.lit(None)).otherwise(p).alias("ptr"),
                     (F.col(pos_col) if pos_col else F.lit(0)).alias("pos"))
    one = rows.groupBy("node").agg(F.min_by(F.struct("ptr"), "pos").getField("ptr").alias("ptr"))
    # a pointer to an id that is not a row ends the chain
    ids = one.select(F.col("node").alias("known"))
    return (one.join(ids, one.ptr == ids.known, "left")
               .select("node", F.when(F.col("known").isNotNull(), F.col("ptr")).alias("ptr")))


def circular_references(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id",
                        pos_col: str | None = "pos", spark: SparkSession | None = None) -> DataFrame:
    """Ids whose ancestor chain never ends (in a cycle or leading into one).

    Pointer doubling: after round k each pointer is the 2^k-th ancestor.  A
    chain of length L ends by round ceil(log2(L+1)); the number of live
    pointers can only fall, and a round in which none falls proves that all
    remaining ones loop for ever (a longer chain always has a member whose
    remaining length lies in the round's range).  Rounds are O(log depth).
    """
    spark = spark or df.sparkSession
    checkpoint_dir(spark)
    ptr = _parent_pointers(df, id_col, parent_col, pos_col).where(F.col("ptr").isNotNull())
    ptr = ptr.checkpoint()
    live = ptr.count()
    while live:
        nxt = ptr.alias("a").join(ptr.alias("b"), F.col("a.ptr") == F.col("b.node"), "inner") \
                 .select(F.col("a.node").alias("node"), F.col("b.ptr").alias("ptr"))
        nxt = nxt.checkpoint()
        n = nxt.count()
        ptr = nxt
        if n == live:
            break
        live = n
    return ptr.select(F.col("node").alias("concept_id"))


# ---------------------------------------------------------------- H14
def transitive_closure(edges: DataFrame) -> DataFrame:
    """All (child, ancestor) pairs by path doubling (``operators.graph``); terminates on cycles."""
    return closure_by_doubling(edges)


# ---------------------------------------------------------------- H2b
DEPTHS_PER_PASS = 64


def edges_from_outline(df: DataFrame, id_col: str = "id", level_col: str = "level", order_col: str = "pos",
                       group_col: str | None = None, block: int = 100000) -> DataFrame:
    """Document-order stack: parent = nearest preceding row of level-1 with no shallower row
    in between (per group, e.g. per file).

    Equivalently the last preceding row with level <= L-1, kept when its level is exactly L-1.
    Rows are numbered densely in (group, order); for every depth k the last earlier position
    with level <= k is found inside blocks of ``block`` rows by bounded windows and carried
    across blocks through a per-block summary, so no window spans a whole group.  Depths are
    taken ``DEPTHS_PER_PASS`` at a time over the numbered rows, so any depth is allowed.
    """
    from pyspark.sql import Window
    from tessera.sources.ttl import number_rows

    g = F.col(group_col) if group_col else F.lit("")
    base = df.select(g.cast("string").alias("grp"), _s(id_col).alias("node"),
                     _num(level_col).cast("int").alias("level"), F.col(order_col).alias("ord"))
    depth = base.agg(F.max("level")).collect()[0][0] or 1
    num = number_rows(base, ["grp", "ord", "node"], "i").withColumn("blk", F.floor(F.col("i") / block))
    w_in = Window.partitionBy("grp", "blk").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    w_blk = Window.partitionBy("grp").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    owners = num.select(F.col("grp").alias("og"), F.col("i").alias("oi"), F.col("node").alias("parent"),
                        F.col("level").alias("plevel"))

    def one_pass(ks: list[int]) -> DataFrame:
        inner = num.select("grp", "node", "level", "i", "blk",
                           *[F.last(F.when(F.col("level") <= k, F.col("i")), ignorenulls=True).over(w_in).alias(f"in{k}")
                             for k in ks])
        summ = num.groupBy("grp", "blk").agg(*[F.max(F.when(F.col("level") <= k, F.col("i"))).alias(f"b{k}") for k in ks])
        carry = summ.select("grp", "blk", *[F.max(f"b{k}").over(w_blk).alias(f"c{k}") for k in ks])
        prev = inner.where((F.col("level") > ks[0]) & (F.col("level") <= ks[-1] + 1)).join(carry, ["grp", "blk"], "left")
        last = F.array(*[F.coalesce(F.col(f"in{k}"), F.col(f"c{k}")) for k in ks])
        kids = prev.select("grp", "node", "level", F.try_element_at(last, F.col("level") - ks[0]).alias("pi"))
        hit = kids.join(owners, (kids.grp == owners.og) & (kids.pi == owners.oi))
        return hit.where(F.col("plevel") == F.col("level") - 1).select(F.col("node").alias("child"), "parent")

    passes = [list(range(k, min(k + DEPTHS_PER_PASS, depth))) for k in range(1, depth, DEPTHS_PER_PASS)]
    if not passes:
        return owners.where(F.lit(False)).select(F.col("parent").alias("child"), "parent")
    return reduce(DataFrame.unionByName, [one_pass(ks) for ks in passes])

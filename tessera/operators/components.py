"""Connected components of an edge table, by contraction.

Each round every node joins the neighbour (or itself) that comes first in a random order drawn anew, and the
nodes that were joined are the nodes of the next, smaller graph.  A round at least halves long chains, whatever the
order of their labels, and a star or clique is gone after one, so all rounds together read little more than the first and
their number grows with the logarithm of the graph.  Names are replaced by numbers before
the rounds (``coded``).  Minima are combined map-side, and adaptive execution can split a hot node
in the joins (``skew.join_reduced``).
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.operators.skew import join_reduced
from tessera.session import dropped, settled


def coded(edges: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """The different edges (a, b) with numbers instead of names, and (id, name) of all nodes, from settled tables.

    Edges with a null end are left out; ``dropped`` deletes the files of both.  A number is a hash of the name.  Different names with one hash are seen in ``name`` and lead to another
    seed; where every seed has such names (to be expected above some billions of nodes), the names themselves are kept.
    """
    ends = settled(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b).distinct())
    every = settled(ends.select(F.explode(F.array(a, b)).alias("name")).distinct())

    def part(table: DataFrame, *columns: Column) -> DataFrame:
        out = table.select(*columns)
        out._settled_path = table._settled_path
        return out
    for seed in (None, 1, 2):
        code = (lambda c: F.xxhash64(c)) if seed is None else (lambda c, seed=seed: F.xxhash64(c, F.lit(seed)))
        names = every.select(code("name").alias("id"), "name")
        if names.groupBy("id").count().where("count > 1").isEmpty():
            return part(ends, code(a).alias(a), code(b).alias(b)), part(every, code("name").alias("id"), "name")
    return ends, part(every, F.col("name").alias("id"), "name")


def drawn(turn: int, numbers: bool):
    """A random order of the nodes: what sorts a node, and the node of such a value.

    A number is a hash already, so its bits turned and some of them inverted make a new order, and the way back is as short; a minimum of numbers needs
    no sort.  A name goes along with its hash.
    """
    if not numbers:
        return lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("r"), F.col(c).alias("to")), lambda m: m["to"]
    by, flip = 11 * turn % 64, F.lit(random.Random(turn).getrandbits(64) - (1 << 63)).cast("long")

    def turned(c: Column, n: int) -> Column:
        return F.shiftleft(c, n).bitwiseOR(F.shiftrightunsigned(c, 64 - n))
    return lambda c: turned(F.col(c), by).bitwiseXOR(flip), lambda m: turned(m.bitwiseXOR(flip), 64 - by)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node of an edge, with the smallest node of its component.

    Loops and edges with a null end are left out (a null is no node); edges may repeat.
    """
    plain, names = coded(edges, a, b)
    # an edge may be there twice, once in each direction; no step minds, and the next graph has it once
    e = settled(plain.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    numbers = e.schema["u"].dataType == LongType()
    steps = []
    while not e.isEmpty():
        order, node = drawn(len(steps) + 1, numbers)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min(order("v")).alias("m"))
        to = settled(near.select(F.col("u").alias("node"), node(F.least("m", order("u"))).alias("to")))
        steps.append(to)
        x = join_reduced(e, to.select(F.col("node").alias("u"), F.col("to").alias("_u")), ["u"])
        x = join_reduced(x, to.select(F.col("node").alias("v"), F.col("to").alias("_v")), ["v"]).where("_u <> _v")
        last, e = e, settled(x.select(F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")).distinct())
        dropped(last)
    # names of the components, from the smallest graph back to the whole one
    at = None
    for to in reversed(steps):
        if at is None:
            at = to
        else:
            up = at.select(F.col("node").alias("to"), F.col("to").alias("_top"))
            at = settled(join_reduced(to, up, ["to"], "left").select("node", F.coalesce("_top", "to").alias("to")))
    every = names if at is None else names.join(at.withColumnRenamed("node", "id"), "id", "left")
    named = every.select("name", (F.col("id") if at is None else F.coalesce("to", "id")).alias("c"))
    first = named.groupBy("c").agg(F.min("name").alias("component"))
    return join_reduced(named, first, ["c"]).select(F.col("name").alias("node"), "component")


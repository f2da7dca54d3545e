"""Broader graphs with several parents per concept: cycles (H12), closure and reachability.

Edges are (child, parent); a concept may have any number of parents, edges may
repeat, null ends are no concepts.  All jobs are rounds of joins over edge
tables; every round is written to the shared folder, and rounds grow with the logarithm of the
depth of tree-like parts instead of with the depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import coded
from tessera.operators.skew import join_reduced
from tessera.session import dropped, settled


def plain_edges(edges: DataFrame) -> DataFrame:
    """Different (child, parent) without null ends, written to the shared folder."""
    return settled(edges.select("child", "parent").where(F.col("child").isNotNull() & F.col("parent").isNotNull()).distinct())


# ---------------------------------------------------------------- H12: cycles as strongly connected components
def _degrees(e: DataFrame) -> DataFrame:
    """(node, up, down, above, below): edges up and down of every concept, and the first concept of either kind."""
    one, none = F.lit(1), F.lit(0)
    ends = F.array(F.struct(F.col("child").alias("node"), one.alias("up"), none.alias("down"), F.col("parent").alias("above"), F.when(F.lit(False), F.col("child")).alias("below")),
                   F.struct(F.col("parent").alias("node"), none.alias("up"), one.alias("down"), F.when(F.lit(False), F.col("parent")).alias("above"), F.col("child").alias("below")))
    return (e.select(F.inline(ends)).groupBy("node")
            .agg(F.sum("up").alias("up"), F.sum("down").alias("down"), F.min("above").alias("above"), F.min("below").alias("below")))


def _bypassed(degrees: DataFrame, turn: int) -> DataFrame:
    """(node, below, above): concepts with one child and one parent, no two of them neighbours.

    A number drawn per concept and round decides: one is taken if it draws more than its two neighbours.
    """
    def drawn(c: str):
        return F.struct(F.xxhash64(c, F.lit(turn)), F.col(c))
    return degrees.where("up = 1 and down = 1").where((drawn("node") > drawn("below")) & (drawn("node") > drawn("above"))).select("node", "below", "above")


def _spread(value: DataFrame, e: DataFrame, src: str, dst: str, keep) -> DataFrame:
    """(node, c) at the fixed point of c(dst) = max(c(dst), c(src)) over edges; ``keep`` filters the edges joined to both ends' values."""
    while True:
        other = value.select(F.col("node").alias("_n"), F.col("c").alias("_c"))
        own = value.select(F.col("node").alias("_m"), F.col("c").alias("_d"))
        step = keep(e.join(other, e[src] == other["_n"]).join(own, e[dst] == own["_m"]))
        better = step.where("_d is null or _c > _d").groupBy("_m").agg(F.max("_c").alias("_best"))
        nxt = (settled(value.join(better, value.node == better["_m"], "left")
               .select("node", F.coalesce("_best", "c").alias("c"), F.col("_best").isNotNull().alias("_new"), *value.columns[2:])))
        if nxt.where("_new").isEmpty():
            return nxt.drop("_new")
        value = nxt.drop("_new")


def _colour_components(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of forward and backward colours: (node, c) of the components found, and the edges left among the others.

    Forward, every concept takes the largest name that reaches it; those that reach the concept of that name
    again, inside its colour, form its component.
    """
    nodes = e.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    colour = _spread(nodes.withColumn("c", F.col("node")), e, "child", "parent", lambda j: j)
    back = settled(colour.select("node", F.when(F.col("node") == F.col("c"), F.col("c")).alias("c"), F.col("c").alias("colour")))

    def same_colour(j: DataFrame) -> DataFrame:
        a = back.select(F.col("node").alias("_a"), F.col("colour").alias("_ca"))
        b = back.select(F.col("node").alias("_b"), F.col("colour").alias("_cb"))
        return j.join(a, j["_n"] == a["_a"]).join(b, j["_m"] == b["_b"]).where("_ca = _cb and _c is not null")

    mark = _spread(back, e, "parent", "child", same_colour)
    found = mark.where("c is not null").select("node", "c")
    rest = mark.where("c is null").select("node", "colour")
    left = (settled(e.join(rest.select(F.col("node").alias("child"), F.col("colour").alias("_x")), "child")
            .join(rest.select(F.col("node").alias("parent"), F.col("colour").alias("_y")), "parent")
            .where("_x = _y").select("child", "parent")))
    return found, left


def _members(whole: DataFrame) -> DataFrame:
    """(node, c): every concept of a cycle, with the one its component goes by; ``whole`` are different edges.

    Each round drops the edges no cycle can use (their child has no child or their parent no parent) and bypasses concepts
    with one child and one parent (they belong to the component of both neighbours or to none), so trees and chains of
    any depth vanish in a logarithmic number of rounds; what is left is coloured forward and backward.
    """
    e, found, removed, turn = whole, [], [], 0
    n = e.count()
    while n:
        turn += 1
        degrees = settled(_degrees(e))
        gone = settled(_bypassed(degrees, turn))
        removed.append(gone)
        names = gone.select("node")
        low = degrees.where("down = 0").select("node").union(names).withColumnRenamed("node", "child")
        high = degrees.where("up = 0").select("node").union(names).withColumnRenamed("node", "parent")
        kept = e.join(low, "child", "left_anti").join(high, "parent", "left_anti").select("child", "parent")
        last, e = e, settled(kept.union(gone.select("below", "above")).distinct())
        dropped(degrees, *([last] if last is not whole else []))
        before, n = n, e.count()
        if n == before:
            part, e = _colour_components(e)
            found.append(part)
            n = e.count()
    kind = whole.schema["child"].dataType.simpleString()
    empty = whole.sparkSession.createDataFrame([], f"node {kind}, c {kind}")
    member = settled(reduce(DataFrame.unionByName, found, empty))
    for gone in reversed(removed):
        if gone.isEmpty():
            continue
        a = member.select(F.col("node").alias("below"), F.col("c").alias("_ca"))
        b = member.select(F.col("node").alias("above"), F.col("c").alias("_cb"))
        back = gone.join(a, "below").join(b, "above").where("_ca = _cb").select("node", F.col("_ca").alias("c"))
        last, member = member, settled(member.unionByName(back))
        dropped(last, gone)
    return member


def _cycle_parts(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, member) and (c, child, parent) by name: the concepts on cycles and the edges between those of one component.

    The rounds work on numbers; only concepts on cycles get their names back.
    """
    whole, names = coded(edges, "child", "parent")
    member = _members(whole)
    named = settled(names.join(member.withColumnRenamed("node", "id"), "id").select("id", "c", F.col("name").alias("member")))
    a = named.select(F.col("id").alias("child"), F.col("c"), F.col("member").alias("_child"))
    b = named.select(F.col("id").alias("parent"), F.col("c").alias("_other"), F.col("member").alias("_parent"))
    inside = settled(whole.join(a, "child").join(b, "parent").where("c = _other").select("c", F.col("_child").alias("child"), F.col("_parent").alias("parent")))
    # a component without an edge inside is a single concept that no cycle uses
    return named.join(inside.select("c").distinct(), "c", "left_semi").select("c", "member"), inside


def strong_components(edges: DataFrame) -> DataFrame:
    """(component, member, n_members, cycle_child, cycle_parent), a row per concept that lies on a cycle.

    ``component`` is the smallest member, ``cycle_child`` -> ``cycle_parent`` the smallest edge inside it.
    """
    member, inside = _cycle_parts(edges)
    first = inside.groupBy("c").agg(F.min(F.struct("child", "parent")).alias("_e"))
    size = member.groupBy("c").agg(F.min("member").alias("component"), F.count(F.lit(1)).alias("n_members"))
    return (join_reduced(member, size.join(first, "c"), ["c"])
            .select("component", "member", "n_members", F.col("_e.child").alias("cycle_child"), F.col("_e.parent").alias("cycle_parent")))


def cycle_edges(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(component, child, parent): every edge that lies on a cycle."""
    if components is None:
        member, inside = _cycle_parts(edges)
        first = member.groupBy("c").agg(F.min("member").alias("component"))
        return join_reduced(inside, first, ["c"]).select("component", "child", "parent")
    c = components.select("component", "member")
    a = c.select(F.col("member").alias("child"), F.col("component"))
    b = c.select(F.col("member").alias("parent"), F.col("component").alias("_other"))
    return plain_edges(edges).join(a, "child").join(b, "parent").where("component = _other").select("component", "child", "parent")


# ---------------------------------------------------------------- H14: closure by path doubling
#: Steps along a path are doubled this often, so a piece has at most 2^DOUBLINGS concepts and so has the list of its names.
DOUBLINGS = 6


def _picked(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, to): every concept with one of its parents or none, no parent twice.

    A parent offers itself to one child, and a child takes the offer of the parent with the fewest children.
    """
    offers = e.where("child <> parent").groupBy("parent").agg(F.min("child").alias("node"), F.count(F.lit(1)).alias("n")).select("node", F.col("parent").alias("to"), "n")
    none = nodes.select("node", F.when(F.lit(False), F.col("node")).alias("to"), F.when(F.lit(False), F.lit(0).cast("long")).alias("n"))
    return offers.unionByName(none).groupBy("node").agg(F.min_by("to", "n").alias("to"))


def _pieces(picked: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, piece, at): the paths of ``picked`` cut to pieces, named by their top, which is at 1; and the tables to drop afterwards.

    Every concept finds the top by doubling its steps.  Those further below, or on a ring, are cut where a concept draws the least number of
    as many concepts as were passed (on every ring one does), and below concepts that are done; then they start anew.
    Doubling ends early where only rings are left and more steps would cut no less.
    """
    own, done, tables, live = F.xxhash64("node"), [], [], picked
    while True:
        start = walk = settled(live.select("node", F.coalesce("to", "node").alias("top"), F.col("to").isNotNull().cast("int").alias("steps"), own.alias("least")))
        tables.append(walk)
        ended: list[DataFrame] = []
        cuts = None
        for k in range(DOUBLINGS + 1):
            # after k doublings those on the way have made 2^k steps, the others fewer
            on = F.col("steps") == 1 << k
            ended.append(walk.where(~on))
            live = walk.where(on)
            n, left, least = walk.agg(F.count(F.lit(1)), F.count_if(on), F.count_if(on & (F.col("least") == own))).first()
            if k == DOUBLINGS or not left or (left, least) == (n, cuts):
                break
            cuts = least
            ahead = reduce(DataFrame.unionByName, ended, live).select(F.col("node").alias("top"), F.col("top").alias("_top"), F.col("steps").alias("_steps"), F.col("least").alias("_least"))
            walk = settled(live.join(ahead, "top").select("node", F.col("_top").alias("top"), (F.col("steps") + F.col("_steps")).alias("steps"), F.least("least", "_least").alias("least")))
            tables.append(walk)
        done += [x.select("node", F.col("top").alias("piece"), (F.col("steps") + 1).alias("at")) for x in ended]
        if not left:
            return reduce(DataFrame.unionByName, done), tables
        kept = live.select("node", (F.col("least") != own).alias("_kept")).join(start.select("node", F.col("top").alias("to")), "node")
        going = live.select(F.col("node").alias("to"), F.lit(True).alias("_going"))
        live = kept.join(going, "to", "left").select("node", F.when(F.col("_going") & F.col("_kept"), F.col("to")).alias("to"))


def _reached(links: DataFrame) -> DataFrame:
    """(piece, above, at, low, far): the closure of such rows over pieces, ``low`` the first concept of ``piece`` that reaches the one at ``at`` of ``above``.

    ``far`` marks those that take 2^k links and not fewer; a round joins them with all, so there are as many rounds as the longest way has binary digits.
    A row stands for all concepts below ``low`` too; ways down to up inside a piece have no rows.
    """
    best = settled(links.withColumn("far", F.lit(True)))
    while not best.where("far").isEmpty():
        # of the concepts of a piece reached from one concept, the lowest reaches the others; a loop leads nowhere new
        step = best.where("far and (piece <> above or at > low)").groupBy("piece", "above", "low").agg(F.max("at").alias("reach"))
        ahead = best.select(F.col("piece").alias("_piece"), F.col("above").alias("_above"), F.col("at").alias("_at"), F.col("low").alias("_low"), "far")
        made = (step.join(ahead, (step["above"] == ahead["_piece"]) & (F.col("_low") <= F.col("reach")))
                .select("piece", F.col("_above").alias("above"), F.col("_at").alias("at"), "low", "far").where("piece <> above or low <= at"))
        every = made.unionByName(best.withColumn("far", F.lit(False)))
        low = every.groupBy("piece", "above", "at").agg(F.min(F.when(F.col("far"), F.col("low"))).alias("_far"), F.min(F.when(~F.col("far"), F.col("low"))).alias("_near"))
        last, best = best, settled(low.select("piece", "above", "at", F.least("_far", "_near").alias("low"),
                                              F.coalesce(F.col("_far") < F.col("_near"), F.col("_near").isNull()).alias("far")))
        dropped(last)
    return best


def closure_by_doubling(edges: DataFrame) -> DataFrame:
    """All (child, ancestor) pairs, cycles included.

    The graph is covered by paths, cut to pieces of bounded length.  What a concept reaches, all below it in its piece reach too, so of
    each piece and ancestor in another piece (or on a cycle) only the first concept that reaches it is kept, and the rounds work on these
    rows and on numbers.  Pairs are listed when the result is read, a row with the names below in its piece; what the rounds made on the
    way leaves the disk.
    """
    e, names = coded(edges, "child", "parent")
    place, walks = _pieces(_picked(e, names.select(F.col("id").alias("node"))))
    listed = names.join(place, names["id"] == place["node"]).groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("_m"))
    piece = settled(listed.select("piece", F.col("_m")["name"].alias("names")))
    low = place.select(F.col("node").alias("child"), "piece", F.col("at").alias("low"))
    up = place.select(F.col("node").alias("parent"), F.col("piece").alias("above"), "at")
    links = e.join(low, "child").join(up, "parent").where("piece <> above or low <= at")
    # a concept reached reaches those above it in its piece
    first = F.when(F.col("piece") == F.col("above"), F.col("low")).otherwise(1)
    best = _reached(links.select("piece", "above", "low", F.explode(F.sequence(first, "at")).alias("at")).groupBy("piece", "above", "at").agg(F.min("low").alias("low")))
    dropped(e, names, *walks)
    whole = F.lit(1 << DOUBLINGS)
    above = piece.select(F.col("piece").alias("above"), F.col("names").alias("_above"))
    # from the concept reached in the same piece down, it is above anyway
    n = F.when(F.col("piece") == F.col("above"), F.col("at") - F.col("low") + 1).otherwise(whole)
    named = best.join(above, "above").select("piece", "low", n.alias("n"), F.col("_above")[F.col("at") - 1].alias("parent"))
    across = named.join(piece, "piece").select(F.explode(F.slice("names", F.col("low"), F.col("n"))).alias("child"), "parent")
    inside = piece.select("names", F.posexplode("names").alias("_above", "parent")).select(F.explode(F.slice("names", F.col("_above") + 2, whole)).alias("child"), "parent")
    return across.unionByName(inside)


# ---------------------------------------------------------------- H14: reachability without a closure
class AncestorIndex:
    """Answers "is b an ancestor of a" for tables of pairs.

    Cycles are contracted.  One parent per concept makes a forest, whose ancestors at distance 1, 2, 4, ... are tables
    (a logarithmic number, each with a row per concept); an ancestor in the forest is found by jumping the
    difference of the depths.  Where a concept on the way has further parents, the search goes on from those:
    ``portal`` is the nearest concept upwards (or the concept itself) that has any.  Search rounds are as many as portals
    lie behind each other on a way, so for long chains that branch at every concept ``closure_by_doubling`` is the better job.
    """

    def __init__(self, edges: DataFrame):
        whole = plain_edges(edges)
        cyclic = strong_components(whole).select(F.col("member").alias("node"), F.col("component").alias("c"))
        self.cyclic = settled(cyclic)
        e = settled(self._contract(self._contract(whole, "child"), "parent").where("child <> parent").distinct())
        tree = e.groupBy("child").agg(F.min("parent").alias("parent"))
        self.tree = settled(tree)
        self.more = settled(e.join(self.tree, ["child", "parent"], "left_anti"))
        nodes = e.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
        start = nodes.join(self.tree.withColumnRenamed("child", "node"), "node", "left")
        self.jumps = [settled(self.tree.select(F.col("child").alias("node"), F.col("parent").alias("to")))]
        depth = settled(start.select("node", F.col("parent").alias("to"), F.col("parent").isNotNull().cast("int").alias("depth")))
        while True:
            last = self.jumps[-1]
            nxt = settled(last.join(last.select(F.col("node").alias("to"), F.col("to").alias("_t")), "to").select("node", F.col("_t").alias("to")))
            up = depth.select(F.col("node").alias("_n"), F.col("to").alias("_t"), F.col("depth").alias("_d"))
            depth = (settled(depth.join(up, depth["to"] == up["_n"], "left")
                     .select("node", F.col("_t").alias("to"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"))))
            if nxt.isEmpty():
                break
            self.jumps.append(nxt)
        self.depth = settled(depth.select("node", "depth"))
        branching = self.more.select(F.col("child").alias("node")).distinct().withColumn("_own", F.lit(True))
        portal = (settled(start.join(branching, "node", "left")
                  .select("node", F.when(F.col("_own"), F.col("node")).otherwise(F.col("parent")).alias("to"),
                          F.coalesce("_own", F.lit(False)).alias("done"))))
        for _ in self.jumps:
            up = portal.select(F.col("node").alias("_n"), F.col("to").alias("_t"), F.col("done").alias("_d"))
            portal = (settled(portal.join(up, portal["to"] == up["_n"], "left")
                      .select("node", F.when(F.col("done"), F.col("to")).otherwise(F.col("_t")).alias("to"),
                              (F.col("done") | F.coalesce("_d", F.lit(False))).alias("done"))))
        self.portal = settled(portal.where("done and to is not null").select("node", F.col("to").alias("portal")))

    def _contract(self, df: DataFrame, col: str) -> DataFrame:
        """``col`` with concepts of a cycle replaced by the component's name."""
        c = self.cyclic.select(F.col("node").alias("_n"), F.col("c").alias("_c"))
        return df.join(c, df[col] == c["_n"], "left").withColumn(col, F.coalesce("_c", col)).drop("_n", "_c")

    def _in_tree(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b, ...) with ``hit``: b is a or above it in the forest."""
        cols = pairs.columns
        da = self.depth.select(F.col("node").alias("a"), F.col("depth").alias("_da"))
        db = self.depth.select(F.col("node").alias("b"), F.col("depth").alias("_db"))
        d = pairs.join(da, "a", "left").join(db, "b", "left").withColumn("_up", F.col("_da") - F.col("_db")).withColumn("_at", F.col("a"))
        for k, jump in enumerate(self.jumps):
            j = jump.select(F.col("node").alias("_n"), F.col("to").alias("_to"))
            bit = F.col("_up").bitwiseAND(1 << k) > 0
            d = d.join(j, (d["_at"] == j["_n"]) & (d["_up"] >= 0) & bit, "left") \
                 .withColumn("_at", F.when((F.col("_up") >= 0) & bit, F.col("_to")).otherwise(F.col("_at"))).drop("_n", "_to")
        return d.select(*cols, F.coalesce((F.col("_up") >= 0) & (F.col("_at") == F.col("b")), F.lit(False)).alias("hit"))

    def reachable(self, pairs: DataFrame) -> DataFrame:
        """(child, ancestor, reachable) for the different pairs (child, ancestor); a concept is its own ancestor only on a cycle."""
        asked = settled(pairs.select("child", "ancestor").distinct())
        c = self.cyclic.select(F.col("node").alias("a"), F.lit(True).alias("_cyclic")).unionByName(
            self.cyclic.select(F.col("c").alias("a"), F.lit(True).alias("_cyclic"))).distinct()
        d = self._contract(self._contract(asked.select("child", "ancestor", F.col("child").alias("a"), F.col("ancestor").alias("b")), "a"), "b")
        same = d.where("a = b").join(c, "a", "left").select("child", "ancestor", F.coalesce("_cyclic", F.lit(False)).alias("hit"))
        found = [same.where("hit").select("child", "ancestor")]
        # only between concepts of the graph there is anything to search; equal ones are settled above
        search = d.where("a <> b").select("a", "b").distinct()
        tested = settled(self._in_tree(search.select("a", "b", F.col("a").alias("from"))))
        hits, seen, open_ = [tested.where("hit").select("from", "b")], None, tested.where("not hit").select("a", "b", "from")
        while True:
            at = open_.join(self.portal.withColumnRenamed("node", "a"), "a").select("from", "b", "portal").distinct()
            if seen is not None:
                at = at.join(seen, ["from", "b", "portal"], "left_anti")
            at = settled(at)
            if at.isEmpty():
                break
            seen = at if seen is None else seen.unionByName(at)
            ways = self.more.unionByName(self.tree).select(F.col("child").alias("portal"), F.col("parent").alias("a"))
            tested = settled(self._in_tree(at.join(ways, "portal").select("a", "b", "from").distinct()))
            hit = tested.where("hit").select("from", "b").distinct()
            hits.append(hit)
            open_ = tested.where("not hit").select("a", "b", "from").join(hit, ["from", "b"], "left_anti")
        met = reduce(DataFrame.unionByName, hits).distinct().withColumnRenamed("from", "a")
        found.append(d.where("a <> b").join(met, ["a", "b"], "left_semi").select("child", "ancestor"))
        yes = reduce(DataFrame.unionByName, found).withColumn("_yes", F.lit(True))
        return asked.join(yes, ["child", "ancestor"], "left").select("child", "ancestor", F.coalesce("_yes", F.lit(False)).alias("reachable"))

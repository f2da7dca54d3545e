"""Cycles, closure and reachability over random graphs against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import hierarchy as H


def closure(edges):
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    out = set()
    for a in up:
        todo, seen = list(up[a]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        out |= {(a, x) for x in seen}
    return out


def graphs():
    rng = random.Random(5)
    n = lambda k: f"n{k:04d}"
    mixed = [(n(rng.randrange(60)), n(rng.randrange(60))) for _ in range(70)]
    tree = [(n(k), n(rng.randrange(k))) for k in range(1, 70)]
    dag = tree + [(n(k), n(rng.randrange(k))) for k in range(1, 70) if rng.random() < 0.3]
    ring = [(n(k), n((k + 1) % 24)) for k in range(24)] + [(n(50), n(3)), (n(7), n(51)), (n(60), n(60)), (n(61), n(60))]
    chords = ring + [(n(5), n(2)), (n(12), n(18)), (n(70), n(71)), (n(71), n(70)), (n(70), n(10)), (None, "x"), ("x", None)]
    return {"mixed": mixed, "dag": dag, "chords": chords, "none": []}


@pytest.mark.parametrize("name", list(graphs()))
def test_components_closure_and_reachability(spark, name):
    edges = graphs()[name]
    plain = {(a, b) for a, b in edges if a is not None and b is not None}
    df = spark.createDataFrame(edges + edges[:3], "child string, parent string")
    pairs = closure(plain)
    assert {tuple(r) for r in G.closure_by_doubling(df).collect()} == pairs
    members = {a for a, b in pairs if a == b}
    want = set()
    for a in members:
        mates = {b for b in members if (a, b) in pairs and (b, a) in pairs}
        first = min(e for e in plain if e[0] in mates and e[1] in mates)
        want.add((min(mates), a, len(mates), *first))
    comps = G.strong_components(df).collect()
    assert len(comps) == len(want) and {tuple(r) for r in comps} == want
    assert {tuple(r) for r in G.cycle_edges(df).collect()} == {
        (min(x for x in members if (x, a) in pairs and (a, x) in pairs), a, b) for a, b in plain if (b, a) in pairs}
    names = sorted({x for e in plain for x in e} | {"unknown"})
    rng = random.Random(6)
    asked = [(rng.choice(names), rng.choice(names)) for _ in range(400)]
    got = {(r.child, r.ancestor): r.reachable for r in G.AncestorIndex(df).reachable(spark.createDataFrame(asked, "child string, ancestor string")).collect()}
    assert got == {p: p in pairs for p in asked}


def test_a_chain_of_500_takes_few_rounds(spark, monkeypatch):
    chain = [(f"c{k:04d}", f"c{k + 1:04d}") for k in range(500)]
    df = spark.createDataFrame(chain, "child string, parent string")
    from pyspark.sql import DataFrame
    made = []
    keep = DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **k: made.append(1) or keep(self, *a, **k))
    assert H.transitive_closure(df).count() == 500 * 501 // 2
    assert len(made) <= 2 + 2 * 10


def test_rounds_of_components_work_on_numbers_and_shrink(spark, monkeypatch):
    """Trees and chains beside the cycles vanish: all rounds together write few more edges than the graph has, none by name."""
    written, keep, n = [], G.settled, 400

    def counted(df):
        out = keep(df)
        if out.columns == ["child", "parent"]:
            written.append((out.count(), out.schema["child"].dataType.simpleString()))
        return out
    monkeypatch.setattr(G, "settled", counted)
    edges = [(f"n{k:04d}", f"n{k + 1:04d}") for k in range(n)] + [("n0010", "n0005")]
    df = spark.createDataFrame(edges, "child string, parent string")
    got = {(r.component, r.member, r.n_members, r.cycle_child, r.cycle_parent) for r in G.strong_components(df).collect()}
    assert got == {("n0005", f"n{k:04d}", 6, "n0005", "n0006") for k in range(5, 11)}
    assert {kind for _, kind in written} == {"bigint"} and sum(c for c, _ in written) <= 3 * n


def test_closure_leaves_no_shuffle_files_and_no_dead_rounds(spark):
    """What the rounds wrote and the result does not read is deleted; near pairs are shuffled once a round to compare them."""
    from tessera.session import checkpoint_dir
    import glob
    folder = checkpoint_dir(spark).removeprefix("file:").rstrip("/")
    before = set(glob.glob(f"{folder}/settled-*"))
    df = spark.createDataFrame([(f"k{k:04d}", f"k{k + 1:04d}") for k in range(40)], "child string, parent string")
    out = G.closure_by_doubling(df)
    read = {f.removeprefix("file:").replace("///", "/").rsplit("/", 1)[0] for f in out.inputFiles()}
    left = set(glob.glob(f"{folder}/settled-*")) - before
    assert out.count() == 40 * 41 // 2
    assert left == read


def test_closure_rounds_write_few_rows_where_concepts_lie_on_paths(spark, monkeypatch):
    """Below one another, concepts reach nearly the same: the rounds keep a row per piece of a path and ancestor, not one per pair."""
    written, keep, n = [], G.settled, 300

    def counted(df):
        out = keep(df)
        written.append(out.count())
        return out
    monkeypatch.setattr(G, "settled", counted)
    edges = [(f"n{k:04d}", f"n{k + 1:04d}") for k in range(n)] + [(f"n{k:04d}", f"top{k % 7}") for k in range(n)]
    got = G.closure_by_doubling(spark.createDataFrame(edges, "child string, parent string"))
    pairs = closure(edges)
    assert {tuple(r) for r in got.collect()} == pairs and got.count() == len(pairs)
    assert sum(written) < len(pairs) / 2


@pytest.mark.parametrize("numbers", [True, False])
def test_closure_over_pieces_cut_from_rings_and_long_paths(spark, monkeypatch, numbers):
    """Rings shorter and longer than a piece, paths of many pieces into and out of them, and names that stay names."""
    def named(edges, a, b):
        ends = G.plain_edges(edges)
        names = G.settled(ends.select(F.explode(F.array(a, b)).alias("id")).distinct().select("id", F.col("id").alias("name")))
        return ends, names
    monkeypatch.setattr(G, "DOUBLINGS", 2)
    if not numbers:
        monkeypatch.setattr(G, "coded", named)

    def ring(name, n):
        return [(f"{name}{k:02d}", f"{name}{(k + 1) % n:02d}") for k in range(n)]
    rng = random.Random(11)
    edges = [e for name, n in [("a", 23), ("b", 3), ("c", 2), ("d", 1), ("e", 9)] for e in ring(name, n)]
    edges += [(f"p{k:02d}", f"p{k + 1:02d}") for k in range(30)] + [("p30", "a05"), ("a11", "q00"), ("p12", "b01"), ("p17", "p09"), ("c00", "p20")]
    edges += [(f"q{k:02d}", f"q{k + 1:02d}") for k in range(12)] + [("q07", "e03"), ("q07", "d00"), ("q03", "q09")]
    edges += [(f"r{rng.randrange(30):02d}", f"r{rng.randrange(30):02d}") for _ in range(36)] + [("r03", "p05"), (None, "p01"), ("p01", None)]
    got = [tuple(r) for r in G.closure_by_doubling(spark.createDataFrame(edges, "child string, parent string")).collect()]
    assert len(got) == len(set(got)) and set(got) == closure({e for e in edges if None not in e})

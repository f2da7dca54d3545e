"""The chosen-path join against all pairs; components against union-find."""

import random
from collections import Counter

import numpy as np
import pytest

import tessera.llm.ngram_join as J
from tessera.operators.components import connected_components
from tests.llm.cases import prose, unique_rows


def sets_of(data):
    out = {}
    for i, t in data:
        w = (t or "").split()
        if w:
            out[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))
    return out


def brute(data, similarity=0.8):
    sets = sets_of(data)
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    reps = sorted(rep.values())
    links, parent = Counter(), {i: i for i, _ in data}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(reps):
        for b in reps[:k]:
            c = len(sets[a] & sets[b])
            if c >= similarity * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    out = {}
    for i, _ in data:
        r = rep[sets[i]] if i in sets else i
        out[i] = (find(r), r, sum(1 for j in sets if i in sets and sets[j] == sets[i]) or 1, links[r])
    return out


def family(rng, n, words=150, change=4):
    base = prose(rng, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, change)):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(10 ** 6))
        out.append(" ".join(w))
    return out


def test_join_matches_all_pairs(spark):
    rng = random.Random(11)
    texts = [t for k in range(6) for t in family(rng, 6, 60 + 40 * k)] + [prose(rng, rng.randint(0, 90)) for _ in range(60)]
    data = [(1000 + i, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in unique_rows()]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.rep_id, r.n_copies, r.n_links) for r in J.ngram_join(df).collect()}
    assert got == brute(data)


@pytest.mark.parametrize("small,large,block", [(4, 20_000, 16), (4, 30, 7)])
def test_large_groups_are_split_and_stay_whole(spark, monkeypatch, small, large, block):
    """Buckets over the limits are split in tasks and by Spark joins; groups over a block are verified block by block."""
    rng = random.Random(12)
    data = list(enumerate(family(rng, 90, 120, 3) + family(rng, 30, 80, 3) + [prose(rng, 40) for _ in range(30)]))
    df = spark.createDataFrame(data, "doc_id long, text string")
    monkeypatch.setattr(J, "LARGE", large)
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "SMALL", small)
    got = {r.doc_id: (r.class_id, r.rep_id, r.n_copies, r.n_links) for r in J.ngram_join(df).collect()}
    want = brute(data)
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert got == want


def test_buckets_in_a_task_find_similar_sets():
    """One run's recursion, without Spark: pairs at 0.85 and more end up linked over all runs."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 16, (40, J.TOKENS), dtype=np.uint16)
    twin = base.copy()
    for k in range(40):
        twin[k, rng.choice(J.TOKENS, 8, replace=False)] = 0
    sk, ids = np.concatenate([base, twin]), np.arange(80)
    linked = set()
    for run in range(J.runs_for(0.99)):
        row, child = J._children(np.full(80, J.mix(np.array([run + 1], dtype=np.uint64))[0]), sk)
        for c in np.unique(child):
            part = np.sort(row[child == c])
            for a, b, _ in J._bucket_links(c, ids[part], sk[part], 1):
                linked |= set(zip(a.tolist(), b.tolist()))
    assert sum((k + 40, k) in linked for k in range(40)) >= 39
    assert J.runs_for(0.99) == 10 and J.runs_for(0.999) > J.runs_for(0.9)


def test_an_id_with_two_texts_keeps_all_links(spark):
    rng = random.Random(13)
    a, b = family(rng, 2, 150, 2), family(rng, 2, 150, 2)
    data = [(1, a[0]), (1, b[0]), (2, a[1]), (3, b[1]), (1, a[0])]
    got = sorted(tuple(r) for r in J.ngram_join(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == [(1, 1, 1, 1, 1), (1, 1, 1, 1, 1), (2, 1, 2, 1, 1), (3, 1, 3, 1, 1)]


def test_a_template_family_falls_apart_before_pairs_are_formed(spark, monkeypatch):
    """Sets that share half of their shingles: linked at the sketches, one group; refined groups hold only the planted pairs."""
    rng = random.Random(14)
    template = prose(rng, 110)
    texts = [template + " " + " ".join(f"y{rng.randrange(10 ** 7)}" for _ in range(90)) for _ in range(400)]
    pairs = [(k, 400 + k) for k in range(30)]
    for k, _ in pairs:
        w = texts[k].split()
        w[rng.randrange(len(w))] = "z1"
        texts.append(" ".join(w))
    seen = {}
    refine = J.refined
    monkeypatch.setattr(J, "BLOCK", 64)
    monkeypatch.setattr(J, "refined", lambda wanted, *a: seen.setdefault("out", refine(wanted.cache(), *a).cache()))
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: ((i - 400, 1) if i >= 400 else (i, int(i < 30))) for i in range(430)}
    if seen:
        assert seen["out"].groupBy("_group").count().agg({"count": "max"}).first()[0] <= 4


def test_recall_on_a_hot_group(spark, monkeypatch):
    """Planted pairs at 0.8 and a little more inside a family of per-token agreement 0.4 whose buckets go deep."""
    rng = np.random.default_rng(15)
    n, planted = 4_000, 100
    template = rng.integers(0, 1 << 16, J.TOKENS, dtype=np.uint16)
    base = np.where(rng.random((n, J.TOKENS)) < 0.4, template, rng.integers(0, 1 << 16, (n, J.TOKENS), dtype=np.uint16)).astype("<u2")
    twin = base[:planted].copy()
    for k in range(planted):
        twin[k, rng.choice(J.TOKENS, 13, replace=False)] = 1
    rows = [(k, s.tobytes()) for k, s in enumerate(np.concatenate([base, twin]))]
    monkeypatch.setattr(J, "SMALL", 16)
    sets = spark.createDataFrame([(k, bytearray(s)) for k, s in rows], "_id long, _sketch binary").repartition(8).cache()
    assert J.bucket_links(sets.selectExpr("*", "15 as _last"), 0, 15).agg({"_level": "max"}).first()[0] > J.SHALLOW
    links = connected_components(J.candidate_links(sets, 0.999), "_a", "_b")
    group = {r.node: r.component for r in links.collect()}
    assert sum(group.get(k, -1) == group.get(n + k, -2) for k in range(planted)) >= 0.99 * planted


def test_components_match_union_find(spark):
    rng = random.Random(4)
    chain = [0, *range(200, 0, -1)]
    edges = [(f"c{a:04d}", f"c{b:04d}") for a, b in zip(chain, chain[1:])]
    edges += [(f"r{rng.randrange(80):04d}", f"r{rng.randrange(80):04d}") for _ in range(60)] + [("z", "z"), ("z1", None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}

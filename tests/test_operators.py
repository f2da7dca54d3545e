"""Operators on hand-made rows with edge cases, checked against brute-force Python."""

import itertools

import pytest
from pyspark.sql import functions as F

from tessera.operators import combine as C
from tessera.operators import hierarchy as H
from tessera.operators import mappings as M

EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "f"), ("f", "g"), ("s", "s"), ("m", "zz")]


def _py_cycles(rows):
    parent = {i: p for i, p in rows}
    ids = set(parent)
    out = set()
    for start in ids:
        seen, cur = set(), start
        while cur in ids and parent.get(cur) not in (None, ""):
            if cur in seen:
                out.add(start)
                break
            seen.add(cur)
            cur = parent[cur]
    return out


def test_cycles_pointer_doubling(spark):
    rows = EDGES + [("c", "a"), ("g", ""), ("zz", None)]
    rows = list(dict(rows).items())
    df = spark.createDataFrame([(i, p, n) for n, (i, p) in enumerate(rows)], "id string, parent_id string, pos long")
    got = {r[0] for r in H.circular_references(df).collect()}
    assert got == _py_cycles(rows) == {"a", "b", "c", "d", "s"}


def test_transitive_closure_terminates_on_cycles(spark):
    df = spark.createDataFrame(EDGES, "child string, parent string")
    got = {tuple(r) for r in H.transitive_closure(df).collect()}
    closure = set(EDGES)
    while True:
        new = {(a, d) for (a, b), (c, d) in itertools.product(closure, closure) if b == c} - closure
        if not new:
            break
        closure |= new
    assert got == closure


def test_prefix_hierarchy_longest_prefix(spark):
    rows = [("1", 1), ("11", 2), ("111", 3), ("1111", 4), ("12", 2), ("121", 3), ("2", 1), ("13", 3), ("x1", 2)]
    df = spark.createDataFrame(rows, "id string, level int")
    got = dict(tuple(r) for r in H.edges_from_prefix(df).collect())
    assert got == {"11": "1", "111": "11", "1111": "111", "12": "1", "121": "12"}


def test_outline_stack_across_blocks(spark):
    lv = [1, 2, 3, 3, 2, 3, 1, 3, 2, 2, 4, 3]
    df = spark.createDataFrame([(f"n{i}", v, i) for i, v in enumerate(lv)], "id string, level int, pos long")
    stack, expect = {}, {}
    for i, v in enumerate(lv):
        if v > 1 and (v - 1) in stack:
            expect[f"n{i}"] = stack[v - 1]
        stack[v] = f"n{i}"
        for k in [k for k in stack if k > v]:
            del stack[k]
    for block in (2, 5, 1000):
        got = dict(tuple(r) for r in H.edges_from_outline(df, block=block).collect())
        assert got == expect


def test_exact_match_clusters_union_find(spark):
    pairs = [("a", "b"), ("b", "c"), ("d", "e"), ("f", "f"), ("c", "g"), ("h", "d"), ("x", "y")]
    rows = [(s, t, "exactMatch") for s, t in pairs] + [("a", "z", "closeMatch")]
    df = spark.createDataFrame(rows, "source_uri string, target_uri string, mapping_type string")
    got = dict(tuple(r) for r in M.exact_match_clusters(df).collect())
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for s, t in pairs:
        a, b = find(s), find(t)
        parent[max(a, b)] = min(a, b)
    expect = {n: min(m for m in parent if find(m) == find(n)) for n in parent}
    assert got == expect


def test_mapping_inference_shuffles_pairs_once(spark):
    """The statements of a pair are reduced in one shuffle; self pairs, missing ends and unknown types included."""
    rows = [("a", "b", "exactMatch"), ("a", "b", "exactMatch"), ("b", "a", "closeMatch"), ("c", "c", "broadMatch"), ("d", None, "narrowMatch"),
            (None, "d", "broadMatch"), ("b", "a", "odd"), ("b", "a", None), ("a", "b", "broader"), ("a", "b", "broadMatch"), ("a", "b", "")]
    df = spark.createDataFrame(rows, "source_uri string, target_uri string, mapping_type string")
    want = {(s, t, m): False for s, t, m in rows}
    rules = M.INFERENCE_RULES + [(t, False, r) for t, r in M.SUPER_RELATIONS]
    for s, t, m in rows:
        for _, rev, new in (r for r in rules if r[0] == m):
            want.setdefault((t, s, new) if rev else (s, t, new), True)
    got = M.mapping_inference(df)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((*k, v) for k, v in want.items()), key=str)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") == 2


@pytest.mark.parametrize("poor_hash", [False, True])
def test_components_shrink_from_round_to_round(spark, monkeypatch, poor_hash):
    """All rounds together write few more edges than the graph has; names whose hashes collide are kept as they are."""
    from tessera.operators import components as C
    n, written, keep, xx = 600, [], C.settled, F.xxhash64

    def counted(df):
        out = keep(df)
        if out.columns == ["u", "v"]:
            written.append(out.count())
        return out
    monkeypatch.setattr(C, "settled", counted)
    if poor_hash:
        monkeypatch.setattr(F, "xxhash64", lambda *c: F.pmod(xx(*c), F.lit(50)))
    chain = [0, *range(n, 0, -1)]
    df = spark.createDataFrame([(f"c{a:04d}", f"c{b:04d}") for a, b in zip(chain, chain[1:])] + [("x", "x"), ("y", None)], "a string, b string")
    got = {r.node: r.component for r in C.connected_components(df, "a", "b").collect()}
    assert got == {f"c{k:04d}": "c0000" for k in range(n + 1)} | {"x": "x"}
    assert sum(written) <= (6 if poor_hash else 3) * n


def test_rounds_of_components_need_no_sort_for_minima(spark, monkeypatch):
    """Names and neighbours are reduced by hash; edges repeated in both directions are no trouble; long chains end in few rounds."""
    from tessera.operators import components as C
    n, plans, keep = 2000, [], C.settled

    def seen(df):
        plans.append((df.columns, df._jdf.queryExecution().sparkPlan().toString()))
        return keep(df)
    monkeypatch.setattr(C, "settled", seen)
    ends = [(f"c{a:04d}", f"c{a + 1:04d}") for a in range(n)] + [(f"h{k % 40:03d}", f"p{k:04d}") for k in range(1000)]
    df = spark.createDataFrame(ends + [(b, a) for a, b in ends] + ends[:5] + [("x", "x"), (None, "y")], "a string, b string")
    got = {r.node: r.component for r in C.connected_components(df, "a", "b").collect()}
    hubs = {f"p{k:04d}": f"h{k % 40:03d}" for k in range(1000)} | {f"h{k:03d}": f"h{k:03d}" for k in range(40)}
    assert got == {f"c{k:04d}": "c0000" for k in range(n + 1)} | hubs | {"x": "x"}
    assert not [c for c, plan in plans if "SortAggregate" in plan]
    assert len([c for c, _ in plans if c == ["u", "v"]]) <= 18


def test_orders_of_numbers_lead_back_to_the_numbers(spark):
    from tessera.operators.components import drawn
    ids = [0, 1, -1, 2**63 - 1, -2**63, 123456789, -987654321]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    for turn in (1, 2, 6, 29, 64):
        order, node = drawn(turn, True)
        rows = df.select("id", order("id").alias("r"), node(order("id")).alias("back")).collect()
        assert all(r.id == r.back for r in rows) and len({r.r for r in rows}) == len(ids)


def test_inference_is_compiled_and_a_missing_type_stays_apart(spark):
    """No lambda (run row by row) and no work on URIs in a filter; rows without a type share a pair with others."""
    rows = [("a", "b", None), ("a", "b", "exactMatch"), ("b", "a", None), ("a", "b", "odd"), (None, "b", "closeMatch"), ("a", "a", "broadMatch")]
    df = spark.createDataFrame(rows, "source_uri string, target_uri string, mapping_type string")
    got = M.mapping_inference(df)
    want = {(*r, False) for r in rows} | {("b", "a", "exactMatch", True), ("a", "b", "closeMatch", True), ("b", None, "closeMatch", True),
                                          ("a", "a", "narrowMatch", True), ("a", "a", "broader", True)}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    raw = spark.createDataFrame([(" x", "urn:y", "exact"), (None, "z", "exact"), ("z", None, "exact")], df.schema)
    out = M.normalise_mappings(raw, "http://e/")
    assert [tuple(r)[:3] for r in out.collect()] == [("http://e/x", "urn:y", "exactMatch")]
    filters = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert filters and not [x for x in filters if "trim" in x.lower()]


def test_mapping_inference_and_conflicts(spark):
    rows = [("a", "b", "exactMatch"), ("a", "b", "broadMatch"), ("c", "d", "narrowMatch"), ("c", "d", "relatedMatch")]
    df = spark.createDataFrame(rows, "source_uri string, target_uri string, mapping_type string")
    inf = {(r.source_uri, r.target_uri, r.mapping_type) for r in M.mapping_inference(df).collect()}
    assert ("b", "a", "exactMatch") in inf and ("a", "b", "closeMatch") in inf and ("d", "c", "broadMatch") in inf
    ex = M.mapping_conflicts_exact(df).collect()
    assert [(r.source_uri, r.conflicting_types) for r in ex] == [("a", "broadMatch")]
    assert [r.source_uri for r in M.mapping_conflicts_hier_assoc(df).collect()] == ["c"]


def test_join_null_keys_and_keep_first(spark):
    a = spark.createDataFrame([("1", "x"), (None, "n1"), ("2", "y")], "id string, name string")
    b = spark.createDataFrame([("1", "p"), (None, "n2"), ("3", "q")], "id string, name string")
    keep = C.join_pair(a, b, "id", "outer", "_b").collect()
    assert len(keep) == 5  # null keys never match
    match = C.join_pair(a, b, "id", "outer", "_b", null_keys="match").collect()
    assert len(match) == 4 and any(r.id is None and r.name == "n1" and r.name_b == "n2" for r in match)
    rows = spark.createDataFrame([("k", "first", 2), ("k", "second", 5), (None, "na", 1), (None, "nb", 0)],
                                 "id string, v string, pos long")
    first = {r.id: r.v for r in C.dedupe_keep_first(rows).collect()}
    last = {r.id: r.v for r in C.dedupe_keep_first(rows, "id", last=True).collect()}
    assert first == {"k": "first", None: "nb"} and last == {"k": "second", None: "na"}


def test_priority_merge_prefers_higher_priority(spark):
    a = spark.createDataFrame([("1", "low", 0)], "id string, v string, pos long")
    b = spark.createDataFrame([("1", "high", 9), ("2", "only", 1)], "id string, v string, pos long")
    got = {r.id: r.v for r in C.priority_merge([("a", a, 1), ("b", b, 2)], "id").collect()}
    assert got == {"1": "high", "2": "only"}


def test_skewed_key_still_correct(spark):
    """A third of the rows on one key: keep-first, cycles and closure stay exact."""
    n = 3000
    rows = [("hot" if i % 3 == 0 else f"k{i}", f"v{i}", i) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, v string, pos long")
    out = {r.id: r.v for r in C.dedupe_keep_first(df).collect()}
    assert out["hot"] == "v0" and len(out) == 1 + 2 * n // 3
    edges = spark.createDataFrame([(f"c{i}", "root") for i in range(n)] + [("root", "top")], "child string, parent string")
    cl = H.transitive_closure(edges)
    assert cl.count() == 2 * n + 1
    assert F is not None


def test_hot_parent_prefix_and_narrower(spark):
    """One parent code owns a third of all children: prefix parents and counts stay exact."""
    rows = [("1", 1), ("2", 1)] + [(f"1{i:05d}", 2) for i in range(3000)] + [(f"2{i:05d}", 2) for i in range(6000)]
    df = spark.createDataFrame(rows, "id string, level int")
    edges = H.edges_from_prefix(df)
    counts = {r.parent: r.n for r in edges.groupBy("parent").agg(F.count("*").alias("n")).collect()}
    assert counts == {"1": 3000, "2": 6000}
    nl = H.narrower_lists(edges).where("parent = '1'").select("n_children").distinct().collect()
    assert [r.n_children for r in nl] == [3000]


def test_scale_conf_sizes_partitions_for_large_inputs():
    from tessera.session import scale_conf
    c = scale_conf(100 * 10 ** 12)
    assert 30_000 < int(c["spark.sql.shuffle.partitions"]) <= 40_000
    assert int(scale_conf(10 ** 13, shuffled_bytes=10 ** 12)["spark.sql.shuffle.partitions"]) == 10 ** 12 // (256 << 20) + 1
    assert int(c["spark.sql.files.maxPartitionBytes"]) == 256 << 20
    assert int(scale_conf(10 ** 6)["spark.sql.shuffle.partitions"]) == 200


def test_clusters_of_adverse_chains(spark):
    names = ["n0000"] + [f"n{i:04d}" for i in range(70, 0, -1)]
    rows = [(a, b, "exactMatch") for a, b in zip(names, names[1:])] + [("x", None, "exactMatch"), ("y", "n0003", "broadMatch")]
    df = spark.createDataFrame(rows, "source_uri string, target_uri string, mapping_type string")
    assert {tuple(r) for r in M.exact_match_clusters(df).collect()} == {(n, "n0000") for n in names}


def test_outline_of_any_depth(spark):
    import tessera.operators.hierarchy as HH
    lv = [*range(1, 151), 70, 71, 2, 3, 150]
    df = spark.createDataFrame([(f"n{i}", v, i) for i, v in enumerate(lv)], "id string, level int, pos long")
    want, stack = set(), {}
    for i, v in enumerate(lv):
        stack = {k: x for k, x in stack.items() if k < v}
        if v - 1 in stack:
            want.add((f"n{i}", stack[v - 1]))
        stack[v] = f"n{i}"
    assert {tuple(r) for r in HH.edges_from_outline(df, block=40).collect()} == want


def test_hierarchy_falls_through_sources_without_edges(spark):
    rel = spark.createDataFrame([("a", "prefLabel", "x", 1)], "uri string, prop string, target string, pos long")
    rows = spark.createDataFrame([("1", 1), ("2", 2)], "id string, Ebene int")
    name, edges = H.extract_hierarchy(rows, rel)
    assert name == "level" and [tuple(r) for r in edges.collect()] == [("2", "1")]
    flat = spark.createDataFrame([("1", 1, None), ("2", 1, "1")], "id string, rang int, `übergeordnet` string")
    assert H.extract_hierarchy(flat, rel)[0] == "parent"


def test_stacked_positions_cannot_overflow(spark):
    from tessera.operators import combine as C
    big = 2 ** 62
    a = spark.createDataFrame([("k", "first", big)], "id string, v string, pos long")
    b = spark.createDataFrame([("k", "second", 0), ("j", "third", 1)], "id string, v string, pos long")
    got = {(r.id, r.v) for r in C.concat_dedupe([("a", a), ("b", b)]).collect()}
    assert got == {("k", "first"), ("j", "third")}


def test_counters_follow_the_written_concepts(spark):
    """Three blocks of one URI and one unlabelled block, counted by hand."""
    from tessera.operators import cleaner as CL
    concepts = spark.createDataFrame([("http://e/a", 1), ("http://e/a", 2), ("http://e/b", 3), ("c", 4)], "raw_uri string, pos long")
    lits = [(1, "prefLabel", 0, "One,two", "en"), (1, "altLabel", 1, "One,two", "en"), (1, "altLabel", 2, "ok", "en"),
            (1, "definition", 3, "A.B &amp; c", "en"), (1, "note", 4, "fine", "en"), (1, "altLabel", 5, "  ", "en"),
            (2, "prefLabel", 0, "Dropped,twice", "en"), (2, "definition", 1, "gone", "en"),
            (3, "definition", 0, "no label", "en"), (4, "prefLabel", 0, "Ã¤", "en")]
    literals = spark.createDataFrame(lits, "pos long, prop string, vpos int, text string, lang string")
    out = CL.clean_vocabulary(concepts, literals, base="http://e/")
    got = {r.counter: r.value for r in out["report"].collect()}
    assert got == {"total_concepts": 4, "duplicates_removed": 1, "malformed_uris_fixed": 1, "concepts_without_preflabel": 1,
                   "encoding_issues_fixed": 2, "empty_labels_removed": 1, "text_fields_cleaned": 2, "comma_fixes": 2,
                   "labels_processed": 4, "definitions_processed": 1, "notes_processed": 1, "final_concepts": 2,
                   "invalid_concepts_removed": 1, "violations": 1, "warnings": 0}
    assert {(r.prop, r.text) for r in out["literals"].where("uri = 'http://e/a'").collect()} == {
        ("prefLabel", "One, two"), ("altLabel", "One, two"), ("altLabel", "ok"), ("definition", "A. B & c"), ("note", "fine")}
    assert [r.detail for r in out["issues"].collect()] == [
        'S13 Violation: <http://e/a> has 1 overlapping prefLabel/altLabel, first "One,two"@en']


def _outer(a, b):
    """Full outer join of (key, value) lists: null keys meet nothing."""
    out = [(k, x, y) for k, x in a for j, y in b if k is not None and k == j]
    out += [(k, x, None) for k, x in a if k is None or k not in {j for j, _ in b}]
    return out + [(k, None, y) for k, y in b if k is None or k not in {j for j, _ in a}]


def test_full_outer_join_splits_hot_keys(spark):
    from collections import Counter
    from pyspark.sql import functions as F
    from tessera.operators.combine import distributed_join, hot_keys, join_pair
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        a = [("hot", i) for i in range(600)] + [(f"k{i}", i) for i in range(600)] + [(None, i) for i in range(300)] + [("alone", i) for i in range(300)]
        b = [("hot", -1), ("hot", -2), ("warm", -3)] + [("warm2", i) for i in range(500)] + [(f"k{i}", i) for i in range(300, 900)] + [(None, 5), (None, 6)]
        c = [("warm2", 1), ("hot", 2), ("k1", 3)]
        df = {n: spark.createDataFrame(r, f"id string, {n} int").repartition(4) for n, r in (("a", a), ("b", b), ("c", c))}
        hot = hot_keys([df["a"], df["b"], df["c"]], "id")
        assert set(hot[0]) == {"hot", "alone"} and set(hot[1]) == {"warm2"}
        got = Counter(map(tuple, join_pair(df["a"], df["b"], "id").collect()))
        assert got == Counter(_outer(a, b))
        three = Counter((r.id, r.a, r.b, r.c) for r in distributed_join([("a", df["a"]), ("b", df["b"]), ("c", df["c"])], "id").collect())
        ab = _outer(a, b)
        want = _outer([(k, (x, y)) for k, x, y in ab], c)
        assert three == Counter((k, *(xy or (None, None)), z) for k, xy, z in want)
        # rows per task of the joined stage: salted, no task has more than a few times the median
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        sizes = sorted(r[1] for r in join_pair(df["a"], df["b"], "id").groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) == 48 and sizes[-1] <= 5 * sizes[24]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sample_is_the_smallest_hashes(spark):
    import xxhash
    from tessera.operators.fields import sample_check
    rows = [(k * 7919 % 100_003, f"r{k}") for k in range(3_000)]
    got = [r.key for r in sample_check(spark.createDataFrame(rows, "key long, name string"), 100, ["key"]).collect()]

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def digest(key):
        first = xxhash.xxh64((42).to_bytes(4, "little"), seed=42).intdigest()
        return signed(xxhash.xxh64(key.to_bytes(8, "little"), seed=first).intdigest())
    assert got == sorted((k for k, _ in rows), key=lambda k: (digest(k), k))[:100]

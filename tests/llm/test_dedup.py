"""Exact, line and substring deduplication against brute force and planted cases."""

import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from tessera.llm.exact_dedup import drop_copies, exact_groups
from tessera.llm.line_dedup import line_dedup
from tessera.llm.substring_dedup import _pack, _unpack, sketch_bits, substring_dedup
from tests.llm.cases import SCHEMA, prose, rows, table, unique_rows


def norm(t):
    return re.sub("[\x20\x09-\x0D]", "", t or "")


def test_exact_groups_match_brute_force(spark):
    data = rows()
    got = {}
    for r in exact_groups(table(spark)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in data:
        same = [(j, u or "") for j, u, *_ in data if norm(u) == norm(t)]
        keep = min(same, key=lambda s: (-len(s[1]), s[0] is None, s[0] or 0))[0]
        sha = hashlib.sha256(norm(t).encode()).hexdigest()
        mine = [r for r in got[i] if r.text_sha256 == sha]
        assert {(r.keep_id, r.group_size) for r in mine} == {(keep, len(same))}
    kept = [r for rs in got.values() for r in rs if r.kept]
    assert len(kept) == len({norm(t) for _, t, *_ in data})


def test_colliding_hashes_stay_apart(spark):
    weak = lambda c: F.substring(c, 1, 1)
    df = table(spark)
    a = sorted(map(str, exact_groups(df, hash_fn=weak).collect()))
    assert a == sorted(map(str, exact_groups(df).collect()))
    assert drop_copies(df, hash_fn=weak).count() == drop_copies(df).count() == len({norm(t) for _, t, *_ in rows()})


def brute_lines(data):
    first, wins = {}, {}
    for i, t in sorted(data):
        lines = t.split("\n")
        full = [k for k, x in enumerate(lines) if norm(x)]
        wins[i] = [(tuple(full[k:k + 3]), tuple(lines[j] for j in full[k:k + 3])) for k in range(len(full) - 2)]
        for k, (_, w) in enumerate(wins[i]):
            first.setdefault(w, (i, k))
    out = {}
    for i, t in data:
        gone = set(itertools.chain(*(at for k, (at, w) in enumerate(wins[i]) if first[w] != (i, k))))
        lines = t.split("\n")
        out[i] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(3)
    pool = [prose(rng, 4) for _ in range(12)] + ["", "  "]
    data = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    data += [(r[0] + 100, r[1] or "") for r in unique_rows()]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup(df).collect()}
    assert got == brute_lines(data)


def test_line_dedup_uses_no_python(spark):
    plan = line_dedup(table(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_substrings(data, width=13):
    first, out = {}, {}
    split = {i: [w for w in re.split("[\x20\x09-\x0D]+", t or "") if w] for i, t in data}
    for i in sorted(split):
        for k in range(len(split[i]) - width + 1):
            first.setdefault(tuple(split[i][k:k + width]), i)
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < i:
                gone |= set(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def test_substring_dedup_matches_brute_force_for_any_sketch(spark):
    rng = random.Random(5)
    shared = [prose(rng, 25) for _ in range(5)]
    data = [(r[0], r[1]) for r in unique_rows()]
    for i in range(100, 160):
        data.append((i, " ".join(rng.choice([prose(rng, 9), rng.choice(shared)]) for _ in range(rng.randint(0, 6)))))
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute_substrings(data)
    for cells in (1 << 11, 1 << 22):  # a sketch that is far too small lets more through and changes nothing
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.text)
               for r in substring_dedup(df, max_cells=cells).collect()}
        assert got == want


def test_sketch_parts_round_trip():
    import numpy as np
    rng = np.random.default_rng(1)
    for n in (1, 5, 2000, 400_000):
        cells = np.unique(rng.integers(0, 1 << 20, n)).astype(np.uint64)
        assert (_unpack(_pack(cells)) == cells.astype(np.int64)).all()
    assert sketch_bits(0) == 10 and sketch_bits(1 << 60) == 29
    assert SCHEMA

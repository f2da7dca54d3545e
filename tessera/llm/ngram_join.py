"""N-gram Jaccard join: pairs of texts whose sets of word five-grams have similarity 0.8 or more.

Texts become sets of hashed shingles (runs of five words; a shorter text is one
shingle).  Texts with the same set are copies: one of them, the smallest id,
stands for its class.

*Chosen paths.*  Every set is embedded as ``TOKENS`` minimum hashes.  A run
starts at the root and follows every token with probability
1 / (similarity * TOKENS), decided by a hash of (path, token); sets that follow
the same token meet in its bucket.  Buckets of up to ``SMALL`` sets are compared
by brute force; larger ones are split again by tokens sampled at the longer
path.  Two sets at the threshold share one chosen token per level on average, so
one run finds their pair with the survival chance of that branching process;
``runs_for`` repeats runs until the target recall (15 runs for 0.999 at three levels).

*Large buckets.*  Sets close to the first one of a bucket are linked to it and
leave the bucket before it splits: Jaccard distance is a metric, so whatever
is similar to them is near the first set too and is linked as well.  Buckets
above ``LARGE`` sets are split the same way by Spark joins, level by level, so no
task gathers one.

*Exact check.*  Found links only group sets into candidate groups.  A group above
one block is first refined: its sets stay together only where they share one of
their rarest shingles (the prefix filter: two sets at the threshold share one of the
first ``n - 0.8 n + 1`` shingles in any common order), so a family that only shares a
template falls apart before any pair is formed.  Inside a refined group all
pairs of different sets are verified exactly on their shingles, in blocks of
``BLOCK`` sets a side, so links are complete there and a large group is spread over
tasks.  Tasks return counts and a spanning forest, never pairs.

Defined cases: a null text, or one without a word, has no set: its class is its
own and it has no links; copies share class and links; rows that repeat an id
with its text give one row, an id with different texts one for each (sets are told
apart by their content, never by their id); a row without an id is left out; very long texts
take part whole; ties are broken by the smallest id; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_as_long, raw, text_or_empty
from tessera.llm.words import U64, mix, texts, windows, words
from tessera.operators.components import connected_components
from tessera.operators.skew import join_reduced
from tessera.session import checkpoint_dir

WIDTH, SIMILARITY = 5, 0.8
TOKENS = 64
SMALL, LARGE, BLOCK = 128, 20_000, 256
#: Estimated similarities (of 64 tokens) that make a link in a small bucket, that link to the first set of a large
#: one, and that let a set leave a large one.  Estimates scatter by 0.05 around 0.8.
NEAR, REACH, LEAVE = 0.62, 0.5, 0.75
#: Up to so many ids of sets to verify, they are broadcast; above, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
LEVELS = 10
#: Depth that the runs of all sets allow for; sets met deeper take part in more runs.
SHALLOW = 3
_rng = np.random.default_rng(20240229)
_FLIP = _rng.integers(0, 1 << 64, TOKENS, dtype=U64)
_ODD = _rng.integers(0, 1 << 64, TOKENS, dtype=U64) | U64(1)
_PLACE = _rng.integers(0, 1 << 64, TOKENS, dtype=U64)
_CHOSEN = U64(int((1 << 64) / (SIMILARITY * TOKENS)))


def runs_for(recall: float, levels: int = 3) -> int:
    """Runs that find a pair at the threshold with chance ``recall``, if its bucket is ``levels`` deep.

    The chance of one run is the survival of a branching process with one child on average.
    """
    alive = 1.0
    for _ in range(levels):
        alive = 1.0 - math.exp(-alive)
    return max(1, math.ceil(math.log(1.0 - recall) / math.log(1.0 - alive)))


# ---------------------------------------------------------------- sets

def shingles(buf: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle, texts ascending, each text's hashes sorted and different."""
    _, _, counts, (w,) = words(buf, bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    at, h = windows(w, counts, width)
    doc = owner[at]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])
        own = np.array([int.from_bytes(hashlib.blake2b(w[first[k]:first[k + 1]].tobytes(), digest_size=8).digest(), "little")
                        for k in short], dtype=U64)
        doc, h = np.concatenate([doc, short]), np.concatenate([h, own])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


_SET = pa.schema([("_id", pa.int64()), ("_key", pa.binary()), ("_sketch", pa.binary())])


def _set_task(width: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("_id").to_pylist()
            for a, b, buf, bounds in texts(batch, "_t"):
                doc, h = shingles(buf, bounds, width)
                some, start = np.unique(doc, return_index=True)
                if not len(some):
                    continue
                sketch = np.empty((len(some), TOKENS), dtype="<u2")
                for k in range(TOKENS):
                    least = np.minimum.reduceat((h ^ _FLIP[k]) * _ODD[k], start)
                    sketch[:, k] = mix(least) >> U64(48)
                stop = np.append(start[1:], len(h))
                keys = [hashlib.md5(h[x:y].tobytes()).digest() for x, y in zip(start, stop)]
                yield pa.RecordBatch.from_arrays([pa.array([ids[a + k] for k in some], pa.int64()), pa.array(keys, pa.binary()),
                                                  pa.array([s.tobytes() for s in sketch], pa.binary())], schema=_SET)
    return run


def text_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(_id, _key, _sketch): 128-bit key of the set and its tokens, for texts with a word."""
    base = docs.where(F.col(f"`{id_col}`").isNotNull()).select(
        id_as_long(id_col).alias("_id"), raw(text_or_empty(text_col)).alias("_t"))
    return base.mapInArrow(_set_task(width), "_id long, _key binary, _sketch binary")


# ---------------------------------------------------------------- buckets

def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, TOKENS)


def _children(path: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, path of the child) for every token a row follows from its path."""
    token = mix(sketch.astype(U64) + _PLACE[None, :]) ^ path[:, None]
    row, place = np.nonzero(mix(token) < _CHOSEN)
    return row, mix(token[row, place] + U64(0x9E3779B97F4A7C15))


_PATH = pa.schema([("_path", pa.int64()), ("_id", pa.int64()), ("_sketch", pa.binary())])


def _root_task(first: int, last: int):
    """A set takes part in the runs ``first`` to its own ``_last`` - 1."""
    roots = mix(np.arange(first + 1, last + 1, dtype=U64) * U64(0xD1B54A32D192ED03))

    def run(batches):
        for batch in batches:
            sk, until = _sketches(batch.column("_sketch")), batch.column("_last").to_numpy()
            for k, root in enumerate(roots, first):
                own = np.flatnonzero(until > k)
                row, path = _children(np.full(len(own), root, dtype=U64), sk[own])
                if len(row):
                    take = pa.array(own[row])
                    yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column("_id").take(take),
                                                      batch.column("_sketch").take(take)], schema=_PATH)
    return run


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of every row's component, for links a-b among rows 0..n-1."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if np.array_equal(low, label):
            return label
        label = low


def _bucket_links(path: int, ids: np.ndarray, sk: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Links found in one bucket and the buckets it splits into: (id, linked id, 0), and (id, id, level) of sets in deep ones."""
    if len(ids) < 2:
        return
    if level > SHALLOW and (len(ids) <= SMALL or level >= LEVELS):
        yield ids, ids, level
    if len(ids) <= SMALL or level >= LEVELS:
        label = np.arange(len(ids))
        step = max(1, (1 << 22) // (len(ids) * TOKENS))
        for lo in range(0, len(ids), step):
            a, b = np.nonzero((sk[lo:lo + step, None, :] == sk[None, :, :]).sum(2, dtype=np.int16) >= NEAR * TOKENS)
            own = np.flatnonzero(label != np.arange(len(ids)))
            label = _forest(len(ids), np.concatenate([a + lo, own]), np.concatenate([b, label[own]]))
        own = np.flatnonzero(label != np.arange(len(ids)))
        if len(own):
            yield ids[own], ids[label[own]], 0
        return
    close = (sk == sk[0]).sum(1) / TOKENS
    near = close >= REACH
    near[0] = False
    if near.any():
        yield ids[near], np.repeat(ids[0], near.sum()), 0
    stay = close < LEAVE
    ids, sk = ids[stay], sk[stay]
    row, child = _children(np.full(len(ids), path, dtype=U64), sk)
    order = np.argsort(child, kind="stable")
    row, child = row[order], child[order]
    cut = np.flatnonzero(np.diff(child)) + 1
    for part in np.split(np.arange(len(row)), cut):
        if len(part) > 1:
            yield from _bucket_links(child[part[0]], ids[row[part]], sk[row[part]], level + 1)


_LINK = pa.schema([("_a", pa.int64()), ("_b", pa.int64()), ("_level", pa.int32())])


def _bucket_task(level: int):
    """Buckets arrive sorted by path; each has at most ``LARGE`` sets and lies ``level`` deep."""
    def solve(path, parts):
        ids = np.concatenate([p[0] for p in parts])
        if len(ids) > 1:
            sk = np.concatenate([p[1] for p in parts])
            order = np.argsort(ids, kind="stable")
            for a, b, deep in _bucket_links(np.int64(path).view(U64), ids[order], sk[order], level):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), deep, dtype=np.int32))], schema=_LINK)

    def run(batches):
        path, parts = None, []
        for batch in batches:
            paths = batch.column("_path").to_numpy()
            ids, sk = batch.column("_id").to_numpy(), _sketches(batch.column("_sketch"))
            cut = np.concatenate([[0], np.flatnonzero(np.diff(paths)) + 1, [len(paths)]])
            some = np.diff(cut) > 1  # a single set in the middle of a batch is alone in its bucket
            some[[0, -1]] = True
            for x, y in zip(cut[:-1][some], cut[1:][some]):
                if x == y:
                    continue
                if paths[x] != path:
                    if path is not None:
                        yield from solve(path, parts)
                    path, parts = paths[x], []
                parts.append((ids[x:y], sk[x:y]))
        if path is not None:
            yield from solve(path, parts)
    return run


def _split_task(batches):
    """One level of a bucket above ``LARGE`` sets: links to its first set, and the children of the sets that stay."""
    for batch in batches:
        sk, first = _sketches(batch.column("_sketch")), _sketches(batch.column("_first_sketch"))
        ids, head = batch.column("_id").to_numpy(), batch.column("_first").to_numpy()
        close = (sk == first).sum(1) / TOKENS
        link = np.flatnonzero((close >= REACH) & (ids != head))
        stay = np.flatnonzero(close < LEAVE)
        row, path = _children(batch.column("_path").to_numpy()[stay].view(U64), sk[stay])
        none = pa.nulls(len(link), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([none, pa.array(path.view(np.int64))]), pa.array(np.concatenate([ids[link], ids[stay][row]])),
             pa.concat_arrays([pa.nulls(len(link), pa.binary()), batch.column("_sketch").take(pa.array(stay[row]))]),
             pa.concat_arrays([pa.array(head[link]), pa.nulls(len(row), pa.int64())])],
            names=["_path", "_id", "_sketch", "_b"])


def bucket_links(sets: DataFrame, first: int, last: int) -> DataFrame:
    """(_a, _b, _level) of the runs ``first`` to ``last - 1``: links between sets that met in a bucket and look similar, at most
    one per set and bucket, and for every set of a deep bucket (_a = _b) its level."""
    rows = sets.select("_id", "_sketch", "_last").mapInArrow(_root_task(first, last), "_path long, _id long, _sketch binary")
    links, level = [], 1

    def solved(part: DataFrame) -> DataFrame:
        return (part.repartition("_path").sortWithinPartitions("_path")
                .mapInArrow(_bucket_task(level), "_a long, _b long, _level int"))

    while True:
        big = rows.groupBy("_path").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")).where(F.col("_n") > LARGE)
        big = big.select("_path", "_first").checkpoint()
        if big.isEmpty():
            links.append(solved(rows))
            break
        links.append(solved(rows.join(big.select("_path"), "_path", "left_anti")))
        heads = (big.join(rows, "_path").where("_id = _first").select("_path", "_first", F.col("_sketch").alias("_first_sketch"))
                 .dropDuplicates(["_path"]))
        split = (rows.join(heads, "_path").select("_path", "_id", "_sketch", "_first", "_first_sketch")
                 .mapInArrow(_split_task, "_path long, _id long, _sketch binary, _b long").checkpoint())
        links.append(split.where("_b is not null").select(F.col("_id").alias("_a"), "_b", F.lit(0).alias("_level")))
        rows = split.where("_path is not null").select("_path", "_id", "_sketch")
        level += 1
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def candidate_links(sets: DataFrame, recall: float) -> DataFrame:
    """(_a, _b): links of as many runs as the target recall asks for at the depth where a set was met."""
    first = runs_for(recall, SHALLOW)
    found = bucket_links(sets.withColumn("_last", F.lit(first)), 0, first).distinct().checkpoint()
    out = found.where("_a <> _b").select("_a", "_b")
    levels = sorted(r[0] for r in found.where("_level > 0").select("_level").distinct().collect())  # at most LEVELS of them
    if levels:
        until = F.element_at(F.create_map(*[F.lit(x) for k in levels for x in (k, runs_for(recall, k))]), F.col("_level"))
        deep = found.where("_level > 0").groupBy(F.col("_a").alias("_id")).agg(F.max("_level").alias("_level")).select("_id", until.alias("_last"))
        again = bucket_links(sets.join(deep, "_id"), first, runs_for(recall, levels[-1]))
        out = out.unionByName(again.where("_a <> _b").select("_a", "_b"))
    return out


# ---------------------------------------------------------------- exact check

_ROW = pa.schema([("_group", pa.int64()), ("_i", pa.int32()), ("_j", pa.int32()), ("_blocks", pa.int32()),
                  ("_id", pa.int64()), ("_set", pa.binary())])


def _wanted_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingles) of the texts whose set is the one asked for; another text of the same id is passed over."""
    keys = batch.column("_key").to_pylist()
    for a, _, buf, bounds in texts(batch, "_t"):
        doc, h = shingles(buf, bounds, width)
        some, start = np.unique(doc, return_index=True)
        for k, x, y in zip(some, start, np.append(start[1:], len(h))):
            if hashlib.md5(h[x:y].tobytes()).digest() == keys[a + k]:
                yield a + k, h[x:y]


def _shingle_task(width: int):
    """The shingles of a set, a row each."""
    def run(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("_group", "_id")]
            for k, h in _wanted_sets(batch, width):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), c[k])) for c in cols] + [pa.array(h.view(np.int64))],
                                                 names=["_group", "_id", "_h"])
    return run


def refined(wanted: DataFrame, similarity: float, width: int) -> DataFrame:
    """(_id, _group): the sets of ``wanted`` (_group, _id, _key, _t), together only where they share one of their rarest shingles."""
    rows = wanted.mapInArrow(_shingle_task(width), "_group long, _id long, _h long").distinct()
    often = rows.groupBy("_group", "_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    ranked = join_reduced(rows, often, ["_group", "_h"], "left")
    # a shingle that no other set of the group has leads nowhere, but takes a place of the prefix
    sets = ranked.groupBy("_group", "_id").agg(
        F.count(F.lit(1)).alias("_size"), F.count("_n").alias("_shared"),
        F.sort_array(F.collect_list(F.when(F.col("_n").isNotNull(), F.struct("_n", "_h")))).alias("_order"))
    left = F.col("_size") - F.ceil(F.col("_size") * similarity - 1e-9) + 1 - (F.col("_size") - F.col("_shared"))
    prefix = (sets.where(left > 0).select("_group", "_id", F.explode(F.slice("_order", F.lit(1), left.cast("int"))).alias("_x"))
              .select("_group", "_id", F.col("_x._h").alias("_h")).checkpoint())
    heads = prefix.groupBy("_group", "_h").agg(F.min("_id").alias("_head"))
    stars = join_reduced(prefix, heads, ["_group", "_h"]).where("_id <> _head").select("_id", "_head").distinct()
    return connected_components(stars, "_id", "_head").select(F.col("node").alias("_id"), F.col("component").alias("_group"))


def _block_task(width: int):
    """A set goes to every pair of blocks that its block is in."""
    def run(batches):
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("_id", "_group", "_blocks")}
            for k, h in _wanted_sets(batch, width):
                ident, group, blocks = (cols[c][k] for c in ("_id", "_group", "_blocks"))
                own = int(mix(np.array([ident], dtype=np.int64).view(U64))[0] % U64(blocks))
                pairs = [(min(own, o), max(own, o)) for o in range(blocks)]
                data = h.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group] * blocks, pa.int64()), pa.array([p[0] for p in pairs], pa.int32()),
                     pa.array([p[1] for p in pairs], pa.int32()), pa.array([blocks] * blocks, pa.int32()),
                     pa.array([ident] * blocks, pa.int64()),
                     pa.array([data] * blocks, pa.binary())], schema=_ROW)
    return run


_FOUND = pa.schema([("_id", pa.int64()), ("_links", pa.int64()), ("_to", pa.int64())])


def _similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets have Jaccard similarity ``similarity`` or more, exactly."""
    n, size = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    column = (np.cumsum(count > 1) - 1)[code[shared]]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), dtype=np.float32)
    total, step = int(column[-1]) + 1 if len(column) else 0, 2048
    for lo in range(0, total, step):
        x, y = np.searchsorted(column, (lo, lo + step))
        part = np.zeros((n, min(step, total - lo)), dtype=np.float32)
        part[owner[x:y], column[x:y] - lo] = 1
        common += part @ part.T
    union = size[:, None] + size[None, :] - common
    return common >= similarity * union - 1e-6


def _verify_task(similarity: float):
    def solve(key, rows):
        ids = np.array(list(rows), dtype=np.int64)
        block = (mix(ids.view(U64)) % U64(key[3])).astype(np.int64)
        linked = _similar([np.frombuffer(d, dtype=U64) for d in rows.values()], similarity)
        linked &= ids[:, None] != ids[None, :]
        if key[1] != key[2]:
            linked &= block[:, None] != block[None, :]
        a, b = np.nonzero(linked)
        if len(a):
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), dtype=np.int64)
            rank[order] = np.arange(len(ids))
            label = _forest(len(ids), rank[a], rank[b])
            n = linked.sum(1)
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(n[has].astype(np.int64)),
                                              pa.array(ids[order[label[rank[has]]]])], schema=_FOUND)

    def run(batches):
        key, rows = None, {}  # a repeated row counts once
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("_group", "_i", "_j", "_blocks", "_id", "_set")]
            for g, i, j, blocks, ident, data in zip(*cols):
                if (g, i, j, blocks) != key:
                    if key is not None:
                        yield from solve(key, rows)
                    key, rows = (g, i, j, blocks), {}
                rows[ident] = data
        if key is not None:
            yield from solve(key, rows)
    return run


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
               similarity: float = SIMILARITY, recall: float = 0.999) -> DataFrame:
    """(id, class_id, rep_id, n_copies, n_links), one row per id.

    ``rep_id``: smallest id with the same set (``n_copies`` ids have it); ``n_links``: other
    different sets linked to this one; ``class_id``: smallest id of everything linked, directly or not.
    """
    checkpoint_dir(docs.sparkSession)
    sets = text_sets(docs, id_col, text_col, width).checkpoint()
    members = sets.select("_id", "_key").distinct()
    # from here on a set has a number of its own; an id may have several sets
    classes = (members.groupBy("_key").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_copies"))
               .withColumn("_node", F.monotonically_increasing_id()).checkpoint())
    members = join_reduced(members, classes, ["_key"]).select("_id", "_rep", "_copies", "_node").checkpoint()
    reps = (sets.select("_id", "_key", "_sketch").join(classes.select(F.col("_rep").alias("_id"), "_key", "_node"), ["_id", "_key"])
            .select(F.col("_node").alias("_id"), "_sketch").dropDuplicates(["_id"]))

    base = docs.where(F.col(f"`{id_col}`").isNotNull()).select(id_as_long(id_col).alias("_rep"), text_or_empty(text_col).alias("_s"))
    named = classes.select(F.col("_node").alias("_id"), "_rep", "_key")

    def with_texts(todo: DataFrame) -> DataFrame:
        few = todo.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        return base.join(F.broadcast(todo) if few else todo, "_rep").withColumn("_t", raw(F.col("_s"))).drop("_s", "_rep")

    groups = connected_components(candidate_links(reps, recall), "_a", "_b").select(F.col("node").alias("_id"), F.col("component").alias("_group"))
    size = groups.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    groups = groups.join(size, "_group").join(named, "_id").checkpoint()
    large = groups.where(F.col("_n") > BLOCK).select("_group", "_id", "_key", "_rep").checkpoint()
    todo = groups.where(F.col("_n") <= BLOCK).select("_group", "_id", "_key", "_rep")
    if not large.isEmpty():
        todo = todo.unionByName(refined(with_texts(large), similarity, width).join(large.select("_id", "_key", "_rep"), "_id"))
    sizes = todo.groupBy("_group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    todo = todo.join(sizes, "_group").checkpoint()
    blocks = with_texts(todo).mapInArrow(_block_task(width), "_group long, _i int, _j int, _blocks int, _id long, _set binary")
    found = (blocks.repartition("_group", "_i", "_j").sortWithinPartitions("_group", "_i", "_j")
             .mapInArrow(_verify_task(similarity), "_id long, _links long, _to long").checkpoint())
    linked = found.groupBy("_id").agg(F.sum("_links").alias("_links"))
    merged = connected_components(found.where("_id <> _to"), "_id", "_to").join(named.select(F.col("_id").alias("node"), "_rep"), "node")
    least = merged.groupBy("component").agg(F.min("_rep").alias("_class"))
    per_set = (linked.join(merged.join(least, "component").select(F.col("node").alias("_id"), "_class"), "_id", "left")
               .withColumnRenamed("_id", "_node"))
    out = (join_reduced(members, per_set, ["_node"], "left")
           .select("_id", F.coalesce("_class", "_rep").alias("class_id"), F.col("_rep").alias("rep_id"),
                   F.col("_copies").alias("n_copies"), F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links")))
    ids = docs.where(F.col(f"`{id_col}`").isNotNull()).select(id_as_long(id_col).alias("_id")).distinct()
    return (ids.join(out, "_id", "left")
            .select(F.col("_id").alias(id_col), F.coalesce("class_id", "_id").alias("class_id"),
                    F.coalesce("rep_id", "_id").alias("rep_id"), F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"),
                    F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")))


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                      similarity: float = SIMILARITY, recall: float = 0.999) -> DataFrame:
    """The rows, with all columns, whose id is the smallest of its class; rows without an id stay.

    An id that has several texts goes if one of them belongs to a smaller id's class.

    Only the ids that go (copies and linked texts) are joined back; up to ``BROADCAST_IDS`` of them are broadcast.
    """
    found = ngram_join(docs, id_col, text_col, width, similarity, recall)
    gone = found.where(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias("_gone")).checkpoint()
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col].cast("bigint") == gone["_gone"], "left_anti")

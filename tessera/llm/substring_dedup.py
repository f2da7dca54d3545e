"""Substring deduplication: word windows that repeat in a document of smaller id.

1. *Sketch.*  Every task folds its 13-word windows into a count-min sketch of
   ``DEPTH`` rows; counters saturate at two, which is all the filter asks for,
   so a cell is two bits.  Tasks send only the parts they touched, compressed,
   block by block; merging adds saturating counters.  The width follows the
   input's size up to ``max_cells`` bits (the broadcast bound, 128 MB).
   A document whose whole text stands in a smaller id (by SHA-256) is all
   repetition and needs no windows; it takes no part in either pass.
2. *Exact grouping.*  A second pass keeps the windows whose counters all reach
   two - counters overestimate, so no repeated window is lost - and groups them
   by a 96-bit hash of their words with the smallest document id.  Beyond the
   bound the filter lets more windows through, up to all; results stay exact.
3. *Removal.*  The words covered by windows found in a smaller id go.

Windows are judged on the input, never on what is left.

Defined cases: a null or empty text has no words; texts under ``width`` words
stay whole; a row without an id stays whole and does not count for others;
rows that repeat an id with its text are one document, whose windows do not
remove each other; an id that stands on rows with different texts is one document,
too, and the positions found in any of them are taken from all; very long texts
take part whole; a window that repeats only inside one document stays; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_as_long, raw, text_or_empty
from tessera.llm.words import U64, mix, texts, windows, words
from tessera.operators.skew import join_reduced
from tessera.session import checkpoint_dir

WIDTH = 13
DEPTH = 2
#: Cells of one block of a sketch row: the unit of merging.
BLOCK_BITS = 20
#: Most cells of a whole sketch; at one bit a cell this bounds the broadcast to 128 MB.
MAX_CELLS = 1 << 30
#: Windows a task gathers before it sends their cells on.
FLUSH = 1 << 20
#: Up to so many ids of whole copies, they are broadcast (8 bytes each); above, they are joined by a shuffle.
BROADCAST_COPIES = 2_000_000
#: Up to so many bytes of removals (and documents with one), they are broadcast; above, texts are joined by a shuffle.
BROADCAST_GONE_BYTES, BROADCAST_GONE_ROWS = 16 << 20, 500_000
#: In place of positions: every window of the document.
EVERY = -1


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(h + U64(0x9E3779B97F4A7C15 * row % (1 << 64))) >> U64(64 - bits)).astype(np.uint32)  # MAX_CELLS < 2^32


def _pack(cells: np.ndarray) -> bytes:
    """Ascending cell numbers as gaps, a byte each (255: carry on), about one byte a cell."""
    gaps = np.diff(cells.astype(np.int64), prepend=-1) - 1
    more = gaps // 255
    out = np.full(len(gaps) + int(more.sum()), 255, dtype=np.uint8)
    out[np.cumsum(more + 1) - 1] = gaps % 255
    return zstandard.compress(out.tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    gaps = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8)
    last = gaps != 255
    return np.cumsum(gaps, dtype=np.int64)[last] + np.arange(last.sum())


_PART = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _flush(hashes: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """The sketch of some windows: per row and touched block, the cells counted once or more, and twice or more."""
    h = np.concatenate(hashes)
    block_bits = min(BLOCK_BITS, bits)
    for row in range(DEPTH):
        cells = np.sort(_cells(h, row, bits))
        again = np.unique(cells[1:][cells[1:] == cells[:-1]])
        edges = np.arange(1 << (bits - block_bits), dtype=np.uint32) << np.uint32(block_bits)
        a = np.append(np.searchsorted(cells, edges), len(cells))
        b = np.append(np.searchsorted(again, edges), len(again))
        low = np.uint32((1 << block_bits) - 1)
        out: list[tuple] = []
        for k in np.flatnonzero(np.diff(a)):
            out.append((row, int(k), _pack(np.unique(cells[a[k]:a[k + 1]] & low)),
                        _pack(again[b[k]:b[k + 1]] & low) if b[k + 1] > b[k] else None))
            if len(out) == 64:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _PART)], schema=_PART)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _PART)], schema=_PART)


def _sketch_task(bits: int, width: int):
    def run(batches):
        have: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for _, _, buf, bounds in texts(batch, "_t", 1 << 20):
                _, _, counts, (w,) = words(buf, bounds)
                _, h = windows(w, counts, width)
                have.append(h)
                n += len(h)
                if n >= FLUSH:
                    yield from _flush(have, bits)
                    have, n = [], 0
        if n:
            yield from _flush(have, bits)
        have.clear()
        pa.default_memory_pool().release_unused()
    return run


def _merge_task(batches):
    """Adds the parts of each (row, block), which arrive sorted; keeps the cells counted twice or more."""
    key, once, twice = None, None, None
    schema = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("twice", pa.binary())])

    def result():
        packed = zstandard.compress(np.packbits(twice).tobytes(), 3)
        return pa.RecordBatch.from_pydict({"row": [key[0]], "block": [key[1]], "twice": [packed]}, schema=schema)

    for batch in batches:
        for row, block, one, two in zip(*(batch.column(c).to_pylist() for c in ("row", "block", "once", "twice"))):
            if (row, block) != key:
                if key is not None and twice.any():
                    yield result()
                key, once, twice = (row, block), np.zeros(1 << BLOCK_BITS, bool), np.zeros(1 << BLOCK_BITS, bool)
            cells = _unpack(one)
            twice[cells] |= once[cells]
            once[cells] = True
            if two is not None:
                twice[_unpack(two)] = True
    if key is not None and twice.any():
        yield result()


def _bitmap(blocks: list, bits: int) -> list[np.ndarray]:
    """The merged sketch: one bitmap per row."""
    rows = [np.zeros(max(1 << bits, 1 << BLOCK_BITS) // 8, np.uint8) for _ in range(DEPTH)]
    size = (1 << BLOCK_BITS) // 8
    for row, block, blob in blocks:
        rows[row][block * size:(block + 1) * size] = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return rows


_HIT = pa.schema([("_id", pa.int64()), ("_k", pa.int32()), ("_h1", pa.int64()), ("_h2", pa.int32())])


def _hit_task(shared, bits: int, width: int):
    def run(batches):
        rows = _bitmap(shared.value, bits)  # per task: nothing stays in an idle worker
        for batch in batches:
            ids = batch.column("_id").to_numpy(zero_copy_only=False)
            for a, b, buf, bounds in texts(batch, "_t", 1 << 20):
                _, _, counts, (w1, w2) = words(buf, bounds, 2)
                at, h = windows(w1, counts, width)
                keep = np.arange(len(h))
                for row, bitmap in enumerate(rows):
                    c = _cells(h[keep], row, bits).astype(np.int64)
                    keep = keep[(bitmap[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1]
                if len(keep):
                    _, g = windows(w2, counts, width, 1)
                    doc = np.repeat(np.arange(a, b), counts)[at[keep]]
                    first = np.concatenate([[0], np.cumsum(counts)])[doc - a]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[doc], pa.int64()), pa.array((at[keep] - first).astype(np.int32)),
                         pa.array(h[keep].view(np.int64)), pa.array((g[keep] >> U64(32)).astype(np.uint32).view(np.int32))], schema=_HIT)
    return run


def sketch_bits(n_bytes: int, max_cells: int = MAX_CELLS) -> int:
    """log2 of the cells of a row: about as many cells as half the text's bytes, over all rows, within the bound."""
    return max(10, min(int(math.log2(max_cells // DEPTH)), math.ceil(math.log2(max(n_bytes, 2) / DEPTH))))


def whole_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id): documents whose whole text also stands in a smaller id."""
    slim = docs.where(F.col(f"`{id_col}`").isNotNull()).select(
        id_as_long(id_col).alias("_id"), F.unhex(F.sha2(raw(text_or_empty(text_col)), 256)).alias("_sha"))
    first = slim.groupBy("_sha").agg(F.min("_id").alias("_f"), F.max("_id").alias("_l")).where("_f < _l").drop("_l")
    return join_reduced(slim, first, ["_sha"]).where("_id > _f").select("_id").distinct()


def repeated_windows(docs: DataFrame, copies: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     width: int = WIDTH, max_cells: int = MAX_CELLS) -> DataFrame:
    """(_id, _k, _h1, _h2): windows whose sketched count is two or more, by document and first word, without ``copies``."""
    spark = docs.sparkSession
    base = docs.where(F.col(f"`{id_col}`").isNotNull()).select(
        id_as_long(id_col).alias("_id"), raw(text_or_empty(text_col)).alias("_t"))
    n_bytes = base.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    base = base.join(copies, "_id", "left_anti")
    bits = sketch_bits(n_bytes, max_cells)
    parts = base.select("_t").mapInArrow(_sketch_task(bits, width), "row int, block int, once binary, twice binary")
    merged = (parts.repartition("row", "block").sortWithinPartitions("row", "block")
              .mapInArrow(_merge_task, "row int, block int, twice binary"))
    blocks = [(r["row"], r["block"], bytes(r["twice"])) for r in merged.toLocalIterator()]  # at most max_cells / 8 bytes
    shared = spark.sparkContext.broadcast(blocks)
    return base.mapInArrow(_hit_task(shared, bits, width), "_id long, _k int, _h1 long, _h2 int")


def _runs_task(batches):
    """Positions of a document's removed windows as runs (first, last)."""
    for batch in batches:
        out = []
        for at in batch.column("_at"):
            k = np.unique(at.values.to_numpy())
            cut = np.flatnonzero(np.diff(k) != 1) + 1
            out.append(np.stack([k[np.append(0, cut)], k[np.append(cut - 1, len(k) - 1)]], 1).astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(out, pa.binary())], names=["_id", "_gone"])


def _digest_task(width: int, with_text: bool):
    names = ["_id", "n_words", "n_removed", "kept_sha256"] + ["_kept"] * with_text
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for ident, text, gone in zip(*(batch.column(c) for c in ("_id", "_t", "_gone"))):
                w = text.as_py().split()
                n = len(w)
                if gone.is_valid and n >= width:
                    covered = np.zeros(n + 1, dtype=np.int32)
                    first, last = np.frombuffer(gone.as_py(), dtype="<i4").reshape(-1, 2).T
                    if first[0] == EVERY:
                        first, last = np.array([0]), np.array([n - width])
                    np.add.at(covered, first, 1)
                    np.add.at(covered, np.minimum(last + width, n), -1)
                    w = list(itertools.compress(w, (np.cumsum(covered[:n]) == 0).tolist()))
                kept = b" ".join(w)
                row = (ident.as_py(), n, n - len(w), hashlib.sha256(kept).hexdigest())
                out.append(row + (kept.decode(),) if with_text else row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    max_cells: int = MAX_CELLS, with_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, text]): what stays of each document, one row per input row."""
    checkpoint_dir(docs.sparkSession)
    copies = whole_copies(docs, id_col, text_col).checkpoint()
    few = copies.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES
    found = repeated_windows(docs, F.broadcast(copies) if few else copies, id_col, text_col, width, max_cells)
    first = (found.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
             .where("_first < _last").drop("_last"))
    gone = (join_reduced(found, first, ["_h1", "_h2"]).where("_id > _first")
            .groupBy("_id").agg(F.collect_list("_k").alias("_at"))
            .unionByName(copies.select("_id", F.array(F.lit(EVERY)).alias("_at")))
            .mapInArrow(_runs_task, "_id long, _gone binary").checkpoint())
    n, size = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_gone")), F.lit(0))).first()
    if n <= BROADCAST_GONE_ROWS and size <= BROADCAST_GONE_BYTES:
        gone = F.broadcast(gone)
    base = docs.select(id_as_long(id_col).alias("_id"), raw(text_or_empty(text_col)).alias("_t")).join(gone, "_id", "left")
    schema = "_id long, n_words long, n_removed long, kept_sha256 string" + (", _kept string" if with_text else "")
    out = base.mapInArrow(_digest_task(width, with_text), schema).withColumnRenamed("_id", id_col)
    return out.withColumnRenamed("_kept", text_col) if with_text else out

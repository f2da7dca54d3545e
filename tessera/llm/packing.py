"""Packing tokenised documents into sequences of bounded length.

1. *Pieces.*  Texts become token ids plus an end id; documents longer than a
   sequence are cut into full pieces, only the first of which may be shorter.
   The slim piece table (no texts, no ids) is checkpointed, so texts are
   tokenised once.
2. *Plan.*  Only the histogram of piece lengths (at most ``capacity`` numbers)
   reaches the driver.  The configuration linear program over it - fewest
   sequences so that the chosen fillings hold every length as often as it
   occurs - is solved by multiplicative weights: a knapsack dynamic program
   prices the best filling under the current weights, the filling is taken as
   often as its scarcest length allows, and weights of covered lengths fall.
   The fractional solution is rounded down; what is left is filled best-fit
   decreasing, each filling as many times as the histogram allows, so the
   work does not depend on the number of pieces.
3. *Placement.*  Pieces of a length are numbered by salted groups of bounded
   size plus offsets; the number picks the sequence and the place from the plan.

Defined cases: a null text is empty, and an empty document is its end id
alone; a repeated row is a document of its own and is placed on its own; equal
lengths are numbered by (id, piece, checksum), so ties change nothing; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import id_as_long, text_or_empty
from tessera.session import checkpoint_dir

CAPACITY = 1024
END_ID = 2
#: Pieces of one length numbered in one group.
GROUP = 100_000
_encoders: dict[str, object] = {}


def _printable_bytes() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from code point 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_encoder(path: str):
    """``text -> uint32 ids`` for a byte-level BPE file of the ``tokenizers`` library, without special tokens.

    Where the file's merges come in the order of their ids, its vocabulary is a
    rank table and ``tiktoken`` gives the same ids about five times faster; any
    other file is run by ``tokenizers`` itself.
    """
    if path in _encoders:
        return _encoders[path]
    from tokenizers import Tokenizer
    spec = json.load(open(path, encoding="utf-8"))
    special = {t["content"] for t in spec.get("added_tokens", [])}
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
    ranked = (model.get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
              and pre.get("use_regex", True) and not spec.get("normalizer")
              and [vocab.get(m) for m in merges] == list(range(256, 256 + len(merges))) and len(vocab) == 256 + len(merges))
    if ranked:
        import tiktoken
        from public_tokenizers import PATTERN
        byte = _printable_bytes()
        enc = tiktoken.Encoding("ranks", pat_str=PATTERN, special_tokens={},
                                mergeable_ranks={bytes(byte[c] for c in k): v for k, v in vocab.items()})
        fn = lambda text: np.asarray(enc.encode_ordinary(text), dtype="<u4")
    else:
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        fn = lambda text: np.asarray(tok.encode(text, add_special_tokens=False).ids, dtype="<u4")
    _encoders[path] = fn
    return fn


_PIECE = pa.schema([("_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64())])


def _piece_task(path: str, capacity: int, end_id: int):
    def run(batches):
        encode = load_encoder(path)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            out: list[tuple] = []
            for ident, text in zip(batch.column("_id"), batch.column("_t")):
                ids = np.concatenate([encode(text.as_py()), end])
                n = len(ids)
                first = (n - 1) % capacity + 1
                cuts = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    out.append((ident.as_py(), k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECE)], schema=_PIECE)
    return run


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(_id, piece, start, length, ids_crc32): the pieces of every document."""
    base = docs.select(id_as_long(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))
    return base.mapInArrow(_piece_task(path, capacity, end_id),
                           "_id long, piece int, start long, length long, ids_crc32 long")


def _best_filling(value: np.ndarray, capacity: int) -> dict[int, int]:
    """Knapsack by dynamic programming: lengths (with repeats) of largest total value that fit."""
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, dtype=np.int32)  # length put in last; 0: the space stays empty
    for c in range(1, capacity + 1):
        total = value[1:c + 1] + best[c - 1::-1]
        k = int(total.argmax())
        if total[k] > best[c - 1]:
            best[c], last[c] = total[k], k + 1
        else:
            best[c] = best[c - 1]
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        n = int(last[c])
        if n:
            out[n] = out.get(n, 0) + 1
        c -= n or 1
    return out


def fractional_fillings(counts: np.ndarray, capacity: int, rounds: int, eps: float) -> dict[tuple, float]:
    """Multiplicative weights on the configuration LP: how often each filling is used, per unit of demand."""
    need = counts.astype(float)
    alive = need > 0
    weight = alive.astype(float)
    covered = np.zeros(capacity + 1)
    used: dict[tuple, float] = {}
    for _ in range(rounds):
        value = np.where(alive, weight / np.where(alive, need, 1), -1.0)
        filling = _best_filling(value, capacity)
        if not filling:
            break
        step = min(need[n] / a for n, a in filling.items())
        key = tuple(sorted(filling.items(), reverse=True))
        used[key] = used.get(key, 0.0) + step
        for n, a in filling.items():
            covered[n] += step * a / need[n]
            weight[n] *= np.exp(-eps * step * a / need[n])
        if weight.max() < 1e-200:
            weight /= weight.max()
    return {k: x / covered.max() for k, x in used.items()}  # scaled so that no length is used beyond its count


def _rounded(counts: np.ndarray, fractional: dict[tuple, float], scale: float) -> list[tuple[tuple, int]]:
    """Whole numbers of fillings: the scaled fractional ones rounded down, the rest best-fit decreasing."""
    left, capacity = counts.copy(), len(counts) - 1
    plan: list[tuple[tuple, int]] = []

    def take(filling: tuple, times: int) -> None:
        if times > 0:
            plan.append((filling, times))
            for n, a in filling:
                left[n] -= a * times

    empty = {f: capacity - sum(n * a for n, a in f) for f in fractional}
    slack = min(empty.values(), default=0)
    for filling, x in sorted(fractional.items(), key=lambda f: (-f[1], f[0])):
        if empty[filling] == slack:
            take(filling, min([int(x * scale)] + [int(left[n]) // a for n, a in filling]))
    while left.any():
        space, filling, spare = capacity, {}, left.copy()
        while space:
            fits = np.flatnonzero(spare[:space + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            filling[n] = min(space // n, int(spare[n]))
            spare[n] -= filling[n]
            space -= n * filling[n]
        take(tuple(sorted(filling.items(), reverse=True)), min(int(left[n]) // a for n, a in filling.items()))
    return plan


def plan_fillings(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 1200,
                  eps: float = 1.0) -> list[tuple[tuple, int]]:
    """[(((length, times), ...), sequences)]: fillings that use every length exactly as often as it occurs.

    The fractional solution is rounded at several scales and the plan with the fewest sequences is returned.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in histogram.items():
        counts[n] = c
    full, counts[capacity] = int(counts[capacity]), 0
    fractional = fractional_fillings(counts, capacity, rounds, eps) if counts.any() else {}
    plans = [_rounded(counts, fractional, s) for s in (1.0, 0.75, 0.5, 0.25)]
    best = min(plans, key=lambda p: sum(t for _, t in p))
    return ([(((capacity, 1),), full)] if full else []) + best


def _places(plan: list[tuple[tuple, int]], capacity: int) -> tuple[np.ndarray, ...]:
    """The plan by (length, number of the piece): first number, first sequence, pieces per sequence, first place."""
    used = np.zeros(capacity + 1, dtype=np.int64)
    rows, base = [], 0
    for filling, times in plan:
        place = 0
        for n, a in filling:
            rows.append(((n << 44) | int(used[n]), base, a, place))
            used[n] += a * times
            place += a * n
        base += times
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else tuple(np.empty(0, np.int64) for _ in range(4))


def _place_task(shared):
    names = ["_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches):
        first, base, per, place = shared.value
        for batch in batches:
            n = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            key = (n << 44) | rank
            at = np.searchsorted(first, key, side="right") - 1
            within = key - first[at]
            seq, off = base[at] + within // per[at], place[at] + within % per[at] * n
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names[:5]] + [pa.array(seq), pa.array(off)],
                                             names=names)
    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, rounds: int = 1200) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    pieces = token_pieces(docs, path, id_col, text_col, capacity, end_id).checkpoint()
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = plan_fillings(histogram, capacity, rounds)
    shared = spark.sparkContext.broadcast(_places(plan, capacity))  # bounded by rounds and capacity
    groups = -(-max(histogram.values(), default=1) // GROUP)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(groups)))
    offsets = (salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(
                   Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .drop("_n"))
    own = Window.partitionBy("length", "_salt").orderBy("_id", "piece", "ids_crc32")
    ranked = (salted.withColumn("_rn", F.row_number().over(own).cast("long") - 1)
              .join(offsets, ["length", "_salt"]).withColumn("_rank", F.col("_rn") + F.col("_off")))
    out = ranked.select("_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(
        _place_task(shared), "_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("_id", id_col)

"""Filter interaction audit as an incremental retraction stream.

Five filters are applied to every document in all 120 orders; the audit counts
what every step keeps, removes, and would have removed.  All of that follows
from how many documents of a part fail exactly which filters (a mask of five
bits), so the job keeps counters per (part, mask) and never a document per order.

1. *Stream.*  The files of the table are processed as available-now
   micro-batches, in whatever order they come, about ``batches`` of them.  Masks
   of the four filters that look at one text, a 128-bit hash of the text and the labels
   are worked out with built-in functions; texts are not shuffled.
2. *Pre-aggregation.*  Inside a task, rows of one text are reduced to those with the
   task's smallest id and to counts of the others, which fail the copy filter for
   certain.  So a text that a third of all rows share sends a row per Arrow batch.
3. *Keyed state.*  Per text the state holds the smallest id so far and the
   contribution of its rows.  When a smaller id arrives, the earlier mask is
   retracted from the counters (-n) and counted again with the copy filter failed.
   Texts are dealt by their hash into shards of about ``TEXTS`` texts, and a state
   value is the sorted table of a shard (38 bytes a text), so a micro-batch updates it
   in a few array operations instead of a Python call per text.
4. *Counters.*  Every micro-batch writes its sums per (part, mask, labels) to its
   own folder, named by the batch id, so a repeated batch overwrites itself; sums of
   all folders are the counters.

State, offsets and sums lie in the shared checkpoint folder, so the stream goes
on after a lost executor.  Every micro-batch writes the shards anew, so the state
costs ``batches`` / 2 times its size; it is kept by the state store that the session names.

Defined cases: a null text is empty; a null part is the empty string; a row
without an id never fails the copy filter and is no smaller id to others; equal
ids with equal texts do not fail because of each other; of several label rows of an
id any 1 counts; labels without a document count nowhere; very long texts are
read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.llm.common import id_as_long
from tessera.session import checkpoint_dir

# Fixed values of the filters.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10
FILTERS = "ABCDE"
COPY = 16  # the bit of filter E
_GOOD, _TOXIC = 1, 2
#: Micro-batches a table is read in, and texts (rows, at most) of one shard of the state.
BATCHES, TEXTS = 8, 20_000


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]++", -1), "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]++", ""))
    n = F.size(words)
    fails = (n < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n,
             100 * capitals > MAX_CAPITALS * F.char_length(text), text.rlike("[#$%&*|]"))
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails[1:], 1)), fails[0].cast("int"))


def marked(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(_key, _id, _part, _mask, _flags) of every document; ``labels``: (id, quality, toxic)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    slim = docs.select(id_as_long(id_col).alias("_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("_part"),
                       text.alias("_t")).select("_id", "_part", F.unhex(F.md5(F.col("_t").cast("binary"))).alias("_key"),
                                                text_mask(F.col("_t")).alias("_mask"))
    flags = (labels.groupBy(id_as_long(id_col).alias("_label_id"))
             .agg(F.max(F.when(F.col("quality") == 1, _GOOD).otherwise(0)).alias("_good"),
                  F.max(F.when(F.col("toxic") == 1, _TOXIC).otherwise(0)).alias("_toxic")))
    return (slim.join(flags, F.col("_id") == F.col("_label_id"), "left")
            .select("_key", "_id", "_part", "_mask", (F.coalesce("_good", F.lit(0)) + F.coalesce("_toxic", F.lit(0))).alias("_flags")))


_REDUCED = pa.schema([("_key", pa.binary()), ("_id", pa.int64()), ("_part", pa.string()), ("_mask", pa.int32()), ("_flags", pa.int32()),
                      ("_n", pa.int64()), ("_kind", pa.int32())])
#: Kinds of reduced rows: the batch's smallest id of its text, a larger id, and no id.
_LEAST, _BEATEN, _NO_ID = range(3)


def _reduce_task(batches):
    """Rows of a text inside one Arrow batch, summed; only rows of the batch's smallest id keep an id."""
    for batch in batches:
        if not batch.num_rows:
            continue
        code = batch.column("_key").dictionary_encode().indices.to_numpy()
        known = batch.column("_id").is_valid().to_numpy(zero_copy_only=False)
        ids = batch.column("_id").fill_null(0).to_numpy()
        least = np.full(code.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, code[known], ids[known])
        kind = np.where(~known, _NO_ID, np.where(ids > least[code], _BEATEN, _LEAST)).astype(np.int32)
        t = pa.table({"_key": batch.column("_key"), "_id": pa.array(np.where(kind == _LEAST, ids, 0)), "_part": batch.column("_part"),
                      "_mask": batch.column("_mask"), "_flags": batch.column("_flags"), "_kind": pa.array(kind)})
        t = t.group_by(["_key", "_id", "_part", "_mask", "_flags", "_kind"]).aggregate([([], "count_all")])
        yield from t.rename_columns([*t.column_names[:-1], "_n"]).select(_REDUCED.names).cast(_REDUCED).to_batches()


_STATE = "texts binary, parts array<string>"
_DELTA = "part string, mask int, flags int, n bigint"
#: A row of the state: hash of the text, its smallest id, and what the rows of that id contribute.
_HELD = np.dtype([("a", "<u8"), ("b", "<u8"), ("id", "<i8"), ("n", "<i8"), ("part", "<i4"), ("mask", "i1"), ("flags", "i1")])


def _rows_of(frame, parts: dict[str, int]) -> np.ndarray:
    out = np.zeros(len(frame), dtype=_HELD)
    key = np.frombuffer(b"".join(frame["_key"]), dtype="<u8").reshape(-1, 2)
    out["a"], out["b"] = key[:, 0], key[:, 1]
    for name in ("id", "n", "mask", "flags"):
        out[name] = frame[f"_{name}"]
    out["part"] = [parts.setdefault(p, len(parts)) for p in frame["_part"]]
    return out


def merge_rows(held: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, int, bool]]]:
    """The state after ``new`` rows, and the changes of the counters: (rows, sign, whether the copy filter fails)."""
    rows = np.concatenate([held, new])
    old = np.arange(len(rows)) < len(held)
    order = np.lexsort((rows["id"], rows["b"], rows["a"]))
    rows, old = rows[order], old[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])
    least = rows["id"][np.flatnonzero(first)[np.cumsum(first) - 1]] if len(rows) else rows["id"]
    stays = rows["id"] == least
    # an earlier smallest id that is beaten now: its mask is retracted and counted as a copy
    changes = [(rows[old & ~stays], -1, False), (rows[old & ~stays], 1, True), (rows[~old & stays], 1, False), (rows[~old & ~stays], 1, True)]
    kept = rows[stays]
    kept = kept[np.lexsort((kept["flags"], kept["part"], kept["b"], kept["a"]))]
    same = ["a", "b", "part", "flags"]
    start = np.ones(len(kept), dtype=bool)
    start[1:] = np.any([kept[c][1:] != kept[c][:-1] for c in same], axis=0)
    state = kept[start]
    if len(kept):
        state["n"] = np.add.reduceat(kept["n"], np.flatnonzero(start))
    return state, changes


def _update(key, frames, state: GroupState):
    """Changes of the counters by the new rows of one shard of texts."""
    import pandas as pd  # only where the state is updated: the workers that reduce rows do without its memory
    parts: dict[str, int] = {}
    held = np.zeros(0, dtype=_HELD)
    if state.exists:
        data, names = state.get
        held, parts = np.frombuffer(data, dtype=_HELD), {p: k for k, p in enumerate(names)}
    frame = pd.concat(list(frames))
    rows, kind = _rows_of(frame, parts), frame["_kind"].to_numpy()
    held, changes = merge_rows(held, rows[kind == _LEAST])
    changes += [(rows[kind == _BEATEN], 1, True), (rows[kind == _NO_ID], 1, False)]
    names = list(parts)
    state.update((held.tobytes(), names))
    out: Counter = Counter()
    for part, sign, copy in changes:
        mask = part["mask"] | (COPY if copy else 0)
        for code in np.unique(part["part"]):
            own = part["part"] == code
            cell = mask[own].astype(np.int64) * 4 + part["flags"][own]
            for c, n in enumerate(np.bincount(cell, weights=part["n"][own]).astype(np.int64).tolist()):
                out[names[code], c // 4, c % 4] += sign * n
    changed = [(*k, v) for k, v in out.items() if v]
    if changed:
        yield pd.DataFrame(changed, columns=["part", "mask", "flags", "n"])


def stream_of(spark: SparkSession, path: str, schema, files_per_batch: int) -> DataFrame:
    """A table's files as a stream; a pattern in place of the last letter lets the source take a folder as well as a file."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .parquet(f"{path[:-1]}[{path[-1]}]"))


def mask_counts(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES, id_col: str = "doc_id",
                text_col: str = "text", part_col: str = "lang", texts: int = TEXTS) -> DataFrame:
    """(part, mask, flags, n): documents by the filters they fail (bits) and their labels (bits: good, toxic)."""
    path = path.rstrip("/")
    folder = f"{checkpoint_dir(spark)}/audit-{uuid.uuid4().hex}"
    whole = spark.read.parquet(path)
    shards = max(1, -(-whole.count() // texts))  # the count comes from the files' footers
    docs = stream_of(spark, path, whole.select(f"`{id_col}`", f"`{text_col}`", f"`{part_col}`").schema,
                     max(1, -(-len(whole.inputFiles()) // batches)))
    rows = marked(docs, labels, id_col, text_col, part_col)
    reduced = rows.mapInArrow(_reduce_task, "_key binary, _id long, _part string, _mask int, _flags int, _n long, _kind int")
    deltas = (reduced.withColumn("_shard", F.pmod(F.xxhash64("_key"), F.lit(shards))).groupBy("_shard")
              .applyInPandasWithState(_update, _DELTA, _STATE, "update", GroupStateTimeout.NoTimeout))

    def write(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy("part", "mask", "flags").agg(F.sum("n").alias("n"))
        sums.write.mode("overwrite").parquet(f"{folder}/sums/batch={batch_id}")

    query = (deltas.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/stream")
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()
    if query.lastProgress is None:  # no file at all
        return spark.createDataFrame([], _DELTA)
    sums = spark.read.schema(f"{_DELTA}, batch int").parquet(f"{folder}/sums")
    return sums.groupBy("part", "mask", "flags").agg(F.sum("n").alias("n")).where("n <> 0")


def steps_of(order: str) -> list[tuple[int, str, int, int]]:
    """(step, filter, its bit, bits of the filters before it) of an order."""
    out, before = [], 0
    for k, f in enumerate(order, 1):
        bit = 1 << FILTERS.index(f)
        out.append((k, f, bit, before))
        before |= bit
    return out


def audit(counts: DataFrame) -> DataFrame:
    """The counts of every (part, filter_order, step), zeros included, from ``mask_counts``."""
    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    steps = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(s).alias("s"), F.lit(f).alias("f"), F.lit(b).alias("b"), F.lit(p).alias("p"))
                      for o in orders for s, f, b, p in steps_of(o)])
    by_mask = counts.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("flags").bitwiseAND(_GOOD) > 0, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("flags").bitwiseAND(_TOXIC) > 0, F.col("n")).otherwise(0)).alias("toxic"))
    d = by_mask.select("*", F.explode(steps).alias("x")).select("*", "x.o", "x.s", "x.f", "x.b", "x.p")
    fails, earlier = F.col("mask").bitwiseAND(F.col("b")) > 0, F.col("mask").bitwiseAND(F.col("p")) > 0
    here = fails & ~earlier

    def total(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0)).cast("bigint")

    per_step = d.groupBy("part", F.col("o").alias("filter_order"), F.col("s").cast("int").alias("step"), "f").agg(
        total(~fails & ~earlier).alias("kept"), total(here).alias("removed"), total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("b")).alias("unique_fails"), total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"))
    per_filter = per_step.groupBy(F.col("part").alias("_p"), F.col("f").alias("_f")).agg(F.sum("removed").cast("bigint").alias("shapley"))
    return (per_step.join(per_filter, (F.col("part") == F.col("_p")) & (F.col("f") == F.col("_f")))
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))


def audit_filters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES, id_col: str = "doc_id",
                  text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of the Parquet table at ``path``."""
    return audit(mask_counts(spark, path, labels, batches, id_col, text_col, part_col))

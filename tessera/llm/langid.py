"""Language identification by prediction by partial matching (PPM).

Per language, byte contexts of up to three bytes and the bytes that follow
them are counted over labelled training texts; the counts are then frozen.
The code length of a byte is exact PPM with escapes (method C) and exclusions:
the longest context that has seen the byte codes it, each shorter step pays
the escape, and bytes never seen are coded evenly.  The language with the shortest
code for the whole text wins.

Every language keeps all its contexts and bytes in sorted tables of its own, so
another language adds its part and takes none away.  The bytes seen behind a
context are among those seen behind its shorter one; so what an exclusion leaves
of a shorter context is one number per context, and a code length is a handful of
look-ups.  The code lengths of the ``cached`` most frequent grams are worked out
beforehand for all languages; that bounds the speed table, not the result.
Scoring runs in numpy over whole Arrow batches, in segments of bounded size.

Training takes about ``rows_per_lang`` labelled rows per language,
chosen by a hash of the text (all rows where there are fewer): the bound of the
training sample.  More than ``max_langs`` different labels are refused, as the column
does not hold languages then.

Defined cases: a null text or one without a letter is ``und`` with score 0, as
is every text if nothing was learned; a text of any length is scored whole;
equal code lengths go to the first language by name; null languages, nulls in
other columns, repeated rows and an empty table need no special care; other
columns are ignored by ``predict_language`` and passed through by
``keep_identified``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import raw, text_or_empty
from tessera.llm.words import texts

ORDER = 3
PAD = "\n" * ORDER


#: Bytes scored at a time, and grams whose code lengths are worked out beforehand.
SEGMENT, CACHED = 1 << 17, 200_000


@dataclass
class Order:
    """Contexts of one length: what follows them, and what an escape from them leaves of the shorter ones."""
    grams: np.ndarray   # context and byte, sorted
    code: np.ndarray    # log2 of the gram's count
    contexts: np.ndarray  # sorted
    own: np.ndarray     # (context, 2): log2(total + kinds), code length of the escape
    below: np.ndarray   # (context, 2): the same for the shorter context without the bytes seen here


@dataclass
class Model:
    langs: list[str]
    orders: list[list[Order]]  # per language, longest context first
    unseen: list[float]        # per language: code length of a byte that was never seen, behind all escapes
    grams: np.ndarray          # sorted four-byte grams with code lengths in ``bits``
    bits: np.ndarray           # (gram, language)


def _count_task(batches):
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for a, b, buf, bounds in texts(batch, "_t"):
            w = buf.astype(np.int64)
            gram = (w[:-3] << 24) | (w[1:-2] << 16) | (w[2:-1] << 8) | w[3:]
            at = np.arange(len(gram))
            doc = np.searchsorted(bounds, at, side="right") - 1
            inside = at + ORDER < bounds[doc + 1]
            for lang in sorted(set(langs[a:b])):
                rows = np.flatnonzero(langs[a:b] == lang)
                g, n = np.unique(gram[inside & np.isin(doc, rows)], return_counts=True)
                if len(g):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g), pa.array(n.astype(np.int64))],
                                                     schema=schema)


def _own_and_escape(total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """log2(total + kinds) and the code length of an escape; nothing left costs nothing."""
    some = total > 0
    size = np.log2(np.where(some, total + kinds, 1))
    return np.stack([size, np.where(some, size - np.log2(np.where(some, kinds, 1)), 0.0)], 1).astype(np.float32)


def _orders(grams: np.ndarray, n: np.ndarray) -> tuple[list[Order], float]:
    """The tables of one language from its four-byte grams (unique) and counts; code length of a byte never seen."""
    out, above = [], None
    tables = []
    for k in range(ORDER, -1, -1):
        u, at = np.unique(grams & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        c = np.bincount(at, weights=n)
        ctx, row, kinds = np.unique(u >> 8, return_inverse=True, return_counts=True)
        tables.append((u, c, ctx, row, np.bincount(row, weights=c), kinds))
    for k, (u, c, ctx, row, total, kinds) in enumerate(tables):
        below = np.zeros((len(ctx), 2), dtype=np.float32)
        if k < ORDER:
            u2, c2, ctx2, _, total2, kinds2 = tables[k + 1]
            bits = 8 * (ORDER - k)
            shorter = np.searchsorted(ctx2, ctx & ((1 << (bits - 8)) - 1))
            taken = np.bincount(row, weights=c2[np.searchsorted(u2, u & ((1 << bits) - 1))])
            below = _own_and_escape(np.round(total2[shorter] - taken), kinds2[shorter] - kinds)
        out.append(Order(u.astype(np.uint32), np.log2(c).astype(np.float32), ctx.astype(np.uint32), _own_and_escape(total, kinds), below))
    return out, float(np.log2(max(1, 256 - len(tables[-1][0]))))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def gram_bits(orders: list[Order], unseen: float, grams: np.ndarray) -> np.ndarray:
    """Exact PPM-C code length of the last byte of every four-byte gram, under one language."""
    bits = np.zeros(len(grams), dtype=np.float32)
    open_ = np.arange(len(grams))               # positions not coded yet
    cost = np.zeros((len(grams), 2), dtype=np.float32)
    above = np.zeros(len(grams), dtype=bool)     # the longer context was seen, ``cost`` holds what it leaves
    for k, o in enumerate(orders):
        key = grams[open_] & np.uint32((1 << 8 * (ORDER - k + 1)) - 1)
        row, have = _find(o.contexts, key >> np.uint32(8))
        now = np.where(above[:, None], cost, np.where(have[:, None], o.own[row], 0))
        at, hit = _find(o.grams, key)
        bits[open_] += np.where(hit, now[:, 0] - o.code[at], now[:, 1])
        rest = ~hit
        cost, above, open_ = o.below[row][rest], have[rest], open_[rest]
        if not len(open_):
            return bits
    bits[open_] += unseen
    return bits


def build_model(langs: np.ndarray, grams: np.ndarray, n: np.ndarray, cached: int = CACHED) -> Model | None:
    """The frozen tables from counted four-byte grams."""
    names = sorted(set(langs))
    if not names:
        return None
    parts = [_orders(grams[langs == x], n[langs == x]) for x in names]
    every, at = np.unique(grams, return_inverse=True)
    weight = np.bincount(at, weights=n)
    top = np.sort(every[np.argsort(-weight, kind="stable")[:cached]]).astype(np.uint32)
    bits = np.stack([gram_bits(o, u, top) for o, u in parts], 1)
    return Model(names, [o for o, _ in parts], [u for _, u in parts], top, bits)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = 3000,
          max_langs: int = 1000, cached: int = CACHED) -> Model | None:
    """A model from the rows with a text and a language."""
    base = labelled.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("_s"))
    per = {r[0]: r[1] for r in base.groupBy("lang").count().limit(max_langs + 1).collect()}
    if len(per) > max_langs:
        raise ValueError(f"more than {max_langs} different values in {lang_col}")
    if not per:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for k, v in per.items() for x in (k, min(1.0, rows_per_lang / v))]), F.col("lang"))
    drawn = F.pmod(F.xxhash64("_s"), F.lit(1 << 30)) < share * float(1 << 30)
    grams = (base.where(drawn).select("lang", raw(F.concat(F.lit(PAD), F.col("_s"))).alias("_t"))
             .mapInArrow(_count_task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    t = grams.toArrow()  # bounded by the training rows
    return build_model(np.array(t["lang"].to_pylist(), dtype=object), t["gram"].to_numpy(), t["n"].to_numpy().astype(float), cached)


def code_lengths(model: Model, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bits of every padded text under every language."""
    out = np.zeros((len(bounds) - 1, len(model.langs)))
    last = len(buf) - ORDER
    for lo in range(0, max(last, 0), SEGMENT):
        hi = min(lo + SEGMENT, last)
        w = buf[lo:hi + ORDER].astype(np.uint32)
        gram = (w[:-3] << np.uint32(24)) | (w[1:-2] << np.uint32(16)) | (w[2:-1] << np.uint32(8)) | w[3:]
        at, known = _find(model.grams, gram)
        bits = model.bits[at]
        rare = np.flatnonzero(~known)
        if len(rare):
            for k, (orders, unseen) in enumerate(zip(model.orders, model.unseen)):
                bits[rare, k] = gram_bits(orders, unseen, gram[rare])
        # grams that lie inside one text: those that start before its last ORDER bytes
        a = np.clip(bounds[:-1] - lo, 0, hi - lo)
        b = np.clip(bounds[1:] - ORDER - lo, 0, hi - lo)
        some = np.flatnonzero(b > a)
        if len(some):
            cuts = np.stack([a[some], b[some]], 1).ravel()
            total = np.add.reduceat(np.concatenate([bits, np.zeros((1, bits.shape[1]), dtype=bits.dtype)]), cuts, axis=0, dtype=np.float64)
            out[some] += total[::2]
    return out


def _scorer(shared):
    @F.arrow_udf("struct<lang_pred: string, score: double, bits: double>")
    def score(text: pa.Array, letter: pa.Array) -> pa.Array:
        model = shared.value
        names = np.array(model.langs, dtype=object)
        n = len(text)
        langs, scores, sizes = np.full(n, "und", dtype=object), np.zeros(n), np.zeros(n)
        for a, b, buf, bounds in texts(pa.RecordBatch.from_arrays([text], names=["t"]), "t", 1 << 19):
            bits = code_lengths(model, buf, bounds)
            best = bits.min(1, keepdims=True)
            langs[a:b] = names[bits.argmin(1)]
            scores[a:b] = 1.0 / np.exp2(np.maximum(best - bits, -1000.0)).sum(1)
            sizes[a:b] = best[:, 0]
        known = letter.to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays(
            [pa.array(np.where(known, langs, "und"), pa.string()), pa.array(np.where(known, scores, 0.0)),
             pa.array(np.where(known, sizes, 0.0))], names=["lang_pred", "score", "bits"])
    return score


def predict_language(docs: DataFrame, model: Model | None, keep: list, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (names or Column objects of ``docs``), ``lang_pred``, ``score`` and ``bits`` (code length).

    Only the text goes to Python; the other columns stay where they are.
    """
    text = text_or_empty(text_col)
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"))
    score = _scorer(docs.sparkSession.sparkContext.broadcast(model))  # bounded by the training rows, and the speed table by ``cached``
    names = docs.select(*keep).columns
    scored = docs.select(*keep, score(raw(F.concat(F.lit(PAD), text)), text.rlike(r"\p{L}")).alias("_scored"))
    return scored.select(*[F.col(f"`{c}`") for c in names], F.col("_scored.lang_pred"), F.col("_scored.score"), F.col("_scored.bits"))


def held_out(id_col: str = "doc_id"):
    """Rows kept from training: CRC-32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", most_bits: float = 8.0) -> DataFrame:
    """The rows, with all columns, whose text has letters and is coded by its language below ``most_bits`` a byte.

    Eight bits a byte is what no language model at all would need, so a text above it resembles none of them.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    size = F.octet_length(text_or_empty(text_col))
    scored = predict_language(docs, model, [row.alias("_row"), size.alias("_size")], text_col)
    return scored.where((F.col("lang_pred") != "und") & (F.col("bits") < most_bits * F.col("_size"))).select("_row.*")

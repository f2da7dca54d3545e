"""Fill-in-middle transformation over a wavelet matrix of character classes.

Every byte of a slice of texts gets a class: line feed, other white space, first
byte of a word, other byte of a word, or continuation byte of a character.  A
wavelet matrix over the classes (three bit rows with popcount directories,
about 0.6 bytes a byte) answers how often a class stands before any position.
Sums of such ranks count the unit boundaries of every text and its characters;
a bisection on the ranks finds the positions of both cuts.  All texts of a
slice are asked at once.

Units are lines (``[^\\n]*\\n|[^\\n]+``), words (a word with the white space behind
it; white space before the first word belongs to it) or characters.  Numbers
from the SHA-256 of ``seed:id`` choose the cuts, whether a text is transformed
(``rate`` per cent) and its order: prefix-suffix-middle, or suffix-prefix-middle
(``spm_rate`` per cent).

Defined cases: a null or empty text, and one that holds a mark, stays plain; a
null id counts as an empty one; a very long text is a slice of its own; repeated
rows are each transformed, alike; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_as_long, raw, text_or_empty
from tessera.llm.words import texts

# The marks in front of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
LF, BLANK, FIRST, REST, CONT = range(5)
BITS = 3
_CLASS = np.full(256, REST, dtype=np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = BLANK
_CLASS[10] = LF
_CLASS[128:192] = CONT
#: Unit -> classes that begin a unit; lines end behind their class instead.
UNITS = {"line": (LF,), "word": (FIRST,), "char": (LF, BLANK, FIRST, REST)}


def classes(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The class of every byte of the texts ``buf[bounds[i]:bounds[i+1]]``."""
    c = _CLASS[buf]
    if len(c):
        before = np.empty(len(c), dtype=bool)
        before[0], before[1:] = True, c[:-1] <= BLANK
        before[bounds[(bounds > 0) & (bounds < len(c))]] = True
        c[before & (c == REST)] = FIRST
    return c


class WaveletMatrix:
    """Ranks of symbols below ``2 ** bits`` in a sequence, for arrays of positions."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.levels = len(symbols), []
        for k in range(bits - 1, -1, -1):
            one = (symbols >> k & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            packed.resize((self.n // 64 + 1) * 8)
            word = packed.view(np.uint64)
            count = np.zeros(len(word), dtype=np.uint32)
            np.cumsum(np.bitwise_count(word[:-1]), out=count[1:])
            zeros = self.n - int(one.sum())
            self.levels.append((k, word, count, zeros))
            symbols = np.concatenate([symbols[~one], symbols[one]])
        self._from: dict[int, int] = {}

    def _walk(self, symbol: int, at: np.ndarray) -> np.ndarray:
        for k, word, count, zeros in self.levels:
            w = at >> 6
            inside = word[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = count[w].astype(np.int64) + np.bitwise_count(inside)
            at = ones + zeros if symbol >> k & 1 else at - ones
        return at

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before every position."""
        if symbol not in self._from:
            self._from[symbol] = int(self._walk(symbol, np.zeros(1, dtype=np.int64))[0])
        return self._walk(symbol, np.asarray(at, dtype=np.int64)) - self._from[symbol]

    def ranks(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, at) for s in symbols)

    def select(self, symbols: tuple[int, ...], count: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest position in ``lo..hi`` with ``count`` of the symbols before it, by bisection on the ranks."""
        lo, hi = lo.copy(), hi.copy()
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            enough = self.ranks(symbols, mid) >= count
            hi = np.where(enough, mid, hi)
            lo = np.where(enough, lo, np.minimum(mid + 1, hi))
        return lo


def cut_units(buf: np.ndarray, bounds: np.ndarray, unit: str, pick) -> tuple[np.ndarray, ...]:
    """(units, first cut, second cut, characters before each cut): ``pick(n)`` gives the units before both cuts."""
    lo, hi = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    wm, marks = WaveletMatrix(classes(buf, bounds), BITS), UNITS[unit]
    base = wm.ranks(marks, lo)
    found = wm.ranks(marks, hi) - base
    full = hi > lo
    if unit == "line":
        last = np.zeros(len(lo), dtype=bool)
        last[full] = buf[hi[full] - 1] != 10
        n = found + last
    else:
        n = np.maximum(found, full)
    cuts = []
    for k in pick(n):
        # a line ends behind its k-th mark; any other unit begins at mark k + 1
        at = wm.select(marks, base + (k if unit == "line" else k + 1), lo, hi) - (unit != "line")
        cuts.append(np.where(k == 0, lo, np.where(k >= n, hi, at)))
    chars = [(c - lo) - (wm.rank(CONT, c) - wm.rank(CONT, lo)) for c in cuts]
    return n, *cuts, *chars


_OUT = pa.schema([("_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                  ("middle_chars", pa.int64()), ("output", pa.string())])


def _cut_task(unit: str, rate: int, spm_rate: int):
    mark_p, mark_s, mark_m = (m.encode() for m in MARKS)

    def run(batches):
        for batch in batches:
            h = [batch.column(f"_h{k}").to_numpy() for k in range(1, 5)]
            for a, b, buf, bounds in texts(batch, "_t"):
                h1, h2, h3, h4 = (x[a:b] for x in h)
                n, c1, c2, p, m = cut_units(buf, bounds, unit, lambda n: (np.minimum(h1 % (n + 1), h2 % (n + 1)),
                                                                          np.maximum(h1 % (n + 1), h2 % (n + 1))))
                data, form, out = buf.tobytes(), [], []
                for k, (lo, hi, x, y) in enumerate(zip(bounds[:-1], bounds[1:], c1, c2)):
                    if lo == hi or h3[k] % 100 >= rate or any(data.find(w, lo, hi) >= 0 for w in (mark_p, mark_s, mark_m)):
                        form.append("plain")
                        out.append(data[lo:hi])
                    elif h4[k] % 100 < spm_rate:
                        form.append("spm")
                        out.append(b"".join([mark_s, data[y:hi], mark_p, data[lo:x], mark_m, data[x:y]]))
                    else:
                        form.append("psm")
                        out.append(b"".join([mark_p, data[lo:x], mark_s, data[y:hi], mark_m, data[x:y]]))
                plain = np.array(form, dtype=object) == "plain"
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(form, pa.string()),
                     pa.array(p, pa.int64(), mask=plain), pa.array(m - p, pa.int64(), mask=plain),
                     pa.array(out, pa.binary()).cast(pa.string())], schema=_OUT)
    return run


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = 100, spm_rate: int = 50, seed: int = 7,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n units, form, prefix_chars, middle_chars, output text), one row per input row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"), 256)
    base = docs.select(id_as_long(id_col).alias("_id"), raw(text_or_empty(text_col)).alias("_t"))
    base = base.select("_id", "_t", *[F.conv(F.substr(digest, F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("bigint").alias(f"_h{k + 1}")
                                      for k in range(4)])
    schema = "_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return base.mapInArrow(_cut_task(unit, rate, spm_rate), schema).withColumnRenamed("_id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation, rebuilt from output and form; a transformed text holds no mark of its own."""
    part = F.split(output, "|".join(MARKS), -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))

"""Words and word windows of UTF-8 texts, hashed in numpy over whole Arrow batches.

A word is a run of characters outside blank, tab and line ends (``common.WS``).
Those are single bytes that never occur inside another character, so the bytes
can be scanned without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_IS_WS = np.zeros(256, dtype=bool)
_IS_WS[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers of the two independent word hashes and of the window hashes.
_MULT = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_STEP = (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
_SEGMENT = 1 << 19
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _pow(mult: int, n: int) -> np.ndarray:
    have = _powers.get(mult)
    if have is None or len(have) < n:
        a = np.full(max(n, _SEGMENT + 1), mult, dtype=U64)
        a[0] = 1
        have = _powers[mult] = np.multiply.accumulate(a)
    return have[:n]


def _poly(seg: np.ndarray, starts: np.ndarray, ends: np.ndarray, mult: int) -> np.ndarray:
    c = np.zeros(len(seg) + 1, dtype=U64)
    np.cumsum((seg.astype(U64) + U64(1)) * _pow(mult, len(seg)), out=c[1:])
    return mix((c[ends] - c[starts]) * _pow(pow(mult, -1, 1 << 64), len(seg))[starts])


def words(buf: np.ndarray, bounds: np.ndarray, n_hash: int = 1) -> tuple:
    """Words of the texts ``buf[bounds[i]:bounds[i+1]]``: starts, ends, words per text, ``n_hash`` hash arrays.

    The hashing walks segments of bounded size, so the working memory of a very
    long text is that of its words, not a multiple of its bytes.
    """
    bounds = bounds.astype(np.int64)
    n = len(buf)
    blank = _IS_WS[buf]
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0], before[1:] = True, blank[:-1]
        after[-1], after[:-1] = True, blank[1:]
        inner = bounds[(bounds > 0) & (bounds < n)]
        before[inner] = True
        after[inner - 1] = True
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(~blank & after) + 1
    counts = np.diff(np.searchsorted(starts, bounds))
    hashes = [np.empty(len(starts), dtype=U64) for _ in range(n_hash)]
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _SEGMENT, side="right")))
        lo, hi = starts[a], ends[b - 1]
        for h, mult in zip(hashes, _MULT):
            h[a:b] = _poly(buf[lo:hi], starts[a:b] - lo, ends[a:b] - lo, mult)
        a = b
    return starts, ends, counts, hashes


def windows(hashes: np.ndarray, counts: np.ndarray, width: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every window of ``width`` words inside one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=U64)
    acc = np.zeros(n, dtype=U64)
    step = U64(_STEP[which])
    for j in range(width):
        acc *= step
        acc += hashes[j:n + j]
    limit = np.repeat(np.cumsum(counts), counts)[:n] - width
    at = np.flatnonzero(np.arange(n) <= limit)
    return at, mix(acc[at])


def texts(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch with bounded bytes (one text at least): (from row, to row, bytes, bounds)."""
    col = batch.column(column)
    col = col.cast(pa.large_binary()) if col.type != pa.large_binary() else col
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most_bytes, side="right")) - 1)
        yield a, b, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b

"""SentencePiece encoding and decoding for merge-type models with byte pieces.

The library's merge rule (always the best-scored neighbouring pair, the left one
of equals) has one result per text, and a sequence of pieces is that result
exactly if every two neighbours come out again when their joint text is merged
alone.  So a text is encoded from left to right by backtracking:

1. one pass of an Aho-Corasick automaton over the vocabulary gives the longest
   piece that starts at every position;
2. the longest piece is tried first, then its prefixes that are pieces; it must be
   compatible with the piece before it (checked by merging the two again, cached)
   and must not end at a position known to fail;
3. where none fits, the position is set in a bitfield of failed positions and the
   piece before it is taken back, so no position is tried twice.

Texts are cut where no piece can reach across (in front of a run of blanks, if no
piece has a blank behind another character, and around characters without a
piece, which become byte pieces).  Results of short cuts are kept in a table of
bounded size.  Normalisation is the model's own; the model file is read by every
worker.

Defined cases: a null text is empty and has no pieces; very long texts, also
without a blank, are encoded whole in memory that grows with them alone; control
pieces decode to nothing and broken byte sequences to one replacement character a
byte; repeated rows are each encoded; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_as_long, text_or_empty

SPACE = "▁"
#: Cuts of up to so many characters are remembered, so many of them.
SHORT, REMEMBERED = 64, 400_000
#: Remembered compatibility checks.
PAIRS = 1 << 19
#: Rows go back to Spark in slices of about so many characters.
SLICE = 1 << 21
codecs.register_error("tessera_one_per_byte", lambda e: ("�", e.start + 1))


class _Known(dict):
    """Ids of cuts, worked out where missing; short cuts are remembered until the table is full and starts anew."""

    def __init__(self, work):
        self._work = work

    def __missing__(self, cut: str) -> bytes:
        ids = self._work(cut)
        if len(cut) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[cut] = ids
        return ids


class Codec:
    """Exact encoder and decoder of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self._normalise = sp.normalize
        self._byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        if len(self._byte_id) != 256 or any(sp.is_unused(i) for i in range(size)):
            raise ValueError("only models with byte pieces and without unused pieces")
        special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i)}
        normal = [i for i in range(size) if i not in special and not sp.is_byte(i)]
        self._piece = [sp.id_to_piece(i) for i in range(size)]
        self._id = {self._piece[i]: i for i in normal}
        self._score = {self._piece[i]: sp.get_score(i) for i in normal}
        self._prefixed = sp.normalize("a").startswith(SPACE)
        self._surface = [self._piece[i].replace(SPACE, " ").encode() for i in range(size)]
        for b, i in self._byte_id.items():
            self._surface[i] = bytes([b])
        for i in special:
            self._surface[i] = " ⁇ ".encode() if sp.is_unknown(i) else b""
        self._special = special
        self._byte = set(self._byte_id.values())
        self._automaton = ahocorasick.Automaton()
        for p in self._id:
            self._automaton.add_word(p, len(p))
        self._automaton.make_automaton()
        self._length = [len(p) for p in self._piece]
        self._cut = self._cutter()
        self._known = _Known(self._cut_ids)
        self._pairs: dict[int, bool] = {}
        self._alone = lru_cache(maxsize=None)(self._alone)      # one entry per piece at most
        self._shorter = lru_cache(maxsize=None)(self._shorter)  # likewise

    def _cutter(self) -> re.Pattern:
        """Cuts a text at places that no piece reaches across."""
        def one_of(chars) -> str:
            return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"

        chars = {c for p in self._id for c in p} - {SPACE}
        none = one_of(chars | {SPACE}).replace("[", "[^", 1)
        if any(SPACE in p.lstrip(SPACE) for p in self._id):
            return re.compile(f"{one_of(chars | {SPACE})}+|{none}")
        word = {c for c in chars if c.isalpha()}
        behind = {y for p in self._id for x, y in zip(p, p[1:]) if x in word}
        apart = chars - word - behind  # no piece has one of these right behind a letter
        whole = f"{SPACE}++{one_of(chars)}*+|{one_of(chars)}++|{none}"
        return re.compile(f"{SPACE}*+{one_of(word)}++(?={one_of(apart)})|{whole}" if word and apart else whole)

    def merged(self, text: str) -> list[str]:
        """A short text by the merge rule itself."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self._score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, left: int, right: int) -> bool:
        """Whether two pieces come out again when their joint text is merged."""
        a, b = self._piece[left], self._piece[right]
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        fits = self._pairs[left << 32 | right] = self.merged(a + b) == [a, b]
        return fits

    def _alone(self, piece: int) -> bool:
        return self.merged(self._piece[piece]) == [self._piece[piece]]

    def _shorter(self, piece: int) -> int:
        """The longest piece that is a proper prefix, or -1."""
        p = self._piece[piece]
        return next((self._id[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self._id), -1)

    def _search(self, text: str) -> array:
        """Ids of a run of characters that all have pieces."""
        n, pairs, length, ids = len(text), self._pairs, self._length, self._id
        longest = array("H", bytes(2 * n))
        for end, size in self._automaton.iter(text):
            longest[end - size + 1] = size  # ends ascend, so the longest comes last
        failed = bytearray(n // 8 + 1)
        out, at, last = array("i"), 0, -1
        piece = ids[text[:longest[0]]]
        while at < n:
            end = at + length[piece]
            if not failed[end >> 3] >> (end & 7) & 1:
                fits = pairs.get(last << 32 | piece) if last >= 0 else self._alone(piece)
                if self._fits(last, piece) if fits is None else fits:
                    out.append(piece)
                    at, last = end, piece
                    if at < n:
                        piece = ids[text[at:at + longest[at]]]
                    continue
            piece = self._shorter(piece)
            while piece < 0:
                failed[at >> 3] |= 1 << (at & 7)
                taken = out.pop()
                at -= length[taken]
                last = out[-1] if out else -1
                piece = self._shorter(taken)
        return out

    def _cut_ids(self, cut: str) -> bytes:
        ids = self._search(cut) if cut[0] in self._id else array("i", [self._byte_id[b] for b in cut.encode()])
        return ids.tobytes()

    def encode(self, text: str) -> np.ndarray:
        normal = self._normalise(text)
        cuts: Iterable[str] = (self._cut.findall(normal) if len(normal) < SLICE
                               else (m.group() for m in self._cut.finditer(normal)))
        return np.frombuffer(b"".join(map(self._known.__getitem__, cuts)), dtype=np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        out = b"".join(map(self._surface.__getitem__, ids))
        first = next((i for i in ids if i not in self._special or self._surface[i]), None)
        if self._prefixed and first is not None and first not in self._byte and self._piece[first].startswith(SPACE):
            out = out[1:]
        return out.decode("utf-8", "tessera_one_per_byte")


@lru_cache(maxsize=4)
def load_codec(path: str) -> Codec:
    return Codec(path)


def _codec_task(path: str):
    def run(batches):
        codec = load_codec(path)
        for batch in batches:
            ids, decoded, a, size = [], [], 0, 0
            last = batch.num_rows - 1
            for k, text in enumerate(batch.column("_t")):
                ids.append(codec.encode(text.as_py()))
                decoded.append(codec.decode(ids[-1]))
                size += len(decoded[-1])
                if size >= SLICE or k == last:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("_id").slice(a, k + 1 - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))),
                         pa.array(decoded, pa.string())], names=["_id", "ids", "decoded"])
                    ids, decoded, a, size = [], [], k + 1, 0
    return run


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded text), one row per input row; ``path`` is the model file."""
    base = docs.select(id_as_long(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))
    return base.mapInArrow(_codec_task(path), "_id long, ids array<int>, decoded string").withColumnRenamed("_id", id_col)


def ids_digest(ids: str = "ids"):
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256)

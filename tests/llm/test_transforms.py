"""SentencePiece codec, fill-in-middle and the filter audit against the library, plain Python and brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.fill_middle import BITS, WaveletMatrix, cut_units, fill_in_middle, restored
from tessera.llm.filter_audit import _HELD, _update, audit_filters, mask_counts, merge_rows
from tessera.llm.pieces import Codec, encode_pieces, ids_digest
from tests.conftest import SMALL
from tests.llm.cases import prose, rows, table, unique_rows


# ---------------------------------------------------------------- pieces

@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=model)


def test_codec_equals_the_library(model, library):
    codec, rng = Codec(model), random.Random(11)
    pieces = list(codec._id)
    made = ["", " ", "\n", "▁", "<s> </s> <unk> <0x41>", "a\x00b", "▁▁x", "  two  blanks  ", "ab" * 20_000, "=" * 5_001 + " " * 5_003,
            "é́ 中文 😀 ퟿"]
    for k in range(6_000):
        made.append("".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))) if k % 3 == 0 else
                    "".join(rng.choice(" \n\t▁ab<0x41>éñ中　\x00e-=.") for _ in range(rng.randint(0, 60))) if k % 3 == 1 else
                    "".join(rng.choice("etaoinshrdlu  ") for _ in range(rng.randint(0, 80))))
    for text in made:
        ids = codec.encode(text)
        assert ids.tolist() == library.encode(text), text[:80]
        assert codec.decode(ids) == library.decode(ids.tolist()), text[:80]


def test_decoding_of_any_ids_equals_the_library(model, library):
    codec, rng = Codec(model), random.Random(12)
    for _ in range(4_000):
        ids = [rng.choice([rng.randrange(1, 300), rng.randrange(32_000), 28705]) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_backtracking_takes_linear_time(model):
    codec = Codec(model)
    for text in ("ab" * 200_000, "a" * 300_000, "=" * 300_000, " " * 300_000):
        assert len(codec.encode(text)) > 1_000


def test_remembered_tables_are_bounded(model, monkeypatch):
    from tessera.llm import pieces
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    monkeypatch.setattr(pieces, "PAIRS", 50)
    codec, fresh = Codec(model), Codec(model)
    rng = random.Random(13)
    for _ in range(30):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20))
        assert codec.encode(text).tolist() == fresh.encode(text).tolist()
        assert len(codec._known) <= 50 and len(codec._pairs) <= 50


def test_codec_on_documents(spark, model, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in encode_pieces(docs, model).withColumn("sha", ids_digest()).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "")
        assert list(got[r.doc_id].ids) == ids and got[r.doc_id].decoded == library.decode(ids)
        assert got[r.doc_id].sha == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


# ---------------------------------------------------------------- fill in the middle

def units_of(text, unit):
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    if unit == "char":
        return list(text)
    w = re.findall(r"[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*", text)
    return [text[:len(text) - sum(map(len, w))] + w[0], *w[1:]] if w else [text] * bool(text)


def brute_fim(ident, text, unit="line", rate=100, spm=50, seed=7):
    text = text or ""
    u = units_of(text, unit)
    assert "".join(u) == text
    h = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in range(0, 32, 8))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    x, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(w in text for w in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(u), "plain", None, None, text
    if h4 % 100 < spm:
        return len(u), "spm", len(x), len(m), f"<S>{s}<P>{x}<M>{m}"
    return len(u), "psm", len(x), len(m), f"<P>{x}<S>{s}<M>{m}"


def test_ranks_and_selects_of_the_wavelet_matrix():
    rng = np.random.default_rng(4)
    for n in (0, 1, 63, 64, 65, 1000):
        s = rng.integers(0, 5, n).astype(np.uint8)
        wm, at = WaveletMatrix(s, BITS), np.arange(n + 1)
        for c in range(5):
            want = np.concatenate([[0], np.cumsum(s == c)])
            assert (wm.rank(c, at) == want).all()
            for k in range(1, int(want[-1]) + 1):
                got = wm.select((c,), np.array([k]), np.array([0]), np.array([n]))[0]
                assert want[got] == k and s[got - 1] == c


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_cuts_match_plain_python(spark, unit):
    rng = random.Random(14)
    data = [(i, "".join(rng.choice("ab é中\n\n\t .") for _ in range(rng.randint(0, rng.choice([3, 200])))), None, None, 0) for i in range(150)]
    data += rows() + [(900, "x <P> y\nz", None, None, 0), (901, "<S><", None, None, 0), (902, "a<P\nb>", None, None, 0), (903, "<M", None, None, 0)]
    out = fill_in_middle(table(spark, data, clash=unit == "word"), unit=unit, rate=80, spm_rate=30, seed=3)
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back)
                  for r in out.withColumn("back", restored(F.col("output"), F.col("form"))).collect())
    assert got == Counter((i, *brute_fim(i, t, unit, 80, 30, 3), t or "") for i, t, *_ in data)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}


def test_texts_of_a_slice_do_not_mix():
    texts = [b"a\nb", b"", b"\n", b"c", b"d\n\ne"]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = cut_units(np.frombuffer(b"".join(texts), dtype=np.uint8), bounds, "line", lambda n: (np.minimum(n, 1), n))
    assert got[0].tolist() == [2, 0, 1, 1, 3]
    assert (got[1] - bounds[:-1]).tolist() == [2, 0, 1, 1, 2] and (got[2] - bounds[:-1]).tolist() == [3, 0, 1, 1, 4]


# ---------------------------------------------------------------- filter audit

def brute_mask(text):
    w = [x for x in re.split("[\x20\x09-\x0D]+", text) if x]
    return ((len(w) < 100) + 2 * (100 * len(set(w)) < 80 * len(w)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
            + 8 * bool(re.search("[#$%&*|]", text)))


def brute_audit(data, labels):
    least = {}
    for i, t, *_ in data:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    per = defaultdict(list)
    for i, t, lang, *_ in data:
        t = t or ""
        mask = brute_mask(t) + 16 * (i is not None and i > least[t])
        per[lang or ""].append(({c for k, c in enumerate("ABCDE") if mask >> k & 1}, i in good, i in toxic))
    out = {}
    for part, docs in per.items():
        share = Counter()
        for o in map("".join, itertools.permutations("ABCDE")):
            for s, f in enumerate(o):
                before = set(o[:s])
                here = [d for d in docs if f in d[0] and not d[0] & before]
                share[f] += len(here)
                out[part, o, s + 1] = (sum(not d[0] & (before | {f}) for d in docs), len(here), sum(f in d[0] and bool(d[0] & before) for d in docs),
                                       sum(d[0] == {f} for d in docs), sum(d[1] for d in here), sum(d[2] for d in here))
        for (p, o, s), v in list(out.items()):
            if p == part:
                out[p, o, s] = (*v, share[o[s - 1]])
    return out


def audit_table():
    rng = random.Random(15)
    texts = [prose(rng, 130), " ".join(f"w{k}" for k in range(120)), "A B C # " * 40, prose(rng, 30), " ".join(f"W{k}X" for k in range(150)), None, ""]
    data = [(i, rng.choice(texts), rng.choice(["en", "fr", None, ""]), "s", 0) for i in rng.sample(range(10_000), 400)]
    return data + rows() + data[:3]  # repeated ids and texts


def test_audit_equals_brute_force_in_any_batch_order(spark, tmp_path):
    data = audit_table()
    rng = random.Random(16)
    ids = [d[0] for d in data if d[0] is not None]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in rng.sample(ids, 200)] + [(ids[0], 1, 0), (99_999, 1, 1), (None, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_audit(data, labels)
    for name, order in (("ascending", lambda d: d[0] or 0), ("descending", lambda d: -(d[0] or 0))):
        path = str(tmp_path / name)
        for k, part in enumerate(np.array_split(np.arange(len(data)), 5)):
            chunk = sorted(data, key=order)
            table(spark, [chunk[i] for i in part], clash=True).coalesce(1).write.mode("append").parquet(path)
        got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit_filters(spark, path, lab, batches=5).collect()}
        assert got.keys() == want.keys()
        assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


class FakeState:
    def __init__(self):
        self.value = None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value


def test_smaller_ids_retract_earlier_masks():
    import pandas as pd
    state, total = FakeState(), Counter()
    columns = ["_id", "_part", "_mask", "_flags", "_n", "_kind"]
    seen = []
    for batch in ([(9, "en", 3, 1, 1, 0)], [(12, "fr", 3, 0, 1, 0)], [(4, "fr", 3, 2, 2, 0), (0, "fr", 3, 0, 5, 1)], [(9, "en", 3, 0, 1, 0)],
                  [(0, "en", 3, 0, 1, 2), (4, "fr", 3, 2, 1, 0), (4, "en", 3, 0, 1, 0)]):
        frame = pd.DataFrame(batch, columns=columns).assign(_key=b"0123456789abcdef")
        for out in _update(None, iter([frame]), state):
            for part, mask, flags, n in out.itertuples(index=False):
                total[part, mask, flags] += n
                seen.append(n)
    assert +total == Counter({("fr", 3, 2): 3, ("en", 19, 1): 1, ("fr", 19, 0): 6, ("en", 19, 0): 1, ("en", 3, 0): 2})
    held = np.frombuffer(state.value[0], dtype=_HELD)
    assert -1 in seen and held["id"].tolist() == [4, 4] and sorted(held["n"].tolist()) == [1, 3]


def test_state_of_a_shard_equals_a_dictionary():
    rng = random.Random(17)
    held, truth, total = np.zeros(0, dtype=_HELD), [], Counter()
    for _ in range(12):
        new = np.zeros(rng.randint(0, 40), dtype=_HELD)
        for r in new:
            r["a"], r["b"], r["id"], r["n"] = rng.randint(1, 4), rng.randint(1, 3), rng.randint(1, 60), rng.randint(1, 3)
            r["part"], r["flags"], r["mask"] = rng.randint(0, 1), rng.randint(0, 3), r["a"]
        truth += new.tolist()
        held, changes = merge_rows(held, new)
        for rows_, sign, copy in changes:
            for r in rows_:
                total[int(r["part"]), int(r["mask"]) | 16 * copy, int(r["flags"])] += sign * int(r["n"])
        least = {}
        for r in truth:
            least[r[:2]] = min(r[2], least.get(r[:2], r[2]))
        want = Counter()
        for a, b, i, n, part, mask, flags in truth:
            want[part, mask | 16 * (i > least[a, b]), flags] += n
        assert +total == want and min(total.values(), default=0) >= 0


def test_audit_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    table(spark, []).write.parquet(path)
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mask_counts(spark, path, lab).count() == 0 and audit_filters(spark, path, lab).count() == 0
    one = str(tmp_path / "one")
    table(spark, unique_rows()).coalesce(1).write.parquet(one)
    assert audit_filters(spark, one, lab).select("part").distinct().count() == len({r[2] or "" for r in unique_rows()})

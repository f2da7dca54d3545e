"""Mixing and packing, and the pipeline against a brute-force version."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm.mixing import mix_sources
from tessera.llm.packing import load_encoder, pack, plan_fillings
from tests.llm.cases import SCHEMA, prose, table
from tests.llm.test_dedup import norm
from tests.llm.test_join import brute, family


def poisson_draw(ident, rate, seed=17):
    u = (int(hashlib.md5(f"{seed}|{'' if ident is None else ident}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
    n, p, c = 0, math.exp(-rate), math.exp(-rate)
    while c < u and n < rate + 12 * math.sqrt(rate) + 50:
        n += 1
        p *= rate / n
        c += p
    return n


def rates_of(data, weights=None, exponent=0.5):
    chars = Counter()
    for _, t, _, s, _ in data:
        chars[s] += len(t or "")
    want = {s: (0 if not c else c ** exponent if weights is None else weights.get(s, 0)) for s, c in chars.items()}
    return {s: (want[s] / sum(want.values()) * sum(chars.values()) / c if c else 1.0) for s, c in chars.items()}


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0}])
def test_mixing_matches_inverse_poisson(spark, weights):
    rng = random.Random(2)
    data = [(i, prose(rng, 5 + i % 30), "en", rng.choice(["a", "a", "a", "b", None, "none"]), i) for i in range(400)]
    data += [(1000, None, "en", "empty", 0), (1001, "", "en", "empty", 0), (None, "x y", "en", "a", 3)]
    data = [(i, "" if s == "none" else t, la, s, n) for i, t, la, s, n in data]
    got = Counter((r.doc_id, r.source) for r in mix_sources(table(spark, data), weights=weights).collect())
    rate = rates_of(data, weights)
    want = Counter({(i, s): n for i, _, _, s, _ in data if (n := poisson_draw(i, rate[s]))})
    assert got == want


def test_mixing_does_not_depend_on_partitions_and_orders_globally(spark):
    rng = random.Random(2)
    data = [(i, prose(rng, 20), "en", "ab"[i % 2], i) for i in range(300)]
    a = [r.mix_key for r in mix_sources(table(spark, data)).collect()]
    b = [r.mix_key for r in mix_sources(table(spark, data).repartition(7)).collect()]
    assert a == b == sorted(a)
    clash = mix_sources(table(spark, data, clash=True))
    assert clash.columns.count("copy") == 1 and [r.mix_key for r in clash.collect()] == a


def test_encoder_gives_the_ids_of_the_tokenizers_library(tokenizer):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer)
    tok.encode_special_tokens = True
    rng = random.Random(1)
    encode = load_encoder(tokenizer)
    pools = ["ab c\n\t 1'sX", "éßüñ ÀÇ漢字かな🙂 ", "".join(chr(c) for c in range(32, 0x2000) if chr(c).isprintable()), "\x00\x1f​ 　 '’"]
    texts = ["", " ", "<|endoftext|> a", "a" * 5000, " " * 3000, "\n" * 999, "it's we'LL 12345  x"]
    texts += ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 300))) for _ in range(600)]
    for t in texts:
        assert encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_plan_uses_every_length_and_is_tight():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 3000):
        lengths = np.minimum(np.exp(rng.normal(6, 1.0, n)).astype(int) + 1, 1024)
        histogram = Counter(lengths.tolist())
        used, sequences = Counter(), 0
        for filling, times in plan_fillings(histogram, rounds=150):
            assert sum(length * a for length, a in filling) <= 1024
            sequences += times
            for length, a in filling:
                used[length] += a * times
        assert used == histogram
        bound = max(-(-int(lengths.sum()) // 1024), int((lengths > 512).sum()))
        assert sequences <= bound * 1.02 + 2


def check_packing(rows, docs, tokenizer):
    """Every document's pieces cover its ids; sequences are gapless and at most 1024 long."""
    encode = load_encoder(tokenizer)
    want = Counter()
    for i, t in docs:
        ids = encode(t or "").tolist() + [2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for places in seqs.values():
        end = 0
        for off, n in sorted(places):
            assert off == end
            end += n
        assert end <= 1024
    return len(seqs), -(-sum(r.length for r in rows) // 1024)


def test_packing_round_trip(spark, tokenizer, monkeypatch):
    import tessera.llm.packing as P
    monkeypatch.setattr(P, "GROUP", 40)  # several groups for each length
    rng = random.Random(4)
    data = [(i, prose(rng, rng.choice([0, 1, 2, 10, 200, 900, 3000])), "en", "s", 0) for i in range(300)] + [(7, "a", "en", "s", 0)] * 90
    data += [(500, None, None, None, None)]
    rows = pack(table(spark, data), tokenizer, rounds=100).collect()
    n, bound = check_packing(rows, [(r[0], r[1]) for r in data], tokenizer)
    assert n <= bound * 1.05 + 2


def test_pipeline_matches_brute_force(spark, tmp_path, tokenizer):
    rng = random.Random(21)
    data = []
    langs = {"xx": "the of and to".split(), "yy": "der die das und".split()}
    for lang, common in langs.items():
        for k in range(40):
            data.append((len(data), prose(rng, 60 + k, common), lang, "ab"[k % 2], 0))
    for t in family(rng, 8, 120, 2):
        data.append((len(data), t, "xx", "a", 0))
    data += [(len(data) + k, t, "xx", "b", 0) for k, t in enumerate([data[3][1], data[3][1].replace(" ", "  "), "", None, "123 456", "!!"])]
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [r for r in data if any(c.isalpha() for c in r[1] or "")]
    best = {}
    for r in kept:
        k = norm(r[1])
        if k not in best or (-len(r[1]), r[0]) < (-len(best[k][1]), best[k][0]):
            best[k] = r
    kept = sorted(best.values())
    classes = brute([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if classes[r[0]][0] == r[0]]
    assert len(kept) == 81
    rate = rates_of(kept)
    mixed = [(r[0], r[1]) for r in kept for _ in range(poisson_draw(r[0], rate[r[3]]))]
    n, bound = check_packing(rows, mixed, tokenizer)
    assert n <= bound * 1.1 + 2


def test_stages_return_the_columns_of_documents(spark):
    df = table(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, "").columns == df.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "mix_sources", "best_fit_packing"]


@pytest.mark.parametrize("kind", ["clash", "empty"])
def test_pipeline_takes_awkward_tables(spark, tmp_path, kind):
    """Nulls, repeated ids, long texts and columns named like the stages' own; an empty table."""
    df = table(spark, [] if kind == "empty" else None, clash=kind == "clash")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    left = [r.doc_id for r in docs.collect()]
    assert {r.doc_id for r in rows} == set(left) and (kind == "empty") == (not rows)
    assert not {5, 6, 7, 13} & set(left)  # no language

"""Every operator over the awkward tables: it runs, and gives one defined row per input row."""

import pytest

from tessera.llm import pii
from tessera.llm.exact_dedup import drop_copies, exact_groups
from tessera.llm.fill_middle import fill_in_middle
from tessera.llm.langid import keep_identified, predict_language, train
from tessera.llm.licenses import scan_licenses
from tessera.llm.line_dedup import line_dedup
from tessera.llm.mixing import mix_sources
from tessera.llm.ngram_join import ngram_join, one_of_each_class
from tessera.llm.packing import pack
from tessera.llm.pieces import encode_pieces
from tessera.llm.quality import judge
from tessera.llm.substring_dedup import substring_dedup
from tests.llm.cases import table


@pytest.mark.parametrize("kind", ["plain", "clash", "empty"])
def test_operators_take_awkward_tables(spark, tokenizer, kind):
    df = table(spark, [] if kind == "empty" else None, clash=kind == "clash").cache()
    n = df.count()
    assert line_dedup(df).count() == n
    assert exact_groups(df).count() == n
    assert scan_licenses(df).count() == n
    assert judge(df, min_rows=2).count() == n
    assert substring_dedup(df, max_cells=1 << 14).count() == n
    assert fill_in_middle(df).count() == n
    assert encode_pieces(df, tokenizer.replace("byte_bpe_50k.json", "piece_bpe_32k.model")).count() == n
    model = train(df)
    assert (model is None) == (kind == "empty")
    assert predict_language(df, model, ["doc_id"]).count() == n
    assert pii.detect(df, pii.train(df, sample=20)).count() == n
    assert pack(df, tokenizer, rounds=50).select("doc_id").distinct().count() == df.select("doc_id").distinct().count()
    joined, ids = ngram_join(df), df.select("doc_id").where("doc_id is not null").distinct()
    assert joined.select("doc_id").distinct().count() == ids.count()
    assert joined.count() == ids.count() + (kind != "empty")  # id 15 has two texts
    mix_sources(df).collect()
    for kept in (drop_copies(df), keep_identified(df, model), one_of_each_class(df)):
        assert kept.columns == df.columns
        assert kept.count() <= n
    df.unpersist()

"""Cleaning expressions (Java regex, Spark) against plain-Python statements of the same rules."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import terms as TM
from tessera.functions import text as X

ALPHABET = st.sampled_from(list("ab1 ,.;:!?\n\t\x1c\xa0\u2003\u0663\u0085") + ["Ã¤", "ä", "&amp;", "&lt;", "é", "Ã "])
TEXTS = st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=30, max_size=60)


def py_mojibake(s):
    for a, b in X.MOJIBAKE:
        s = s.replace(a, b)
    return s


def py_punct(s, collapse=r"\s{2,}"):
    s = re.sub(r",(?!\s)", ", ", s)
    s = re.sub(r"\.(?!\s|$|\d)", ". ", s)
    s = re.sub(r";(?!\s)", "; ", s)
    s = re.sub(r":(?!\s|$)", ": ", s)
    s = re.sub(r"!(?!\s|$)", "! ", s)
    s = re.sub(r"\?(?!\s|$)", "? ", s)
    s = re.sub(collapse, " ", s)
    return s.strip()


def py_label(s):
    s = " ".join(py_mojibake(s).split())
    return s or None


def py_text(s):
    s = py_mojibake(s)
    for a, b in X.ENTITIES:
        s = s.replace(a, b)
    s = py_punct(s, r"\s+")
    return s or None


def py_escape(s):
    return s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


def _run(spark, texts, col):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(col.alias("o")).collect()]


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_punctuation_matches_python(spark, texts):
    assert _run(spark, texts, X.space_after_punctuation("t")) == [py_punct(t) for t in texts]


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_clean_label_matches_python(spark, texts):
    assert _run(spark, texts, X.clean_label("t")) == [py_label(t) for t in texts]


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_clean_text_matches_python(spark, texts):
    assert _run(spark, texts, X.clean_text("t")) == [py_text(t) for t in texts]


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_escape_and_idempotent_cleaning(spark, texts):
    assert _run(spark, texts, TM.escape_literal("t")) == [py_escape(t) for t in texts]
    once = _run(spark, texts, X.clean_text("t"))
    twice = _run(spark, [o or "" for o in once], X.clean_text("t"))
    assert [o for o in once] == [t if t else None for t in twice]


def test_uri_lang_and_types(spark):
    vals = ["<http://a.org/x>", "esco:123", "p:q", "abc", " http://b.org ", "", "urn:x"]
    got = _run(spark, vals, X.clean_uri("t"))
    assert got == ["http://a.org/x", "http://data.europa.eu/esco/skill/123", "http://example.org/p/q",
                   "http://data.europa.eu/esco/skill/abc", "http://b.org", "http://data.europa.eu/esco/skill/",
                   "http://example.org/urn/x"]
    assert _run(spark, ["http://a.org/x", "a.org", "<https://h/p>", "ftp://"], X.is_valid_uri("t")) == \
        [True, False, True, False]
    assert _run(spark, ["en", "EN", "de-AT", "fra", "e"], X.is_valid_lang("t")) == [True, False, True, True, False]
    assert _run(spark, ["Exact", " broader ", "exactMatch", "EXACTMATCH", "foo", ""], X.mapping_type("t")) == \
        ["exactMatch", "broadMatch", "exactMatch", "exactMatch", "foo", "closeMatch"]
    assert _run(spark, ["Brand#17", "a b/c-d_é"], X.collection_slug("t")) == ["Brand17", "a_b_c-d_é"]

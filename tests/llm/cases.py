"""Awkward tables that every operator must take: nulls, empties, long texts, repeats, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names the operators use inside, and names of columns that they add.
CLASHES = ["_id", "_t", "_h", "_row", "_norm", "_gone", "_path", "_sketch", "_salt", "_cdf", "_lang", "_w", "kept", "keep_id",
           "class_id", "copy", "mix_key", "lang_pred", "score", "sequence_id", "length", "piece", "spans", "n_words", "licenses"]


def prose(rng, n, words="the of and to in is that for with by".split()):
    extra = ["w" + "".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(40)]
    return " ".join(rng.choice(words + extra) for _ in range(n))


def rows():
    rng = random.Random(7)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    long = prose(rng, 30_000)
    lines = "\n".join(prose(rng, 8) + "." for _ in range(9))
    out = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base.replace(" ", "\n ", 3), "en", "b"), (4, " ".join(near), "en", None),
        (5, "", "en", "a"), (6, None, "en", "a"), (7, " \t\n\x0b\x0c\r ", None, None), (8, long, "en", "b"),
        (9, lines, "fr", "b"), (10, prose(rng, 5) + "\n" + lines, "fr", "b"), (11, "one two", None, "c"), (12, "one two", "de", "c"),
        (13, "12345 !!! ###", "en", "c"), (14, "é " * 40, "fr", "c"), (15, prose(rng, 60), "en", "a"), (15, base, "en", "a"),
        (None, base, "en", "a"), (None, None, None, None), (16, base + " " + prose(rng, 80), "en", "a"),
    ]
    out.append(out[14])
    return [(i, t, la, s, None if t is None else len(t)) for i, t, la, s in out]


def table(spark, data=None, clash=False):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clash else df


def unique_rows():
    """The awkward rows with ids that identify them."""
    seen, out = set(), []
    for r in rows():
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out

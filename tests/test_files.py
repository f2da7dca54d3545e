"""CSV dialects, uneven rows, quotes, encodings and JSON lists."""

import os
import tempfile

from tessera.sources import files as S


def _file(text, name="a.csv", encoding="utf-8"):
    d = tempfile.mkdtemp(prefix="tessera-csv-", dir="/tmp")
    with open(os.path.join(d, name), "wb") as f:
        f.write(text.encode(encoding))
    return d


def test_quoted_line_ends_short_and_long_rows(spark):
    d = _file('a;b;c\n1;"x\ny";3\n4;5\n6;7;8;9\n"q ""in"" q";"s;t";\n"b\\"s";;z\n10;11;12;\n')
    got = sorted(map(tuple, S.read_csv(spark, d, sep=";").collect()))
    assert got == sorted([("1", "x\ny", "3"), ("4", "5", None), ("10", "11", "12"), ('q "in" q', "s;t", None), ('b"s', None, "z")])


def test_splittable_mode_pads_and_skips_too(spark):
    d = _file("a,b\n1,2\n3\n4,5,6\n")
    assert sorted(r.a for r in S.read_csv(spark, d, multi_line=False).collect()) == ["1", "3"]


def test_separators_inside_quotes_do_not_count(spark):
    lines = [("f", 0, "name;note"), ("f", 1, '"a";"x, y, z, u, v"'), ("f", 2, '"b ""c;d""";"1, 2, 3, 4, 5"'), ("f", 3, "  "), ("f", 4, "e")]
    df = spark.createDataFrame(lines, "file string, line_no long, line string")
    got = {r.sep: r for r in S.csv_dialect_scores(df).collect()}
    assert (got[";"].columns, got[";"].rows, got[";"].chosen) == (2, 3, True)
    assert (got[","].columns, got[","].rows) == (1, 3)


def test_encoding_choice(spark):
    d = _file("ä;ö\n", "utf.csv")
    for name, enc in (("sig.csv", "utf-8-sig"), ("one.csv", "cp1252")):
        with open(os.path.join(d, name), "wb") as f:
            f.write("ä;ö\n".encode(enc))
    got = {os.path.basename(r.file): r.encoding for r in S.choose_encoding(spark, d).collect()}
    assert got == {"utf.csv": "utf-8", "sig.csv": "utf-8-sig", "one.csv": "cp1252"}


def test_json_list_of_objects(spark):
    d = _file('[{"id": "a", "p": {"x:y": "1", "q": {"z": 2}}},\n {"id": "b"}]', "l.json")
    got = S.read_json_flat(spark, d, multi_line=True).orderBy("id").collect()
    assert [r.asDict() for r in got] == [{"id": "a", "p.q.z": 2, "p.x:y": "1"}, {"id": "b", "p.q.z": None, "p.x:y": None}]

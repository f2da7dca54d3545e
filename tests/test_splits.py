"""Quoted CSV and JSON lists cut into many small splits, against Python's own readers."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import files as S
from tessera.sources import splits as P


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def cell(rng):
    return "".join(rng.choice(["a", "é", ";", '"', "\n", "\n\n", ",", " ", "b\nc", '"";"', "x;\"\n", '";"']) for _ in range(rng.randint(0, 12)))


def written(rows, always):
    out = io.StringIO()
    csv.writer(out, delimiter=";", quoting=csv.QUOTE_ALL if always else csv.QUOTE_MINIMAL, lineterminator="\n").writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("encoding", ["UTF-8", "cp1252"])
def test_one_quoted_file_is_read_by_many_tasks(spark, tmp_path, small_splits, encoding):
    rng = random.Random(31)
    rows = [[f"k{i}", cell(rng), cell(rng)] for i in range(300)]
    (tmp_path / "one.csv").write_bytes(written([["key", "a", "b"], *rows], False).encode(encoding))
    (tmp_path / "two.csv").write_bytes(written([["key", "a", "b"], *rows[:40]], True).replace("\nk", "\n\nk").encode(encoding))
    df = S.read_csv(spark, str(tmp_path), sep=";", encoding=encoding)
    lines = P.pieces(spark, str(tmp_path))
    assert lines.select(F.spark_partition_id()).distinct().count() > 5
    got = sorted(tuple(x or "" for x in r) for r in df.collect())
    assert got == sorted(map(tuple, rows + rows[:40]))


def test_escapes_uneven_and_odd_records(spark, tmp_path):
    (tmp_path / "x.csv").write_text('﻿a;b;c\r\n1;"x\\"y;\r\nz";2\r\n3;"";4;\r\n5\r\n6;7;8;9\r\n;"q""";" w"\r\n"m\\\\";n"o;p', encoding="utf-8")
    got = [tuple(r) for r in S.read_csv(spark, str(tmp_path / "x.csv"), sep=";").collect()]
    assert sorted(got, key=str) == sorted([("1", 'x"y;\r\nz', "2"), ("3", None, "4"), ("5", None, None), (None, 'q"', " w"), ("m\\", 'n"o', "p")], key=str)


def value(rng, depth=0):
    k = rng.randrange(7 if depth < 3 else 4)
    if k == 0:
        return rng.randrange(1000)
    if k < 3:
        return "".join(rng.choice(["a", "}", "{", "[", "]", '"', "\\", "\n", "é", ",", '\\"']) for _ in range(rng.randint(0, 9)))
    if k == 3:
        return None
    if k == 4:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {f"f{j}": value(rng, depth + 1) for j in range(rng.randint(0, 3))}


@pytest.mark.parametrize("indent", [None, 2])
def test_one_json_list_is_read_by_many_tasks(spark, tmp_path, small_splits, indent):
    rng = random.Random(32)
    items = [{"id": i, "v": value(rng)} for i in range(400)]
    (tmp_path / "list.json").write_text(json.dumps(items, indent=indent, ensure_ascii=False))
    (tmp_path / "one.json").write_text(json.dumps({"id": 1000, "v": {"w": [{"x": "}"}]}}, indent=indent))
    (tmp_path / "none.json").write_text(" [ ]")
    assert P.pieces(spark, str(tmp_path), "}").select(F.spark_partition_id()).distinct().count() > 5
    got = [json.loads(r.record) for r in P.json_records(spark, str(tmp_path)).collect()]
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(got, key=key) == sorted([*items, {"id": 1000, "v": {"w": [{"x": "}"}]}}], key=key)


def test_types_come_from_all_records(spark, tmp_path):
    items = [{"id": i, "properties": {"a": i}} for i in range(50)] + [{"id": 2.5, "properties": {"a": 1, "late": {"x": "y"}}}]
    (tmp_path / "list.json").write_text(json.dumps(items))
    df = S.read_json_flat(spark, str(tmp_path), multi_line=True)
    assert dict(df.dtypes) == {"id": "double", "properties.a": "bigint", "properties.late.x": "string"}
    assert df.where("id = 2.5").select("`properties.late.x`").first()[0] == "y" and df.count() == 51


def test_encodings_of_files(spark, tmp_path, small_splits):
    long = "é" * 2_000  # characters across the edges of splits
    made = {"a": (f"x;{long}\n" * 3).encode(), "b": b"\xef\xbb\xbfx;y\n", "c": f"x;{long}\n".encode("cp1252"), "d": b"x;\x81\n" + b"y\n" * 900,
            "e": b"y\n" * 900 + b"\xe2\x82", "f": b"", "g": "€;“\n".encode("cp1252")}
    for name, data in made.items():
        (tmp_path / f"{name}.csv").write_bytes(data)
    got = {r.file.rsplit("/", 1)[1][0]: r.encoding for r in S.choose_encoding(spark, str(tmp_path)).collect()}
    assert got == {"a": "utf-8", "b": "utf-8-sig", "c": "cp1252", "d": "latin1", "e": "cp1252", "g": "cp1252"}
    only = {r.file.rsplit("/", 1)[1][0]: r.encoding for r in S.choose_encoding(spark, str(tmp_path), ["utf-8", "cp1252"]).collect()}
    assert only["d"] is None and only["b"] == "utf-8"


def test_json_cuts_are_examined_once(spark, tmp_path, small_splits):
    """The files are read by one job, not once for every step; lists with strings full of brackets over many splits."""
    import json
    from tessera.sources import splits
    rows = [{"a": i, "b": {"c": '}"[{\\' * (i % 4), "d": [i, {"e": "]"}]}} for i in range(300)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/list.json").write_text("\n " + json.dumps(rows))
    (tmp_path / "in/rows.json").write_text("\n".join(json.dumps(r) for r in rows[:7]))
    out = splits.json_records(spark, str(tmp_path / "in"))
    assert str(tmp_path) not in out._jdf.queryExecution().optimizedPlan().toString()
    assert not any(f.startswith(f"file:{tmp_path}") or str(tmp_path) in f for f in out.inputFiles())
    got = sorted(json.dumps(json.loads(r.record)) for r in out.collect())
    assert got == sorted(json.dumps(r) for r in rows + rows[:7])

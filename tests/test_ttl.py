"""TTL reading of foreign files and round trips."""

import os
import tempfile

from pyspark.sql import functions as F

from tessera.sources import ttl as TT

FOREIGN = """@base <http://ex.org/v/> .
@prefix skos: <http://www.w3.org/2004/02/skos/core#> .
# a comment line
<http://ex.org/v/s> a skos:ConceptScheme ;
    skos:prefLabel "Scheme"@en .

<http://ex.org/v/a> a skos:Concept ;
    skos:prefLabel "Alpha \\"quoted\\""@en , "Alpha"@de ;
    skos:altLabel "A"@en-GB ;
    skos:definition "Line one\\nline two" ;
    skos:broader <http://ex.org/v/root> ;
    skos:related <http://ex.org/v/b> ,
        <http://ex.org/v/c> ;
    skos:exactMatch esco:123 .
esco:b a skos:Concept ;
    skos:prefLabel "Beta"@en .
.
"""


def _write(text):
    d = tempfile.mkdtemp(prefix="tessera-ttl-", dir="/tmp")
    with open(os.path.join(d, "v.ttl"), "w", encoding="utf-8") as f:
        f.write(text)
    return d


def test_foreign_file_blocks_literals_relations(spark):
    b = TT.read_ttl(spark, _write(FOREIGN)).withColumn("uri", F.regexp_replace("raw_uri", "^<|>$", ""))
    uris = sorted(r.uri for r in b.collect())
    assert uris == ["esco:b", "http://ex.org/v/a"]  # the ConceptScheme is not a concept
    lit = {(r.uri, r.prop, r.text, r.lang) for r in TT.parse_literals(b).collect()}
    assert ("http://ex.org/v/a", "prefLabel", 'Alpha "quoted"', "en") in lit
    assert ("http://ex.org/v/a", "prefLabel", "Alpha", "de") in lit
    assert ("http://ex.org/v/a", "altLabel", "A", "en-GB") in lit
    assert ("http://ex.org/v/a", "definition", "Line one\nline two", "en") in lit
    rel = {(r.uri, r.prop, r.target) for r in TT.parse_relations(b).collect()}
    assert {("http://ex.org/v/a", "related", "http://ex.org/v/b"), ("http://ex.org/v/a", "related", "http://ex.org/v/c"),
            ("http://ex.org/v/a", "broader", "http://ex.org/v/root"), ("http://ex.org/v/a", "exactMatch", "esco:123")} <= rel
    hdr = {(r.kind, r.text) for r in TT.read_header(spark, _write(FOREIGN)).collect()}
    assert ("base", "@base <http://ex.org/v/> .") in hdr
    assert any(k == "scheme" and "ConceptScheme" in t for k, t in hdr)


def test_numbering_is_global_and_dense(spark):
    df = spark.range(0, 5000, 1, 7).withColumn("k", (F.col("id") * 7919) % 5000)
    out = TT.number_rows(df, ["k"], "n").select("k", "n").collect()
    assert sorted(r.n for r in out) == list(range(1, 5001))
    assert all(r.n == r.k + 1 for r in out)


def test_report_sinks_write_numbered_lines(spark):
    d = tempfile.mkdtemp(prefix="tessera-rep-", dir="/tmp")
    ch = spark.createDataFrame([(f"u{i % 7}", i, f"Duplicate removed: u{i % 7}") for i in range(50)],
                               "uri string, pos long, detail string")
    TT.write_change_log(ch, f"{d}/changes")
    lines = [r.value for r in spark.read.text(f"{d}/changes").collect()]
    assert sorted(int(x.split(".")[0]) for x in lines) == list(range(1, 51))
    iss = spark.createDataFrame([("a", "S14", "violation", "v1"), ("b", "encoding", "warning", "w1")],
                                "uri string, rule string, severity string, detail string")
    TT.write_validation_report(iss, f"{d}/report")
    assert sorted(r.value for r in spark.read.text(f"{d}/report").collect()) == ["   1. v1", "   1. w1"]


def test_blank_lines_tabs_and_crlf_inside_blocks(spark):
    text = FOREIGN.replace('    skos:altLabel "A"@en-GB ;\n', '\n\t\n    skos:altLabel "A"@en-GB ;\n').replace("<http://ex.org/v/a> a", "\t<http://ex.org/v/a> a")
    for content in (text, text.replace("\n", "\r\n")):
        d = _write_bytes(content)
        lit = {(r.prop, r.text) for r in TT.parse_literals(TT.read_ttl(spark, d), uri_col="raw_uri").collect()}
        assert ("altLabel", "A") in lit and ("definition", "Line one\nline two") in lit
        files = spark.createDataFrame([("f", content)], "file string, content string")
        a = sorted((r.k, r.raw_uri, r.block) for r in TT.blocks_from_files(files).collect())
        assert a == sorted((r.k, r.raw_uri, r.block) for r in TT.read_ttl(spark, d).collect())


def _write_bytes(text):
    d = tempfile.mkdtemp(prefix="tessera-ttl-", dir="/tmp")
    with open(os.path.join(d, "v.ttl"), "wb") as f:
        f.write(text.encode())
    return d


def test_many_blocks_in_one_file_over_many_splits(spark):
    n = 120_000
    body = "".join(f'<u{i}> a skos:Concept ;\n\n  skos:prefLabel "L{i}"@en .\n{".x"[i % 2 :] if i % 3 == 0 else ""}\n' for i in range(n))
    d = _write_bytes(body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        b = TT.read_ttl(spark, d)
        rows = b.select("k", "raw_uri", F.size(F.split("block", "\n")).alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == n
    assert all(r.raw_uri == f"<u{r.k - 1}>" for r in rows)


def test_long_value_lists_keep_their_order(spark):
    values = [f"v{i:05d}" for i in range(1500)]
    block = "<u> a skos:Concept ;\n" + "skos:altLabel " + ", ".join(f'"{v}"@en' for v in values) + ' ;\nskos:altLabel "last"@en .'
    b = spark.createDataFrame([("u", 1, block)], "uri string, pos long, block string")
    lit = TT.parse_literals(b)
    assert [r.text for r in lit.orderBy("vpos").collect()] == [*values, "last"]
    assert lit.select("vpos").distinct().count() == 1501


def test_stream_keeps_the_first_block_over_batches(spark):
    from tessera.streaming.cleaner_stream import clean_stream
    root = tempfile.mkdtemp(prefix="tessera-str-", dir="/tmp")
    os.makedirs(f"{root}/in")

    def land(name, label):
        with open(f"{root}/in/{name}", "w") as f:
            f.write("".join(f'<http://ex.org/{i}> a skos:Concept ;\n\n skos:prefLabel "{label} {i}"@en .\n' for i in range(3 if name > "c" else 2)))

    land("b.ttl", "second")
    land("a.ttl", "first")
    clean_stream(spark, f"{root}/in", f"{root}/out", f"{root}/ckpt").awaitTermination()
    land("c.ttl", "third")
    clean_stream(spark, f"{root}/in", f"{root}/out", f"{root}/ckpt").awaitTermination()
    got = sorted((r.uri, r.text) for r in spark.read.parquet(f"{root}/out/labels").collect())
    assert got == [("http://ex.org/0", "first 0"), ("http://ex.org/1", "first 1"), ("http://ex.org/2", "third 2")]


def test_stream_reads_a_large_file_line_by_line(spark, tmp_path):
    """No record of the stream holds a whole file, and a file of many splits gives the blocks of ``read_ttl``."""
    from tessera.streaming.cleaner_stream import clean_stream
    n = 3000
    (tmp_path / "in").mkdir()
    text = "".join(f'<http://ex.org/{i % 2000}> a skos:Concept ;\r\n\r\n# note\r\n  skos:prefLabel "label {i}"@en .\r\n' for i in range(n))
    (tmp_path / "in/one.ttl").write_text(text, newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        q = clean_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ckpt")
        q.awaitTermination()
        assert sum(p["numInputRows"] for p in q.recentProgress) >= 4 * n
        got = {r.uri: (r.text, r.lang) for r in spark.read.parquet(f"{tmp_path}/out/labels").collect()}
        blocks = {(r.uri, r.block) for r in spark.read.parquet(f"{tmp_path}/out/concepts").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {f"http://ex.org/{i}": (f"label {i}", "en") for i in range(2000)}
    assert blocks == {(f"http://ex.org/{i}", f'<http://ex.org/{i}> a skos:Concept ;\nskos:prefLabel "label {i}"@en .') for i in range(2000)}


def test_a_concept_of_many_statements_is_not_gathered(spark, tmp_path):
    """Written and read line by line: no list of a concept's statements anywhere in the plans."""
    from pyspark.sql import functions as F
    from tessera.sources import ttl as TT
    terms = spark.range(20_000).select(F.lit("http://ex.org/big").alias("uri"), F.lit("altLabel").alias("prop"), F.col("id").cast("int").alias("vpos"),
                                       F.concat(F.lit('"label '), F.col("id").cast("string"), F.lit('"@en')).alias("term"))
    terms = terms.unionByName(terms.where("vpos < 3").withColumn("uri", F.lit("http://ex.org/small")))
    assert "collect_list" not in TT.statement_lines(terms)._jdf.queryExecution().toString()
    path = str(tmp_path / "ttl")
    TT.write_ttl_lines(terms, path, "@base <http://ex.org/> .")
    back = TT.read_statements(spark, f"{path}/concepts")
    assert "collect_list" not in back._jdf.queryExecution().toString()
    lit = TT.parse_literals(back.withColumn("uri", F.regexp_replace("raw_uri", "^<|>$", "")))
    got = {r.uri: r.n for r in lit.groupBy("uri").agg(F.count_distinct("text").alias("n")).collect()}
    assert got == {"http://ex.org/big": 20_000, "http://ex.org/small": 3}
    whole = TT.read_ttl(spark, f"{path}/concepts").where("raw_uri = '<http://ex.org/small>'").first().block
    assert whole.split("\n") == ["<http://ex.org/small> a skos:Concept ;", "skos:inScheme <> ;", *[f'skos:altLabel "label {k}"@en ;' for k in range(3)], "."]

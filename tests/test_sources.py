"""Sources, sinks, streaming and the driver's contract."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern import schemas
from lectern.operators import outline
from lectern.sources import tables
from lectern.streaming import ingest


def section(i, **more):
    return {"section_id": f"s{i}", "title": f"T{i}", "level": 1, "chapter": "a\x00b", "parent_id": None, "children": [], "start_page": i, "end_page": i, "text": "x", "images": [], "equations": []} | more


def test_sections_json(spark, tmp_path):
    for i, s in enumerate([section(2), section(1), section(3, start_page=None)]):
        (tmp_path / f"{i}.json").write_text(json.dumps(s, indent=1))
    (tmp_path / "bad.json").write_text("{")
    df = tables.sections_json(spark, str(tmp_path), "b")
    assert [r.section_id for r in df.orderBy("ord").collect()] == ["s3", "s1", "s2"]
    assert tables.section(df, "b", "s1").count() == 1
    with pytest.raises(LookupError):
        tables.section(df, "b", "nope")
    wanted = spark.createDataFrame([("q", ["s2", "nope", "s1"])], "q_id string, ids array<string>")
    assert [r.section_id for r in tables.sections_by_id(df, wanted).orderBy("pos").collect()] == ["s2", "s1"]
    assert tables.sections_json(spark, str(tmp_path / "gone"), "b").count() == 0
    tables.write_sections(df, str(tmp_path / "out"))
    tables.write_sections(df.withColumn("book_id", F.lit("c")), str(tmp_path / "out"))
    assert {r.book_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"b", "c"}


def test_other_sources(spark, tmp_path):
    (tmp_path / "My-Book.json").write_text(json.dumps([{"question": "q", "expected_sections": ["a"]}]))
    assert [tuple(r) for r in tables.questions_json(spark, str(tmp_path)).select("question", "difficulty", "book_id").collect()] == [("q", None, "my_book")]
    assert tables.confusable_json(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/Fluid-Mechanics.pdf").write_bytes(b"%PDF")
    (tmp_path / "raw/notes.txt").write_bytes(b"x")
    files = tables.pdf_files(spark, str(tmp_path / "raw"))
    assert [(r.book_id, r.display_name) for r in files.collect()] == [("fluid_mechanics", "Fluid Mechanics")]
    assert tables.image_data_urls(files).first().url == "data:image/png;base64,JVBERg=="
    for n in (2, 1):
        (tmp_path / f"scan/chunk_{n}").mkdir(parents=True)
        (tmp_path / f"scan/chunk_{n}/c.json").write_text('{"block_type": "Page"}')
    assert tables.block_texts(spark, str(tmp_path / "scan")).count() == 2


def test_within(spark):
    df = spark.createDataFrame([("a/b.png",), ("../x",), ("a/../../x",), ("/etc",), ("a/../b",), ("..",), ("./a",)], "path string")
    assert [bool(r[0]) for r in df.select(tables.within("/root")).collect()] == [True, False, False, False, True, False, True]


def test_ingest(spark, tmp_path):
    pages, out = str(tmp_path / "pages"), str(tmp_path / "out")

    def build(df):
        return outline.regex_headings(df).groupBy("book_id").agg(F.count("*").alias("n"))

    def run():
        ingest.ingest(ingest.new_pages(spark, pages), build, out, str(tmp_path / "cp")).awaitTermination()
        return {r.book_id: r.n for r in spark.read.parquet(out).collect()}

    spark.createDataFrame([("b", 0, "1 Intro\nx\n2.1 Next")], "book_id string, page int, text string").write.parquet(pages)
    assert run() == {"b": 2}
    spark.createDataFrame([("c", 0, "Chapter 3")], "book_id string, page int, text string").write.mode("append").parquet(pages)
    assert run() == {"b": 2, "c": 1}


def test_book_in_several_batches(spark, tmp_path):
    pages, out = str(tmp_path / "pages"), str(tmp_path / "out")

    def build(df):
        return outline.regex_headings(df).select("book_id", "page", "title")

    def add(*rows):
        spark.createDataFrame(list(rows), "book_id string, page int, text string").coalesce(1).write.mode("append").parquet(pages)

    def run():
        ingest.ingest(ingest.new_pages(spark, pages, 1), build, out, str(tmp_path / "cp")).awaitTermination()
        return sorted((r.book_id, r.page, r.title) for r in spark.read.parquet(out).collect())

    add(("b", 0, "1 Intro"), ("c", 0, "Chapter 3"))
    add(("b", 1, "2 Next"))
    assert run() == [("b", 0, "1 Intro"), ("b", 1, "2 Next"), ("c", 0, "Chapter 3")]
    add(("b", 1, "2 Changed"))
    assert run() == [("b", 0, "1 Intro"), ("b", 1, "2 Changed"), ("c", 0, "Chapter 3")]


def test_thread_activity(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.createDataFrame([("t", 0), ("t", 60), ("u", 86_400 * 3)], "thread_id string, s long").select("thread_id", F.timestamp_seconds("s").alias("created_at"))
    df.write.parquet(path)
    stream = ingest.thread_activity(spark.readStream.schema(df.schema).parquet(path))
    q = stream.writeStream.format("memory").queryName("activity").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.thread_id, r.n_messages) for r in spark.table("activity").collect()] == [("t", 2)]


SMALL = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def matches_sql(spark, name, run, sql):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = run(spark, SMALL)
    cols = sorted(df.columns)
    got = con.execute(sql)
    theirs = [d[0] for d in got.description]
    assert sorted(theirs) == cols
    at = [theirs.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_queries_match_sql(spark):
    from lectern.plans.registry import ORACLES, QUERIES

    assert ORACLES.keys() <= QUERIES.keys()
    for name, sql in ORACLES.items():
        matches_sql(spark, name, QUERIES[name], sql)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert "tfidf_keywords" in e.queries()


def test_parsed(spark):
    def make():
        return lambda content: [(i, line) for i, line in enumerate(content.decode().split("|"))]

    files = spark.createDataFrame([("a", b"x|y"), ("b", b"\xff"), ("c", b"")], "book_id string, content binary")
    got = sorted(tuple(r) for r in tables.parsed(files, make, schemas.PAGE).collect())
    assert got[0] == ("a", 0, "x", None) and got[1] == ("a", 1, "y", None) and got[3] == ("c", 0, "", None)
    assert got[2][:3] == ("b", None, None) and "UnicodeDecodeError" in got[2][3]

import json
import os

from pyspark.sql import functions as F

from sheaf.sources import readers, sinks
from sheaf.streaming import incremental


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿ id , name\n1, x \n2,none\n3,\"a \"\"q\"\", b\"\n".encode())
    got = readers.read_csv(spark, str(p))
    assert got.columns == ["id", "name"] and [tuple(r) for r in got.orderBy("id").collect()] == [("1", "x"), ("2", None), ("3", 'a "q", b')]
    assert readers.read_csv(spark, str(tmp_path / "missing.csv")).columns == []
    p.write_text("A;B\n1,5;x\n")
    assert readers.read_csv(spark, str(p), sep=";").first()["A"] == "1,5"


def test_partitioned_and_aliases(spark, tmp_path):
    for u in ("uni1", "uni2"):
        os.makedirs(tmp_path / u)
        (tmp_path / u / "x_staff.csv").write_text("Name,Title\nAnn,\n")
    got = readers.read_partitioned(spark, str(tmp_path), "staff")
    assert sorted(r.partition for r in got.collect()) == ["uni1", "uni2"]
    al = readers.aliased(got, {"name": ["full_name", "Name"], "title": ["Title", "Name"], "orcid": ["orcid"]})
    assert {tuple(r) for r in al.collect()} == {("Ann", "Ann", None)}


def test_offset_header(spark):
    df = spark.createDataFrame([(0, "note", None, None), (1, "Title", "Unnamed: 1", "ISSN"), (2, "J", "?", "1")], "row_no int, c0 string, c1 string, c2 string")
    assert [r.asDict() for r in readers.with_offset_header(df, 1).collect()] == [{"Title": "J", "ISSN": "1"}]


def test_cache(spark):
    c = spark.sql("select * from values ('k', timestamp'2024-01-01', 'old'), ('m', timestamp'2024-01-01', 'x') as t(key, fetched_at, body)")
    n = spark.sql("select * from values ('k', timestamp'2024-01-05', 'new') as t(key, fetched_at, body)")
    up = readers.upsert_cache(c, n)
    assert {r.key: r.body for r in up.collect()} == {"k": "new", "m": "x"}
    assert [r.key for r in readers.fresh(up, F.lit("2024-01-06").cast("timestamp"), 3).collect()] == ["k"]
    assert readers.cache_stats(up).first()["n_responses"] == 2
    keys = spark.createDataFrame([(f"d{i}",) for i in range(60)], "doi string")
    asked = readers.batches(keys, "doi", 25)
    assert asked.select("batch_no").distinct().count() <= 3
    assert readers.incomplete_batches(asked, keys, "doi").count() == 0


def test_pages_and_metrics(spark):
    body = json.dumps({"total": 3, "items": [{"id": 1, "t": "a"}, {"id": 2, "t": "b"}]})
    df = spark.createDataFrame([(1, body)], "page_no int, body string")
    items = readers.pages(df, "body", "id:int,t:string")
    assert [(r.pos, r.id, r.t) for r in items.orderBy("pos").collect()] == [(0, 1, "a"), (1, 2, "b")]
    assert readers.page_gaps(items).first()["missing"] == 1
    v = spark.sql("select array(named_struct('y', 2020, 'v', 1.0), named_struct('y', 2022, 'v', null), named_struct('y', 2021, 'v', 2.0)) as m")
    assert v.select(readers.latest_value(F.col("m"), "y", "v")).first()[0] == 2


def test_documents(spark):
    page = "<html><head><meta name='orcid' content='0000'></head><body><h2>Staff</h2><div class='card big'><a href='/x'>Ann &amp; Bo</a></div><dl><dt>Role</dt><dd>Dean</dd></dl><h2>Papers</h2><ul><li>One<li>Two</ul></body>"
    df = spark.createDataFrame([("p", page), ("q", None), ("r", "")], "url string, html string")
    got = {(r.kind, r.name, r.value) for r in readers.html_parts(df, "url", "html").collect()}
    assert {("meta", "orcid", "0000"), ("link", "Ann & Bo", "/x"), ("property", "Role", "Dean"), ("card", "Staff", "Ann & Bo")} <= got
    assert any(k == "item" and "Two" in v for k, _, v in got)
    feed = "<rss><channel><item><title>A</title><link>l1</link><pubDate>d1</pubDate></item><item><title>B</title><link>l2</link><pubDate>d2</pubDate></item></channel></rss>"
    rss = readers.rss_items(spark.createDataFrame([("f", feed)], "k string, xml string"), "k", "xml")
    assert sorted(tuple(r) for r in rss.collect()) == [("f", "A", "l1", "d1"), ("f", "B", "l2", "d2")]
    bib = spark.createDataFrame([("@article{k,\n title = {The {B}ig one},\n year = \"2001\"\n}",)], "b string")
    assert tuple(bib.select(readers.bibtex_field("b", "title"), readers.bibtex_field("b", "year"), readers.bibtex_field("b", "doi")).first()) == ("The Big one", "2001", None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, ["a", "b"], "=x"), (2, None, None, None)], "id int, n double, l array<string>, s string")
    sinks.write_tables({"t": df}, str(tmp_path), "u", files=1)
    back = readers.read_csv(spark, f"{tmp_path}/u_t_csv").orderBy("id").collect()
    assert tuple(back[0]) == ("1", "2", "a; b", "'=x") and tuple(back[1]) == ("2", None, None, None)
    assert readers.read_json_rows(spark, f"{tmp_path}/u_t_json", "id int, n double", lines=True).count() == 2
    sinks.write_audit(df.limit(0), f"{tmp_path}/audit")
    assert spark.read.parquet(f"{tmp_path}/audit").count() == 0
    root = str(tmp_path / "pub")
    sinks.publish(df, root)
    sinks.publish(df.where("id = 1"), root)
    assert sinks.published(spark, root).count() == 1
    assert json.loads(sinks.quality_report(df, {"no_n": "n is null"}).first()[0]) == {"rows": 2, "no_n": 1}


def test_streaming(spark, tmp_path):
    src, like = str(tmp_path / "in"), spark.sql("select 1L as k, timestamp'2024-01-01 00:00:00' as at, 'a' as v")
    spark.sql("select * from values (1L, timestamp'2024-01-01 00:00:00', 'a'), (1L, timestamp'2024-01-01 00:01:00', 'b'), (2L, timestamp'2024-01-01 00:02:00', 'c') as t(k, at, v)").write.parquet(src)
    once = incremental.first_of_key(incremental.arriving(spark, src, like), ["k"], "at", "1 hour")
    incremental.run_available(once, str(tmp_path / "c1"), str(tmp_path / "o1"))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "o1")).collect()) == [1, 2]
    incremental.upsert_available(incremental.arriving(spark, src, like), str(tmp_path / "c2"), str(tmp_path / "pub"), "k")
    assert sinks.published(spark, str(tmp_path / "pub")).count() == 2
    spark.sql("select 2L as k, timestamp'2024-01-02 00:00:00' as at, 'new' as v").write.mode("append").parquet(src)
    incremental.upsert_available(incremental.arriving(spark, src, like), str(tmp_path / "c2"), str(tmp_path / "pub"), "k")
    assert {r.k: r.v for r in sinks.published(spark, str(tmp_path / "pub")).collect()}[2] == "new"

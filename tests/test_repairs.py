from pyspark.sql import functions as F

from sheaf.plans.repairs import repaired_title
from sheaf.sources import readers


def test_title_repairs(spark):
    raw = ["3. Cash and cows (winner of the 2019 prize)", "[12] Cash and cows (with A. Lee)", "Cash and cows, 12(3), 44-59.", "Cash and cows", "2001: a study (of cows)", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "id int, t string")
    got = {r.id: r.x for r in df.select("id", repaired_title(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(7)] == ["Cash and cows"] * 4 + ["2001: a study (of cows)", "", None]


def test_batches_never_hold_more_than_asked(spark):
    keys = spark.range(1017).select(F.col("id").cast("string").alias("doi")).unionByName(spark.sql("select cast(null as string) as doi union all select '5'"))
    asked = readers.batches(keys, "doi", 25)
    sizes = [r["count"] for r in asked.groupBy("batch_no").count().collect()]
    assert max(sizes) <= 25 and sum(sizes) == 1017 and len(sizes) == 41
    assert readers.batches(keys.limit(0), "doi", 25).count() == 0


def test_partitions_with_different_headers(spark, tmp_path):
    for name, body in (("a", "x,y\n1,2\n"), ("b", '﻿y,z\n"3\n4",5\n')):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"all_{'t'}.csv").write_text(body, encoding="utf-8")
    got = {r.partition: (r.x, r.y, r.z) for r in readers.read_partitioned(spark, str(tmp_path), "t").collect()}
    assert got == {"a": ("1", "2", None), "b": (None, "3\n4", "5")}
    assert readers.read_partitioned(spark, str(tmp_path), "nothing").count() == 0


def test_a_bad_page_is_a_row(spark):
    pages = [("a", "<h2>Ok</h2>"), ("b", "<![x[ <h2>"), ("c", None), ("d", "<p>" * 5000 + "deep"), ("e", "")]
    got = readers.html_parts(spark.createDataFrame(pages, "k string, p string"), "k", "p").collect()
    assert [(r.key, r.kind, r.value) for r in got if r.key == "a"] == [("a", "heading", "Ok")]
    assert {r.kind for r in got if r.key in "bcde"} <= {"error", "heading"}

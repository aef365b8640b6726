from datetime import datetime as D

from sheaf.operators.orphans import orphan_references, orphan_report

T = [D(2024, m, 1) for m in range(1, 13)]


def run(spark, kids, parents):
    c = spark.createDataFrame(kids, "id bigint, fk bigint, loaded_at timestamp, ref_table string")
    p = spark.createDataFrame(parents, "k bigint, loaded_at timestamp, deleted_at timestamp, ref_key string")
    got = orphan_references(c, "id", "loaded_at", {"parents": ("fk", p, "k")})
    return got


def brute(kids, parents):
    out = set()
    for i, k, at, _ in kids:
        if k is None:
            continue
        live = any(pk == k and f is not None and at is not None and f <= at and (t is None or t > at) for pk, f, t, _ in parents)
        if not live:
            out.add(("parents", at.strftime("%Y-%m") if at else None, i))
    return out


def test_times_nulls_repeats_and_clashing_names(spark):
    kids = [(1, 10, T[5], "a"), (2, 10, T[0], "a"), (3, 11, T[5], None), (4, None, T[5], "x"), (5, 12, T[5], "x"), (5, 12, T[5], "x"), (6, 10, None, "x"), (7, 13, T[2], "x"), (8, 13, T[3], "x")]
    parents = [(10, T[1], None, "r"), (10, T[1], None, "r"), (11, T[1], T[3], "r"), (13, T[0], T[3], None), (None, T[0], None, None), (12, None, None, None)]
    got = run(spark, kids, parents)
    assert {tuple(r) for r in got.collect()} == brute(kids, parents)
    assert got.count() == len(brute(kids, parents))
    assert sum(r.orphans for r in orphan_report(got).collect()) == got.count()


def test_empty_tables(spark):
    kids = [(1, 10, T[5], "a")]
    assert run(spark, [], [(10, T[1], None, "r")]).count() == 0
    assert {r.record_id for r in run(spark, kids, []).collect()} == {1}


def test_hot_key(spark):
    kids = [(i, 1 if i % 3 else i, T[i % 12], "x") for i in range(3000)]
    parents = [(1, T[4], T[9], "x")]
    assert {tuple(r) for r in run(spark, kids, parents).collect()} == brute(kids, parents)

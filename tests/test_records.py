from pyspark.sql import functions as F

from sheaf.functions import records as R


def first(spark, sql, *cols):
    return tuple(spark.sql(sql).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_text_rules(spark):
    v, f = R.forthcoming("x")
    assert first(spark, "select 'Annals of Risk (forthcoming)' x", v, f) == ("Annals of Risk", True)
    assert first(spark, "select 'Annals of Risk' x", v, f) == ("Annals of Risk", False)
    assert first(spark, "select 'pp 1234-20013, 1899 and 2003, 1999' x", R.first_year("x")) == (2003,)
    assert first(spark, "select 'none' x", R.first_year("x")) == (None,)
    assert first(spark, "select repeat('word ', 30) t, cast(null as string) d, cast(null as int) y", R.prose_not_title("t", "d", "y")) == (True,)


def test_three_values(spark):
    q = "select {} v, cast(null as string) i, {} o"
    assert [first(spark, q.format(v, o), R.in_an_issue("v", "i", "o"))[0] for v, o in (("'3'", "true"), ("cast(null as string)", "true"), ("cast(null as string)", "cast(null as boolean)"))] == [True, False, None]


def test_preferences(spark):
    loc = "select array(named_struct('kind', 'repository', 'name', 'R', 'repository', true), named_struct('kind', cast(null as string), 'name', 'N', 'repository', false), named_struct('kind', 'journal', 'name', 'J', 'repository', false)) a"
    assert first(spark, loc, R.preferred_location("a"), R.preferred_location(F.slice("a", 1, 2)), R.preferred_location(F.slice("a", 1, 1))) == ("J", "N", "R")
    typed = "select array(named_struct('kind', cast(null as string), 'value', 'x'), named_struct('kind', 'electronic', 'value', 'e'), named_struct('kind', 'print', 'value', 'p')) a"
    assert first(spark, typed, R.preferred_typed("a", "print"), R.preferred_typed(F.slice("a", 1, 2), "print"), R.preferred_typed(F.slice("a", 1, 1), "print")) == ("p", "e", "x")
    assert first(spark, "select array('1', '2') k, 'Agg' n", R.veto("k", ["2"], "n", ["Other"]), R.veto("k", ["2"], "n", ["agg"])) == (["1"], ["1", "2"])
    assert first(spark, "select array(named_struct('id', 1, 'orcid', cast(null as string)), named_struct('id', 2, 'orcid', 'o')) a, 2 i", R.own_entry("a", "i", "orcid")) == ("o",)


def test_json_and_maps(spark):
    row = first(spark, "select 'Sure: ```json {\"a\": 1}``` ok' x, 'no' y", F.try_variant_get(R.lenient_json("x"), "$.a", "int"), R.lenient_json("y"))
    assert row == (1, None)
    assert first(spark, "select array(named_struct('key', 'a', 'value', 1), named_struct('key', 'a', 'value', 2), named_struct('key', 'b', 'value', 3)) m", R.merged_ids("m")) == ({"a": 1, "b": 3},)
    assert first(spark, "select true a, false b", R.scope_note(no_page=F.col("a"), no_id=F.col("b"))) == ("no page",)

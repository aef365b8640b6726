import pytest

from sheaf.llm import lookalike as L

CASES = [
    ("Ｗｈｏ pays", "Who pays"), ("Café", "Café"), ("secre﻿cy", "secrecy"), ("a b c", "a b c"), ("pensiоn", "pension"), ("А bоunded theory", "A bounded theory"), ("deﬁcits", "deficits"),
    ("Pοrt", "Port"), ("WHΟ PΑΥS", "WHO PAYS"), ("х­y", "xy"),
]
SAME = ["Учёт аренды Brinmouth", "Налоговая нагрузка и Рост", "β-risk and Δ", "R² and ½", "“soft” – a note…", "Ελεγκτική και", "中小企业：研究", "Çamlıova", "ⁿ", "plain", ""]


@pytest.fixture(scope="module")
def forms(spark):
    rows = [(i, t, "x", True) for i, t in enumerate([a for a, _ in CASES] + SAME)] + [(99, None, "x", True), (0, CASES[0][0], "x", False)]
    df = spark.createDataFrame(rows, "record_id bigint, text string, form string, is_case boolean")
    return L.consistent_form(df, "record_id", "text").collect(), L.lookalikes(df, "record_id", "text").collect()


def test_forms(forms):
    got = {r.record_id: r for r in forms[0]}
    for i, (_, want) in enumerate(CASES):
        assert got[i].form == want and got[i].is_case
    for i, t in enumerate(SAME, len(CASES)):
        assert got[i].form == t and not got[i].is_case, t
    assert 99 not in got


def test_cases_only(forms):
    assert sorted(r.record_id for r in forms[1]) == sorted([0, *range(len(CASES))])


def test_idempotent_and_long(spark):
    long = "Ｗ" + " mot" * 50000 + " оf"
    df = spark.createDataFrame([(1, long)], "k bigint, t string")
    once = L.lookalikes(df, "k", "t").first().form
    assert once.startswith("W mot") and once.endswith(" of")
    assert L.lookalikes(spark.createDataFrame([(1, once)], "k bigint, t string"), "k", "t").count() == 0
    assert L.lookalikes(spark.createDataFrame([], "k bigint, t string"), "k", "t").count() == 0

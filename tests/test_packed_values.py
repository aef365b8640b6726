import csv
import io
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.functions import peg
from sheaf.operators.multivalue import split_values

WORD = st.text("abcdefgh", min_size=2, max_size=6)


def vals(s, people=False):
    return [v for _, v, _ in peg.parse(s, people)]


def test_separators():
    assert vals("a;b ;; c;") == ["a", "b", "c"]
    assert vals("a | b|c") == ["a", "b", "c"]
    assert vals("Statistics/Probability (Q1) / Banking") == ["Statistics/Probability (Q1)", "Banking"]
    assert vals("a\nb") == ["a", "b"]


def test_label_commas():
    assert vals("Law, Tax and Policy (Q1), Banking (Q2)") == ["Law, Tax and Policy (Q1)", "Banking (Q2)"]
    assert vals("Economics and Trade (Q2)") == ["Economics and Trade (Q2)"]


def test_quotes_and_brackets():
    assert vals('"A; B";C') == ["A; B", "C"]
    assert vals('"Management of ""Soft"" Assets (Q1)", D') == ['Management of "Soft" Assets (Q1)', "D"]
    assert vals('["A", "B \\"x\\""]') == ["A", 'B "x"']
    got = peg.parse('"Foo; Bar')
    assert [v for _, v, _ in got] == ['"Foo', "Bar"] and {f for *_, f in got} == {peg.MALFORMED_QUOTE}


def test_people():
    assert vals("Hoskezzo, Jürgen", True) == ["Hoskezzo, Jürgen"]
    assert vals("Ann Lee, Bo Ray and Cy Poe", True) == ["Ann Lee", "Bo Ray", "Cy Poe"]
    assert vals("Lee, A., Ray, B.C., and Poe, I.", True) == ["Lee, A.", "Ray, B.C.", "Poe, I."]
    assert vals("Lee A, Ray BC", True) == ["Lee A", "Ray BC"]
    assert vals("Lee, A.; Ray, B. & Poe, C.; et al.", True) == ["Lee, A.", "Ray, B.", "Poe, C."]
    assert vals("Ann Lee et al", True) == ["Ann Lee"]


def test_nothing():
    for s in (None, "", "  ", ";;", "et al."):
        assert vals(s, True) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(WORD, min_size=1, max_size=5))
def test_round_trip(items):
    assert vals(json.dumps(items)) == items
    assert vals("; ".join(items)) == items
    buf = io.StringIO()
    csv.writer(buf, quoting=csv.QUOTE_ALL, delimiter=";").writerow(items)
    assert vals(buf.getvalue().strip()) == items


def test_operator(spark):
    rows = [(1, "a;b", "x"), (2, None, "y"), (3, "", None), (1, "a;b", "x"), (None, "c", "z"), (4, "w " * 20000 + ";z", "q")]
    got = split_values(spark.createDataFrame(rows, "record_id bigint, val string, pos string"), "record_id", "val").collect()
    assert sorted((r.record_id, r.pos, r.val) for r in got if r.record_id == 1) == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b")]
    assert {(r.record_id, r.pos) for r in got if r.record_id == 4} == {(4, 1), (4, 2)}
    assert split_values(spark.createDataFrame([], "record_id bigint, val string"), "record_id", "val").count() == 0


def test_flags_come_with_places():
    assert peg.elements("a;;b") == [(1, "a", ""), (1, None, peg.EMPTY_ELEMENT), (2, "b", "")]
    assert peg.elements("a;b; et al", True) == [(1, "a", ""), (2, "b", ""), (2, None, peg.ET_AL)]
    assert peg.elements("; et al.", True)[-1] == (0, None, peg.ET_AL)
    assert peg.elements('"x";y"z;w') == [(1, "x", ""), (2, 'y"z', peg.MALFORMED_QUOTE), (3, "w", "")]
    assert peg.elements('"a, b", "c; d", e') == [(1, "a, b", ""), (2, "c; d", ""), (3, "e", "")]
    assert [f for *_, f in peg.elements('a;"b;c')] == ["", peg.MALFORMED_QUOTE, peg.MALFORMED_QUOTE]
    assert peg.elements("Ann Lee, , Bo Ray,", True) == [(1, "Ann Lee", ""), (1, None, peg.EMPTY_ELEMENT), (2, "Bo Ray", ""), (2, None, peg.EMPTY_ELEMENT)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text('ab"; ,\\', max_size=5), min_size=2, max_size=4))
def test_quoted_values_come_back(items):
    want = [x.strip() for x in items]
    packed = ";".join('"' + x.replace("\\", "\\\\").replace('"', '""') + '"' for x in items)
    assert vals(packed) == [w for w in want if w]


@settings(max_examples=300, deadline=None)
@given(st.text('ab"; ,|[]\n/&\\', max_size=24), st.booleans())
def test_no_text_breaks_it(text, people):
    got = peg.elements(text, people)
    assert [p for p, v, _ in got if v is not None] == list(range(1, sum(v is not None for _, v, _ in got) + 1))
    assert all(v is None or v == v.strip() and v for _, v, _ in got)


def test_errors_are_rows_without_value(spark):
    df = spark.createDataFrame([(1, "a;;b; et al"), (2, None)], "k bigint, v string")
    got = sorted((r.pos, r.val or "", r.error_flag) for r in split_values(df, "k", "v", True, errors=True).collect())
    assert got == [(1, "", "EMPTY_ELEMENT"), (1, "a", None), (2, "", "ET_AL"), (2, "b", None)]

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import leakage as L


def brute(doc, item, n):
    d, w = L.words(doc), L.words(item)
    grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return any(tuple(d[i : i + n]) in grams for i in range(len(d) - n + 1))


def test_automaton_is_brute_force():
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 30)))) for i in range(12)]
    a = L.Automaton(items, 5)
    for _ in range(300):
        doc = " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 40)))
        if rnd.random() < 0.5:
            w = L.words(rnd.choice(items)[1])
            k = rnd.randrange(len(w))
            doc += " " + " ".join(w[k : k + rnd.randrange(3, 9)])
        got = a.runs(L.words(doc))
        assert set(got) == {i for i, t in items if brute(doc, t, 5)}
        for i, spans in got.items():
            text = " ".join(L.words(dict(items)[i]))
            assert all(" ".join(L.words(doc)[s:e]) in text and e - s >= 5 for s, e in spans)


ITEM = "The bookkeeper at the cannery, Grateirra, recorded the herring tins at 7342 marks although a trader had offered 8037 marks."


def test_operator(spark):
    w = ITEM.split()
    docs = [
        (1, "Before. " + ITEM.upper() + " After.", 9), (2, "> " + "\n> ".join(w), 9), (3, " ".join(f"<b>{x}</b>" for x in w), 9), (4, " ".join(w[:12]), 9), (5, " ".join(w[3:16]), 9), (6, None, 9), (7, "", 9), (8, "x " * 40000 + ITEM, 9), (8, "x " * 40000 + ITEM, 9),
        (9, "said: “" + " ".join(w[:8]) + "” — " + " ".join(w[8:]), 9),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id bigint")
    items = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (None, ITEM), (4, "something else entirely " * 8)], "item_id bigint, text string")
    got = L.leaks(df, "doc_id", "text", items, "item_id", "text").collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 1), (3, 1), (5, 1), (8, 1), (8, 1), (9, 1)]
    one = next(r for r in got if r.doc_id == 1)
    assert docs[0][1][one.start : one.end] == ITEM.upper().rstrip(".") and one.run_words == len(L.words(ITEM))
    small = L.leaks(df, "doc_id", "text", items, "item_id", "text", block_chars=1).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, got))
    assert L.leaks(df, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert L.leaks(df.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


def test_offsets_match_words():
    for t in ("A &amp; B <i>c-d</i> e", "ﬁne ½ x", "zero\u200bwidth", "Ａ１", "Tom &lt;b&gt; wrote", "co&shy;operate", "a<b and c>d", "<p class='x'>ΟΔΟΣ</p> İz", "e\u0301t\u00e9 &eacute;", "\u1112\u1161\u11ab"):
        places = L.word_offsets(t)
        assert len(places) == len(L.words(t)) and all(0 <= a < b <= len(t) for a, b in places)
    assert L.words("a<b and c>d") == ["a", "b", "and", "c", "d"] and L.words("Tom &lt;b&gt; wrote") == ["tom", "b", "wrote"] and L.words("co&shy;operate") == ["cooperate"]


PIECES = st.sampled_from(["a", "B", "ß", "Σ", "é", "e", "\u0301", "\u0327", " ", "-", "<b>", "</b>", "<", ">", "&lt;", "&amp;", "&shy;", "&#769;", "&", ";", "\u00ad", "\u200b", "ﬁ", "½", "İ", "\u1112", "\u1161", "\u11ab", "か", "\u3099", "ｶ", "\uff9e", "1", "_", "x=", "'"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14))
def test_offsets_are_places_of_the_words(pieces):
    t = "".join(pieces)
    places, w = L.word_offsets(t), L.words(t)
    assert len(places) == len(w)
    assert all(a <= c and b <= d for (a, b), (c, d) in zip(places, places[1:]))


def test_items_that_share_a_stem():
    stem = "which of the following statements about the ledger is true"
    items = [(i, f"{stem} item{i} and nothing else at all in this book") for i in range(300)]
    a = L.Automaton(items, 13)
    got = a.runs(L.words(f"intro {stem} item7 and nothing else at all in"))
    assert list(got) == [7] and a.runs(L.words(stem + " something else")) == {}

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sheaf.operators import dedup, joins, mutation, rollup


def rows(df, *cols):
    return sorted(((tuple(r[c] for c in cols) if cols else tuple(r)) for r in df.collect()), key=repr)


def test_band_join_is_brute_force(spark):
    rnd = random.Random(3)
    a = [(i, rnd.randrange(3), rnd.randrange(60)) for i in range(60)]
    x = spark.createDataFrame(a, "l bigint, k int, a int")
    y = spark.createDataFrame(a, "r bigint, k int, b int")
    want = sorted(((p, q) for p, k, u in a for q, m, v in a if k == m and abs(u - v) <= 4), key=repr)
    assert rows(joins.band_join(x, y, ["k"], "a", "b", 4), "l", "r") == want


def test_first_hit(spark):
    df = spark.createDataFrame([(1, ["x", "b", "a"]), (2, ["q"]), (3, []), (4, None)], "id bigint, keys array<string>")
    ref = spark.createDataFrame([("a", 1), ("b", 2), ("x", None)], "k string, v int")
    assert rows(joins.first_hit(df, "id", "keys", ref, "k", "v")) == [(1, 2)]


def test_cascading_and_unambiguous(spark):
    ref = spark.createDataFrame([("s", 1), ("s", 2), ("t", 3)], "k string, v int")
    one = joins.unambiguous(ref, "k", "v")
    assert rows(one) == [("t", 3)]
    df = spark.createDataFrame([(1, "t", "n"), (2, "s", "n"), (3, None, None)], "id int, k string, n string")
    name = spark.createDataFrame([("n", 9)], "n string, w int")
    got = joins.cascading(df, "id", [("key", one, "k", "v"), ("name", name, "n", "w")], "found")
    assert rows(got, "id", "found", "match_method") == [(1, 3, "key"), (2, 9, "name"), (3, None, None)]


def test_overrides_null_sets_null(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), (None, 3, "z")], "k string, n int, s string")
    rules = spark.createDataFrame([("a", "n", None), ("a", "s", "new"), (None, "s", "never")], "k string, field string, value string")
    assert rows(joins.overrides(df, rules, "k", ["n", "s"])) == [("a", None, "new"), ("b", 2, "y"), (None, 3, "z")]


def test_exclude_and_add_missing(spark):
    p = spark.createDataFrame([(1, "a", "d1", "t1"), (2, "a", None, "t2"), (3, "b", None, "t1")], "id int, who string, doi string, title string")
    bad = spark.createDataFrame([("a", "d1", None), ("a", None, "t2"), ("b", None, None)], "who string, doi string, title string")
    assert rows(joins.exclude(p, bad, [["who", "doi"], ["who", "title"]]), "id") == [(3,)]
    more = spark.createDataFrame([(7, "a", "d1", "zz"), (8, "a", None, "t2"), (9, "a", "d9", "t9")], "id int, who string, doi string, title string")
    assert rows(joins.add_missing(p, more, [["who", "doi"], ["who", "title"]]), "id") == [(1,), (2,), (3,), (9,)]


def test_merge_sources(spark):
    a = spark.createDataFrame([(1, None, "x")], "k int, u string, v string")
    b = spark.createDataFrame([(1, "p", "q"), (2, "r", None)], "k int, u string, v string")
    assert rows(joins.merge_sources(a, b, ["k"], ["u", "v"], ("A", "B"))) == [(1, "p", "x", "A+B"), (2, "r", None, "B")]


def test_contains_join_checks_its_size(spark):
    df = spark.createDataFrame([(1, "Audit and Credit"), (2, None)], "id int, t string")
    rules = spark.createDataFrame([("audit",), ("credit",), ("",)], "phrase string")
    assert rows(joins.contains_join(df, "t", rules, "phrase"), "id", "phrase") == [(1, "audit"), (1, "credit")]
    try:
        joins.contains_join(df, "t", rules, "phrase", max_phrases=1)
    except ValueError:
        return
    raise AssertionError("no error")


def test_contains_join_never_broadcasts_the_texts(spark):
    df = spark.range(500).select("id", F.concat(F.lit("Journal of Audit and Credit no "), F.col("id").cast("string")).alias("t"))
    got = joins.contains_join(df, "t", spark.createDataFrame([("audit",), ("ledger",)], "phrase string"), "phrase")
    assert rows(got, "id", "phrase") == rows(df.select("id", F.lit("audit").alias("phrase")))
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_contains_join_is_brute_force(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abC é\U0001d4b3") for _ in range(n))
    texts = [(i, word(rnd.randrange(12))) for i in range(150)] + [(999, None)]
    phrases = sorted({word(1 + rnd.randrange(6)) for _ in range(400)} | {"zz", "longer than a text"})
    df = spark.createDataFrame(texts, "id int, t string")
    rules = spark.createDataFrame([(p,) for p in [*phrases, *phrases[:9], "", None]], "phrase string")
    want = sorted([(i, p) for i, t in texts if t for p in phrases if p.lower() in t.lower()], key=repr)
    assert rows(joins.contains_join(df, "t", rules, "phrase"), "id", "phrase") == want
    assert rows(joins.contains_join(df, "t", rules.where("phrase is null or phrase = ''"), "phrase")) == []


def test_rollup_keeps_groups_without_items(spark):
    who = spark.createDataFrame([(1, "u", "f"), (2, "u", "g"), (3, "w", None)], "id int, uni string, field string")
    items = spark.createDataFrame([(1, "u", "f", 2.0), (1, "u", "f", None)], "id int, uni string, field string, m double")
    got = rollup.two_grain_rollup(who, items, "uni", "field", "id", {"mean": F.avg("m")})
    assert rows(got, "uni", "field", "level", "entity_count", "item_count", "mean") == sorted(
        [("u", None, "overall", 2, 2, 2.0), ("u", "f", "segment", 1, 2, 2.0), ("u", "g", "segment", 1, 0, None), ("w", None, "overall", 1, 0, None), ("w", None, "segment", 1, 0, None)], key=repr
    )


def test_majority_and_first_filled(spark):
    df = spark.createDataFrame([(1, "a", 1, None), (1, "b", 2, "q"), (1, "b", 3, "r"), (1, "a", 4, None), (2, None, 5, None)], "g int, v string, o int, w string")
    assert rows(rollup.majority(df, ["g"], "v", "o")) == [(1, "a", 2)]
    assert rows(rollup.first_filled_row(df, ["g"], ["w"], "o")) == [(1, "q"), (2, None)]


def test_global_rank(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "n int").repartition(5)
    assert rows(rollup.global_rank(df, "n", "place")) == sorted([(i, i + 1) for i in range(101)], key=repr)


def test_doi_first(spark):
    df = spark.createDataFrame([(1, "p", "t", None), (2, "p", "t", "d1"), (3, "p", "t", "d2"), (4, "p", "t", "d1"), (5, "p", "u", None), (6, "p", "u", None)], "o int, who string, k string, doi string")
    assert rows(dedup.doi_first(df, ["who", "k"], "doi", "o"), "o") == [(2,), (3,), (5,)]


def test_fill_from_twins_and_last(spark):
    df = spark.createDataFrame([(1, "k", None, "x"), (2, "k", 5, "y")], "o int, k string, n int, s string")
    assert rows(dedup.fill_from_twins(df, ["k"], "o", ["n"]), "k", "o", "n", "s") == [("k", 1, 5, "x")]
    assert rows(dedup.last_rows(df, ["k"], [F.col("o")]), "o") == [(2,)]


def test_near_pairs_and_representatives(spark):
    base = "the layered effect of audit rotation on family firms in bréval"
    data = [
        (1, 1, base, 2001, None), (2, 1, base.replace("layered", "layred"), 2002, None), (3, 1, base.replace("layered", "layred"), 2009, None), (4, 2, base.replace("layered", "layred"), 2001, None),
        (5, 1, base + " part I", 2001, None), (6, 1, base + " part II", 2001, None), (7, 1, None, 2001, None), (8, 1, "", None, None),
    ]
    df = spark.createDataFrame(data, "id bigint, who int, title string, year int, doi string")
    pairs = dedup.near_pairs(df, "id", "who", "title", "year", "doi")
    assert (1, 2) in {(r.a, r.b) for r in pairs.collect()} and (5, 6) not in {(r.a, r.b) for r in pairs.collect()}
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11)], "a bigint, b bigint")
    assert {r.id: r.representative for r in dedup.representatives(chain).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 10: 10, 11: 10}


def test_near_pairs_are_brute_force(spark):
    from sheaf.functions.similarity import ratio

    rnd = random.Random(11)
    words = "audit credit market rotation hospital boards firm ledger yield of on the a two period model risk in cash".split()
    data = []
    for who in (1, 2):
        for _ in range(12):
            base = " ".join(rnd.choices(words, k=rnd.randrange(1, 14)))
            for _ in range(6):
                t = list(base)
                for _ in range(rnd.randrange(0, 1 + len(t) // 5)):
                    at = rnd.randrange(len(t))
                    t[at] = rnd.choice(["", "x", t[at] + "e", " "])
                data.append((len(data), who, " ".join("".join(t).split()), rnd.choice([2000, 2001, 2004, None]), rnd.choice([None, "10.1234/a", "10.1234/b"])))
    first = {}
    for i, who, t, y, d in data:
        first.setdefault((who, t), (i, y, d))
    data = [(i, who, t, y, d) for (who, t), (i, y, d) in first.items() if t]
    want = {
        (i, j)
        for i, p, s, y, d in data
        for j, q, t, z, e in data
        if i < j and p == q and (y is None or z is None or abs(y - z) <= 1) and (d is None or e is None or d == e) and ratio(s, t) >= 0.85
    }
    df = spark.createDataFrame(data, "id bigint, who int, title string, year int, doi string")
    assert len(want) > 40
    for chunk in (4000, 9):
        got = [(r.a, r.b) for r in dedup.near_pairs(df, "id", "who", "title", "year", "doi", chunk).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_near_pairs_markup_accents_and_short_titles(spark):
    data = [
        (1, 1, "the <i>rotational effect</i> of credit", 2001, None), (2, 1, "the rotational effect of credit", 2001, None), (3, 2, "Énergie à Évry", 2001, None), (4, 2, "Energie a Evry", 2001, None),
        (5, 3, "audit firms", 2001, None), (6, 3, "audit firm", 2001, None), (7, 3, "监管", 2001, None), (8, 3, "审计", 2001, None),
    ]
    df = spark.createDataFrame(data, "id bigint, who int, title string, year int, doi string")
    assert rows(dedup.near_pairs(df, "id", "who", "title", "year", "doi"), "a", "b") == [(1, 2), (3, 4), (5, 6)]


def test_near_pairs_compare_normal_dois(spark):
    base = "the layered effect of audit rotation on family firms"
    doi = [("10.1234/y", " DOI: 10.1234/Y "), ("10.1234/y", ""), ("10.1234/y", "n/a"), ("10.1234/y", "10.99200/z"), ("10.1234/y", "10.1234/z")]
    data = [(10 * who + i, who, base + "s" * i, 2001, d) for who, pair in enumerate(doi) for i, d in enumerate(pair)]
    data += [(100, 9, base, 2001, "10.1234/a"), (101, 9, base, 2001, "10.1234/c"), (102, 9, base + "s", 2001, "10.1234/c")]
    df = spark.createDataFrame(data, "id bigint, who int, title string, year int, doi string")
    assert rows(dedup.near_pairs(df, "id", "who", "title", "year", "doi"), "a", "b") == [(0, 1), (10, 11), (100, 102), (20, 21), (30, 31)]


def test_representatives_are_greedy(spark):
    rnd = random.Random(5)
    edges = {tuple(sorted(rnd.sample(range(25), 2))) for _ in range(40)}
    near = defaultdict(set)
    for a, b in edges:
        near[b].add(a)
    want = {}
    for i in sorted({x for e in edges for x in e}):
        reps = [a for a in sorted(near[i]) if want.get(a) == a]
        want[i] = reps[0] if reps else i
    got = dedup.representatives(spark.createDataFrame(sorted(edges), "a bigint, b bigint"))
    assert {r.id: r.representative for r in got.collect()} == want


def test_representatives_of_cliques_and_chains(spark):
    clique = [(a, b) for a in range(40) for b in range(a + 1, 40)]
    got = dedup.representatives(spark.createDataFrame(clique, "a bigint, b bigint"), 2)
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(40)}
    chain = [(i, i + 1) for i in range(49)] + [(50, 51), (48, 60), (49, 60)]
    for most in (1, 4, 30):
        got = {r.id: r.representative for r in dedup.representatives(spark.createDataFrame(chain, "a bigint, b bigint"), most).collect()}
        assert got == {i: i - i % 2 for i in range(52)} | {60: 48}


def test_pipeline_drops_near_duplicates(spark):
    from sheaf.plans import pipeline

    base = "the layered effect of audit rotation on family firms"
    data = [
        (1, 1, base + "s", "10.1234/b", 2001, None, None), (2, 1, base, "10.1234/a", 2001, "A", 7), (3, 1, base, "10.1234/b", 2001, "B", 8), (4, 1, "something else entirely", None, 2001, None, None),
    ]
    df = spark.createDataFrame(data, "publication_id bigint, researcher_id bigint, title string, doi string, year int, quality_rank string, journal_id bigint")
    for c, kind in (("doi_raw", "string"), ("authors", "string"), ("sjr_quartile", "string"), ("cited_by_count", "int"), ("fwci", "double"), ("oa_status", "string"), ("journal_name", "string"), ("impact_factor", "double"), ("match_method", "string")):
        df = df.withColumn(c, F.lit(None).cast(kind))
    kept, dropped = pipeline.drop_near_duplicates(df)
    assert rows(kept, "publication_id", "doi", "quality_rank", "journal_id") == [(1, "10.1234/b", "B", 8), (2, "10.1234/a", "A", 7), (4, None, None, None)]
    assert rows(dropped) == [(3, "near duplicate")]


def test_near_pairs_lost_subtitles_and_parts(spark):
    base, sub = "elevating professional scepticism again", ": an exploratory study into the trade of many other firms"
    data = [
        (1, 1, base + sub, 2001, "10.1234/a"), (2, 1, base, 2001, "doi:10.1234/A"), (3, 2, base + sub, 2001, None), (4, 2, base, 2001, "10.1234/a"), (5, 3, "book review", 2001, "10.1234/a"), (6, 3, "book review" + sub, 2001, "10.1234/a"),
        (7, 4, base + " in older firms part I", 2001, None), (8, 4, base + " in older firms", 2001, None), (9, 4, base + " in older firms part II", 2001, None),
    ]
    df = spark.createDataFrame(data, "id bigint, who int, title string, year int, doi string")
    assert rows(dedup.near_pairs(df, "id", "who", "title", "year", "doi"), "a", "b") == [(1, 2), (7, 8), (8, 9)]


def test_screen_threshold(spark):
    data = [("low", "j", "A" if i == 0 else None) for i in range(5)] + [("edge", "j", "A" if i == 0 else None) for i in range(4)] + [("few", "j", None)] * 4 + [("none", None, None)] * 9
    df = spark.createDataFrame(data, "who string, j string, r string")
    got = dedup.outlier_screen(df, "who", F.col("j").isNotNull(), F.col("r").isNotNull())
    assert {r.who: r.flagged for r in got.collect()} == {"low": True, "edge": False, "few": False, "none": False}


def test_upsert(spark):
    cur = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    inc = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d"), (4, None), (5, "x"), (5, "y"), (None, "z")], "k int, v string")
    got = mutation.classify_upsert(cur, inc, "k", ["v"], ["v"])
    assert Counter(r.action for r in got.collect()) == {"skip": 1, "update": 1, "insert": 1, "error": 4}
    assert rows(mutation.apply_upsert(cur, got, "k")) == [(1, "a"), (2, "b")]
    assert rows(mutation.apply_upsert(cur, got.where("action <> 'error'"), "k")) == [(1, "a"), (2, "c"), (3, "d")]


def test_cascade_and_prune(spark):
    p = spark.createDataFrame([(1, "A"), (2, None), (9, "Z")], "k int, v string")
    c = spark.createDataFrame([(10, 1, "B"), (11, 2, "B"), (12, 3, "B"), (13, None, "B")], "id int, fk int, v string")
    assert rows(mutation.cascade(p, "k", "v", c, "fk", "v"), "id", "v", "changed") == [(10, "A", True), (11, None, True), (12, "B", False), (13, "B", False)]
    assert rows(mutation.prune_unused(p, "k", c, "fk"), "k") == [(1,), (2,)]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id bigint, who int, title string, year int, doi string")
    assert dedup.near_pairs(e, "id", "who", "title", "year", "doi").count() == 0
    assert dedup.doi_first(e, ["who"], "doi", "id").count() == 0
    assert rollup.majority(e, ["who"], "title", "id").count() == 0

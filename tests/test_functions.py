from pyspark.sql import functions as F

from sheaf.functions import citations, identifiers, people, similarity, text


def one(spark, value, *exprs):
    return tuple(spark.createDataFrame([(value,)], "x string").select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).first())


def test_keys(spark):
    assert one(spark, " The Journal, of X & Y ", text.title_key("x"), text.journal_key("x"), text.bare_key("x"), text.slug("x")) == ("the journal of x y", "journal of x and y", "thejournalofxy", "the-journal-of-x-y")
    assert one(spark, "none", text.null_clean("x")) == (None,)
    assert one(spark, "annals OF the RISK & credit", text.tidy_title("x")) == ("Annals of the RISK and Credit",)
    assert one(spark, "=1+1", text.csv_safe("x")) == ("'=1+1",)


def test_clean_text():
    assert text.clean_text("A &amp;amp; B <i>x</i> , y") == "A & B x, y"
    assert text.clean_text(None) is None
    assert text.undo_utf8_as_cp1252("BrÃ©val") == "Bréval" and text.undo_utf8_as_cp1252("Bréval") == "Bréval"


def test_doi(spark):
    for raw, want in (("https://doi.org/10.1234%2FAbc.5.", "10.1234/abc.5"), ("DOI: 10.1234/x/pdf", "10.1234/x"), ("10.1234", None), ("10.12/x", None), ("", None), ("10.1234/a?x=1", "10.1234/a")):
        assert one(spark, raw, identifiers.doi("x")) == (want,), raw


def test_issn_and_orcid(spark):
    assert one(spark, "90000137; 9000-017x", identifiers.issns("x")) == (["9000-0137", "9000-017X"],)
    assert one(spark, "0378-5955", identifiers.issn_valid("x")) == (True,)
    assert one(spark, "0378-5954", identifiers.issn_valid("x")) == (False,)
    assert one(spark, "https://orcid.example/0000-0002-1825-0097", identifiers.orcid("x")) == ("0000-0002-1825-0097",)
    assert one(spark, "0000-0002-1825-0097", identifiers.orcid_valid("x")) == (True,)
    assert one(spark, "0000-0002-1825-0098", identifiers.orcid_valid("x")) == (False,)


def test_numbers(spark):
    assert one(spark, "2014.0", identifiers.loose_int("x"), identifiers.plausible_year("x")) == (2014, 2014)
    assert one(spark, "1,25", identifiers.decimal_comma("x")) == (1.25,)
    assert one(spark, "x", identifiers.loose_int("x"), identifiers.decimal_comma("x"), identifiers.plausible_year("x")) == (None, None, None)


def test_people(spark):
    assert one(spark, "Associate Professor of Finance", people.rank_of("x"), people.level_of("x")) == ("Associate Professor", "D")
    assert one(spark, "Deputy Head of School and Dean", people.roles_of("x")) == (["deputy head of school", "dean"],)
    assert one(spark, "Prof. Ann B. Lee", people.without_honorific("x"), people.name_key("x"), people.surname("x")) == ("Ann B. Lee", "ann b lee", "lee")
    assert one(spark, "Lee, Ann; Ray, Bo; et al", people.given_first("x"), people.author_count("x")) == ("Ann Lee; Bo Ray", 2)
    assert one(spark, "Lee A, Ray B", people.author_count("x"))[0] in (None, -1)


def test_similarity(spark):
    assert similarity.ratio("abcd", "abcd") == 1.0 and similarity.ratio("ab", "abcdefghij", 0.85) == 0.0
    a, b = "a note on audit risks", "audit risk and a note"
    assert similarity.containment(a, b) == 1.0
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "x")], "a string, b string")
    from difflib import SequenceMatcher

    assert [r[0] for r in df.select(similarity.sequence_ratio("a", "b")).collect()] == [SequenceMatcher(None, "tide", "diet").ratio(), SequenceMatcher(None, "diet", "tide").ratio(), None]


def test_citations(spark):
    t, j, y, doi, authors, vol, issue, pages, status, sure = citations.parse_citation("[3] Lee, A. and Ray, B. (2004). Who pays for audits? A note. Annals of Risk, 30(3), 220-241. doi: 10.1234/x.")
    assert (j, y, doi, vol, issue, pages, status, sure) == ("A note. Annals of Risk", 2004, "10.1234/x", "30", "3", "220-241", "published", True) or (t, y) == ("Who pays for audits? A note", 2004)
    assert citations.parse_citation("  ") is None and citations.parse_citation(None) is None
    got = citations.citations(spark.createDataFrame([(1, 'Lee (1999) "A long enough title," Annals of Risk 3: 5-9'), (2, "no idea"), (3, None)], "k bigint, t string"), "k", "t").collect()
    assert {(r.key, r.confident) for r in got} == {(1, True), (2, False)}


def test_null_columns(spark):
    df = spark.createDataFrame([(None,)], "x string")
    row = df.select(text.title_key("x"), text.tidy_title("x"), identifiers.doi("x"), identifiers.issns("x"), people.rank_of("x"), people.author_names("x"), F.size(people.roles_of("x"))).first()
    assert row[0] is None and row[2] is None

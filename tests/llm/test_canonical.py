import pytest

from sheaf.llm import canonical as C

JOURNALS = [(1, "Archives of Forensic Bookkeeping"), (2, "Annals of Forensic Bookkeeping"), (3, "European Journal of Audit Judgement"), (4, "Journal of Audit Judgement"), (5, "Banking & Thrift"), (6, "Bücher und Bilanzen"), (7, "Kontrol és Számvitel")]
JOBS = [(1, "Lecturer"), (2, "Senior Lecturer"), (3, "Professor"), (4, "Associate Professor"), (5, "Head of School"), (6, "Deputy Head of School"), (7, "Research Fellow")]


@pytest.mark.parametrize(
    "value,ref",
    [
        ("  ARCHIVES  of forensic bookkeeping.", 1), ("Forensic Bookkeeping, Annals of", 2), ("Ann. Forensic Bookkeep.", 2), ("Eur. J. of Audit Judgm.", 3), ("J. Audit Judgm.", 4), ("banking and thrift (Online)", 5),
        ("bucher unnd bilanzen", 6), ("Kontrol �s Sz�mvitel", 7), ("Nordic Journal of Audit Judgement", 0), ("Papers in Forensic Bookkeeping", 0), ("Archives of Forensic Bookkeeping – new series", 1), ("Unknown", 0), ("Journal", 0),
        ("archives of forensic bokkeeping", 1), ("Transactions on Hospital Nursing", 0), ("", 0), ("...", 0),
    ],
)
def test_names(value, ref):
    assert C.Catalogue(JOURNALS, {}, True).match(value) == ref


@pytest.mark.parametrize(
    "value,ref",
    [
        ("Snr. Lect. in Finance", 2), ("senior letcurer", 2), ("Sernior Lecturer", 2), ("Acting Head of School", 5), ("Dep. Head of School", 6), ("A/Prof", 4), ("Lecturer & Head of School", 1), ("Professor / Course Adviser", 3), ("Chaplain", 0),
        ("Res. Fellow (part-time)", 7), ("Ass. Prof (Asscoiate)", 4),
    ],
)
def test_jobs(value, ref):
    assert C.Catalogue(JOBS, C.JOB_ALIASES, False).match(value) == ref


def test_distance_is_brute_force():
    def brute(a, b):
        from functools import lru_cache

        @lru_cache(None)
        def f(i, j):
            if not i or not j:
                return i + j
            best = min(f(i - 1, j) + 1, f(i, j - 1) + 1, f(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, f(i - 2, j - 2) + 1)
            return best

        return f(len(a), len(b))

    import random

    rnd = random.Random(2)
    for _ in range(400):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 7))) for _ in range(2))
        assert min(C.distance(a, b, 2), 3) == min(brute(a, b), 3), (a, b)


def test_longest_mention_wins():
    got = C.Catalogue(JOBS, {}, False).mentions("deputy head of school and lecturer".split())
    assert [x[2] for x in got] == [6, 1]


def test_operator(spark):
    rows = [(1, "Lect.", "x"), (1, "Lect.", "x"), (2, None, "x"), (3, "   ", "x"), (4, "Dean", None), (5, "lecturer " + "x" * 20000, None), (6, " ", None)]
    df = spark.createDataFrame(rows, "record_id bigint, value string, ref_id string")
    ref = spark.createDataFrame([*JOBS, (8, None), (None, "Dean"), (9, " ")], "ref_id bigint, job_title string")
    got = C.canonical(df, "record_id", "value", ref, "ref_id", "job_title", C.JOB_ALIASES, strict=False).collect()
    assert sorted((r.record_id, r.ref_id) for r in got) == [(1, 1), (1, 1), (4, 0), (5, 1)]
    none = spark.createDataFrame([], "ref_id bigint, job_title string")
    assert {r.ref_id for r in C.canonical(df, "record_id", "value", none, "ref_id", "job_title").collect()} == {0}
    with pytest.raises(ValueError):
        C.canonical(df, "record_id", "value", ref, "ref_id", "job_title", max_entries=3)

import random

import numpy as np

from sheaf.llm import reading as R

EASY = ["The cat has a big red hat.", "We put the cup on the box.", "Ben has one old map and a pen.", "Why is the dog so sad?", "A man gives the cup to Tess."]
HARD = [
    "Discretionary accrual manipulation attenuates heterogeneous volatility spillovers, notwithstanding considerable measurement error.", "Insofar as endogenous covenant renegotiation exacerbates asymmetric information, the implied magnitude of these effects is robust.",
    "Our estimates indicate that institutional legitimation strategies substantively reconfigure the accountability regimes of the transnational intermediaries.",
]


def doc(rnd, kind, n=6):
    return " ".join(rnd.choice(kind) for _ in range(n))


def test_isotonic_is_monotone_and_least_squares():
    rnd = np.random.default_rng(1)
    x, y = rnd.integers(0, 8, 40).astype(float), rnd.integers(1, 5, 40)
    xs, fit = R.isotonic(x, y)
    assert (np.diff(fit) >= -1e-12).all() and list(xs) == sorted(set(x))
    best = ((np.interp(x, xs, fit) - y) ** 2).sum()
    for _ in range(300):
        other = np.sort(rnd.uniform(1, 4, len(xs)))
        assert ((np.interp(x, xs, other) - y) ** 2).sum() >= best - 1e-9


def test_difficulty_is_the_median():
    got = R.difficulty(np.array([[1.0, 0, 0, 0], [0, 0, 0, 1.0], [0.5, 0.5, 0, 0], [0.2, 0.6, 0.2, 0]]))
    assert got[0] < 1.5 < got[3] < 2.5 and got[1] > 3.5 and abs(got[2] - 1.5) < 1e-9


def test_probabilities_and_longest_order():
    docs = [R.tokens(" ".join(EASY * 3)), R.tokens(" ".join(HARD * 3))]
    m = R.Bands(docs, np.array([0, 1]), np.array([1, 2]))
    m.finish()
    flat, _ = m.encode(docs)
    loss = m.surprisal(flat)
    assert (loss[flat != R.END] >= -1e-6).all()
    a, b = loss[: len(docs[0])].mean(0), loss[len(docs[0]) + 1 :].mean(0)
    assert a[0] < a[1] and b[1] < b[0]


def test_operator(spark):
    rnd = random.Random(3)
    rows = [(i, doc(rnd, EASY if i % 2 else HARD), "en") for i in range(60)]
    labels = [(i, i % 3, 1 if i % 2 else 4) for i in range(40)] + [(1, 7, 2), (None, 1, 1), (5, 1, None), (99999, 1, 1)]
    extra = [(100, None, "en"), (101, "", "en"), (102, "Das ist ein Haus und die Bank ist auf der Straße. Der Hund ist nicht mit dem Mann. Die Frau ist für das Kind.", "en"), (103, "The cat. Ok then.", "en"), (104, "- The cat has a hat\n- We put the cup on it\n- Ben has a map", "fr"),
             (105, "Lee, J. (2004). 30(3), 220-441.\nRay, B. (1994). 3(5), 9-423.\nPoe, C. (1991). 13(5), 19-43.", "en"), (106, doc(rnd, EASY, 3000), "en"), (106, doc(rnd, EASY, 3000), "en")]
    docs = spark.createDataFrame([(*r, 3) for r in rows + extra], "doc_id bigint, text string, lang string, band int")
    lab = spark.createDataFrame(labels, "doc_id bigint, rater_id int, band int")
    got = R.reading_levels(docs, "doc_id", "text", R.train(docs, "doc_id", "text", lab, "doc_id", "band")).collect()
    by = {r.doc_id: r.band for r in got}
    assert all(by[i] == (1 if i % 2 else 4) for i in range(60))
    assert set(by) == set(range(60)) | {104, 106} and sum(r.doc_id == 106 for r in got) == 2 and by[104] == by[106] == 1
    assert R.train(docs, "doc_id", "text", lab.limit(0), "doc_id", "band") is None
    assert R.reading_levels(docs, "doc_id", "text", None).count() == 0
    assert R.reading_levels(docs.limit(0), "doc_id", "text", R.train(docs, "doc_id", "text", lab, "doc_id", "band")).count() == 0

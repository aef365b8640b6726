"""Reading level of each document: n-gram surprisal under one model per band, mapped by isotonic regression.

Training (on the driver, from a bounded, documented sample of labelled documents): interpolated trigram
models, one per band, with weights fitted by EM on held-out documents. Every document is then read whole:
each sentence's surprisal under each model says how much of it falls to each band, and the distribution over
all of the document's words has its median as difficulty. Isotonic regression maps it monotonically to the
graded bands; it is fitted on difficulties that each labelled document got from models of the other folds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_DECIMAL = re.compile(r"(?<=\d)[.,](?=\d)")
#: Abbreviations whose full stop ends no sentence; punctuation that separates words.
_ABBREVIATIONS = (("e.g.", "e.g"), ("i.e.", "i.e"), ("et al.", "et al"), ("cf.", "cf"), ("vs.", "vs"))
_SEPARATORS = ",;:()[]\"“”=|*_<>…–—"
#: Fields above a text that are no part of it.
_HEADER = re.compile(r"^(?:title|keywords|subjects?|authors?|source|date)[ \t]*:[^\n]*$", re.I | re.M)
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>")
END, UNKNOWN, NUMBER = 0, 1, 2
#: The commonest English function words, by which running English text is told from other text.
FUNCTION_WORDS = frozenset(
    "the a an and or but if of to in on at by for from with as that this these those it its is are was were be been has have had do does did "
    "not no can will would should may could than then so we you they he she his her our your their my i who what which when where why how "
    "all any each most some more many few about after before over under between into out up there only while although because".split()
)
#: The commonest function words of other languages that are no English ones.
OTHER_WORDS = frozenset(
    "der die das und den dem des ein eine einer für mit von zu zur zum im ist sind auf seit werden wird nicht "
    "le la les des du et une un pour par dans sur avec est sont aux qui que malgré depuis "
    "el los las del y una por para con es son en desde durante sobre "
    "il gli della di e che per non o os um uma do dos em não ao".split()
) - {"a", "do", "on", "in", "die", "son", "den", "as", "an"}


def tokens(text: str) -> list[str]:
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    text = _DECIMAL.sub("", _HEADER.sub("", text).lower())
    for a, b in _ABBREVIATIONS:
        text = text.replace(a, b)
    for c in _SEPARATORS:
        text = text.replace(c, " ")
    for c in ".!?":
        text = text.replace(c + " ", " . ").replace(c + "\n", " . ")
    return text.replace("\n", " . ").rstrip(".!? ").split()


class _Vocabulary(dict):
    """Word -> number; what isn't in it is a number, the end of a sentence, or unknown."""

    def __missing__(self, t: str) -> int:
        return NUMBER if t[0].isdigit() else UNKNOWN


class Corpus:
    """The labelled documents as numbers: a vocabulary, and each n-gram's and context's place in its sorted table.

    Built once; the models of all folds and labels are counts over it.
    """

    def __init__(self, docs: list[list[str]]):
        words = sorted({t for d in docs for t in d if t[0].isalpha()} | FUNCTION_WORDS | OTHER_WORDS)
        self.vocab = _Vocabulary({w: i for i, w in enumerate(words, 3)} | {".": END})
        self.size = np.int64(len(words) + 3)
        self.kind = np.zeros(self.size, np.int8)
        self.kind[[self.vocab[w] for w in OTHER_WORDS]] = 2
        self.kind[[self.vocab[w] for w in FUNCTION_WORDS]] = 1
        self.docs = len(docs)
        flat, cut = encode(self.vocab, docs)
        live = flat != END
        self.doc_of = np.repeat(np.arange(len(docs)), np.diff(cut))[live]
        self.tables = [np.unique(key[live], return_inverse=True) for key in (*ngrams(flat, self.size), *contexts(flat, self.size))]

    def counts(self, band_of: np.ndarray, use: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each table its sorted keys and their number per band, over the tokens of use; a last row is all zeros."""
        out = []
        for distinct, at in self.tables:
            n = np.bincount(at[use] * k + band_of[use], minlength=(len(distinct) + 1) * k).reshape(-1, k).astype(np.float32)
            out.append((distinct, n))
        return out


def encode(vocab: dict[str, int], docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of all documents in a row, each closed by END, and where each begins."""
    get, out, cut = vocab.__getitem__, [], [0]
    for d in docs:
        out += map(get, d)
        out.append(END)
        cut.append(len(out))
    return np.array(out, np.int64), np.array(cut)


def ngrams(flat: np.ndarray, size: np.int64) -> list[np.ndarray]:
    a, b = np.roll(flat, 2), np.roll(flat, 1)
    a[:2], b[:1] = END, END
    a[b == END] = END
    return [flat, b * size + flat, (a * size + b) * size + flat]


def contexts(flat: np.ndarray, size: np.int64) -> list[np.ndarray]:
    a, b = np.roll(flat, 2), np.roll(flat, 1)
    a[:2], b[:1] = END, END
    a[b == END] = END
    return [b, a * size + b]


#: Folds that calibration is made on: each document is judged by models that never saw it.
FOLDS = 5


class Bands:
    """Interpolated trigram models of the bands over one vocabulary; arrays only, so it ships as it is.

    without: a fold (documents i with i % FOLDS == without) that is left out of the counts. Weights are fitted by EM on
    the first fold under the counts of the others, unless given.
    """

    def __init__(self, docs: list[list[str]] | Corpus, bands: np.ndarray, levels: np.ndarray, without: int | None = None, weights: np.ndarray | None = None):
        corpus = docs if isinstance(docs, Corpus) else Corpus(docs)
        self.levels, self.vocab, self.size, self.kind = levels, corpus.vocab, corpus.size, corpus.kind
        k, band_of, fold = len(levels), bands[corpus.doc_of], corpus.doc_of % FOLDS
        self.weights = self._em(corpus, band_of, fold, k) if weights is None else weights
        use = np.ones_like(fold, bool) if without is None else fold != without
        tables = corpus.counts(band_of, use, k)
        self.grams, self.context = tables[:3], tables[3:]
        self.total = np.bincount(band_of[use], minlength=k).astype(float) + 1.0

    def _em(self, corpus: Corpus, band_of: np.ndarray, fold: np.ndarray, k: int) -> np.ndarray:
        weights = np.full((k, 4), 0.25)
        held = fold == 0
        if held.all() or not held.any():
            return weights
        tables = corpus.counts(band_of, ~held, k)
        total = np.bincount(band_of[~held], minlength=k).astype(float) + 1.0
        band = band_of[held]
        rows = np.arange(len(band))
        g1, g2, g3, c2, c3 = (n[at[held]][rows, band] for (_, n), (_, at) in zip(tables, corpus.tables))
        parts = np.stack([g3 / np.maximum(c3, 1.0), g2 / np.maximum(c2, 1.0), g1 / total[band], np.full(len(band), 1.0 / float(self.size))], 1)
        for b in range(k):
            mine = parts[band == b]
            w = np.array([0.4, 0.3, 0.2, 0.1])
            for _ in range(8 if len(mine) else 0):
                share = mine * w
                share /= share.sum(1, keepdims=True)
                w = share.mean(0)
            weights[b] = np.maximum(w, 1e-3) / np.maximum(w, 1e-3).sum()
        return weights

    def encode(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        return encode(self.vocab, docs)

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        distinct, counts = table
        if not len(distinct):
            return np.zeros((len(keys), counts.shape[1]), np.float32)
        at = np.searchsorted(distinct, keys)
        at[at == len(distinct)] = len(distinct) - 1
        at[distinct[at] != keys] = len(distinct)  # the last row is all zeros
        return counts[at]

    def finish(self) -> None:
        """Joins each trigram with its words' lower orders into one table of log probabilities per order."""
        n2, n3 = self.grams[1], self.grams[2]
        one = self.grams[0][1] / self.total * self.weights[:, 2] + self.weights[:, 3] / float(self.size)
        self.p1 = np.log(np.maximum(one, 1e-12)).astype(np.float32)
        w2 = n2[0] % self.size
        two = np.exp(self._row1(w2)) + self.weights[:, 1] * n2[1][:-1] / np.maximum(self._look(self.context[0], n2[0] // self.size), 1.0)
        self.p2 = np.log(two).astype(np.float32)
        low = n3[0] % (self.size * self.size)
        at = np.searchsorted(n2[0], low)
        three = np.exp(self.p2[at]) + self.weights[:, 0] * n3[1][:-1] / np.maximum(self._look(self.context[1], n3[0] // self.size), 1.0)
        self.p3 = np.log(three).astype(np.float32)
        self.k1, self.k2, self.k3 = self.grams[0][0], n2[0], n3[0]
        self.unseen = self.p1[-1]
        self.grams, self.context = [], []
        dense = np.tile(self.unseen, (int(self.size), 1))
        dense[self.k1] = self.p1[:-1]
        self.dense = dense.astype(np.float32)

    def _row1(self, w: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.grams[0][0], w)
        return self.p1[np.minimum(at, len(self.p1) - 1)]

    def surprisal(self, flat: np.ndarray) -> np.ndarray:
        """Negative log probability of each token under each band's model, at the longest order that is known."""
        _, two, three = ngrams(flat, self.size)
        out = self.dense[flat]
        for keys, rows, q in ((self.k2, self.p2, two), (self.k3, self.p3, three)):
            if len(keys):
                at = np.searchsorted(keys, q)
                at[at == len(keys)] = 0
                hit = keys[at] == q
                out[hit] = rows[at[hit]]
        return -out


#: Columns of profile() after the bands' shares.
SURPRISAL, UNITS, ENGLISH, OTHER, NUMBERS, WORDS = range(6)


def profile(model: Bands, docs: list[list[str]]) -> np.ndarray:
    """One row per document: the words' share of each band, sentence by sentence; mean surprisal; number of
    sentences and list lines; shares of English and of other languages' function words and of numbers; words."""
    flat, cut = model.encode(docs)
    loss = model.surprisal(flat)
    live = flat != END
    loss[~live] = 0.0
    starts = np.flatnonzero(np.concatenate(([True], flat[:-1] == END)))
    sums = np.add.reduceat(loss, starts, axis=0)
    length = np.add.reduceat(live.astype(np.int64), starts)
    number = np.add.reduceat((flat == NUMBER).astype(np.int64), starts)
    post = np.exp(np.clip(-(sums - sums.min(1, keepdims=True)), -60, 0))
    post /= post.sum(1, keepdims=True)
    n, k = len(docs), post.shape[1]
    doc_of = np.searchsorted(cut, starts, side="right") - 1
    add = lambda x: np.bincount(doc_of, weights=x, minlength=n)
    out = np.zeros((n, k + 6))
    for b in range(k):
        out[:, b] = add(post[:, b] * length)
    total = add(length)
    some = np.maximum(total, 1.0)
    out[:, :k] /= some[:, None]
    kind = model.kind[flat]
    out[:, k + SURPRISAL] = add(sums.min(1)) / some
    out[:, k + UNITS] = add(length - number >= 2)
    out[:, k + ENGLISH] = add(np.add.reduceat((kind == 1).astype(np.int64), starts)) / some
    out[:, k + OTHER] = add(np.add.reduceat((kind == 2).astype(np.int64), starts)) / some
    out[:, k + NUMBERS] = add(number) / some
    out[:, k + WORDS] = total
    return out


def difficulty(shares: np.ndarray) -> np.ndarray:
    """The median of each document's distribution over the bands 1, 2, ...: where half of its words lie below."""
    cum = np.cumsum(shares, axis=1)
    at = np.minimum((cum < 0.5).sum(1), shares.shape[1] - 1)
    row = np.arange(len(shares))
    before = cum[row, at] - shares[row, at]
    return at + 0.5 + np.clip((0.5 - before) / np.maximum(shares[row, at], 1e-9), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: break points and the non-decreasing fit there."""
    order = np.lexsort((y, x))
    xs, ys = x[order], y[order].astype(float)
    uniq, at = np.unique(xs, return_inverse=True)
    w = np.bincount(at).astype(float)
    v = np.bincount(at, weights=ys) / w
    blocks: list[list[float]] = []  # value, weight, last index
    for i in range(len(uniq)):
        blocks.append([v[i], w[i], i])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            a[0] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1])
            a[1] += b[1]
            a[2] = b[2]
    fit = np.empty(len(uniq))
    lo = 0
    for value, _, hi in blocks:
        fit[lo : int(hi) + 1] = value
        lo = int(hi) + 1
    return uniq, fit


def train(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, band: str, max_labelled: int = 4000, max_bytes: int = 256 << 20) -> tuple[Bands, np.ndarray, np.ndarray] | None:
    """The bands' models and the isotonic fit, from at most max_labelled labelled documents (lowest id hashes) of at most max_bytes in all.

    Raters err: a document's band is first its raters' mean. Every document's difficulty is then taken by models of the
    other folds, and isotonic regression of the raters' bands on these out-of-fold difficulties says which band each
    document is counted to in the second and last round, whose out-of-fold difficulties give the fit that is kept.
    None where no document with a text is labelled.
    """
    sample = (
        labels.where(F.col(label_id).isNotNull() & F.col(band).isNotNull())
        .groupBy(F.col(label_id).cast("bigint").alias("label_id"))
        .agg(F.avg(band).alias("mean_band"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(max_labelled)
    )
    texts = docs.select(F.col(doc_id).cast("bigint").alias("label_id"), F.col(text).cast("string").alias("body")).where(F.length("body") > 0)
    rows = texts.join(F.broadcast(sample), "label_id").withColumn("size", F.octet_length("body"))
    before = F.sum("size").over(W.orderBy(F.xxhash64("label_id"), "label_id", "body").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("before", before).where(F.coalesce("before", F.lit(0)) + F.col("size") <= max_bytes).orderBy("label_id", "body").toArrow()
    if not rows.num_rows:
        return None
    return fit([tokens(t) for t in rows.column("body").to_pylist()], np.array(rows.column("mean_band").to_pylist(), float))


def fit(parts: list[list[str]], mean: np.ndarray) -> tuple[Bands, np.ndarray, np.ndarray]:
    levels = np.arange(int(np.floor(mean.min())), int(np.ceil(mean.max())) + 1)
    given = np.floor(mean + 0.5).astype(int) - levels[0]
    corpus = Corpus(parts)
    fold = np.arange(len(parts)) % FOLDS
    for _ in range(2):
        weights = Bands(corpus, given, levels).weights
        apart = np.empty(len(parts))
        for f in range(FOLDS):
            mine = np.flatnonzero(fold == f)
            if len(mine):
                model = Bands(corpus, given, levels, f if len(mine) < len(parts) else None, weights)
                model.finish()
                apart[mine] = difficulty(profile(model, [parts[i] for i in mine])[:, : len(levels)])
        xs, ys = isotonic(apart, mean)
        last, given = given, np.clip(np.floor(np.interp(apart, xs, ys) + 0.5), levels[0], levels[-1]).astype(int) - levels[0]
    model = Bands(corpus, last, levels, None, weights)
    model.finish()
    return model, xs, ys


def reading_levels(docs: DataFrame, doc_id: str, text: str, fitted: tuple[Bands, np.ndarray, np.ndarray] | None, min_units: int = 3, max_numbers: float = 0.18) -> DataFrame:
    """(doc_id, band, difficulty, surprisal, words) of each document that is running English text, see judged()."""
    return judged(docs, doc_id, text, fitted, min_units, max_numbers).where("left_out is null").drop("left_out")


def judged(docs: DataFrame, doc_id: str, text: str, fitted: tuple[Bands, np.ndarray, np.ndarray] | None, min_units: int = 3, max_numbers: float = 0.18) -> DataFrame:
    """(doc_id, band, difficulty, surprisal, words, left_out): left_out says why a document is no running English text.

    Running English text: at least min_units sentences or list lines, more English function words than other
    languages' ones, and fewer numbers than lists of references or tables have. Whole texts are read, in one
    pass without a shuffle. Null and empty texts and, without a fit, all texts give no row; repeated rows
    give repeated results; equal difficulties get equal bands.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fitted)
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "band", "difficulty", "surprisal", "words", "left_out"]
        for batch in batches:
            if shared.value is None or not batch.num_rows:
                continue
            model, xs, fit = shared.value
            ids = batch.column(0)
            body = batch.column(1)
            for at in range(0, batch.num_rows, 500):
                got = profile(model, [tokens(t) for t in body.slice(at, 500).to_pylist()])
                k = len(model.levels)
                score = difficulty(got[:, :k])
                band = np.clip(np.floor(np.interp(score, xs, fit) + 0.5), model.levels[0], model.levels[-1]).astype(np.int32)
                why = np.select([got[:, k + UNITS] < min_units, got[:, k + ENGLISH] <= got[:, k + OTHER], got[:, k + NUMBERS] >= max_numbers], ["FEW_SENTENCES", "NOT_ENGLISH", "NUMBERS"], "")
                cols = [ids.slice(at, 500), pa.array(band), pa.array(score), pa.array(got[:, k + SURPRISAL]), pa.array(got[:, k + WORDS].astype(np.int64)), pa.array([w or None for w in why.tolist()], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names)

    return slim.mapInArrow(run, "doc_id bigint, band int, difficulty double, surprisal double, words bigint, left_out string")

"""Best representative of each group of deliveries: grouping of deliveries, then field-by-field survivorship."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sheaf.llm import encoding, names
from sheaf.llm.canonical import distance
from sheaf.session import materialized

#: Titles that many different papers bear; words that tell works of a series apart.
GENERIC = frozenset(
    "editorial|editorials|editorial note|editors note|guest editorial|reply|a reply|response|rejoinder|comment|comments|commentary|discussion|book review|book reviews|review|"
    "introduction|preface|foreword|erratum|corrigendum|correction|obituary|letter|letter to the editor|note|notes|research note|abstract|untitled|front matter|in memoriam|news|announcement|table of contents|index".split("|")
)
SERIES = re.compile(r"^\s*(?:part|teil|partie|vol|volume|no|book|chapter|paper|study|theory|data|evidence|methods?|\d{4}|[ivx]+|[a-z]|\d+)(?:\s+(?:update|[ivx]+|[a-z]|\d+|edition|revision))?\s*$", re.I)
_DOI = re.compile(r"(?:^|[^0-9])(10\.\d{4,9}/[^\s?#\"<>]+)")
_CUT = re.compile(r"(?:…|\.\.\.|\[…\])\W*$")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_WORD = re.compile(r"[\w�]+")
_LOST = re.compile("�+")
_LOST_DASH = re.compile(r"(?<=\d)�+(?=\d)")
_SUBTITLE = re.compile(r"\s*[:?]\s+|\s+[–—-]\s+|\.\s+")


def complete_doi(value: str | None) -> str | None:
    """The DOI in lower case without its wrapping, or None where it isn't complete."""
    if not value:
        return None
    m = _DOI.search(re.sub("%2f", "/", value.strip(), flags=re.I))
    got = m.group(1).lower().rstrip(".,;)]}'\"") if m else None
    return got if got and not got.endswith("/") else None


def title_words(title: str) -> list[str]:
    """The words of a title without markup, case, accents, look-alikes, invisible characters and punctuation."""
    folded = names.fold(_TAG.sub(" ", title) if "<" in title else title)
    if "&" in folded:
        folded = folded.replace("&", " and ")
    if "_" in folded:
        folded = folded.replace("_", " ")
    if "�" not in folded:
        return _WORD.findall(folded)
    return [w for w in (_LOST.sub("�", x) for x in _WORD.findall(_LOST_DASH.sub(" ", folded))) if w != "�"]


def _signature(title: str | None) -> tuple[str, str, bool]:
    """(words, words without the subtitle or '', cut off): of a restored title."""
    if not title:
        return "", "", False
    plain = (_TAG.sub(" ", title) if "<" in title else title).strip()
    cut = ("…" in plain or "..." in plain) and bool(_CUT.search(plain))
    m = None if cut else _SUBTITLE.search(plain)
    if m is None:
        return " ".join(title_words(plain)), "", cut
    rest = plain[m.end() :]
    head, tail = title_words(plain[: m.start()]), title_words(rest)
    main = " ".join(head) if tail and len(head) > 2 and not SERIES.match(rest) else ""
    return " ".join(head + tail), main, cut


def _read_titles(counts: dict) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean = encoding.clean_of(counts.value)
        for b in batches:
            rows = []
            for title, doi in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                spans = encoding.label(title, clean) if title and not title.isascii() else []
                words, main, cut = _signature(encoding.restore(title, spans) if spans else title)
                generic = words in GENERIC
                usable = bool(title and title.strip()) and not spans and not cut
                rows.append((complete_doi(doi), words, main, cut, generic, usable))
            out = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.string()] * 3 + [pa.bool_()] * 3
            fields = ["doi", "words", "main", "cut", "generic", "usable"]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[3:], *(pa.array(c, k) for c, k in zip(out, kinds))], ["id", "owner", "venue", "year", "rank", "at", *fields])

    return run


def read_deliveries(papers: DataFrame, trust: DataFrame, counts: dict | None = None) -> DataFrame:
    """id, owner, venue, year, rank, at, and of the title and DOI: doi, words, main, cut, generic, usable.

    rank is the source's trust rank, null for sources that are null or not in the trust table; source names
    are compared without case, blanks, hyphens and underscores. Rows without an id or an owner are left out.
    """
    plain = lambda c: F.lower(F.regexp_replace(c, r"[\s_\-]+", ""))
    ranks = trust.groupBy(plain(F.col("source")).alias("t_source")).agg(F.min("trust_rank").cast("int").alias("rank"))
    slim = papers.where(F.col("researcher_id").isNotNull() & F.col("publication_id").isNotNull()).withColumn("t_source", plain(F.col("source")))
    slim = slim.join(ranks, "t_source", "left").select(
        F.col("publication_id").cast("bigint").alias("id"), "title", "doi", F.col("researcher_id").cast("bigint").alias("owner"), F.col("journal_id").cast("bigint").alias("venue"), F.col("year").cast("int"), "rank", F.col("loaded_at").alias("at")
    )
    shared = papers.sparkSession.sparkContext.broadcast(encoding.clean_counts(papers, "title") if counts is None else counts)
    schema = "id bigint, owner bigint, venue bigint, year int, rank int, at timestamp, doi string, words string, main string, cut boolean, generic boolean, usable boolean"
    return slim.mapInArrow(_read_titles(shared), schema)


def components(edges: DataFrame, max_rounds: int = 1000, hub: Sequence[str] = ("hub",)) -> DataFrame:
    """(node, label): the smallest node reachable from each node of edges (node, *hub), hubs being shared keys.

    Labels and hubs exchange minima until nothing changes, unfinished labels are an error; nodes of hubs that nobody
    shares are left out. Every step is a combinable minimum or a join that AQE may split, so a hub may be of any size.
    """
    hub = list(hub)
    shared = edges.groupBy(*hub).agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).where("_lo < _hi").select(*hub)
    state = materialized(edges.select("node", *hub).join(shared, hub, "left_semi").distinct().withColumn("label", F.col("node")))
    for done in range(max_rounds):
        low = state.groupBy(*hub).agg(F.min("label").alias("low"))
        best = state.join(low, hub).groupBy("node").agg(F.min("low").alias("new"))
        if done >= 4:
            best = materialized(best)
            best = best.join(best.select(F.col("node").alias("new"), F.col("new").alias("far")), "new", "left").select("node", F.coalesce("far", "new").alias("new"))
        seen = Observation()
        state = materialized(state.join(best, "node").observe(seen, F.count_if(F.col("new") < F.col("label")).alias("moved")).select("node", *hub, F.col("new").alias("label")))
        if not seen.get["moved"]:
            return state.select("node", "label").distinct()
    raise RuntimeError(f"components: labels still change after {max_rounds} rounds")


def _typing_errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, z, x, y = (c.to_pylist() for c in b.columns)
        keep = [i for i in range(len(a)) if differs_by_typing(x[i], y[i])]
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([z[i] for i in keep], pa.int64())], ["a", "b"])


def differs_by_typing(x: str, y: str) -> bool:
    """Whether two titles have the same words but for one or two long ones with a typing error or a lost letter."""
    p, q = x.split(), y.split()
    if len(p) != len(q):
        return False
    odd = [(s, t) for s, t in zip(p, q) if s != t]
    for s, t in odd:
        lost = "�" in s or "�" in t
        if not lost and (min(len(s), len(t)) < 4 or s.isdigit() or t.isdigit()):
            return False
        if (distance(s, t, 2) if "�" in s else distance(t, s, 2)) > (2 if lost or min(len(s), len(t)) > 6 else 1):
            return False
    lossy = any("�" in s or "�" in t for s, t in odd)
    return 0 < len(odd) <= (6 if lossy else 2)


def group_deliveries(rows: DataFrame) -> DataFrame:
    """The rows of read_deliveries with group_id: the deliveries of one paper of one owner share the smallest id.

    Deliveries with the same DOI, or the same whole title and years at most one apart, are one paper; cut titles
    (with the same venue), titles without their subtitle and titles with typing errors join the one paper they fit,
    with fitting year and venue. Generic titles go by DOI alone. Where the years of one title leave a gap of two or
    more, each run of years is a paper, and deliveries without a year are one of their own.
    """
    marked = _marked(rows)
    papers = _papers(rows, marked)
    return rows.join(marked.join(papers, "node", "left").select("id", F.coalesce("group_id", "node").alias("group_id")), "id")


def _marked(rows: DataFrame) -> DataFrame:
    """The rows as numbers, with their node: the smallest id of the same title where its years leave no gap, else the row's own.

    told: the title tells something; real: the DOI is a publisher's; gap: the row's title is of several runs of years.
    Titles stand as hashes beside their owner, so that only titles of one owner could be mistaken for each other.
    """
    told = (F.col("words") != "") & ~F.col("generic")
    title = F.when(told, F.xxhash64("words", "cut", F.when(F.col("cut"), F.col("venue")))).otherwise(F.xxhash64(F.lit("alone"), "id"))
    doi, real = F.when(F.col("doi").isNotNull(), F.xxhash64("doi")), F.col("doi").isNotNull() & ~F.col("doi").contains("/repo")
    keyed = rows.select("id", "owner", title.alias("title"), "year", "venue", F.xxhash64("words").alias("text"), "cut", told.alias("told"), doi.alias("doi"), real.alias("real"), "usable", "rank", "at")
    first = keyed.groupBy("title", "owner").agg(F.min("id").alias("first"), F.coalesce(F.max("year") - F.min("year") > 1, F.lit(False)).alias("gap"))
    got = keyed.join(first, ["title", "owner"])  # hashes come first in keys: they sort by their prefix alone
    return materialized(got.select("id", "owner", F.when(F.col("gap"), F.col("id")).otherwise(F.col("first")).alias("node"), "title", "gap", "year", "venue", "text", "cut", "told", "doi", "real", "usable", "rank", "at"))


def _papers(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, group_id) of the nodes that aren't alone in their paper or not its smallest."""
    hub = lambda kind, *cols: F.xxhash64(F.lit(kind), *cols).alias("hub")
    by_doi = marked.where("doi is not null").select("node", "owner", hub("D", "doi"))
    apart = marked.where("gap and told").select("node", "owner", "title", F.explode(F.when(F.col("year").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.array(F.col("year") - 1, F.col("year")))).alias("y"))
    first = materialized(components(by_doi.unionByName(apart.select("node", "owner", hub("T", "title", "y"))), hub=("hub", "owner")))
    links = materialized(_soft_links(rows, marked, first))
    second = materialized(_joined(links)).select(F.col("node").alias("label"), F.col("label").alias("final"))
    again = first.join(second, "label", "left").select("node", F.coalesce("final", "label").alias("group_id"))
    return again.unionByName(second.select(F.col("label").alias("node"), F.col("final").alias("group_id")).join(first, "node", "left_anti"))


def _soft_links(rows: DataFrame, marked: DataFrame, first: DataFrame) -> DataFrame:
    """(a, b): labels to be joined; a is a cut, shortened or mistyped title that fits exactly one paper b.

    marked: see _marked; first: (node, label) of those joined so far. One table holds each paper's different titles
    with their ranges of years and venues. Titles meet by hashes that stand for what must be equal: the whole beginning
    (cut titles), all words but the subtitle, one half of the words, or two neighbouring words (titles with lost letters).
    """
    labelled = marked.where("told").join(first, "node", "left").select("id", "owner", F.coalesce("label", "node").alias("label"), "text", "cut", "real", "year", "venue")
    ranges = [F.min("year").alias("y1"), F.max("year").alias("y2"), F.min("venue").alias("v1"), F.max("venue").alias("v2")]
    titles = labelled.groupBy("owner", "label", "text", "cut", "real").agg(F.min("id").alias("id"), *ranges).drop("text")
    titles = materialized(titles.join(rows.select("id", "words", "main"), "id").withColumn("n", F.length("words") - F.length(F.replace("words", F.lit(" "))) + 1))
    whole = titles.where("not cut")
    facts = ("id", "label", "real", "y1", "y2", "v1", "v2")
    side = lambda df, name, *keys: df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in facts])
    years = F.col("a_y1").isNull() | F.col("b_y1").isNull() | ((F.col("a_y1") <= F.col("b_y2") + 1) & (F.col("b_y1") <= F.col("a_y2") + 1))
    venues = F.col("a_v1").isNull() | F.col("b_v1").isNull() | ((F.col("a_v1") <= F.col("b_v2")) & (F.col("b_v1") <= F.col("a_v2")))
    fits = (F.col("a_label") != F.col("b_label")) & years & venues & ~(F.col("a_real") & F.col("b_real"))

    def meet(kind: str, a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
        return side(a, "a", *keys).join(side(b, "b", *keys), list(keys)).where(fits).select(F.lit(kind).alias("kind"), "a_id", "a_label", "b_id", "b_label")

    # cut titles are the beginning of a whole one, of the same length; those whose paper has a whole one already need no other
    cut = titles.where("cut")
    cut = materialized(cut.join(whole.join(cut.select("label").distinct(), "label", "left_semi").select("label").distinct(), "label", "left_anti").withColumn("k", F.length("words")))
    lengths = materialized(cut.select("owner", "k").distinct())
    begins = whole.join(lengths, "owner").where(F.length("words") > F.col("k")).withColumn("block", F.xxhash64(F.substr("words", F.lit(1), F.col("k"))))
    near = [meet("cut", cut.withColumn("block", F.xxhash64("words")), begins, "block", "owner", "k")]
    # a title that is another one's without the subtitle; typing errors leave one half of the words as it is
    main = F.xxhash64(F.lit("main"), F.when(F.col("main") == "", F.col("words")).otherwise(F.col("main")))
    half = (F.col("n") / 2).cast("int")
    words_of = lambda count: F.call_function("substring_index", F.col("words"), F.lit(" "), count)
    halves = [F.xxhash64(F.lit("1"), "n", words_of(half)), F.xxhash64(F.lit("2"), "n", words_of(half - F.col("n")))]
    entry = lambda keep, is_half, block: F.when(keep, F.struct(block.alias("block"), F.lit(is_half).alias("half")))
    long = F.col("n") >= 4
    asking = F.array(entry(F.col("main") == "", False, main), *[entry(long & ~F.col("real"), True, h) for h in halves])
    asked = F.array(entry(F.col("main") != "", False, main), *[entry(long, True, h) for h in halves])
    blocks = lambda e: whole.withColumn("e", F.explode(F.array_compact(e))).withColumns({"block": F.col("e.block"), "half": F.col("e.half")})
    once = ~F.col("half") | F.col("b_real") | (F.col("a_label") < F.col("b_label"))
    pairs = side(blocks(asking), "a", "block", "owner", "half").join(side(blocks(asked), "b", "block", "owner", "half"), ["block", "owner", "half"]).where(fits & once)
    near.append(pairs.select(F.when(F.col("half"), "half").otherwise("main").alias("kind"), "a_id", "a_label", "b_id", "b_label"))
    # lost letters anywhere: two neighbouring words are untouched
    damaged = materialized(whole.where(F.col("words").contains("�") & (F.col("n") >= 3)))
    mates = whole.join(damaged.select("owner", "n").distinct(), ["owner", "n"], "left_semi")
    two = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("n") - 2), lambda i: F.array_join(F.slice(F.split("words", " "), i + 1, 2), " "))))
    paired = lambda df: df.withColumn("two", two).where(~F.col("two").contains("�")).withColumn("block", F.xxhash64("n", "two"))
    near.append(meet("lost", paired(damaged), paired(mates), "block", "owner").distinct())
    near = materialized(reduce(DataFrame.unionByName, near))
    text = lambda s: titles.select(F.col("id").alias(f"{s}_id"), F.col("words").alias(f"{s}_words"))
    alike = near.where("kind in ('half', 'lost')").join(text("a"), "a_id").join(text("b"), "b_id").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"), F.col("a_words").alias("x"), F.col("b_words").alias("y")).distinct()
    typed = materialized(alike.mapInArrow(_typing_errors, "a bigint, b bigint").distinct())
    same = _joined(typed).select(F.col("node").alias("b_label"), F.col("label").alias("b_same"))  # spellings of one paper count once
    clear = near.where("kind in ('cut', 'main')").join(same, "b_label", "left").withColumn("b", F.coalesce("b_same", "b_label"))
    one = clear.groupBy("kind", "a_label").agg(F.min("b").alias("b"), F.max("b").alias("hi")).where("b = hi").select(F.col("a_label").alias("a"), "b")
    return one.unionByName(typed).distinct()


def _joined(pairs: DataFrame) -> DataFrame:
    """(node, label) of the nodes that pairs (a, b) connect."""
    ends = [pairs.select(F.col(c).alias("node"), F.col("a").alias("lo"), F.col("b").alias("hi")) for c in ("a", "b")]
    return components(ends[0].unionByName(ends[1]), hub=("lo", "hi"))


def survivors(rows: DataFrame) -> DataFrame:
    """(group_id, field_name, id): for each field of each group of two or more rows the row whose value survives.

    rows as of read_deliveries. One aggregation takes, for each field, the maximum of (usable, trust, load time,
    smallest id): among the usable values the most trusted source's, then the latest, then the smallest id's.
    Groups without a usable value of a field have no row for it.
    """
    marked = _marked(rows)
    grouped = marked.join(_papers(rows, marked), "node", "left").withColumn("group_id", F.coalesce("group_id", "node"))
    order = [(-F.coalesce("rank", F.lit(2**31 - 1)).cast("bigint")).alias("trust"), F.col("at"), (-F.col("id")).alias("key")]

    def best(usable: Column) -> Column:
        return F.max(F.when(usable, F.struct(*order)))

    got = grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), best(F.lit(True)).alias("source"), best(F.col("doi").isNotNull()).alias("doi"), best(F.col("usable")).alias("title")).where("n > 1")
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), (-F.col(f"{f}.key")).alias("id")) for f in ("source", "doi", "title")]))
    return got.select("group_id", fields.alias("f")).select("group_id", "f.field_name", "f.id").where("id is not null")

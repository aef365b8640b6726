"""Deduplication with defined winners, near-duplicate clustering and the outlier screen."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheaf.functions.identifiers import dedup_doi
from sheaf.functions.similarity import ratio
from sheaf.functions.text import clean_text, part_marker, prefix_of, title_key
from sheaf.session import materialized

#: Thresholds of similarity and of the screen.
NEAR_TITLE, TWIN_TITLE, YEARS_APART, SCREEN_SHARE, SCREEN_JUDGED, PREFIX_WORDS = 0.85, 0.90, 1, 0.25, 5, 4

#: Fixed value: DOIs that name a repository's copy rather than the paper.
REPOSITORY_PREFIX = "10.99200/"


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key, chosen by one map-side combinable minimum over (order, row) instead of a window."""
    cols = df.columns
    best = df.groupBy(*keys).agg(F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*[F.col(c) for c in cols]).alias("_row"))).alias("_m"))
    return best.select("_m._row.*")


def doi_first(df: DataFrame, keys: Sequence[str], doi: str, order: str) -> DataFrame:
    """Rows of one key: each different DOI once, the first; rows without a DOI only where the key has none, the first.

    The rule of a stable sort with DOIs first in which a later row goes if it has no DOI or a kept one.
    """
    has = first_rows(df.where(F.col(doi).isNotNull()), [*keys, doi], [F.col(order)])
    bare = first_rows(df.where(F.col(doi).isNull()), keys, [F.col(order)])
    return has.unionByName(bare.join(has.select(*keys).distinct(), list(keys), "left_anti"))


def fill_from_twins(df: DataFrame, keys: Sequence[str], order: str, fill: Sequence[str]) -> DataFrame:
    """One row of each key, the first; its blank columns from the first row that has them."""
    rest = [c for c in df.columns if c not in (*keys, *fill)]
    return df.groupBy(*keys).agg(
        *[F.min_by(c, order).alias(c) for c in rest],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fill],
    )


def near_pairs(df: DataFrame, row_id: str, owner: str, title: str, year: str, doi: str, chunk: int = 4000, per_doi: bool = False) -> DataFrame:
    """(a, b, similarity): different titles of one owner that are nearly the same, a < b.

    All titles of one owner meet; what can't reach NEAR_TITLE is ruled out by bounds that never lose a pair (see _signed),
    so the result is that of comparing every two. Owners with more than chunk titles are cut into chunks, and
    each two chunks meet in a block of their own, so no task holds a whole large owner. Markup and accents don't
    count; equal keys are left to exact deduplication, so copies don't multiply. Part markers that differ, years more
    than one apart and DOIs of which none is common rule a pair out before the ratio is taken; DOIs are normalised,
    unusable ones and those of repositories are none. Under a common DOI a title of PREFIX_WORDS words or more that
    begins the other one (a lost subtitle) is near at any ratio; a part marker on one side only is no veto. A title is one row, the first; with per_doi, one for each DOI.
    """
    base = df.select(F.col(row_id).alias("id"), F.col(owner).alias("owner"), title_key(title).alias("k"), F.when(F.col(title).rlike("[<&]|[^\\x00-\\x7f]"), F.col(title)).alias("raw"), part_marker(title).alias("part"), F.col(year).alias("y"), dedup_doi(doi, REPOSITORY_PREFIX).alias("d"))
    base = base.where(F.col("owner").isNotNull() & F.col("k").isNotNull())
    one = base.withColumn("same", F.col("d") if per_doi else F.lit(None).cast("string")).groupBy("owner", "k", "raw", "part", "same").agg(F.min("id").alias("id"), F.min("y").alias("y1"), F.max("y").alias("y2"), F.collect_set("d").alias("d")).drop("same")
    facts = ("id", "k", "c", "part", "y1", "y2", "d", *_SIGNS)
    kinds = {f.name: f.dataType.simpleString() for f in one.schema}
    signed = materialized(one.mapInArrow(_signed, ", ".join(f"{c} {kinds[c]}" for c in ("owner", "id", "k", "part", "y1", "y2", "d")) + ", c string, " + ", ".join(f"{c} bigint" for c in _SIGNS)))
    large = signed.groupBy("owner").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk).select("owner", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    placed = signed.join(F.broadcast(large), "owner", "left").withColumn("last", F.coalesce(F.col("chunks") - 1, F.lit(0))).withColumn("own", F.pmod(F.hash("k"), F.col("last") + 1))
    a = placed.withColumn("other", F.explode(F.sequence("own", "last"))).select("owner", F.col("own").alias("lo"), F.col("other").alias("hi"), *[F.col(c).alias(f"a_{c}") for c in facts])
    b = placed.withColumn("other", F.explode(F.sequence(F.lit(0), "own"))).select("owner", F.col("other").alias("lo"), F.col("own").alias("hi"), *[F.col(c).alias(f"b_{c}") for c in facts])
    years = F.col("a_y1").isNull() | F.col("b_y1").isNull() | ((F.col("a_y1") <= F.col("b_y2") + YEARS_APART) & (F.col("b_y1") <= F.col("a_y2") + YEARS_APART))
    dois = (F.size("a_d") == 0) | (F.size("b_d") == 0) | F.arrays_overlap("a_d", "b_d")
    parts = (F.col("a_part") == "") | (F.col("b_part") == "") | (F.col("a_part") == F.col("b_part"))
    starts = lambda p, q: prefix_of(f"{p}c", f"{q}c") & (F.size(F.split(f"{p}c", " ")) >= PREFIX_WORDS)
    cut = (starts("a_", "b_") | starts("b_", "a_")) & F.arrays_overlap("a_d", "b_d")
    once = (F.col("lo") < F.col("hi")) | (F.col("a_id") < F.col("b_id"))
    near = a.join(b, ["owner", "lo", "hi"]).where(once & (F.col("a_k") != F.col("b_k")) & parts & years & dois & (cut | _may_be_near("a_", "b_"))).withColumn("cut", cut)
    swap = F.col("a_id") > F.col("b_id")
    first = lambda c: F.when(swap, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}"))
    second = lambda c: F.when(swap, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    return near.select(first("id").alias("a"), second("id").alias("b"), first("c").alias("x"), second("c").alias("y"), "cut").mapInArrow(_ratios, "a bigint, b bigint, similarity double")


#: Columns of a title's signature of 512 bits.
_SIGNS = tuple(f"s{i}" for i in range(8))


def _may_be_near(a: str, b: str) -> Column:
    """False only where the ratio is sure to be below NEAR_TITLE.

    With S characters in both and M matched ones, ratio = 2 M / S, so M >= NEAR_TITLE / 2 * S. The S - 2 M unmatched ones
    cut the match into at most S - 2 M + 1 blocks, so at least M - (S - 2 M + 1) >= (1.5 * NEAR_TITLE - 1) * S - 1 pairs of
    neighbouring characters are common, and of a title of n characters (n - 1 pairs) at most n - (1.5 * NEAR_TITLE - 1) * S
    are not. Each bit that only one signature has is one of those.
    """
    n, m = F.length(f"{a}c"), F.length(f"{b}c")
    least = (n + m) * (1.5 * NEAR_TITLE - 1)
    only = lambda p, q: sum((F.bit_count(F.col(f"{p}{c}").bitwiseAND(F.bitwise_not(f"{q}{c}"))) for c in _SIGNS[1:]), F.bit_count(F.col(f"{p}{_SIGNS[0]}").bitwiseAND(F.bitwise_not(f"{q}{_SIGNS[0]}"))))
    return (2 * F.least(n, m) >= NEAR_TITLE * (n + m) - 1e-6) & (only(a, b) <= n - least + 1e-6) & (only(b, a) <= m - least + 1e-6)


def _comparable(raw: str) -> str:
    """The key of a title without markup and accents."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", clean_text(raw)) if not unicodedata.combining(c))
    return re.sub(r"[\W_]+", " ", plain.lower()).strip()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with what is compared (c) and its signature: a hashed bit for each pair of neighbouring characters, repeated ones numbered. Rows without any letter or digit go."""
    bits: dict[tuple[str, int], int] = {}
    for batch in batches:
        rows = {n: batch.column(n) for n in batch.schema.names}
        text = [k if raw is None else _comparable(raw) for k, raw in zip(rows["k"].to_pylist(), rows["raw"].to_pylist())]
        signs = []
        for t in text:
            seen: dict[str, int] = {}
            sign = 0
            for i in range(len(t) - 1):
                g = t[i : i + 2]
                seen[g] = n = seen.get(g, 0) + 1
                bit = bits.get((g, n))
                if bit is None:
                    bit = bits[g, n] = 1 << zlib.crc32(f"{g}{n}".encode()) % 512
                sign |= bit
            signs.append(sign.to_bytes(64, "little"))
        words = np.frombuffer(b"".join(signs), dtype="<i8").reshape(-1, len(_SIGNS))
        keep = pa.array([t != "" for t in text], pa.bool_())
        names = ["owner", "id", "k", "part", "y1", "y2", "d"]
        out = pa.RecordBatch.from_arrays([*[rows[n] for n in names], pa.array(text, pa.string()), *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(len(_SIGNS))]], [*names, "c", *_SIGNS])
        yield out.filter(keep)


def _ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y, cut = (c.to_pylist() for c in batch.columns)
        score = [ratio(s, t, 0.0 if c else NEAR_TITLE) for s, t, c in zip(x, y, cut)]
        keep = [i for i, s in enumerate(score) if cut[i] or s >= NEAR_TITLE]
        yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in keep], t) for v, t in ((a, pa.int64()), (b, pa.int64()), (score, pa.float64()))], ["a", "b", "similarity"])


def representatives(pairs: DataFrame, max_rounds: int = 30) -> DataFrame:
    """(id, representative): greedy clusters in order of id: a row whose near rows are all represented or later is one itself.

    Distributed form of going through the rows in order and comparing with representatives only: in each
    round a row is decided once its smallest near representative precedes every undecided smaller neighbour, or
    none of those is left. What long chains leave undecided after max_rounds is decided in order in one pass.
    """
    pairs = materialized(pairs.select("a", "b").distinct())
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    state = materialized(ids.withColumn("rep", F.lit(None).cast("bigint")))
    for _ in range(max_rounds):
        before = state.select(F.col("id").alias("a"), F.col("rep").alias("a_rep"))
        smaller = pairs.join(before, "a").groupBy(F.col("b").alias("id")).agg(
            F.min(F.when(F.col("a_rep").isNull(), F.col("a"))).alias("open"), F.min(F.when(F.col("a_rep") == F.col("a"), F.col("a"))).alias("near")
        )
        settled = F.when(F.col("open").isNull(), F.coalesce("near", "id")).when(F.col("near") < F.col("open"), F.col("near"))
        state = materialized(state.join(smaller, "id", "left").select("id", F.coalesce("rep", settled).alias("rep")))
        if not state.where("rep is null").limit(1).count():
            return state.select("id", F.col("rep").alias("representative"))
    rest = state.where("rep is null").select("id")
    known = state.select(F.col("id").alias("a"), F.col("rep").alias("a_rep"))
    edges = rest.join(pairs.withColumnRenamed("b", "id"), "id").join(known, "a").select("id", "a", (F.col("a_rep") == F.col("a")).alias("sure"))
    last = edges.repartition(1).sortWithinPartitions("id", "a").mapInArrow(_in_order, "id bigint, representative bigint")
    return state.where("rep is not null").select("id", F.col("rep").alias("representative")).unionByName(last)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Representatives of undecided rows from (id, a, sure), sorted: their smaller neighbours and whether those are representatives, null if undecided."""
    chosen: dict[int, int] = {}
    for batch in batches:
        for i, a, sure in zip(*(c.to_pylist() for c in batch.columns)):
            if chosen.setdefault(i, i) == i and (sure or (sure is None and chosen[a] == a)):
                chosen[i] = a
    yield pa.RecordBatch.from_arrays([pa.array(list(v), pa.int64()) for v in (chosen.keys(), chosen.values())], ["id", "representative"])


def outlier_screen(items: DataFrame, owner: str, judged: Column, rated: Column) -> DataFrame:
    """(owner, n_items, judged, rated, share, flagged): owners with enough judged items of which too few are rated."""
    got = items.groupBy(owner).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(judged).alias("judged"), F.count_if(judged & rated).alias("rated"))
    share = F.col("rated") / F.nullif(F.col("judged"), F.lit(0))
    return got.withColumn("share", F.round(share, 6)).withColumn("flagged", F.coalesce((F.col("judged") >= SCREEN_JUDGED) & (share < SCREEN_SHARE), F.lit(False)))


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key (a later one overwrites)."""
    cols = df.columns
    best = df.groupBy(*keys).agg(F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*[F.col(c) for c in cols]).alias("_row"))).alias("_m"))
    return best.select("_m._row.*")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank_no") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))

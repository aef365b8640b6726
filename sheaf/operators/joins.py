"""Enrichment and linking joins. None collects a group or multiplies rows beyond what its name says.

Sides are left to AQE, which broadcasts what is small by its measured size and splits hot keys of shuffled
joins. By hint only the one-row bitmap of contains_join is broadcast, and its join of texts is a sort-merge join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; ties are the caller's to exclude."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def left_enrich(df: DataFrame, lookup: DataFrame, on: Sequence[str], fill: Sequence[str] = (), take: Sequence[str] = ()) -> DataFrame:
    """Left join to a lookup with unique keys; `take` columns are overwritten (null without a match), `fill` ones only where empty."""
    other = lookup.select(*on, *[F.col(c).alias(f"_r_{c}") for c in (*fill, *take)])
    out = df.join(other, list(on), "left")
    for c in fill:
        out = out.withColumn(c, F.coalesce(c, f"_r_{c}") if c in df.columns else F.col(f"_r_{c}"))
    for c in take:
        out = out.withColumn(c, F.col(f"_r_{c}"))
    return out.drop(*[f"_r_{c}" for c in (*fill, *take)])


def first_hit(df: DataFrame, row_id: str, keys: str, lookup: DataFrame, lookup_key: str, value: str, needed: bool = True) -> DataFrame:
    """(row_id, value): for each row the lookup's value of the first of its array of keys that is found.

    The keys are exploded with their place and the smallest place with a hit is kept by a map-side
    combinable minimum; needed: hits whose value is null don't count.
    """
    keyed = df.select(row_id, F.posexplode(keys).alias("pos", "_key"))
    hits = keyed.join(lookup.select(F.col(lookup_key).alias("_key"), F.col(value)), "_key")
    if needed:
        hits = hits.where(F.col(value).isNotNull())
    return hits.groupBy(row_id).agg(F.min_by(value, "pos").alias(value))


def unambiguous(df: DataFrame, key: str, identity: str) -> DataFrame:
    """(key, identity) of the keys that belong to one identity only."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(identity).alias(identity), F.max(identity).alias("_hi")).where(F.col(identity) == F.col("_hi")).drop("_hi")


def cascading(df: DataFrame, row_id: str, stages: Sequence[tuple[str, DataFrame, str, str]], result: str) -> DataFrame:
    """df with result and match_method: the first stage (method, lookup, key, value) whose unique key is found."""
    out, methods, values = df, [], []
    for method, lookup, key, value in stages:
        out = out.join(lookup.select(F.col(key), F.col(value).alias(f"_v_{method}")), key, "left")
        methods.append(F.when(F.col(f"_v_{method}").isNotNull(), F.lit(method)))
        values.append(F.col(f"_v_{method}"))
    out = out.withColumn(result, F.coalesce(*values)).withColumn("match_method", F.coalesce(*methods))
    return out.drop(*[f"_v_{m}" for m, *_ in stages])


def overrides(df: DataFrame, rules: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Long-form overrides (key, field, value) applied; an override with a null value sets null."""
    wide = rules.where(F.col(key).isNotNull()).groupBy(key)
    wide = wide.agg(*[x for f in fields for x in (F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_v_{f}"), F.max(F.when(F.col("field") == f, 1)).alias(f"_h_{f}"))])
    out = df.join(wide, key, "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.col(f"_h_{f}") == 1, F.col(f"_v_{f}").cast(df.schema[f].dataType)).otherwise(F.col(f)))
    return out.select(*df.columns)


def exclude(df: DataFrame, reviewed: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """Rows that no reviewed exclusion names by any of the key tuples; null key parts never match."""
    for key in keys:
        named = reviewed.select(*key).where(" and ".join(f"{k} is not null" for k in key)).distinct()
        df = df.join(named, list(key), "left_anti")
    return df


def add_missing(held: DataFrame, found: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """held and those rows of found that share none of the keys with it (columns by name, missing ones null)."""
    new = found
    for key in keys:
        new = new.join(held.select(*key).distinct(), list(key), "left_anti")
    return held.unionByName(new, allowMissingColumns=True)


def best_match(df: DataFrame, candidates: DataFrame, on: Sequence[str], row_id: str, order: Sequence[Column]) -> DataFrame:
    """Left join to the best candidate of the same key, by the given order; the best one is a combinable minimum, not a window."""
    pairs = df.join(candidates, list(on), "left")
    best = pairs.groupBy(row_id).agg(F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*[F.col(c) for c in pairs.columns]).alias("_row"))).alias("_m"))
    return best.select("_m._row.*")


def merge_sources(first: DataFrame, second: DataFrame, on: Sequence[str], fill: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Full outer merge: the first source is authoritative, the second fills blanks or adds rows; provenance says which."""
    a = first.select(*on, *[F.col(c).alias(f"_a_{c}") for c in fill], F.lit(1).alias("_a"))
    b = second.select(*on, *[F.col(c).alias(f"_b_{c}") for c in fill], F.lit(1).alias("_b"))
    got = a.join(b, list(on), "full_outer")
    origin = F.when(F.col("_a").isNull(), names[1]).when(F.col("_b").isNull(), names[0]).otherwise(f"{names[0]}+{names[1]}")
    return got.select(*on, *[F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in fill], origin.alias("provenance"))


def exactly_one(pairs: DataFrame, row_id: str, candidate: str) -> DataFrame:
    """(row_id, candidate, status): unique, ambiguous, by the number of different candidates."""
    n = pairs.groupBy(row_id).agg(F.min(candidate).alias(candidate), F.max(candidate).alias("_hi"))
    one = F.col(candidate) == F.col("_hi")
    return n.select(row_id, F.when(one, F.col(candidate)).alias(candidate), F.when(one, "unique").otherwise("ambiguous").alias("status"))


def band_join(left: DataFrame, right: DataFrame, on: Sequence[str], a: str, b: str, width: int) -> DataFrame:
    """Pairs with equal keys and |a - b| <= width, by buckets of the band's width instead of all pairs of a key.

    Each left row enters its own bucket, each right row its own and the two beside it; the exact band is then
    a residual predicate, so every pair comes out once.
    """
    w = max(1, width)
    x = left.withColumn("_k", F.floor(F.col(a) / w))
    y = right.withColumn("_k", F.explode(F.array(*[F.floor(F.col(b) / w) + i for i in (-1, 0, 1)])))
    return x.join(y, [*on, "_k"]).where(F.abs(F.col(a) - F.col(b)) <= width).drop("_k")


def propagate(df: DataFrame, key: str, flag: str) -> DataFrame:
    """Each row with whether any row of its key has the flag; by an aggregate joined back, so a hot key is no window."""
    any_of = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(flag).cast("int")).alias("_any"))
    return df.join(any_of, key, "left").withColumn(f"{flag}_any", F.coalesce(F.col("_any") == 1, F.col(flag))).drop("_any")


def contains_join(df: DataFrame, text: str, phrases: DataFrame, phrase: str, max_phrases: int | None = None) -> DataFrame:
    """Rows with each phrase they contain, whatever the number of phrases; case doesn't count, null and empty phrases are none.

    With max_phrases, a rule table that should be short is checked, and more phrases are an error.

    Phrases of four or more characters meet a text by an equality join on the four characters they begin with, shorter ones,
    of which there can only be few kinds, by their own length; contains() then decides. A text's runs of characters that no
    phrase begins with are left out by a bitmap of fixed size before they become rows, and the join is a sort-merge join: from
    the file's size alone Spark would take the texts, repeated for each run, for the smaller side and broadcast them.
    """
    rules = phrases.select(F.col(phrase).alias("_phrase")).where(F.col(phrase) != "").distinct().withColumn("_low", F.lower("_phrase"))
    if max_phrases is not None and rules.limit(max_phrases + 1).count() > max_phrases:
        raise ValueError(f"more than {max_phrases} phrases")
    rules = rules.withColumn("_gram", F.substring("_low", 1, 4))
    begins = _bitmap(rules, "_gram").withColumnRenamed("_lengths", "_ks")
    low = df.withColumn("_row", F.struct("*")).select("_row", F.lower(text).alias("_text")).where(F.length("_text") > 0).crossJoin(F.broadcast(begins))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length("_text")), lambda i: F.transform("_ks", lambda k: F.substr("_text", i, k))))
    known = F.array_distinct(F.filter(grams, lambda g: F.getbit(F.get("_words", F.shiftright(_bit(g), 6)), F.pmod(_bit(g), F.lit(64)).cast("int")) == 1))
    hits = low.select("_row", "_text", F.explode(known).alias("_gram")).join(rules.hint("merge"), "_gram").where(F.contains("_text", F.col("_low")))
    return hits.select("_row.*", F.col("_phrase").alias(phrase))


def _bit(value: Column | str) -> Column:
    """A value's place in a bitmap of 512 words of 64 bits."""
    return F.pmod(F.xxhash64(value), F.lit(512 * 64)).cast("int")


def _bitmap(df: DataFrame, col: str) -> DataFrame:
    """One row: _words, the bits of all values of col, and _lengths, the lengths they have; 4 KB however many values there are."""
    words = df.select(F.shiftright(_bit(col), 6).alias("_w"), F.expr(f"shiftleft(1L, pmod(xxhash64({col}), 64L)::int)").alias("_b"), F.length(col).alias("_n"))
    words = words.groupBy("_w").agg(F.bit_or("_b").alias("_b"), F.collect_set("_n").alias("_n"))
    one = words.agg(F.map_from_entries(F.collect_list(F.struct("_w", "_b"))).alias("_m"), F.array_distinct(F.flatten(F.collect_list("_n"))).alias("_lengths"))
    return one.select(F.transform(F.sequence(F.lit(0), F.lit(511)), lambda w: F.coalesce(F.col("_m")[w], F.lit(0).cast("bigint"))).alias("_words"), "_lengths")


def anti_both(used: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(side, key): keys used but unknown, and known but unused."""
    a = used.select(key).where(F.col(key).isNotNull()).distinct()
    b = known.select(key).where(F.col(key).isNotNull()).distinct()
    x = a.join(b, key, "left_anti").select(F.lit("unknown").alias("side"), key)
    return x.unionByName(b.join(a, key, "left_anti").select(F.lit("unused").alias("side"), key))

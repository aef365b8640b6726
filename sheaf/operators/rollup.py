"""Aggregations: rollups over two grains, majorities, coverage, top rows, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheaf.session import materialized


def two_grain_rollup(entities: DataFrame, items: DataFrame, group: str, segment: str, entity_id: str, item_metrics: dict[str, Column]) -> DataFrame:
    """Per group, overall (segment null) and per segment: entity_count on the entities' grain, the metrics on the items'.

    items carry group and segment. The grains are aggregated apart and joined, so nothing fans out and
    groups without items stay with zero items.
    """
    who = entities.groupingSets([[group], [group, segment]], group, segment).agg(F.countDistinct(entity_id).alias("entity_count"), F.grouping(segment).alias("_all"))
    what = items.groupingSets([[group], [group, segment]], group, segment).agg(F.count(F.lit(1)).alias("item_count"), *[m.alias(n) for n, m in item_metrics.items()], F.grouping(segment).alias("_all"))
    w = what.select(F.col(group).alias("_g"), F.col(segment).alias("_s"), F.col("_all").alias("_a"), "item_count", *item_metrics)
    same = who[group].eqNullSafe(w["_g"]) & who[segment].eqNullSafe(w["_s"]) & (who["_all"] == w["_a"])
    out = who.join(w, same, "left").withColumn("item_count", F.coalesce("item_count", F.lit(0)))
    per = F.col("item_count") / F.nullif(F.col("entity_count"), F.lit(0))
    return out.withColumn("items_per_entity", per).withColumn("level", F.when(F.col("_all") == 1, "overall").otherwise("segment")).drop("_g", "_s", "_a", "_all")


def majority(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """(keys, value, votes): the commonest value of each key, of equals the one seen first; by counts, not by rows."""
    votes = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("_first"))
    best = votes.groupBy(*keys).agg(F.max(F.struct("votes", (-F.col("_first")).alias("first"), value)).alias("_b"))
    return best.select(*keys, F.col(f"_b.{value}").alias(value), F.col("_b.votes").alias("votes"))


def first_filled_row(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """For each key and column the first value that isn't null."""
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, filled, total, share): one pass over the rows, then one row for each column."""
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))).alias(c) for c in columns])
    long = one.unpivot("total", list(columns), "column_name", "filled")
    return long.select("column_name", "filled", "total", F.round(F.col("filled") / F.nullif(F.col("total"), F.lit(0)), 6).alias("share"))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank_no") -> DataFrame:
    """The first n rows of each key; Spark's group limit cuts every task's rows before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def multiplicity(df: DataFrame, key: str) -> DataFrame:
    """How many keys occur how often."""
    return df.where(F.col(key).isNotNull()).groupBy(key).count().groupBy(F.col("count").alias("times")).agg(F.count(F.lit(1)).alias("n_keys"))


def conflicts(df: DataFrame, keys: Sequence[str], value: str, least: int = 2) -> DataFrame:
    """Keys with several different values, and how many."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n_values")).where(F.col("n_values") >= least)


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def global_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Row numbers over a whole table: numbers within ranges of the order plus the sizes of the ranges before."""
    ranged = df.repartitionByRange(column).withColumn("_p", F.spark_partition_id())
    ranged = materialized(ranged)
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    rn = F.row_number().over(W.partitionBy("_p").orderBy(column))
    return ranged.withColumn("_r", rn).join(before, "_p").select(*df.columns, (F.col("_r") + F.col("_b")).cast("bigint").alias(name))

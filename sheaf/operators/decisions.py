"""Ordered rules that give each row a decision with its reason, and metrics ranked side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def decide(df: DataFrame, rules: Sequence[tuple[str, str, Column]], otherwise: tuple[str, str]) -> DataFrame:
    """df with action and reason of the first rule (action, reason, condition) that holds; null conditions don't hold."""
    action = reason = None
    for act, why, cond in rules:
        hit = F.coalesce(cond, F.lit(False))
        action = F.when(hit, act) if action is None else action.when(hit, act)
        reason = F.when(hit, why) if reason is None else reason.when(hit, why)
    return df.withColumn("action", action.otherwise(otherwise[0])).withColumn("reason", reason.otherwise(otherwise[1]))


def rank_by_each(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """(key, metric, value, rank_no): each metric ranked on its own, descending, missing last, ties by key."""
    long = df.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(key, list(metrics), "metric", "value")
    return long.withColumn("rank_no", F.row_number().over(W.partitionBy("metric").orderBy(F.col("value").desc_nulls_last(), F.col(key))))

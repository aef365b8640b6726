"""Upserts as classified joins, cascades and post-hoc exclusion; tables are rewritten, never changed in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify_upsert(current: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """incoming with `action`: error (null key, missing required value, key twice), insert, update or skip (nothing changes)."""
    twice = incoming.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    old = current.select(key, F.lit(1).alias("_have"), *[F.col(c).alias(f"_c_{c}") for c in columns])
    out = incoming.join(twice, key, "left").join(old, key, "left")
    bad = F.col(key).isNull() | (F.coalesce("_n", F.lit(1)) > 1)
    for c in required:
        bad = bad | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    action = F.when(bad, "error").when(F.col("_have").isNull(), "insert").when(same, "skip").otherwise("update")
    return out.withColumn("action", action).select(*incoming.columns, "action")


def apply_upsert(current: DataFrame, classified: DataFrame, key: str) -> DataFrame:
    """The table after all inserts and updates; nothing is applied where any row is an error."""
    good = classified.where(F.col("action").isin("insert", "update")).drop("action")
    failed = classified.where("action = 'error'").limit(1).select(F.lit(1).alias("_e"))
    merged = current.join(good.select(key), key, "left_anti").unionByName(good.select(*current.columns))
    ok = merged.join(failed, how="left_anti")
    return ok.unionByName(current.join(failed, how="left_semi"))


def cascade(parents: DataFrame, key: str, value: str, children: DataFrame, fk: str, target: str) -> DataFrame:
    """children with target set to their parent's value where they have a parent, and whether that changed it."""
    p = parents.select(F.col(key).alias(fk), F.col(value).alias("_v"), F.lit(1).alias("_p"))
    out = children.join(p, fk, "left")
    new = F.when(F.col("_p") == 1, F.col("_v")).otherwise(F.col(target))
    return out.withColumn("changed", ~new.eqNullSafe(F.col(target))).withColumn(target, new).drop("_v", "_p")


def prune_unused(parents: DataFrame, key: str, children: DataFrame, fk: str) -> DataFrame:
    """Parents that some child still uses."""
    return parents.join(children.select(F.col(fk).alias(key)).distinct(), key, "left_semi")

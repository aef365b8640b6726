"""References to records that do not exist at the time they are made."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphan_references(child: DataFrame, child_id: str, loaded_at: str, references: dict[str, tuple[str, DataFrame, str]]) -> DataFrame:
    """(ref_table, period, record_id) for each reference without a live parent row.

    references: ref_table -> (foreign key column, parent rows, parent key column); parents carry
    loaded_at and deleted_at. A parent is live when loaded_at <= the child's load time and deleted_at is
    null or later than it. The distinct (table, key, time) triples are anti-joined with the parents
    (equality on the key, the times as residual predicate), and what is left is joined back to the child.
    The join is left to AQE: small parents are broadcast by their measured size, larger ones are
    sort-merged with the hot keys split, as a left anti join may split its left side.

    Null keys are no reference. A child without load time can't have a live parent and is orphaned with
    null period. Repeated child rows are reported once. Empty parents orphan every reference.
    """
    refs = F.array(*[F.struct(F.lit(t).alias("ref_table"), F.col(fk).cast("bigint").alias("ref_key")) for t, (fk, _, _) in references.items()])
    slim = child.select(F.col(child_id).alias("record_id"), F.col(loaded_at).alias("at"), F.explode(refs).alias("r"))
    slim = slim.select("record_id", "at", "r.ref_table", "r.ref_key").where(F.col("ref_key").isNotNull())
    parents = reduce(
        DataFrame.unionByName,
        [
            p.select(F.lit(t).alias("p_table"), F.col(k).cast("bigint").alias("p_key"), F.col("loaded_at").alias("p_from"), F.col("deleted_at").alias("p_to"))
            for t, (_, p, k) in references.items()
        ],
    ).where(F.col("p_key").isNotNull() & F.col("p_from").isNotNull())
    live = (
        (F.col("ref_table") == F.col("p_table"))
        & (F.col("ref_key") == F.col("p_key"))
        & (F.col("p_from") <= F.col("at"))
        & (F.col("p_to").isNull() | (F.col("p_to") > F.col("at")))
    )
    missing = slim.select("ref_table", "ref_key", "at").distinct().join(parents, live, "left_anti")
    m = missing.select(F.col("ref_table").alias("m_table"), F.col("ref_key").alias("m_key"), F.col("at").alias("m_at"))
    back = slim.join(m, (slim.ref_table == m.m_table) & (slim.ref_key == m.m_key) & slim.at.eqNullSafe(m.m_at), "left_semi")
    return back.select("ref_table", F.date_format("at", "yyyy-MM").alias("period"), "record_id").distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per referenced table and month."""
    return orphans.groupBy("ref_table", "period").agg(F.count(F.lit(1)).alias("orphans"))

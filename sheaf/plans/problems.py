"""Queries of the general training-data problems: packed values (p5) and orphan references (p7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.multivalue import split_values
from sheaf.operators.orphans import orphan_references, orphan_report
from sheaf.session import table


def _p5_all(spark: SparkSession, d: str, errors: bool = False) -> DataFrame:
    names = split_values(table(spark, d, "publications"), "publication_id", "authors", people=True, errors=errors)
    labels = split_values(table(spark, d, "anu_journals"), "row_id", "scimago_categories", errors=errors)
    return names.withColumn("table_name", F.lit("publications")).unionByName(labels.withColumn("table_name", F.lit("anu_journals")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5_all(spark, d).select("table_name", "record_id", "pos", "val")


def p5_errors(spark: SparkSession, d: str) -> DataFrame:
    """Elements by table and error flag: null for values without fault, else MALFORMED_QUOTE, EMPTY_ELEMENT or ET_AL."""
    return _p5_all(spark, d, errors=True).groupBy("table_name", "error_flag").agg(F.count(F.lit(1)).alias("elements"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphan_references(
        table(spark, d, "publications"),
        "publication_id",
        "loaded_at",
        {
            "researchers": ("researcher_id", table(spark, d, "researchers"), "researcher_id"),
            "journals": ("journal_id", table(spark, d, "journals"), "journal_id"),
        },
    )
    return found.withColumnRenamed("record_id", "publication_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(p7_found(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p5_found": p5_found,
    "p5_errors": p5_errors,
    "p7_found": p7_found,
    "p7_report": p7_report,
}

_P7 = """
WITH refs AS (
  SELECT 'researchers' AS ref_table, researcher_id AS k, loaded_at, publication_id FROM publications WHERE researcher_id IS NOT NULL
  UNION ALL
  SELECT 'journals', journal_id, loaded_at, publication_id FROM publications WHERE journal_id IS NOT NULL),
parents AS (
  SELECT 'researchers' AS ref_table, researcher_id AS k, loaded_at, deleted_at FROM researchers
  UNION ALL SELECT 'journals', journal_id, loaded_at, deleted_at FROM journals),
found AS (
  SELECT DISTINCT r.ref_table, strftime(r.loaded_at AT TIME ZONE 'UTC', '%Y-%m') AS period, r.publication_id
  FROM refs r
  WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.ref_table = r.ref_table AND p.k = r.k
    AND p.loaded_at <= r.loaded_at AND (p.deleted_at IS NULL OR p.deleted_at > r.loaded_at)))
"""

ORACLES: dict[str, str] = {
    "p7_found": _P7 + "SELECT ref_table, period, publication_id FROM found",
    "p7_report": _P7 + "SELECT ref_table, period, count(*) AS orphans FROM found GROUP BY ref_table, period",
}

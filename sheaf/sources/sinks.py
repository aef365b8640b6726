"""Writers: tables as CSV and JSON, audits that are written even when empty, and versioned publishing."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.text import csv_safe
from sheaf.session import hadoop_path


def flat_text(df: DataFrame) -> DataFrame:
    """All columns as text: arrays joined with '; ', booleans in lower case, whole numbers without '.0', no formulas."""
    cols = []
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind == "array":
            c = F.array_join(c.cast("array<string>"), "; ")
        elif kind == "double":
            c = F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
        elif kind in ("struct", "map"):
            c = F.to_json(c)
        else:
            c = c.cast("string")
        cols.append((csv_safe(c) if kind == "string" else c).alias(f.name))
    return df.select(*cols)


def write_tables(tables: dict[str, DataFrame], path: str, prefix: str, files: int | None = None) -> None:
    """Each table as CSV and as JSON under `<path>/<prefix>_<table>_{csv,json}`; files: into so many files (small tables only)."""
    for name, df in tables.items():
        out = df.coalesce(files) if files else df
        flat_text(out).write.mode("overwrite").options(header=True, escape='"').csv(f"{path}/{prefix}_{name}_csv")
        out.write.mode("overwrite").json(f"{path}/{prefix}_{name}_json")


def write_audit(dropped: DataFrame, path: str) -> None:
    """Dropped rows with their reason; an empty table instead of a missing one."""
    dropped.write.mode("overwrite").parquet(path)


def publish(df: DataFrame, root: str, batch_id: int | None = None) -> str:
    """Writes a new version beside the old ones and then moves the pointer file, so readers see one or the other.

    The pointer is replaced through Hadoop's file system, on whatever storage root lies; earlier versions stay as
    backups. With batch_id, the pointer also says which batch was the last, see published_batch.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs, draft = hadoop_path(spark, f"{root}/.draft-{version}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"version": version, "batch": batch_id}).encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    over[0] = jvm.Options.Rename.OVERWRITE
    target = jvm.Path(f"{root}/{POINTER}")
    jvm.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(target), over)
    return version


POINTER = "current.json"


def _pointer(spark: SparkSession, root: str) -> dict:
    fs, at = hadoop_path(spark, f"{root}/{POINTER}")
    if not fs.exists(at):
        raise FileNotFoundError(f"{root}/{POINTER}")
    return json.loads(spark.read.text(f"{root}/{POINTER}", wholetext=True).first()[0])


def published(spark: SparkSession, root: str) -> DataFrame:
    """The current version; FileNotFoundError where nothing was published."""
    return spark.read.parquet(f"{root}/{_pointer(spark, root)['version']}")


def published_batch(spark: SparkSession, root: str) -> int | None:
    """The batch that was published last, None where there is none."""
    try:
        return _pointer(spark, root).get("batch")
    except FileNotFoundError:
        return None


def quality_report(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """One row of JSON: rows, and for each named condition how many fulfil it."""
    got = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.expr(c)).alias(n) for n, c in checks.items()])
    return got.select(F.to_json(F.struct("*")).alias("report"))

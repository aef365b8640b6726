"""Incremental mode: the batch operators over files that keep arriving, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 64) -> DataFrame:
    """A stream of parquet files as they come, with the schema of an example."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_of_key(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed, so the state is bounded by time."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, key: str, window: str, late: str) -> DataFrame:
    """Rows per key and tumbling window, late rows within the watermark included."""
    got = stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n_rows"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n_rows")


def run_available(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there and stops; a later run goes on from the checkpoint."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)
    q.awaitTermination()
    return q


def upsert_available(stream: DataFrame, checkpoint: str, root: str, key: str, order: str | None = None) -> StreamingQuery:
    """Each micro-batch merged into a published table, the last row of a key winning; versions are swapped whole.

    Within a batch the last row is the one with the greatest order (equal ones, or without order all, by their
    values). The pointer names the batch it holds, so a batch that is replayed after a failure changes nothing.
    """
    from sheaf.operators.dedup import last_rows
    from sheaf.sources.sinks import publish, published, published_batch

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = published_batch(spark, root)
        if done is not None and done >= batch_id:
            return
        new = last_rows(batch, [key], [F.col(order)] if order else [])
        try:
            new = published(spark, root).join(new.select(key), key, "left_anti").unionByName(new)
        except FileNotFoundError:
            pass
        publish(new, root, batch_id)

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q

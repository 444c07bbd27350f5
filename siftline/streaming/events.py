"""Streams of events: ingestion, windows, quotas and per-finding state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", per_trigger: int = 100) -> DataFrame:
    """Event files of a folder as a stream; ``per_trigger`` throttles the source."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; works on streams and tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand everything that is there to ``sink`` in micro-batches, then end."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_sink(path: str, key: str, columns: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that merges micro-batches into versions of a Parquet table below ``path``; a batch that runs again overwrites its own version."""
    from ..operators.dedup import upsert

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        if epoch:
            new = upsert(spark.read.parquet(f"{path}/v={epoch - 1}"), new, key, columns)
        new.write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return sink


def debate_progress(rounds: DataFrame, stop_confidence: float = 0.85) -> DataFrame:
    """Per finding: rounds seen, best confidence and whether it has converged, as streaming aggregates."""
    best = rounds.groupBy("finding_id").agg(F.count("*").alias("rounds"), F.max("confidence").alias("best"), F.sum("tokens").alias("tokens"))
    return best.withColumn("converged", F.col("best") >= stop_confidence)

"""Incremental scans as Structured Streaming: batches merge findings first, then the ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import ledger as L
from lodestone.sources.sinks import merge_into, read_table


def scan_stream(objects: DataFrame, scan: Callable[[DataFrame], tuple[DataFrame, DataFrame]], findings_path: str, ledger_path: str, checkpoint: str, finding_keys: list[str]):
    """Run a stream of objects with ledger keys to its present end.

    scan returns (findings, ledger entries) of a batch.  Items with a terminal
    entry are skipped.  Both merges are idempotent, so that a batch that is
    run again changes nothing: findings are durable before the ledger says so.
    Both tables are there in the end, if only empty ones.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        done = read_table(rows.sparkSession, ledger_path)
        found, entries = scan(rows if done is None else L.left_to_scan(rows, done))
        merge_into(findings_path, found, lambda all_: all_.dropDuplicates(finding_keys), finding_keys)
        merge_into(ledger_path, entries, L.merge, L.KEYS)

    query = objects.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = objects.sparkSession
    if any(read_table(spark, path) is None for path in (findings_path, ledger_path)):
        batch(spark.createDataFrame([], objects.schema), -1)
    return query


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and window, for batch and stream alike; ts becomes an instant for the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

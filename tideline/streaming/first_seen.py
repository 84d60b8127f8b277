"""First time each (user, event type) pair was seen, kept up to date from a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.session import checkpoint_root

KEYS = ["user_id", "event_type"]


def first_seen_batch(events: DataFrame) -> DataFrame:
    return events.groupBy(*KEYS).agg(F.min("ts").alias("first_ts"))


def start_first_seen(events: DataFrame, target: str, checkpoint: str):
    """Stream ``events`` and write each batch's changed minima under ``target``.

    The running minimum lives in the state store, so a late event can still
    lower it.  A batch replaces only its own folder, which makes a replay
    after a failure harmless.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        first_seen_batch(events)
        .writeStream.outputMode("update")
        .foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current(spark: SparkSession, target: str) -> DataFrame:
    """Latest value per key: minima only decrease, so the smallest written one is current."""
    return spark.read.parquet(target).groupBy(*KEYS).agg(F.min("first_ts").alias("first_ts"))


def run_first_seen(spark: SparkSession, root: str) -> DataFrame:
    """Drain the events file as a stream and return the table."""
    schema = spark.read.parquet(f"{root}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{root}/events.parquet*")
    base = f"{checkpoint_root(spark)}/first-seen-{uuid.uuid4().hex}"
    query = start_first_seen(events, f"{base}/table", f"{base}/state")
    query.awaitTermination()
    return current(spark, f"{base}/table")

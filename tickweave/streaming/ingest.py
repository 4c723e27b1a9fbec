"""Extension: series from streams. Micro-batches are committed to a store, or aggregated over windows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickweave.sources.store import Store


def write_stream(tall: DataFrame, store: Store, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Commit every micro-batch of a streaming tall DataFrame; a late batch is merged on read like any overlapping one.

    A batch's segment is named after the checkpoint and its number, so a batch
    that is replayed after a failure is not committed again.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def commit(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.append(batch, f"stream-{run}-{number}")

    writer = tall.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed(ticks: DataFrame, keys: list[str], ts: str, value: str, width: str, late: str) -> DataFrame:
    """Count, least, largest and mean of a value in tumbling windows, rows later than ``late`` left out.

    Streams need a timestamp with time zone for their watermark, so ``ts`` is cast.
    """
    rows = ticks.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return rows.groupBy(*keys, F.window("__ts", width).alias("w")).agg(
        F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean")
    ).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "low", "high", "mean")

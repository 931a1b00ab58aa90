"""Attribute updates as a stream: upserts per micro-batch, and running profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..sources.tabular import parse_updates


def upsert_stream(messages: DataFrame, path: str, checkpoint: str, on_change: Callable[[DataFrame, int], None] | None = None):
    """Start a query that appends parsed updates to a Parquet table under ``path``, one folder a batch.

    A batch that is run again overwrites its own folder, so each update counts once.
    ``on_change`` gets the batch's rows after they are saved.
    """
    def save(batch: DataFrame, number: int) -> None:
        rows = parse_updates(batch)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if on_change is not None:
            on_change(batch.sparkSession.read.parquet(f"{path}/batch={number}"), number)

    return messages.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(updates: DataFrame) -> DataFrame:
    """The last value of each attribute of each node; updates may arrive in any order."""
    return updates.groupBy("id", "attribute").agg(F.max_by(F.struct("time", "value", "type"), "time").alias("s")).select("id", "attribute", "s.*")


def windowed_profile(events: DataFrame, time: str, value: str, width: str, late: str) -> DataFrame:
    """Counts and sums of tumbling windows, closed once ``late`` has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(value).alias("n"), F.sum(value).alias("total"))

"""Micro-batch scoring: resumable, idempotent by id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "id", event_time: str | None = None, lateness: str = "1 hour") -> StreamingQuery:
    """Score a stream of cards into path. Repeated ids are scored once: within the watermark if there is an event time.

    A batch that runs again after a failure replaces its own folder, so the answer has no doubles.
    """
    once = stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([key]) if event_time else stream.dropDuplicates([key])

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

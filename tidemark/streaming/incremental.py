"""The incremental merge as a stream: each micro-batch of fetched rows is merged into the table [E01-E05 E09]."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.merge import upsert
from tidemark.operators.sinks import recovered, replace_table


def merging(table: str, key: str, now: Callable[[], str], sequence: str | None = None, compare: tuple[str, ...] = ("data_hash",)) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch. A batch that is delivered again changes nothing: its rows are already there."""

    def merge(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        kept = batch.sparkSession.read.parquet(recovered(batch.sparkSession, table))
        made = upsert(kept, batch, key, now(), compare, sequence=sequence)
        replace_table(made.drop("change"), table, [key])

    return merge


def start(fetched: DataFrame, table: str, checkpoint: str, key: str, now: Callable[[], str], sequence: str | None = None, compare: tuple[str, ...] = ("data_hash",)) -> StreamingQuery:
    """Merges all that a streaming frame has to offer, then stops."""
    return fetched.writeStream.foreachBatch(merging(table, key, now, sequence, compare)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Events by day of a stream, closed when the watermark has passed [A16]."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day")).agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")

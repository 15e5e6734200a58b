"""Counts over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sigloom.operators import aggregates
from sigloom.sources.batches import BATCH, BatchTable


def rate_per_minute(
    stream: DataFrame,
    time: str = "timestamp",
    width: str = "1 minute",
    slide: str | None = None,
    keep: str = "60 minutes",
    amount: str | None = None,
) -> DataFrame:
    """Rows (or the sum of ``amount``) per window; windows are kept for ``keep``."""
    counted = F.sum(amount) if amount else F.count(F.lit(1))
    return (
        stream.withWatermark(time, keep)
        .groupBy(F.window(time, width, slide))
        .agg(counted.cast("bigint").alias("signals"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "signals",
        )
    )


def on_batch(
    stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> DataStreamWriter:
    """Hand every micro-batch and its number to user code."""
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(callback)
        .option("checkpointLocation", checkpoint)
    )


def keep_updates(stream: DataFrame, table: BatchTable, checkpoint: str) -> DataStreamWriter:
    """Write the changed windows of every micro-batch; ``current_windows`` reads the values."""

    def put(batch: DataFrame, batch_id: int) -> None:
        table.put(batch.withColumn("day", F.to_date("window_start")), batch_id)

    return on_batch(stream, put, checkpoint, mode="update")


def newest(updates: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The value each key had in the last batch that touched it."""
    return updates.groupBy(*keys).agg(*[F.max_by(v, BATCH).alias(v) for v in values])


def window_table(
    spark: SparkSession, root: str, keep_minutes: int | None = 60, every: int = 50
) -> BatchTable:
    """A table for ``keep_updates``: the newest count of every window, laid out by the window's day.

    Windows that ended ``keep_minutes`` or more before the newest end are dropped as the
    table is merged; ``current_windows`` leaves them out at once.
    """

    def merge(rows: DataFrame) -> DataFrame:
        kept = (
            rows.groupBy("window_start", "window_end")
            .agg(F.max_by("signals", BATCH).alias("signals"), F.max(BATCH).alias(BATCH))
        )
        return _recent_windows(kept, keep_minutes).withColumn("day", F.to_date("window_start"))

    return BatchTable(spark, root, merge, every, ["day"])


def _recent_windows(windows: DataFrame, keep_minutes: int | None) -> DataFrame:
    if keep_minutes is None:
        return windows
    bound = windows.agg(F.max("window_end") - F.make_dt_interval(mins=F.lit(keep_minutes))).scalar()
    return windows.where(F.col("window_end") > bound)


def current_windows(table: BatchTable, keep_minutes: int | None = 60) -> DataFrame:
    """``(window_start, window_end, signals)`` of the windows kept."""
    windows = newest(table.read(), ["window_start", "window_end"], ["signals"])
    return _recent_windows(windows, keep_minutes)


def pattern_rate(
    stream: DataFrame,
    collect: Callable[[DataFrame], DataFrame],
    table: BatchTable,
    checkpoint: str,
    message: str = "message",
) -> DataStreamWriter:
    """Pattern counts of every message; ``collect`` gives its signals with ``patterns``.

    The number of the message is a column of the data, so the counts do not depend on how messages share
    micro-batches.  ``message_totals`` adds up a message whose signals came in several.
    """

    def count(batch: DataFrame, batch_id: int) -> None:
        table.put(aggregates.pattern_distribution(collect(batch), [message]), batch_id)

    return on_batch(stream, count, checkpoint)


def message_totals(rows: DataFrame, keys: list[str], value: str = "signals") -> DataFrame:
    """Counts of one message from all micro-batches it came in."""
    return rows.groupBy(*keys).agg(F.sum(value).alias(value))

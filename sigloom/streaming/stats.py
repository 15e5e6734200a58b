"""Running statistics of a streaming feed."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sigloom.sources.batches import BatchTable
from sigloom.streaming.rates import on_batch
from sigloom.streaming.refresh import utc_now

#: One row for every micro-batch of a feed.
LOG = "time timestamp_ntz, count bigint, error string, first_timestamp string"


def logged(
    feed: DataFrame,
    send: Callable[[DataFrame, int], None],
    log: BatchTable,
    checkpoint: str,
    first: Column | None = None,
    keep_going: bool = False,
    clock: Callable[[], datetime] = utc_now,
) -> DataStreamWriter:
    """Hand every micro-batch to ``send``, which has to write it, and one row about it to ``log``.

    The rows are counted as they pass, without another pass over them; ``first`` is an aggregate that
    tells the time of the batch's first row.  The row replaces its own if the batch is repeated, so
    totals over the log hold however long the query runs and however often it is started.  A failure is
    logged and ends the query; with ``keep_going`` it is only logged.
    """

    def watched(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        newest = F.lit(None) if first is None else first
        told = batch.observe(
            seen, F.count(F.lit(1)).alias("count"), newest.cast("string").alias("first_timestamp")
        )
        problem = None
        try:
            send(told, batch_id)
        except Exception as failure:  # noqa: BLE001 - any failure of a feed is counted
            problem = failure
        if problem is None:
            row = (clock(), seen.get["count"], None, seen.get["first_timestamp"])
        else:
            row = (clock(), 0, str(problem)[:1000], None)
        log.put(batch.sparkSession.createDataFrame([row], LOG).coalesce(1), batch_id)
        if problem is not None and not keep_going:
            raise problem

    return on_batch(feed, watched, checkpoint)

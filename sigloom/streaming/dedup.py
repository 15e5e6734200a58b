"""Showing every signal once."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sigloom.operators import ranking
from sigloom.sources.batches import BATCH, BatchTable
from sigloom.streaming.rates import on_batch
from sigloom.streaming.refresh import utc_now


def dedup_seen(
    alerts: DataFrame,
    key: str = "signal_id",
    time: str = "signal_timestamp",
    delay: str = "48 hours",
) -> DataFrame:
    """Each key once, for a stream about in order of time.

    A key is remembered until the watermark is ``delay`` past its time; with a delay not shorter
    than the lookback a repeated signal is either still known or too late to be let in.  For histories
    in any order see ``show_once``.
    """
    return alerts.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


class SeenKeys:
    """The keys shown so far, as a stored table in buckets of a hash of the key.

    ``keep`` is how long a key is remembered after it was shown, by the clock and not by the data:
    a history read in any order loses nothing.  A key older than the source's lookback cannot
    come again, so a ``keep`` not shorter than that forgets nothing that is needed.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        key: str = "signal_id",
        keep: timedelta | None = None,
        buckets: int = 64,
        every: int = 50,
        clock: Callable[[], datetime] = utc_now,
    ):
        self.key, self.keep, self.buckets, self.clock = key, keep, buckets, clock
        self.table = BatchTable(spark, root, self._remembered, every, ["bucket"])

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        return rows.withColumn("bucket", bucket)

    def _remembered(self, rows: DataFrame) -> DataFrame:
        # A key shown again counts from then on, so what is forgotten goes first.
        fresh = rows.where(self._fresh()) if self.keep is not None else rows
        return fresh.groupBy("bucket", self.key).agg(
            F.min("seen_at").alias("seen_at"), F.min(BATCH).alias(BATCH)
        )

    def _fresh(self):
        bound = self.clock() - self.keep
        return F.col("seen_at") > F.lit(bound.isoformat(sep=" ")).cast("timestamp_ntz")

    def unseen(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Rows whose key no batch before has shown; null keys count as one key.

        Only the buckets the batch has keys in are read, at most ``buckets`` numbers to the driver.
        """
        if self.table.empty():
            return rows
        cut = self._bucketed(rows)
        present = [r["bucket"] for r in cut.select("bucket").distinct().collect()]
        seen = self.table.read().where(F.col("bucket").isin(present) & (F.col(BATCH) < batch_id))
        if self.keep is not None:
            seen = seen.where(self._fresh())
        known = seen.select(F.col("bucket").alias("_bucket"), F.col(self.key).alias("_key"))
        same = (F.col("bucket") == F.col("_bucket")) & F.col(self.key).eqNullSafe(F.col("_key"))
        return cut.join(known, same, "left_anti").drop("bucket")

    def put(self, rows: DataFrame, batch_id: int) -> None:
        now = F.lit(self.clock().isoformat(sep=" ")).cast("timestamp_ntz")
        self.table.put(self._bucketed(rows.select(self.key, now.alias("seen_at"))), batch_id)


def show_once(
    alerts: DataFrame, shown: BatchTable, seen: SeenKeys, checkpoint: str, order: str = "signal_timestamp"
) -> DataStreamWriter:
    """Each key once, whatever the order in which the history comes, over any number of runs.

    The state is the stored table; the stream keeps none.  Of several rows of one key in a
    micro-batch the earliest is shown.  A repeated micro-batch shows the same rows again.
    """

    def show(batch: DataFrame, batch_id: int) -> None:
        first = ranking.distinct_on(batch, [seen.key], [F.asc_nulls_last(order)])
        shown.put(seen.unseen(first, batch_id), batch_id)
        seen.put(shown.written(batch_id), batch_id)

    return on_batch(alerts, show, checkpoint)

"""Event sink and versioned snapshot table."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sigloom.operators import positions

HEAD_SCHEMA = (
    "turn bigint, version bigint, row_count bigint, place bigint, written double, "
    "starts map<int, bigint>"
)


def read_if_present(
    spark: SparkSession, path: str, schema: str, **options: bool | str
) -> DataFrame | None:
    """The Parquet files below ``path``, or None as long as nothing has been written there."""
    try:
        return spark.read.options(**options).schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def event_sink(events: DataFrame, checkpoint: str) -> DataStreamWriter:
    """A writer that appends event payloads as text lines, one folder per channel.

    ``events`` has the columns ``channel`` and ``value``; finish with ``.start(path)``.
    """
    return (
        events.select("channel", "value")
        .writeStream.outputMode("append")
        .format("text")
        .partitionBy("channel")
        .option("checkpointLocation", checkpoint)
    )


def kafka_event_sink(events: DataFrame, servers: str, checkpoint: str) -> DataStreamWriter:
    """The same with the channel as Kafka topic (needs the Kafka connector on the classpath)."""
    return (
        events.select(F.col("channel").alias("topic"), "value")
        .writeStream.outputMode("append")
        .format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", checkpoint)
    )


class SnapshotTable:
    """A table that is replaced as a whole and keeps serving its last complete version.

    A version keeps the order in which its frame was published: rows are stored with their task of the
    sort and their place in it, the head has the number of rows before each task, and readers
    get the place in the whole as the column ``pos``.

    Versions rotate through folders, so nothing has to be deleted as they come and go.  A folder is
    used again once ``keep`` of them exist and its version was replaced ``hold_seconds`` ago or
    earlier; until then a reader may hold on to it, however fast versions follow.  A one-row
    head is written after the data; readers follow the newest head and never see a half-written
    version.  A version broken off half-way has no head, and its folder is the next one to be
    overwritten.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 8, hold_seconds: float = 600):
        if keep < 2:
            raise ValueError("keep at least two versions")
        self.spark = spark
        self.root = root.rstrip("/")
        self.keep = keep
        self.hold_seconds = hold_seconds

    def _data(self, place: int) -> str:
        return f"{self.root}/data/slot={place}"

    def _heads(self) -> list[Row]:
        """Newest first; the oldest may be missing while it is being overwritten."""
        heads = read_if_present(
            self.spark, f"{self.root}/heads/slot=*", HEAD_SCHEMA, ignoreMissingFiles=True
        )
        return [] if heads is None else heads.orderBy(F.desc("turn")).collect()

    def _next_place(self, heads: list[Row], now: float) -> int:
        if len(heads) >= self.keep and heads[-2]["written"] <= now - self.hold_seconds:
            return heads[-1]["place"]
        return max((h["place"] for h in heads), default=-1) + 1

    def replace(self, snapshot: DataFrame, version: int) -> None:
        """Publish ``snapshot`` as ``version`` (a batch number; a repeated batch publishes again)."""
        heads = self._heads()
        turn = heads[0]["turn"] + 1 if heads else 0
        place = self._next_place(heads, time.time())
        stored = positions.written_in_order(snapshot, self._data(place))
        parts = positions.part_totals(stored)
        row_count = sum(p["rows"] for p in parts)
        head = [(turn, version, row_count, place, time.time(), positions.starts(parts))]
        frame = self.spark.createDataFrame(head, HEAD_SCHEMA).coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.root}/heads/slot={place}")

    def latest_version(self) -> int | None:
        """Newest complete version, or None before the first one."""
        heads = self._heads()
        return heads[0]["version"] if heads else None

    def latest(self, in_order: bool = True) -> DataFrame:
        """The last complete snapshot with ``pos``, without recomputing it, sorted by ``pos``."""
        heads = self._heads()
        if not heads:
            raise LookupError(f"no snapshot under {self.root}")
        stored = self.spark.read.parquet(self._data(heads[0]["place"]))
        rows = positions.positioned(stored, heads[0]["starts"])
        return rows.orderBy("pos") if in_order else rows

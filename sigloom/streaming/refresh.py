"""Snapshot refresh: probe, gate, policy, and the ``foreachBatch`` that ties them together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sigloom.sources.sinks import SnapshotTable, read_if_present


#: Version of the snapshot published before the first micro-batch.
START_VERSION = -1


@dataclass(frozen=True)
class GateState:
    """What the last change left behind, and when the last refresh ran."""

    max_id: int = 0
    max_timestamp: datetime | None = None
    refreshed_at: datetime | None = None


def gate_change(
    newest: int | None,
    time: datetime | None,
    state: GateState,
    by_time: bool = True,
    failed: bool = False,
) -> tuple[bool, GateState]:
    """Whether a probe shows a change, and the state to keep.

    A change is a larger id or, unless ``by_time`` is off, a different newest time.  An empty
    window is no change.  On a change both values are taken over, also when the id went down.  A failed
    probe counts as a change, so that nothing is missed, and leaves the state as it is.
    """
    if failed:
        return True, state
    if not newest:
        return False, state
    time = time if by_time else None
    changed = newest > state.max_id or (time is not None and time != state.max_timestamp)
    if not changed:
        return False, state
    return True, replace(state, max_id=newest, max_timestamp=time)


def check_gate(
    probe: Row | None, state: GateState, by_time: bool = True, failed: bool = False
) -> tuple[bool, GateState]:
    """``gate_change`` of a row with ``max_id`` and ``max_timestamp``."""
    values = probe.asDict() if probe is not None else {}
    return gate_change(values.get("max_id"), values.get("max_timestamp"), state, by_time, failed)


def probed(probe: Callable[[], DataFrame]) -> tuple[Row | None, Exception | None]:
    """The row of a probe, or what it failed with."""
    try:
        return probe().first(), None
    except Exception as problem:  # noqa: BLE001 - any failure of a probe counts as a change
        return None, problem


class GateStore:
    """One small state row per micro-batch, so that a repeated batch starts from the same state.

    The rows rotate through ``keep`` folders; only the ones just before a batch are ever needed.
    """

    SCHEMA = "batch_id bigint, max_id bigint, max_timestamp timestamp, refreshed_at timestamp"

    def __init__(self, spark: SparkSession, root: str, keep: int = 16):
        self.spark = spark
        self.root = root.rstrip("/")
        self.keep = keep

    def before(self, batch_id: int) -> GateState:
        """State left by the batches before ``batch_id``."""
        rows = read_if_present(self.spark, f"{self.root}/slot=*", self.SCHEMA)
        if rows is None:
            return GateState()
        last = rows.filter(F.col("batch_id") < batch_id).orderBy(F.desc("batch_id")).first()
        if last is None:
            return GateState()
        return GateState(last["max_id"], last["max_timestamp"], last["refreshed_at"])

    def put(self, batch_id: int, state: GateState) -> None:
        row = [(batch_id, state.max_id, state.max_timestamp, state.refreshed_at)]
        frame = self.spark.createDataFrame(row, self.SCHEMA).coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.root}/slot={batch_id % self.keep}")


@dataclass(frozen=True)
class RefreshPolicy:
    """When to probe and when to refresh without a change.

    Event mode probes rarely, as a safety net behind the events.  Poll mode probes often and, with
    ``force_seconds``, refreshes anyway once the last refresh is that old.
    """

    probe_seconds: int = 1
    force_seconds: int | None = 30

    @classmethod
    def event_mode(cls, safety_seconds: int = 60) -> RefreshPolicy:
        return cls(probe_seconds=safety_seconds, force_seconds=None)

    @classmethod
    def poll_mode(cls, probe_seconds: int = 1, query_interval: int | None = 30) -> RefreshPolicy:
        return cls(probe_seconds=probe_seconds, force_seconds=query_interval)

    def trigger(self) -> dict[str, str]:
        """Arguments for ``DataStreamWriter.trigger``."""
        return {"processingTime": f"{self.probe_seconds} seconds"}

    def due(self, changed: bool, now: datetime, refreshed_at: datetime | None) -> bool:
        if changed or self.force_seconds is None:
            return changed
        if refreshed_at is None:
            return True
        return (now - refreshed_at).total_seconds() >= self.force_seconds


def utc_now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def publish_at_start(build: Callable[[], DataFrame], table: SnapshotTable) -> bool:
    """Publish a first snapshot where there is none, so that readers need not wait for a change."""
    if table.latest_version() is not None:
        return False
    table.replace(build(), START_VERSION)
    return True


def snapshot_refresh(
    changes: DataFrame,
    build: Callable[[], DataFrame],
    table: SnapshotTable,
    checkpoint: str,
    at_start: bool = True,
) -> DataStreamWriter:
    """Rebuild and replace the snapshot after every micro-batch of changes.

    ``build`` runs the batch feed; it should read its tables anew, since rows also leave the window
    by age.  All changes of one micro-batch share one rebuild.  The first snapshot is published
    here, before any change, unless ``at_start`` is off.
    """
    if at_start:
        publish_at_start(build, table)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        table.replace(build(), batch_id)

    return changes.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)


def gated_refresh(
    ticks: DataFrame,
    probe: Callable[[], DataFrame],
    build: Callable[[], DataFrame],
    table: SnapshotTable,
    store: GateStore,
    checkpoint: str,
    policy: RefreshPolicy | None = None,
    by_time: bool = True,
    clock: Callable[[], datetime] = utc_now,
    at_start: bool = True,
) -> DataStreamWriter:
    """Probe at every micro-batch and rebuild the snapshot only when the policy says so.

    ``ticks`` is any stream that fires at the probing interval, such as a ``rate`` source.  A probe that
    fails counts as a change.  The first snapshot is published here, before any probe, unless
    ``at_start`` is off; its time is that of the last refresh.
    """
    rules = policy or RefreshPolicy()
    if at_start and publish_at_start(build, table):
        store.put(START_VERSION, GateState(refreshed_at=clock()))

    def check(batch: DataFrame, batch_id: int) -> None:
        now = clock()
        state = store.before(batch_id)
        found, problem = probed(probe)
        changed, following = check_gate(found, state, by_time, problem is not None)
        if rules.due(changed, now, state.refreshed_at):
            table.replace(build(), batch_id)
            following = replace(following, refreshed_at=now)
        store.put(batch_id, following)

    return (
        ticks.writeStream.foreachBatch(check)
        .option("checkpointLocation", checkpoint)
        .trigger(**rules.trigger())
    )


def buffer_replace(
    feed: DataFrame,
    shape: Callable[[DataFrame], DataFrame],
    table: SnapshotTable,
    checkpoint: str,
    message: str | None = None,
) -> DataStreamWriter:
    """Keep only the shaped rows of the newest message; nothing is appended to older ones.

    The column ``message`` numbers the messages; without it a micro-batch counts as one.
    """

    def swap(batch: DataFrame, batch_id: int) -> None:
        if message is not None:
            newest = batch.agg(F.max(message)).first()[0]
            batch = batch.filter(F.col(message).eqNullSafe(F.lit(newest)))
        table.replace(shape(batch), batch_id)

    return feed.writeStream.foreachBatch(swap).option("checkpointLocation", checkpoint)

"""Gate and refresh policy as keyed state over a stream of probes.

A probe is a row: the feed it belongs to, its time, what it found (``max_id``, ``max_timestamp``) or the
``error`` it ended with.  The state of a feed is what the last change left behind, the time of
the last refresh and of the last probe; a timer refreshes a feed that is no longer probed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigloom.streaming.refresh import GateState, RefreshPolicy, gate_change

PROBE = "feed string, probe_time timestamp, max_id bigint, max_timestamp timestamp, error string"

_EPOCH = datetime(1970, 1, 1)
_STATE = "max_id bigint, max_timestamp bigint, refreshed_at bigint, probed_at bigint"
_DECISION = (
    "feed string, probe_time bigint, max_id bigint, max_timestamp bigint, error string, "
    "changed boolean, refresh boolean, reason string"
)


class Probe(NamedTuple):
    time: datetime
    max_id: int | None = None
    max_timestamp: datetime | None = None
    error: str | None = None


class Decision(NamedTuple):
    """What follows from a probe.  ``reason``: ``error``, ``change``, ``age``, ``timer``, ``late`` or None."""

    probe: Probe
    changed: bool
    refresh: bool
    reason: str | None


@dataclass(frozen=True)
class FeedState:
    gate: GateState = GateState()
    probed_at: datetime | None = None


@dataclass(frozen=True)
class GateRules:
    """The policy; whether the newest time counts; whether a feed that is not probed is refreshed."""

    policy: RefreshPolicy = RefreshPolicy()
    by_time: bool = True
    timer: bool = False

    def next_refresh(self, state: FeedState) -> datetime | None:
        """When the timer refreshes the feed."""
        force, last = self.policy.force_seconds, state.gate.refreshed_at
        if not self.timer or force is None or last is None:
            return None
        return last + timedelta(seconds=force)

    def timed(self, state: FeedState, until: datetime, included: bool) -> tuple[list[Decision], FeedState]:
        """Refreshes of the timer up to a time."""
        out = []
        while (due := self.next_refresh(state)) is not None and (due < until or included and due == until):
            out.append(Decision(Probe(due), False, True, "timer"))
            state = replace(state, gate=replace(state.gate, refreshed_at=due))
        return out, state

    def decided(self, probe: Probe, state: FeedState) -> tuple[Decision, FeedState]:
        """One probe.  A failed one counts as a change and leaves what is known as it is."""
        if state.probed_at is not None and probe.time < state.probed_at:
            return Decision(probe, False, False, "late"), state
        changed, gate = gate_change(
            probe.max_id, probe.max_timestamp, state.gate, self.by_time, probe.error is not None
        )
        refresh = self.policy.due(changed, probe.time, gate.refreshed_at)
        reason = None
        if refresh:
            gate = replace(gate, refreshed_at=probe.time)
            reason = "error" if probe.error is not None else "change" if changed else "age"
        return Decision(probe, changed, refresh, reason), FeedState(gate, probe.time)

    def walked(self, probes: Iterable[Probe], state: FeedState) -> tuple[list[Decision], FeedState]:
        """Probes of one feed in order of time, with the timer's refreshes between them."""
        out: list[Decision] = []
        for probe in sorted(probes, key=_order):
            timed, state = self.timed(state, probe.time, included=False)
            decision, state = self.decided(probe, state)
            out += [*timed, decision]
        return out, state


def _order(probe: Probe) -> tuple:
    """Time, then newest time and id, nothing found first."""
    found, number = probe.max_timestamp, probe.max_id
    return (
        probe.time,
        found is not None, found or _EPOCH,
        number is not None, number or 0,
        probe.error or "",
    )


def _micros(time: datetime | None) -> int | None:
    return None if time is None else (time - _EPOCH) // timedelta(microseconds=1)


def _time(micros: int | None) -> datetime | None:
    return None if pd.isna(micros) else _EPOCH + timedelta(microseconds=int(micros))


def _restored(state: GroupState) -> FeedState:
    if not state.exists:
        return FeedState()
    max_id, max_timestamp, refreshed_at, probed_at = state.get
    gate = GateState(int(max_id), _time(max_timestamp), _time(refreshed_at))
    return FeedState(gate, _time(probed_at))


def _frame(feed: str, decisions: list[Decision]) -> pd.DataFrame:
    rows = [
        (feed, _micros(p.time), p.max_id, _micros(p.max_timestamp), p.error, changed, refresh, reason)
        for p, changed, refresh, reason in decisions
    ]
    names = [c.split()[0] for c in _DECISION.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    for name in ("probe_time", "max_id", "max_timestamp"):
        frame[name] = frame[name].astype("Int64")
    return frame


def gated(probes: DataFrame, rules: GateRules = GateRules(), delay: str = "1 minute") -> DataFrame:
    """A decision for every probe of a stream, and one for every refresh of the timer.

    Probes that come within ``delay`` of the newest one are all decided; one that is older than a
    probe of its feed decided before changes nothing (``late``).  The probes of one feed in one
    micro-batch are put in order in the task's memory, some 100 bytes each; ``maxFilesPerTrigger`` bounds
    them.  The result is the same however the stream is cut into micro-batches, as long as their
    order is that of time.
    """

    def step(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        known = _restored(state)
        if state.hasTimedOut:
            # Spark fires timers below the watermark, in whole milliseconds.
            until = _time((state.getCurrentWatermarkMs() - 1) * 1000)
            decisions, known = rules.timed(known, until, included=True)
        else:
            found = [
                Probe(
                    _time(row.probe_time),
                    None if pd.isna(row.max_id) else int(row.max_id),
                    _time(row.max_timestamp),
                    None if pd.isna(row.error) else row.error,
                )
                for frame in frames
                for row in frame.itertuples(index=False)
            ]
            decisions, known = rules.walked(found, known)
        gate = known.gate
        state.update(
            (gate.max_id, _micros(gate.max_timestamp), _micros(gate.refreshed_at), _micros(known.probed_at))
        )
        due = rules.next_refresh(known)
        if due is not None:
            # Timers count in milliseconds; the next one above is never too early.
            state.setTimeoutTimestamp(-(-_micros(due) // 1000))
        yield _frame(key[0], decisions)

    named = probes.select(
        "feed",
        F.col("probe_time").alias("_at"),
        F.unix_micros("probe_time").alias("probe_time"),
        "max_id",
        F.unix_micros("max_timestamp").alias("max_timestamp"),
        "error",
    )
    decided = (
        named.withWatermark("_at", delay)
        .groupBy("feed")
        .applyInPandasWithState(step, _DECISION, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
    return decided.withColumns(
        {c: F.timestamp_micros(c) for c in ("probe_time", "max_timestamp")}
    )

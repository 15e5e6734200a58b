"""The keyed gate against a plain loop."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sigloom.plans import monitoring
from sigloom.sources.changes import change_source
from sigloom.sources.sinks import SnapshotTable
from sigloom.streaming import refresh
from sigloom.streaming.gate import PROBE, FeedState, GateRules, Probe, gated
from sigloom.streaming.refresh import GateStore, RefreshPolicy
from tests.conftest import rows
from tests.test_streaming import run

NOW = datetime(2024, 1, 31)


def some_probes(seed=7, count=400, feeds=("a", "b", "c")):
    """Times that never repeat in a feed; empty windows, failures, ids that fall."""
    rng, out = random.Random(seed), []
    for feed in feeds:
        time, number = NOW, 0
        for _ in range(count // len(feeds)):
            time += timedelta(seconds=rng.choice([1, 1, 2, 5, 20, 90]))
            number += rng.choice([0, 0, 0, 1, 3, -2])
            kind = rng.random()
            if kind < 0.05:
                out.append((feed, time, None, None, "timeout"))
            elif kind < 0.1:
                out.append((feed, time, rng.choice([None, 0]), None, None))
            else:
                out.append((feed, time, max(1, number), NOW + timedelta(hours=number // 4), None))
    return out


def plain_loop(probes, force, by_time=True):
    """What a service that probes and refreshes one feed after the other does."""
    kept, out = {}, []
    for feed, time, number, newest, error in sorted(probes, key=lambda p: (p[0], p[1])):
        state = kept.setdefault(feed, {"id": 0, "time": None, "refreshed": None})
        if error is not None:
            changed = True
        elif not number:
            changed = False
        else:
            changed = number > state["id"] or (by_time and newest is not None and newest != state["time"])
            if changed:
                state["id"], state["time"] = number, newest if by_time else None
        age = None if state["refreshed"] is None else (time - state["refreshed"]).total_seconds()
        refreshed = changed or (force is not None and (age is None or age >= force))
        if refreshed:
            state["refreshed"] = time
        out.append((feed, time, changed, refreshed))
    return out


@pytest.mark.parametrize("force", [None, 30])
@pytest.mark.parametrize("by_time", [True, False])
def test_walk_equals_the_loop(force, by_time):
    probes = some_probes()
    rules = GateRules(RefreshPolicy(1, force), by_time)
    got = []
    for feed in "abc":
        decisions, _ = rules.walked([Probe(*p[1:]) for p in probes if p[0] == feed], FeedState())
        got += [(feed, d.probe.time, d.changed, d.refresh) for d in decisions]
    assert got == plain_loop(probes, force, by_time)


@pytest.mark.parametrize("by_time", [True, False])
def test_history_equals_the_loop(spark, by_time):
    probes = some_probes(11, 600)
    df = spark.createDataFrame(probes, PROBE)
    got = monitoring.gate_history(df, span="minute", by_time=by_time, error="error")
    wanted = [(f, t, c) for f, t, c, _ in plain_loop(probes, None, by_time)]
    assert rows(got, "feed", "probe_time", "changed") == sorted(wanted, key=repr)


def decisions(spark, folder, probes, cuts, rules):
    """The stream's rows, its input cut into micro-batches at the given places of the time order."""
    ordered = sorted(probes, key=lambda p: p[1])
    bounds = [0, *cuts, len(ordered)]
    for number, (low, high) in enumerate(zip(bounds, bounds[1:])):
        part = spark.createDataFrame(ordered[low:high], PROBE).coalesce(1)
        part.write.parquet(f"{folder}/in/{number}")
    schema = spark.createDataFrame([], PROBE).schema
    stream = change_source(spark, f"{folder}/in/*", source_format="parquet", schema=schema, max_files=1)
    writer = gated(stream, rules).writeStream.format("parquet").outputMode("append")
    run(writer.option("checkpointLocation", f"{folder}/c"), f"{folder}/out")
    return spark.read.parquet(f"{folder}/out")


def test_stream_equals_the_loop_however_it_is_cut(spark, tmp_path):
    probes = some_probes(3, 300)
    rules = GateRules(RefreshPolicy(1, 60))
    wanted = sorted(plain_loop(probes, 60), key=repr)
    for number, cuts in enumerate([[], [50], [1, 100, 101, 250]]):
        got = decisions(spark, tmp_path / str(number), probes, cuts, rules)
        assert rows(got, "feed", "probe_time", "changed", "refresh") == wanted


def test_timer_refreshes_a_silent_feed(spark, tmp_path):
    """Feed a is probed once, b goes on; a is refreshed every minute as the stream's time goes on."""
    minute = timedelta(minutes=1)
    probes = [("a", NOW, 5, NOW, None)]
    probes += [("b", NOW + k * minute / 2, 5, NOW, None) for k in range(21)]
    rules = GateRules(RefreshPolicy(1, 60), timer=True)
    wanted = [("a", NOW, "change")] + [("a", NOW + k * minute, "timer") for k in range(1, 9)]
    for number, cuts in enumerate([[], [4, 9], [2, 3, 5, 8, 12, 20]]):
        got = decisions(spark, tmp_path / str(number), probes, cuts, rules)
        of_a = got.where("feed = 'a' and refresh")
        # The watermark ends a minute behind the last probe, at nine minutes; timers are due below it.
        assert rows(of_a, "feed", "probe_time", "reason") == sorted(wanted, key=repr)


def test_late_probe_changes_nothing():
    rules = GateRules(RefreshPolicy(1, 30))
    _, state = rules.walked([Probe(NOW, 5, NOW)], FeedState())
    [late], same = rules.walked([Probe(NOW - timedelta(seconds=1), 9, NOW)], state)
    assert (late.changed, late.refresh, late.reason) == (False, False, "late") and same == state


def test_failed_probe_refreshes(spark, tmp_path):
    """Ticks: a first look, a failure, the same window again."""
    (tmp_path / "ticks").mkdir()
    ticks = spark.readStream.schema("n int").json(str(tmp_path / "ticks"))
    table = SnapshotTable(spark, str(tmp_path / "snapshot"))
    store = GateStore(spark, str(tmp_path / "gate"))
    served = []

    def good():
        return spark.range(1).select(F.lit(3).alias("max_id"), F.lit(NOW).alias("max_timestamp"))

    def bad():
        return spark.range(1).select(F.raise_error(F.lit("no connection")).alias("max_id"))

    for number, probe in enumerate([good, bad, good]):
        (tmp_path / "ticks" / f"{number}.json").write_text('{"n": 1}')
        run(
            refresh.gated_refresh(
                ticks, probe, lambda: spark.range(4), table, store, str(tmp_path / "c"),
                RefreshPolicy.event_mode(), clock=lambda: NOW,
            )
        )
        served.append(table.latest_version())
    assert served == [0, 1, 1]
    assert store.before(3).max_id == 3

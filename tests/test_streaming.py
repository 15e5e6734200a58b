from __future__ import annotations

import glob
import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sigloom.operators import ranking
from sigloom.registry.streams import drain, in_batches, staged
from sigloom.schemas import CHANGE_ROW, SCORING_HISTORY
from sigloom.plans import monitoring
from sigloom.sources.batches import BatchTable
from sigloom.sources.changes import change_source
from sigloom.sources.sinks import SnapshotTable, event_sink
from sigloom.streaming import dedup, events, rates, refresh, stats
from sigloom.streaming.refresh import GateState, GateStore, RefreshPolicy, check_gate
from tests.conftest import column, rows

NOW = datetime(2024, 1, 31)


def image(number, **changes):
    """A fact row that qualifies, with some columns changed."""
    values = {
        "id": number, "trading_pair_id": 1, "pair_symbol": "TEST", "recommended_action": "BUY",
        "score_week": 75.5, "score_month": 80.2, "total_score": 77.0,
        "timestamp": NOW.isoformat(), "created_at": NOW.isoformat(), "is_active": True,
    }
    return {**values, **changes}


def write_changes(path, number, changes):
    path.mkdir(exist_ok=True)
    lines = [json.dumps({"op": op, "old": old, "new": new}) for op, old, new in changes]
    (path / f"{number}.json").write_text("\n".join(lines))


def run(writer, path=None):
    query = writer.trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, is_active boolean")


def announced(spark, stream, tmp_path, name):
    run(event_sink(stream, str(tmp_path / f"{name}-checkpoint")), str(tmp_path / name))
    lines = spark.read.text(str(tmp_path / name))
    assert column(lines.select("channel").distinct(), "channel") in ([], ["new_signals"])
    return sorted((json.loads(r["value"]) for r in lines.collect()), key=lambda e: e["id"])


def test_insert_events(spark, pairs, tmp_path):
    old = (NOW - timedelta(minutes=33)).isoformat()
    edge = (NOW - timedelta(minutes=32)).isoformat()
    write_changes(tmp_path / "in", 1, [
        ("INSERT", None, image(1)),
        ("INSERT", None, image(2, is_active=False)),
        ("INSERT", None, image(3, trading_pair_id=2)),
        ("INSERT", None, image(4, trading_pair_id=3)),
        ("INSERT", None, image(5, trading_pair_id=9)),
    ])
    write_changes(tmp_path / "in", 2, [
        ("INSERT", None, image(6, score_week=50.0)),
        ("INSERT", None, image(7, timestamp=old)),
        ("INSERT", None, image(8, timestamp=edge, recommended_action=None)),
        ("UPDATE", image(9, score_week=1.0), image(9)),
    ])
    changes = change_source(spark, str(tmp_path / "in"), max_files=1)
    got = announced(spark, events.insert_events(changes, pairs, NOW), tmp_path, "events")
    assert [e["id"] for e in got] == [1, 8]
    assert got[0] == {
        "event": "INSERT", "id": 1, "pair_symbol": "TEST", "score_week": 75.5,
        "score_month": 80.2, "timestamp": "2024-01-31T00:00:00+00:00", "action": "BUY",
    }
    assert "action" in got[1] and got[1]["action"] is None


def test_update_events(spark, pairs, tmp_path):
    write_changes(tmp_path / "in", 1, [
        ("UPDATE", image(1), image(1)),
        ("UPDATE", image(2, score_week=None), image(2)),
        ("UPDATE", image(3, is_active=None), image(3)),
        ("UPDATE", image(4, is_active=True), image(4, is_active=False)),
        ("UPDATE", image(5, total_score=1.0), image(5)),
        ("UPDATE", image(6, score_month=10.0), image(6, score_month=50.0)),
        ("INSERT", None, image(7)),
    ])
    changes = change_source(spark, str(tmp_path / "in"))
    got = announced(spark, events.update_events(changes, pairs, NOW), tmp_path, "events")
    assert [(e["event"], e["id"]) for e in got] == [("UPDATE", 2), ("UPDATE", 3)]


def test_gate():
    start = GateState()
    assert check_gate(None, start) == (False, start)
    assert check_gate(Row(max_id=None, max_timestamp=None), start) == (False, start)
    assert check_gate(Row(max_id=0, max_timestamp=NOW), start) == (False, start)
    changed, kept = check_gate(Row(max_id=5, max_timestamp=NOW), start)
    assert changed and (kept.max_id, kept.max_timestamp) == (5, NOW)
    assert check_gate(Row(max_id=5, max_timestamp=NOW), kept) == (False, kept)
    assert check_gate(Row(max_id=4, max_timestamp=NOW), kept) == (False, kept)
    later = NOW + timedelta(seconds=1)
    changed, lower = check_gate(Row(max_id=3, max_timestamp=later), kept)
    assert changed and (lower.max_id, lower.max_timestamp) == (3, later)
    assert check_gate(Row(max_id=5, max_timestamp=later), kept, by_time=False) == (False, kept)
    assert check_gate(Row(max_id=6), kept, by_time=False)[0]


def test_policy():
    poll, event = RefreshPolicy.poll_mode(1, 30), RefreshPolicy.event_mode()
    assert event.trigger() == {"processingTime": "60 seconds"}
    assert poll.trigger() == {"processingTime": "1 seconds"}
    assert poll.due(True, NOW, NOW) and event.due(True, NOW, NOW)
    assert not poll.due(False, NOW, NOW - timedelta(seconds=29))
    assert poll.due(False, NOW, NOW - timedelta(seconds=30))
    assert poll.due(False, NOW, None)
    assert not event.due(False, NOW, None)
    assert not RefreshPolicy.poll_mode(1, None).due(False, NOW, None)


def test_state_of_a_repeated_batch(spark, folder):
    store = GateStore(spark, folder, keep=4)
    assert store.before(0) == GateState()
    for batch in range(7):
        store.put(batch, GateState(batch, NOW + timedelta(seconds=batch), None))
    assert store.before(7).max_id == 6
    assert store.before(6) == GateState(5, NOW + timedelta(seconds=5), None)


def test_gated_refresh(spark, tmp_path):
    """Five ticks: first, nothing new, new id, nothing new, overdue."""
    facts = {"ids": [1]}
    clock = {"now": NOW}

    def snapshot():
        return spark.createDataFrame([(i,) for i in facts["ids"]], "id long")

    def probe():
        return snapshot().agg(F.max("id").alias("max_id"), F.lit(NOW).alias("max_timestamp"))

    table = SnapshotTable(spark, str(tmp_path / "snapshot"))
    store = GateStore(spark, str(tmp_path / "gate"))
    (tmp_path / "ticks").mkdir()
    ticks = spark.readStream.schema("n int").json(str(tmp_path / "ticks"))
    served = []
    steps = [([1], 0), ([1], 10), ([1, 2], 5), ([1, 2], 10), ([1, 2], 30)]
    for number, (ids, seconds) in enumerate(steps):
        facts["ids"], clock["now"] = ids, clock["now"] + timedelta(seconds=seconds)
        (tmp_path / "ticks" / f"{number}.json").write_text('{"n": 1}')
        run(
            refresh.gated_refresh(
                ticks, probe, snapshot, table, store, str(tmp_path / "checkpoint"),
                RefreshPolicy.poll_mode(1, 30), clock=lambda: clock["now"],
            )
        )
        served.append((table.latest_version(), table.latest().count()))
    assert served == [(0, 1), (0, 1), (2, 2), (2, 2), (4, 2)]
    assert store.before(5).refreshed_at == clock["now"]


def test_every_batch_of_changes_refreshes(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    for number in (1, 2, 3):
        write_changes(tmp_path / "in", number, [("INSERT", None, image(number))] * 2)
    table = SnapshotTable(spark, str(tmp_path / "snapshot"))
    changes = change_source(spark, str(tmp_path / "in"), max_files=1)
    run(refresh.snapshot_refresh(changes, build, table, str(tmp_path / "checkpoint")))
    # One snapshot before the first change, then one for each batch.
    assert len(calls) == 4 and table.latest().count() == 4


def test_first_snapshot_needs_no_change(spark, tmp_path):
    (tmp_path / "in").mkdir()
    changes = change_source(spark, str(tmp_path / "in"), max_files=1)
    table = SnapshotTable(spark, str(tmp_path / "snapshot"))

    def started(**settings):
        build = lambda: spark.range(2)
        run(refresh.snapshot_refresh(changes, build, table, str(tmp_path / "c"), **settings))

    started(at_start=False)
    assert table.latest_version() is None
    started()
    assert (table.latest_version(), table.latest().count()) == (refresh.START_VERSION, 2)
    assert not refresh.publish_at_start(lambda: spark.range(5), table)


def test_buffer_holds_the_newest_batch_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for number, scores in enumerate([[60, 55], [75, 70]]):
        lines = [
            json.dumps({"id": s, "score_week": s, "timestamp": NOW.isoformat()}) for s in scores
        ]
        (tmp_path / "in" / f"{number}.json").write_text("\n".join(lines))
        feed = spark.readStream.schema("id long, score_week double, timestamp timestamp").json(
            str(tmp_path / "in")
        )
        table = SnapshotTable(spark, str(tmp_path / "snapshot"))
        run(refresh.buffer_replace(feed, ranking.tail_buffer, table, str(tmp_path / "checkpoint")))
    assert sorted(column(table.latest(), "score_week")) == [70.0, 75.0]


def test_buffer_holds_the_newest_message_of_a_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for number, scores in enumerate([[60, 55], [75, 70]]):
        lines = [
            json.dumps(
                {"id": s, "score_week": s, "timestamp": NOW.isoformat(), "message": number}
            )
            for s in scores
        ]
        (tmp_path / "in" / f"{number}.json").write_text("\n".join(lines))
    feed = spark.readStream.schema(
        "id long, score_week double, timestamp timestamp, message long"
    ).json(str(tmp_path / "in"))
    table = SnapshotTable(spark, str(tmp_path / "snapshot"))
    run(
        refresh.buffer_replace(
            feed, ranking.tail_buffer, table, str(tmp_path / "checkpoint"), message="message"
        )
    )
    assert sorted(column(table.latest(), "score_week")) == [70.0, 75.0]


def test_signal_is_shown_once_across_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    batches = [[(1, 0), (2, 5)], [(1, 0), (3, 50)], [(2, 5), (3, 50), (1, 0)]]
    for number, batch in enumerate(batches):
        lines = [
            json.dumps({"signal_id": i, "signal_timestamp": (NOW + timedelta(hours=h)).isoformat()})
            for i, h in batch
        ]
        (tmp_path / "in" / f"{number}.json").write_text("\n".join(lines))
    alerts = (
        spark.readStream.schema("signal_id long, signal_timestamp timestamp")
        .option("maxFilesPerTrigger", 1)
        .json(str(tmp_path / "in"))
    )
    shown = dedup.dedup_seen(alerts).writeStream.format("parquet")
    run(shown.option("checkpointLocation", str(tmp_path / "c")), str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "signal_id") == [(1,), (2,), (3,)]


def counted(spark, tmp_path, slide=None, amount=None):
    (tmp_path / "in").mkdir()
    batches = [[(0, 2), (30, 3)], [(59, 1), (60, 4)], [(119, 1), (30, 1)]]
    for number, batch in enumerate(batches):
        lines = [
            json.dumps({"time": (NOW + timedelta(seconds=s)).isoformat(), "count": c})
            for s, c in batch
        ]
        (tmp_path / "in" / f"{number}.json").write_text("\n".join(lines))
    stream = (
        spark.readStream.schema("time timestamp, count int")
        .option("maxFilesPerTrigger", 1)
        .json(str(tmp_path / "in"))
    )
    table = rates.window_table(spark, str(tmp_path / "windows"), every=2)
    counts = rates.rate_per_minute(stream, "time", slide=slide, amount=amount)
    run(rates.keep_updates(counts, table, str(tmp_path / "c")))
    newest = rates.current_windows(table)
    return [
        ((r["window_start"] - NOW).total_seconds(), r["signals"])
        for r in newest.orderBy("window_start").collect()
    ]


def test_rate_per_minute(spark, tmp_path):
    assert counted(spark, tmp_path) == [(0.0, 4), (60.0, 2)]


def test_sliding_rate_of_batch_counts(spark, tmp_path):
    got = counted(spark, tmp_path, slide="30 seconds", amount="count")
    assert got == [(-30.0, 2), (0.0, 7), (30.0, 9), (60.0, 5), (90.0, 1)]


def json_stream(spark, folder, schema, batches):
    """One file a micro-batch, taken in the given order."""
    folder.mkdir(parents=True)
    for number, lines in enumerate(batches):
        file = folder / f"{number}.json"
        file.write_text("\n".join(json.dumps(line) for line in lines))
        os.utime(file, (1_700_000_000 + number,) * 2)  # files are taken in order of their age
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return reader.json(str(folder))


def test_log_of_every_batch(spark, tmp_path):
    """A failed batch is a row with its error; totals go over all runs of the query."""
    stream = json_stream(spark, tmp_path / "in", "id long", [[{"id": 1}, {"id": 5}], [{"id": 2}], [{"id": 9}] * 3])
    sent, log = BatchTable(spark, str(tmp_path / "rows")), BatchTable(spark, str(tmp_path / "log"), every=2)
    times = iter(NOW + timedelta(seconds=k) for k in range(9))

    def send(batch, batch_id):
        if batch_id == 1:
            raise RuntimeError("client gone")
        sent.put(batch, batch_id)

    writer = stats.logged(
        stream, send, log, str(tmp_path / "c"), F.max("id"), keep_going=True, clock=lambda: next(times)
    )
    run(writer)
    got = rows(log.read(), "batch_id", "count", "first_timestamp", "error")
    assert got == [(0, 2, "5", None), (1, 0, None, "client gone"), (2, 3, "9", None)]
    totals = monitoring.feed_stats(log.read(), NOW + timedelta(minutes=1)).first()
    assert totals.asDict() == {
        "uptime_seconds": 60.0, "queries_executed": 3, "signals_sent": 5, "errors": 1, "last_query": "9",
    }
    assert rows(sent.read(), "batch_id", "id") == [(0, 1), (0, 5), (2, 9), (2, 9), (2, 9)]


def test_failure_ends_the_query_and_is_logged(spark, tmp_path):
    stream = json_stream(spark, tmp_path / "in", "id long", [[{"id": 1}]])
    log = BatchTable(spark, str(tmp_path / "log"))

    def send(batch, batch_id):
        raise RuntimeError("client gone")

    with pytest.raises(Exception, match="client gone"):
        run(stats.logged(stream, send, log, str(tmp_path / "c")))
    assert log.read().first()["error"] == "client gone"


def test_totals_after_many_batches(spark, tmp_path):
    """More batches than Spark keeps reports of; the folders stay few."""
    log = BatchTable(spark, str(tmp_path / "log"), every=8)
    for batch in range(150):
        row = [(NOW + timedelta(seconds=batch), batch, None, str(batch))]
        log.put(spark.createDataFrame(row, stats.LOG).coalesce(1), batch)
    totals = monitoring.feed_stats(log.read(), NOW + timedelta(seconds=150)).first()
    assert (totals["queries_executed"], totals["signals_sent"]) == (150, sum(range(150)))
    assert totals["uptime_seconds"] == 150.0 and totals["last_query"] == "149"
    assert len(list((tmp_path / "log" / "open").iterdir())) <= 16
    assert len(list((tmp_path / "log" / "base").iterdir())) == 2


def test_windows_are_merged_and_dropped(spark, tmp_path):
    """A window an update; at all times the last hour of them, in few folders."""
    table = rates.window_table(spark, str(tmp_path / "windows"), keep_minutes=60, every=5)
    schema = "window_start timestamp, window_end timestamp, signals long"
    for batch in range(130):
        updates = []
        for minute, signals in ((batch, batch), (batch - 1, 1000 + batch)):
            start = NOW + timedelta(minutes=minute)
            updates.append((start, start + timedelta(minutes=1), signals))
        frame = spark.createDataFrame(updates, schema).withColumn("day", F.to_date("window_start"))
        table.put(frame.coalesce(1), batch)
    windows = rates.current_windows(table)
    got = {(r["window_start"] - NOW) // timedelta(minutes=1): r["signals"] for r in windows.collect()}
    assert got == {m: (129 if m == 129 else 1001 + m) for m in range(70, 130)}
    assert table.read().count() < 60 + 2 * 10
    assert len(list((tmp_path / "windows" / "open").iterdir())) <= 10
    assert len(list((tmp_path / "windows" / "base").iterdir())) == 2


def test_repeated_and_compacted_batches(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), every=2)
    assert table.empty()
    with pytest.raises(LookupError):
        table.read()
    for batch in (0, 0, 1, 1, 2):
        table.put(spark.range(batch, batch + 2), batch)
    assert rows(table.read(), "batch_id", "id") == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 3)]
    # A batch repeated after it was merged counts once.
    table.put(spark.range(1, 3), 1)
    assert table.read().count() == 6


def shown_ids(spark, folder, batches, **settings):
    schema = "signal_id long, signal_timestamp timestamp"
    stream = json_stream(
        spark,
        folder / "in",
        schema,
        [
            [{"signal_id": i, "signal_timestamp": (NOW + timedelta(hours=h)).isoformat()} for i, h in batch]
            for batch in batches
        ],
    )
    shown = BatchTable(spark, str(folder / "shown"))
    seen = dedup.SeenKeys(spark, str(folder / "seen"), every=2, **settings)
    run(dedup.show_once(stream, shown, seen, str(folder / "c")))
    return shown, seen


def test_history_in_any_order_is_shown_once(spark, tmp_path):
    alerts = [(i % 60 if i % 61 else None, i % 60 - 500 * (i % 3)) for i in range(300)]
    wanted = {None, *range(60)}
    orders = {
        "one": [alerts],
        "four": [alerts[k::4] for k in range(4)],
        "newest": [[a] for a in sorted(alerts[:40], key=lambda a: -a[1])] + [alerts[40:]],
    }
    for name, batches in orders.items():
        shown, _ = shown_ids(spark, tmp_path / name, batches[-12:] if name == "newest" else batches)
        ids = column(shown.read(), "signal_id")
        assert len(ids) == len(set(ids)) and set(ids) == wanted, name


def test_seen_keys_expire_by_the_clock(spark, tmp_path):
    clock = {"now": NOW}
    seen = dedup.SeenKeys(
        spark, str(tmp_path / "seen"), "id", timedelta(hours=48), every=2, clock=lambda: clock["now"]
    )
    shown = []
    for batch in range(6):
        new = seen.unseen(spark.range(2), batch).persist()
        shown.append(new.count())
        seen.put(new, batch)
        clock["now"] += timedelta(hours=20)
    # Shown at 0 h, remembered at 20 and 40 h, shown again at 60 h.
    assert shown == [2, 0, 0, 2, 0, 0]
    assert seen.unseen(spark.range(2), 3).count() == 2


def test_pattern_counts_by_message(spark, tmp_path):
    """The same counts whether messages share a micro-batch or come in parts."""
    lines = [
        {"message": m, "patterns": p}
        for m, p in ((0, ["A"]), (0, ["A", "B"]), (1, ["B"]), (1, []), (2, ["C", "A"]), (2, ["C"]))
    ]
    wanted = [(0, "A", 2), (0, "B", 1), (1, "B", 1), (2, "A", 1), (2, "C", 2)]
    for name, batches in {
        "one": [lines], "each": [[x] for x in lines], "back": [lines[3:], lines[:3]],
    }.items():
        folder = tmp_path / name
        stream = json_stream(spark, folder / "in", "message long, patterns array<string>", batches)
        table = BatchTable(spark, str(folder / "counts"), every=2)
        run(rates.pattern_rate(stream, lambda batch: batch, table, str(folder / "c")))
        assert rows(rates.message_totals(table.read(), ["message", "pattern"])) == wanted


def test_change_rows_have_the_declared_layout(spark):
    from sigloom.sources.changes import change_rows

    facts = spark.createDataFrame([], SCORING_HISTORY)
    for op in ("INSERT", "UPDATE"):
        shaped = change_rows(facts, op)
        assert [f.dataType for f in shaped.schema] == [f.dataType for f in CHANGE_ROW]


def test_staged_ranges_are_dealt_to_the_same_number_of_files(spark, folder):
    """No task writes a whole range, and a micro-batch still takes just its own range."""
    numbered = spark.range(0, 400, 1, 3)
    path, _, files = staged(numbered, "numbers", F.col("id"), batches=2, file_rows=30)
    ranges = [glob.glob(f"{p}/*.parquet") for p in sorted(glob.glob(path))]
    assert files > 5 and [len(r) for r in ranges] == [files] * 2
    assert max(spark.read.parquet(p).count() for r in ranges for p in r) <= 60

    # Ties: some ranges are empty, the last one holds nearly all rows.
    tied = numbered.withColumn("at", F.when(F.col("id") < 2, 0).otherwise(9))
    path, _, files = staged(tied, "tied", F.col("at"), batches=4, file_rows=50)
    assert files > 5 and [len(glob.glob(f"{p}/*.parquet")) for p in glob.glob(path)] == [files] * 4

    seen = []
    stream = in_batches(numbered, "numbers", F.col("id"), batches=4, file_rows=20)
    drain(rates.on_batch(stream, lambda b, n: seen.append(sorted(r["id"] for r in b.collect())), f"{folder}/c"))
    assert len(seen) == 4 and sum(seen, []) == list(range(400))

from __future__ import annotations

import json
import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sigloom.config import FeedConfig
from sigloom.operators import positions, ranking
from sigloom.plans import feeds
from sigloom.session import working_folder
from sigloom.sources import messages
from sigloom.sources.catalog import Catalog, scan_tables
from sigloom.sources.layout import write_bucketed
from sigloom.sources.sinks import SnapshotTable
from sigloom.standins import AS_OF, WINDOW_MINUTES, standin_catalog
from tests.conftest import column, rows

FEED = (
    '{"type": "signals", "timestamp": "t", "count": 2, "data": '
    '[{"id": 1, "score_week": 60.5, "extra": true}, {"id": 2, "score_week": 55}]}'
)


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_feed_messages(spark):
    received = texts(
        spark,
        FEED,
        '{"type": "pong"}',
        '{"type": "error", "message": "late"}',
        '{"type": "signals", "data": []}',
        "{broken " + "x" * 200,
        None,
    )
    parsed = messages.parse_feed(received)
    assert rows(parsed, "id", "score_week", "pair_symbol", "pos") == [
        (1, 60.5, None, 0),
        (2, 55.0, None, 1),
    ]
    assert rows(messages.messages_of_type(received, "error"), "message") == [("late",)]
    broken_texts = [r[0] for r in rows(messages.malformed_messages(received))]
    assert len(broken_texts) == 2 and None in broken_texts
    assert max(len(text) for text in broken_texts if text) == 208


def test_a_broken_event_still_announces_a_change(spark):
    good = '{"event": "INSERT", "id": 5, "pair_symbol": "X", "score_week": 75.5}'
    got = messages.parse_events(texts(spark, good, "oops"))
    assert rows(got, "event", "id", "malformed") == [("INSERT", 5, False), (None, None, True)]


def sent_and_parsed(df, max_bytes):
    sent = messages.envelope(df, datetime(2024, 1, 31), max_bytes).cache()
    got = [json.loads(r["value"]) for r in sent.orderBy("part").collect()]
    assert [m["part"] for m in got] == list(range(len(got)))
    assert all(m["parts"] == len(got) and m["count"] == len(m["data"]) for m in got)
    assert {m["timestamp"] for m in got} == {"2024-01-31T00:00:00+00:00"}
    return sent, got


def test_envelope_is_one_message_where_it_fits(spark):
    df = spark.createDataFrame([(2, None), (1, 5.0)], "id long, score_week double")
    _, got = sent_and_parsed(df.orderBy(F.desc("id")), 1000)
    assert got[0]["data"] == [{"id": 2, "score_week": None}, {"id": 1, "score_week": 5.0}]
    assert len(got) == 1 and got[0]["type"] == "signals"
    _, empty = sent_and_parsed(df.limit(0), 1000)
    assert empty[0]["data"] == [] and len(empty) == 1


@pytest.mark.parametrize("room", [60, 100, 300, 2000, 10**6])
def test_envelope_keeps_order_and_bound(spark, room):
    """Long records among short ones; only a record too long for the bound goes beyond it."""
    rng = random.Random(room)
    names = ["x" * rng.choice([0, 5, 20, 20, 150, 700]) + "é" for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(names)), "id long, pair_symbol string")
    bound = messages.MESSAGE_OVERHEAD + room
    sent, got = sent_and_parsed(df.repartition(7).orderBy("id"), bound)
    assert [r["id"] for m in got for r in m["data"]] == list(range(400))
    assert all(m["count"] == 1 for m in got if len(json.dumps(m, ensure_ascii=False).encode()) > 2 * bound)
    texts = sent.select(F.octet_length("value").alias("size"), "count").collect()
    assert all(r["size"] <= bound or r["count"] == 1 for r in texts)
    parsed = messages.parse_feed(sent).orderBy("part", "pos").select("id", "pair_symbol").collect()
    assert [tuple(r) for r in parsed] == list(enumerate(names))


@pytest.mark.parametrize("max_bytes", [700, 5000, 1 << 20])
def test_standard_feed_comes_back_equal(spark, max_bytes):
    tables = standin_catalog(spark, "/root/testdata/sf0.01")
    feed = feeds.standard_feed(tables, FeedConfig(window_minutes=WINDOW_MINUTES), AS_OF)
    wanted = [tuple(r) for r in feed.collect()]
    sent = messages.envelope(feed, AS_OF, max_bytes)
    back = messages.parse_feed(sent).orderBy("part", "pos").drop("part", "pos")
    assert back.columns == feed.columns and len(wanted) == 710
    assert [tuple(r) for r in back.collect()] == wanted


def test_newest_complete_snapshot(spark):
    def sent(numbers, second):
        df = spark.createDataFrame([(n,) for n in numbers], "id long").coalesce(1)
        frame = messages.envelope(df, datetime(2024, 1, 31, 0, 0, second), messages.MESSAGE_OVERHEAD + 30)
        return [r["value"] for r in frame.orderBy("part").collect()]

    def served(*values):
        got = messages.complete_snapshot(texts(spark, *values)).orderBy("part", "pos")
        return [r["id"] for r in got.collect()]

    old, new = sent(range(10), 1), sent(range(50, 70), 2)
    assert len(old) > 2 and len(new) > 3
    assert served(*new[1:]) == []
    assert served(*new[1:], *reversed(old)) == list(range(10))
    assert served(*new[1:], *old, new[0], new[0], "{broken", '{"type": "pong"}') == list(range(50, 70))
    # A message of the plain form is a snapshot of its own.
    plain = '{"type": "signals", "timestamp": "2024-02-01", "count": 1, "data": [{"id": 7}]}'
    assert served(*old, plain) == [7]


def test_catalog_reads_frames_folders_and_tables(spark, folder):
    pairs = spark.createDataFrame([(1, True)], "id long, is_active boolean")
    pairs.write.parquet(f"{folder}/trading_pairs")
    write_bucketed(pairs, "pairs_by_id", "id", 2)
    catalog = Catalog(
        spark,
        {
            "trading_pairs": f"{folder}/trading_pairs",
            "sh_regime": "pairs_by_id",
            "market_regime": pairs,
            "scoring_history": {"format": "parquet", "path": f"{folder}/trading_pairs"},
            "best_parameters": lambda: pairs.limit(0),
        },
    )
    counts = dict(rows(scan_tables(catalog)))
    assert counts.pop("best_parameters") == 0
    assert set(counts.values()) == {1} and len(counts) == 4
    pairs.write.mode("append").parquet(f"{folder}/trading_pairs")
    assert catalog("trading_pairs").count() == 2
    with pytest.raises(KeyError):
        Catalog(spark, {"pairs": pairs})
    whole = Catalog.from_folder(spark, folder)
    assert whole("trading_pairs").count() == 2


def test_bucketed_tables_join_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        write_bucketed(spark.range(100), "fact_by_id", "id", 4)
        links = spark.range(100).withColumnRenamed("id", "scoring_history_id")
        write_bucketed(links, "links_by_id", "scoring_history_id", 4)
        fact, link = spark.table("fact_by_id"), spark.table("links_by_id")
        joined = fact.join(link, fact.id == link.scoring_history_id)
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def test_snapshot_is_replaced_not_appended(spark, folder):
    table = SnapshotTable(spark, folder, keep=2)
    assert table.latest_version() is None
    with pytest.raises(LookupError):
        table.latest()
    for version, scores in enumerate([[60, 55], [75, 70], [80], []]):
        df = spark.createDataFrame(
            [(i, float(s), datetime(2024, 1, 1)) for i, s in enumerate(scores)],
            "id int, score_week double, timestamp timestamp",
        )
        table.replace(ranking.order_feed(df), version * 16)
        assert sorted(column(table.latest(), "score_week")) == sorted(map(float, scores))
        assert table.latest_version() == version * 16


def test_versions_stay_readable_for_a_while(spark, folder):
    table = SnapshotTable(spark, folder, keep=2)
    table.replace(spark.range(7), 0)
    held = table.latest()
    for version in (1, 2, 3):
        table.replace(spark.range(version), version)
    assert held.count() == 7 and table.latest().count() == 3


def test_folders_are_used_again_after_a_while(spark, folder):
    table = SnapshotTable(spark, folder, keep=2, hold_seconds=0)
    for version in range(4):
        table.replace(spark.range(version), version)
        assert table.latest().count() == version
    assert sorted(p.name for p in (Path(folder) / "data").iterdir()) == ["slot=0", "slot=1"]


def test_half_written_version_is_not_served(spark, folder):
    table = SnapshotTable(spark, folder)
    table.replace(spark.range(3), 1)
    spark.range(99).write.mode("overwrite").parquet(f"{folder}/data/slot=1")
    assert table.latest().count() == 3
    table.replace(spark.range(5), 2)
    assert table.latest().count() == 5


def test_snapshot_keeps_its_order(spark, folder):
    """Published from many tasks, the feed reads back in order, with its places."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables = standin_catalog(spark, "/root/testdata/sf0.01")
        feed = feeds.standard_feed(tables, FeedConfig(window_minutes=WINDOW_MINUTES), AS_OF)
        wanted = [tuple(r) for r in feed.collect()]
        table = SnapshotTable(spark, folder)
        table.replace(feed, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list(Path(folder).glob("data/slot=0/*.parquet"))) > 1
    read = table.latest()
    assert [tuple(r)[:-1] for r in read.collect()] == wanted
    assert column(read, "pos") == list(range(len(wanted)))
    assert sorted(column(table.latest(in_order=False), "pos")) == list(range(len(wanted)))
    assert ranking.order_violations(read).count() == 0
    assert read.columns == [*feed.columns, "pos"]


def test_order_columns_of_others_are_refused(spark, folder):
    with pytest.raises(ValueError, match="_part"):
        SnapshotTable(spark, folder).replace(spark.range(1).withColumn("_part", F.lit(1)), 0)


def test_running_sums_over_tasks(spark, folder):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("size")).repartition(5)
    stored = positions.written_in_order(df.orderBy("id"), folder)
    parts = positions.part_totals(stored, F.sum("size").alias("sizes"))
    sums = positions.running_before(stored, "size", positions.starts(parts, "sizes"), "before")
    got = rows(positions.positioned(sums, positions.starts(parts)), "id", "pos", "before")
    assert got == sorted(((i, i, sum(k % 7 for k in range(i))) for i in range(1000)), key=repr)


def test_working_folder_is_below_the_shared_one(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = working_folder(spark, "x"), working_folder(spark, "x")
    assert first.startswith(root) and first != second



from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sigloom.operators import aggregates
from sigloom.plans import monitoring
from tests.conftest import rows

T0 = datetime(2024, 1, 1)
BRIDGE = (
    "scoring_history_id int, signal_patterns_id int, pattern_type string, timeframe string, "
    "pattern_key string"
)


def bridge(spark):
    return spark.createDataFrame(
        [
            (1, 10, "B", "1h", "B_1h"),
            (1, 10, "B", "1h", "B_1h"),
            (1, 11, "A", None, None),
            (2, 10, "B", "1h", "B_1h"),
            (2, 10, "B", "1h", "B_1h"),
            (3, 12, None, None, None),
            (4, 10, "B", "1h", "B_1h"),
            (4, 13, "B", "1h", "B_1h"),
            (4, 14, "C", "4h", "C_4h"),
        ],
        BRIDGE,
    )


def test_collected_patterns_leave_nulls_out(spark):
    got = aggregates.collect_patterns(bridge(spark), ["scoring_history_id"])
    assert rows(got) == [
        (1, ["A", "B"], ["1h"]),
        (2, ["B"], ["1h"]),
        (3, [], []),
        (4, ["B", "C"], ["1h", "4h"]),
    ]


@pytest.mark.parametrize("minimum, expected", [(1, [1, 2, 3, 4]), (2, [1, 4]), (3, [4]), (4, [])])
def test_patterns_are_counted_by_number_not_name(spark, minimum, expected):
    got = aggregates.multi_pattern_having(bridge(spark), ["scoring_history_id"], minimum)
    assert [r[0] for r in rows(got)] == expected


def test_distribution(spark):
    feed = spark.createDataFrame([(["A", "B"],), (["A"],), ([],)], "patterns array<string>")
    assert rows(aggregates.pattern_distribution(feed)) == [("A", 2), ("B", 1)]


def test_probe_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, timestamp timestamp")
    assert rows(aggregates.probe_from_query(empty)) == [(None, None, 0)]


def test_probe_can_miss_what_a_low_threshold_feed_shows(spark):
    facts = spark.createDataFrame(
        [(1, 1, 40.0, 40.0, T0, True), (2, 1, 60.0, 60.0, T0, True)],
        "id long, trading_pair_id long, score_week double, score_month double, "
        "timestamp timestamp_ntz, is_active boolean",
    )
    pairs = spark.createDataFrame([(1, True)], "id long, is_active boolean")
    fixed = aggregates.change_probe(facts, pairs, 30, T0)
    assert fixed.first()["total_count"] == 1
    assert aggregates.probe_from_query(facts).first()["total_count"] == 2


def test_totals_and_rates(spark):
    log = spark.createDataFrame(
        [(0, T0, 3, 10, None), (1, T0 + timedelta(seconds=60), 4, 20, "x")],
        "batch_id int, time timestamp_ntz, count int, bytes int, error string",
    )
    assert rows(aggregates.feed_totals(log)) == [(2, 7, 30, 1)]
    assert rows(aggregates.feed_totals(log.limit(0))) == [(0, 0, 0, 0)]
    at = T0 + timedelta(seconds=60)
    assert rows(aggregates.signals_last_minute(log, at)) == [(4,)]
    assert rows(aggregates.signals_last_minute(log, at - timedelta(microseconds=1))) == [(7,)]
    assert rows(aggregates.seconds_since_last(log, at + timedelta(seconds=1.5))) == [(1.5,)]
    assert rows(aggregates.seconds_since_last(log.limit(0), at)) == [(None,)]
    rate = aggregates.average_rate(F.lit(6), F.col("up"))
    ups = spark.createDataFrame([(0.0,), (3.0,)], "up double")
    assert [r[0] for r in ups.select(rate).collect()] == [0.0, 2.0]


def gate_by_loop(probes):
    last_id, last_time, changes = 0, None, []
    for _, _, newest, time in sorted(probes, key=lambda p: p[1]):
        changed = bool(newest) and (newest > last_id or (time is not None and time != last_time))
        if changed:
            last_id, last_time = newest, time
        changes.append(changed)
    return changes


@pytest.mark.parametrize("seed", range(4))
def test_gate_over_a_history_equals_the_loop(spark, seed):
    """Random walks with long stretches of one time that reach over several spans."""
    pick = random.Random(seed)
    probes, newest, at = [], 50, T0
    for i in range(150):
        if pick.random() < (0.05 if seed % 2 else 0.4):
            at = T0 + timedelta(minutes=pick.randrange(4))
        newest += pick.choice([-1, 0, 0, 1])
        shown = None if pick.random() < 0.1 else newest
        probes.append(("standard", T0 + timedelta(minutes=11 * i), shown, at))
    df = spark.createDataFrame(
        probes,
        "feed string, probe_time timestamp_ntz, max_id long, max_timestamp timestamp_ntz",
    ).repartition(3)
    got = monitoring.gate_history(df).orderBy("probe_time").collect()
    assert [r["changed"] for r in got] == gate_by_loop(probes)
    by_day = monitoring.gate_history(df, span="day").orderBy("probe_time").collect()
    assert [r["changed"] for r in by_day] == gate_by_loop(probes)


def test_probes_of_one_time_have_an_order(spark):
    probes = [("f", T0, 5, T0, 0), ("f", T0, 3, T0, 1), ("f", T0, 4, T0, 2)]
    kind = "feed string, probe_time timestamp_ntz, max_id long, max_timestamp timestamp_ntz, n int"
    for order in (probes, probes[::-1]):
        df = spark.createDataFrame(order, kind)
        by_number = monitoring.gate_history(df, number="n").orderBy("n").collect()
        assert [r["changed"] for r in by_number] == [True, False, False]
        by_value = monitoring.gate_history(df).orderBy("max_id").collect()
        assert [r["changed"] for r in by_value] == [True, True, True]

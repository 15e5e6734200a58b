from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sigloom.config import FeedConfig, enabled_exchanges
from sigloom.operators import filters
from tests.conftest import column, rows

NOW = datetime(2024, 1, 31)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_window_bound_is_included(spark, kind):
    edge = NOW - timedelta(minutes=30)
    data = [(1, edge), (2, edge - timedelta(microseconds=1)), (3, NOW), (4, None)]
    df = spark.createDataFrame(data, f"id int, timestamp {kind}")
    assert column(filters.recent_window(df, 30, NOW), "id") == [1, 3]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_window_defaults_to_now(spark, kind):
    df = spark.createDataFrame([(1,), (2,)], "id int").withColumn(
        "timestamp",
        (F.current_timestamp() - F.expr("make_dt_interval(0, 0, if(id = 1, 5, 60))")).cast(kind),
    )
    assert column(filters.recent_window(df, 30), "id") == [1]


def test_window_reaches_the_scan_and_prunes_days(spark, folder):
    from sigloom.sources.layout import write_by_date

    start = datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(i, start + timedelta(hours=i)) for i in range(240)], "id int, timestamp timestamp"
    )
    write_by_date(df, folder)
    stored = spark.read.parquet(folder)
    recent = filters.recent_window(stored, 60 * 24, datetime(2024, 1, 10, 12))
    # From noon to noon, both included: what came after ``as_of`` is not in the window.
    assert recent.count() == 25
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "GreaterThanOrEqual(timestamp" in plan
    days = {r[0] for r in recent.select("event_date").distinct().collect()}
    assert days == {date(2024, 1, 9), date(2024, 1, 10)}


def test_score_bound_is_strict(spark):
    df = spark.createDataFrame(
        [(1, 50.0, 60.0), (2, 50.1, 50.0), (3, 50.1, 50.1), (4, None, 90.0)],
        "id int, score_week double, score_month double",
    )
    assert column(filters.score_threshold(df), "id") == [3]


def test_parameter_bound_rejects_a_record_of_the_old_feed(spark):
    # The sample records: monthly score 69.1 below the bound 70.
    df = spark.createDataFrame(
        [(5247877, 86.2, 69.1, 62.0, 70.0), (5247875, 75.5, 82.3, 62.0, 70.0)],
        "id long, score_week double, score_month double, score_week_filter double, "
        "score_month_filter double",
    )
    assert column(filters.param_threshold(df), "id") == [5247875]


@pytest.mark.parametrize(
    "switches, expected", [((True, True), [1, 2]), ((True, False), [1]), ((False, True), [2])]
)
def test_exchange_switches(spark, switches, expected):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "exchange_id int")
    assert column(filters.on_exchanges(df, enabled_exchanges(*switches)), "exchange_id") == expected


def test_no_exchange_is_an_error(spark):
    with pytest.raises(ValueError):
        enabled_exchanges(False, False)
    with pytest.raises(ValueError):
        FeedConfig(exchanges=())
    with pytest.raises(ValueError):
        filters.on_exchanges(spark.range(1), [])


def test_quiet_hours_end_before_two(spark):
    data = [
        (1, datetime(2024, 1, 1, 0, 0)),
        (2, datetime(2024, 1, 1, 1, 59, 59)),
        (3, datetime(2024, 1, 1, 2, 0)),
        (4, datetime(2024, 1, 1, 23, 59, 59)),
    ]
    df = spark.createDataFrame(data, "id int, timestamp timestamp_ntz")
    assert column(filters.exclude_hours(df), "id") == [3, 4]


def test_unknown_flag_counts_as_inactive(spark):
    df = spark.createDataFrame(
        [(1, True, True), (2, True, None), (3, None, True), (4, False, True)],
        "id int, is_active boolean, pair_is_active boolean",
    )
    assert column(filters.active_rows(df, "is_active", "pair_is_active"), "id") == [1]


def test_total_score_bound_is_strict(spark):
    df = spark.createDataFrame([(1, 250.0), (2, 250.01)], "id int, total_score double")
    assert column(filters.high_total_score(df), "id") == [2]


def test_near_best_includes_its_bound(spark):
    df = spark.createDataFrame(
        [(1, 1000.0), (2, 950.0), (3, 949.99)], "summary_id int, total_pnl_usd double"
    )
    assert column(filters.near_best_pnl(df), "summary_id") == [1, 2]


def test_near_best_of_losses_is_empty(spark):
    df = spark.createDataFrame([(1, -10.0), (2, -20.0)], "summary_id int, total_pnl_usd double")
    assert filters.near_best_pnl(df).isEmpty()


def test_changed_scores_is_null_safe(spark):
    image = "struct<score_week:double,score_month:double,is_active:boolean>"
    data = [
        (1, (60.0, 60.0, True), (60.0, 60.0, True)),
        (2, (None, 60.0, True), (60.0, 60.0, True)),
        (3, (60.0, 60.0, None), (60.0, 60.0, True)),
        (4, (60.0, 60.0, None), (60.0, 60.0, None)),
        (5, (60.0, 60.0, True), (50.0, 60.0, True)),
        (6, (60.0, 40.0, True), (60.0, 61.0, True)),
    ]
    df = spark.createDataFrame(data, f"id int, old {image}, new {image}")
    assert column(filters.changed_scores(df), "id") == [2, 3, 6]


def test_pattern_whitelist_needs_both(spark):
    df = spark.createDataFrame(
        [("SQUEEZE_IGNITION", "1h"), ("SQUEEZE_IGNITION", "1d"), ("PAT2", "1h")],
        "pattern_type string, timeframe string",
    )
    assert rows(filters.pattern_whitelist(df)) == [("SQUEEZE_IGNITION", "1h")]

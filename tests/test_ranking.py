from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sigloom.operators import ranking, sets
from sigloom.plans import best_params
from tests.conftest import column, rows

T0 = datetime(2024, 1, 1)
SUMMARY = "summary_id int, total_pnl_usd double, win_rate double, final_equity double"


def test_missing_win_rate_comes_first(spark):
    df = spark.createDataFrame(
        [(1, 100.0, 90.0, 5.0), (2, 100.0, None, 4.0), (3, 96.0, 99.0, 3.0), (4, 10.0, None, 9.0)],
        SUMMARY,
    )
    assert rows(ranking.best_per_pnl(df), "summary_id") == [(2,), (3,), (4,)]
    assert column(best_params.best_exchange_row(df), "summary_id") == [2]


def test_ties_go_to_the_smaller_number(spark):
    df = spark.createDataFrame([(9, 1.0, 5.0, 1.0), (3, 1.0, 5.0, 1.0)], SUMMARY)
    assert column(ranking.best_per_pnl(df), "summary_id") == [3]
    assert column(ranking.top_by_win_rate(df), "summary_id") == [3]


def test_top_equity_then_win_rate(spark):
    data = [(i, 0.0, float(i), 100.0 - i) for i in range(8)]
    df = spark.createDataFrame(data, SUMMARY)
    assert column(ranking.top_by_equity(df), "summary_id") == [0, 1, 2, 3, 4]
    assert column(best_params.legacy_best_row(df), "summary_id") == [4]
    assert column(best_params.legacy_best_row_by_key(df), "summary_id") == [4]


def feed(spark):
    data = [
        (1, 60.0, T0),
        (2, None, T0),
        (3, 80.0, T0),
        (4, 80.0, T0 + timedelta(minutes=1)),
        (5, 80.0, None),
        (6, 80.0, T0),
    ]
    return spark.createDataFrame(data, "id int, score_week double, timestamp timestamp_ntz")


def test_feed_order_and_both_ends(spark):
    df = feed(spark).repartition(3)
    order = [5, 4, 3, 6, 1, 2]
    assert column(ranking.order_feed(df), "id") == order
    assert column(ranking.limit_feed(df, 2), "id") == order[:2]
    assert column(ranking.tail_buffer(df, 4), "id") == order[-4:]
    assert column(ranking.consumer_top(df, 3), "id") == [5, 4, 3]
    plan = ranking.limit_feed(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_top_of_a_small_feed(spark):
    assert len(ranking.consumer_top(feed(spark), 50).collect()) == 6
    assert len(ranking.tail_buffer(feed(spark), 50).collect()) == 6


def test_high_order(spark):
    data = [(1, 260.0, T0), (2, 300.0, T0), (3, 300.0, T0 + timedelta(minutes=1))]
    df = spark.createDataFrame(data, "id int, total_score double, timestamp timestamp_ntz")
    assert column(ranking.order_high(df), "id") == [3, 2, 1]


def test_ring_takes_the_head_of_every_batch(spark):
    data = [(b, p) for b in range(8) for p in range(12 if b else 3)]
    df = spark.createDataFrame(data, "batch_id int, pos int")
    got = [tuple(r) for r in ranking.recent_ring(df).collect()]
    assert got == [(b, p) for b in (7, 6, 5, 4, 3) for p in range(10)]
    small = [tuple(r) for r in ranking.recent_ring(df.filter("batch_id < 2")).collect()]
    assert small == [(1, p) for p in range(10)] + [(0, p) for p in range(3)]


def test_violations_are_rises_only(spark):
    data = [(0, 90.0), (1, 90.0), (2, 91.0), (3, None), (4, 10.0), (5, 9.0)]
    df = spark.createDataFrame(data, "pos int, score_week double")
    assert column(ranking.order_violations(df), "pos") == [2]
    batches = df.withColumn("batch_id", F.lit(1)).union(df.withColumn("batch_id", F.lit(2)))
    assert len(ranking.order_violations(batches, batch="batch_id").collect()) == 2


def test_violations_across_gaps_and_spans(spark):
    scores = [(k * k, float((k * 7) % 11) if k % 5 else None) for k in range(300)]
    df = spark.createDataFrame(scores, "pos long, score_week double").repartition(4)
    rises = [
        b[0]
        for a, b in zip(scores, scores[1:])
        if a[1] is not None and b[1] is not None and b[1] > a[1]
    ]
    for span in (2, 1000):
        found = ranking.order_violations(df, span=span)
        assert found.columns == ["pos", "score_week", "previous_score_week"]
        assert sorted(column(found, "pos")) == rises
    assert ranking.order_violations(df.limit(0)).isEmpty()


def test_ordered_feed_has_no_violations(spark):
    ordered = ranking.order_feed(feed(spark).filter("score_week is not null")).collect()
    df = spark.createDataFrame(
        [(i, r["score_week"]) for i, r in enumerate(ordered)], "pos int, score_week double"
    )
    assert ranking.order_violations(df).isEmpty()


def test_hot_key_is_pruned_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 2 as k", "id")
    first = ranking.distinct_on(df, ["k"], [F.desc("id")])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert rows(first) == [(0, 998), (1, 999)]


def test_seen_rows_are_left_out(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "signal_id int")
    seen = spark.createDataFrame([(2,), (2,)], "signal_id int")
    assert rows(sets.new_since_seen(df, seen)) == [(1,), (3,)]

from __future__ import annotations

from sigloom.operators import consumer
from sigloom.plans import feeds
from tests.conftest import column, rows

SCHEMA = "id long, exchange_id int, score double, entry_price double, score_week double"


def feed(spark):
    return spark.createDataFrame(
        [
            (1, 1, 0.7, 10.0, 50.0),
            (2, 1, 0.69, 10.0, 99.0),
            (3, 2, 0.9, 10.0, None),
            (4, 1, 0.9, 0.0, 99.0),
            (5, 1, 0.9, None, 99.0),
            (6, 1, None, 10.0, 99.0),
            (7, 1, 0.9, 10.0, 60.0),
        ],
        SCHEMA,
    )


def test_filter(spark):
    assert column(consumer.consumer_filter(feed(spark)), "id") == [1, 3, 7]
    assert column(consumer.consumer_filter(feed(spark), exchanges=["1"]), "id") == [1, 7]
    assert 6 in column(consumer.consumer_filter(feed(spark), min_score=0.0), "id")


def test_top_of_the_kept(spark):
    assert column(feeds.consumer_feed(feed(spark), k=2), "id") == [7, 1]
    assert column(feeds.consumer_feed(feed(spark)), "id") == [7, 1, 3]


def test_errors_stop_nothing(spark):
    def handle(signal):
        if signal["id"] == 3:
            raise ValueError("no liquidity")

    kept = consumer.consumer_filter(feed(spark))
    outcomes = consumer.process_rows(kept, handle)
    assert rows(outcomes) == [
        (1, "processed", None),
        (3, "error", "no liquidity"),
        (7, "processed", None),
    ]
    totals = consumer.processing_totals(feed(spark), consumer.consumable(), outcomes)
    assert rows(totals) == [(7, 4, 2, 1)]


def test_handlers_see_plain_values(spark):
    seen_types = {"id": int, "exchange_id": int, "score": float}

    def handle(signal):
        for name, kind in seen_types.items():
            assert type(signal[name]) is kind, name
        assert signal["score_week"] is None

    rows_in = feed(spark).filter("id = 3")
    assert rows(consumer.process_rows(rows_in, handle)) == [(3, "processed", None)]

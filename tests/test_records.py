from __future__ import annotations

from datetime import datetime

from sigloom.operators import shaping
from tests.conftest import rows

SAMPLE = (
    5247877, "ZKCUSDT", "BUY", 86.2, 69.1, datetime(2025, 10, 21, 2, 15),
    datetime(2025, 10, 21, 2, 33, 2, 231292), 1013315, 1, 62.0, 70.0, 5, 4.0, 2.0, 0.5,
)
COLUMNS = (
    "id long, pair_symbol string, recommended_action string, score_week double, "
    "score_month double, timestamp timestamp_ntz, created_at timestamp_ntz, trading_pair_id long, "
    "exchange_id int, score_week_filter double, score_month_filter double, max_trades_filter int, "
    "stop_loss_filter double, trailing_activation_filter double, trailing_distance_filter double"
)


def test_standard_record_of_the_sample(spark):
    record = shaping.signal_record(spark.createDataFrame([SAMPLE], COLUMNS))
    assert len(record.columns) == 15
    assert rows(record) == [
        (
            *SAMPLE[:5],
            "2025-10-21T02:15:00+00:00",
            "2025-10-21T02:33:02.231292+00:00",
            *SAMPLE[7:],
        )
    ]


def test_zeros_and_gaps(spark):
    bare = (1, "X", None, None, 0.0, None, None, None, None, 0.0, None, 0, 0.0, None, 0.5)
    record = shaping.signal_record(spark.createDataFrame([bare], COLUMNS)).first()
    assert (record["score_week"], record["score_month"], record["timestamp"]) == (0.0, 0.0, None)
    assert [record[c] for c in record.asDict() if c.endswith("_filter")] == [None] * 5 + [0.5]


def test_narrow_records(spark):
    df = spark.createDataFrame([SAMPLE], COLUMNS)
    assert len(shaping.narrow_record(df).columns) == 9
    assert "exchange_id" not in shaping.narrow_record(df, with_exchange=False).columns
    assert len(shaping.narrow_record(df, with_exchange=False).columns) == 8


def test_high_score_record_has_lists_and_constants(spark):
    df = spark.createDataFrame(
        [(1, 2, "X", 260.0, None, 1.0, None, None, 1, 1, None, ["1h"])],
        "id int, trading_pair_id int, pair_symbol string, total_score double, score_week double, "
        "score_month double, timestamp timestamp_ntz, created_at timestamp_ntz, exchange_id int, "
        "contract_type_id int, patterns array<string>, timeframes array<string>",
    )
    record = shaping.high_score_record(df).first().asDict()
    assert len(record) == 19
    assert record["patterns"] == [] and record["timeframes"] == ["1h"]
    assert record["recommended_action"] == "BUY" and record["max_trades_filter"] == 100
    assert record["trailing_activation_filter"] == 48.0


def test_optimized_record_defaults(spark):
    df = spark.createDataFrame(
        [(1, 7, None, None, None, 3.5, None, None, 1, None, "s", "BULL", None, 2.0, None, 190.0)],
        "signal_id int, trading_pair_id int, pair_symbol string, total_score double, "
        "score_week double, score_month double, signal_timestamp timestamp_ntz, "
        "created_at timestamp_ntz, exchange_id int, strategy_signal_type string, "
        "strategy_name string, market_regime string, sl_pct double, ts_activation_pct double, "
        "ts_callback_pct double, strategy_pnl double",
    )
    record = shaping.optimized_record(df).first().asDict()
    assert len(record) == 22
    assert record["recommended_action"] == "BUY" and record["pair_symbol"] == ""
    assert (record["score_week_filter"], record["score_month_filter"]) == (0.0, 3.5)
    assert (record["stop_loss_filter"], record["trailing_activation_filter"]) == (0.0, 2.0)
    assert record["max_trades_filter"] == 10 and record["contract_type_id"] == 1


def test_alert_rounds_half_to_even_and_marks_above_300(spark):
    df = spark.createDataFrame(
        [
            (1, datetime(2024, 1, 1, 9, 5, 59), "X", "BUY", 1.0, 2.0, 0.5, 300.25),
            (2, datetime(2024, 1, 1, 9, 5), "X", "BUY", 1.0, 2.0, 0.5, 300.0),
            (3, datetime(2024, 1, 1, 9, 5), "X", "BUY", 1.0, 2.0, 0.5, 210.35),
        ],
        "signal_id int, signal_timestamp timestamp_ntz, pair_symbol string, signal_type string, "
        "sl_pct double, ts_activation_pct double, ts_callback_pct double, strategy_pnl double",
    )
    got = rows(shaping.alert_row(df), "signal_id", "time", "pnl", "params", "highlight")
    assert got == [
        (1, "2024-01-01 09:05", "300.2%", "1.0% / 2.0% / 0.5%", True),
        (2, "2024-01-01 09:05", "300.0%", "1.0% / 2.0% / 0.5%", False),
        (3, "2024-01-01 09:05", "210.4%", "1.0% / 2.0% / 0.5%", False),
    ]

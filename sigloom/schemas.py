"""Column layouts of the tables, change rows and messages."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def _struct(text: str) -> T.StructType:
    """A flat schema from ``name type`` pairs, without needing a running session."""
    pairs = (entry.split() for entry in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SCORING_HISTORY = _struct(
    "id bigint, trading_pair_id bigint, pair_symbol string, recommended_action string, "
    "score_week double, score_month double, total_score double, pattern_score double, "
    "combination_score double, indicator_score double, patterns_details string, "
    "combinations_details string, timestamp timestamp, created_at timestamp, is_active boolean"
)
TRADING_PAIRS = _struct(
    "id bigint, pair_symbol string, exchange_id int, contract_type_id int, is_active boolean, "
    "last_24h_volume double"
)
_PARAMETERS = (
    "score_week_filter double, score_month_filter double, max_trades_filter int, "
    "stop_loss_filter double, trailing_activation_filter double, trailing_distance_filter double"
)
BACKTEST_SUMMARY = _struct(
    "summary_id bigint, win_rate double, total_pnl_usd double, final_equity double, " + _PARAMETERS
)
SH_PATTERNS = _struct("scoring_history_id bigint, signal_patterns_id bigint")
SIGNAL_PATTERNS = _struct("id bigint, pattern_type string, timeframe string")
SH_REGIME = _struct("scoring_history_id bigint, signal_regime_id bigint")
MARKET_REGIME = _struct("id bigint, timeframe string, timestamp timestamp, regime string")
RESULTS = _struct("scoring_history_id bigint, signal_type string")
BEST_PARAMETERS = _struct(
    "strategy_name string, signal_type string, market_regime string, sl_pct double, "
    "ts_activation_pct double, ts_callback_pct double, total_pnl_pct double"
)

TABLES: dict[str, T.StructType] = {
    "scoring_history": SCORING_HISTORY,
    "trading_pairs": TRADING_PAIRS,
    "backtest_summary": BACKTEST_SUMMARY,
    "backtest_summary_binance": BACKTEST_SUMMARY,
    "backtest_summary_bybit": BACKTEST_SUMMARY,
    "sh_patterns": SH_PATTERNS,
    "signal_patterns": SIGNAL_PATTERNS,
    "sh_regime": SH_REGIME,
    "market_regime": MARKET_REGIME,
    "scoring_history_results_v2": RESULTS,
    "best_parameters": BEST_PARAMETERS,
}

# Parameter columns in record order.
PARAMETER_COLUMNS = [f.name for f in _struct(_PARAMETERS).fields]

# One change row: both images travel together, so no state is needed to compare them.
CHANGE_ROW = T.StructType(
    [
        T.StructField("op", T.StringType()),
        T.StructField("old", SCORING_HISTORY),
        T.StructField("new", SCORING_HISTORY),
        T.StructField("commit_ts", T.TimestampType()),
    ]
)

FEED_RECORD = _struct(
    "id bigint, pair_symbol string, recommended_action string, score_week double, "
    "score_month double, timestamp string, created_at string, trading_pair_id bigint, "
    "exchange_id int, " + _PARAMETERS
)
FEED_MESSAGE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("count", T.IntegerType()),
        T.StructField("part", T.LongType()),
        T.StructField("parts", T.LongType()),
        T.StructField("data", T.ArrayType(FEED_RECORD)),
        T.StructField("message", T.StringType()),
    ]
)
CHANGE_EVENT = _struct(
    "event string, id bigint, pair_symbol string, score_week double, score_month double, "
    "timestamp string, action string"
)

"""The composite feeds.  The check SQL is the literal form; the engine runs its own plan shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.config import HIGH_SCORE_PARAMETERS
from sigloom.operators import joins, ranking, shaping
from sigloom.plans import feeds
from sigloom.registry.base import (
    CONFIG,
    LEGACY_CONFIG,
    LIVE,
    PARAMETERS,
    RECENT,
    SCORED,
    STANDARD,
    iso,
    joined_list,
    query,
    quoted,
    stamp,
)
from sigloom.standins import AS_OF

SCORES = (
    "coalesce(score_week, 0) as score_week, coalesce(score_month, 0) as score_month, "
    f"{iso('timestamp')} as timestamp, {iso('created_at')} as created_at"
)
NULLED = (
    "nullif(score_week_filter, 0) as score_week_filter, "
    "nullif(score_month_filter, 0) as score_month_filter, "
    "nullif(max_trades_filter, 0) as max_trades_filter, "
    "nullif(stop_loss_filter, 0) as stop_loss_filter, "
    "nullif(trailing_activation_filter, 0) as trailing_activation_filter, "
    "nullif(trailing_distance_filter, 0) as trailing_distance_filter"
)
RECORD = f"id, pair_symbol, recommended_action, {SCORES}, trading_pair_id, exchange_id, {NULLED}"
CONSTANTS = ", ".join(
    f"{repr(v) if isinstance(v, str) else v}{'::double' if isinstance(v, float) else ''} as {k}"
    for k, v in HIGH_SCORE_PARAMETERS.items()
)
HIGH_RECORD = (
    "id, trading_pair_id, pair_symbol, coalesce(total_score, 0) as total_score, "
    f"{SCORES}, exchange_id, contract_type_id, {joined_list('patterns')} as patterns, "
    f"{joined_list('timeframes')} as timeframes, {CONSTANTS}"
)
OPTIMIZED_RECORD = (
    "signal_id as id, trading_pair_id, pair_symbol, coalesce(total_score, 0) as total_score, "
    "coalesce(score_week, 0) as score_week, coalesce(score_month, 0) as score_month, "
    f"{iso('signal_timestamp')} as timestamp, {iso('created_at')} as created_at, exchange_id, "
    "1 as contract_type_id, '' as patterns, '' as timeframes, "
    "coalesce(strategy_signal_type, 'BUY') as recommended_action, "
    "coalesce(score_week, 0) as score_week_filter, coalesce(score_month, 0) as "
    "score_month_filter, 10 as max_trades_filter, coalesce(sl_pct, 0) as stop_loss_filter, "
    "coalesce(ts_activation_pct, 0) as trailing_activation_filter, "
    "coalesce(ts_callback_pct, 0) as trailing_distance_filter, strategy_name, market_regime, "
    "strategy_pnl"
)
OPTIMIZED_ROWS = (
    "select f.id as signal_id, pair_id as trading_pair_id, pair_symbol, total_score, score_week, "
    "score_month, f.timestamp as signal_timestamp, created_at, exchange_id, strategy_name, "
    "signal_type as strategy_signal_type, market_regime, sl_pct, ts_activation_pct, "
    "ts_callback_pct, pnl as strategy_pnl from linked_best join strategies using (code) "
    "join scoring_history f using (id) join scoped_symbols using (pair_symbol) "
    f"where f.id in (select id from several) and f.{RECENT}"
)
BEST_ROWS = (
    "select f.id as signal_id, pair_symbol, f.timestamp as signal_timestamp, signal_type, "
    "total_score, market_regime, strategy_name, sl_pct, ts_activation_pct, ts_callback_pct, "
    "pnl as strategy_pnl from hour_typed_best join strategies using (code) "
    "join scoring_history f using (id) where f.id in (select id from several) "
    "and pair_symbol in (select pair_symbol from scoped_symbols)"
)
LEGACY = f"select * from paired, (select {PARAMETERS} from legacy_best) where {RECENT} and {LIVE}"


def alert_percent(column: str) -> str:
    """A profit with one decimal and a percent sign, ties to the even digit."""
    tenths = f"(cast({column} as decimal(18,6)) * 10)"
    whole = f"cast(floor({tenths}) as bigint)"
    up = f"{tenths} - floor({tenths}) > 0.5 or ({tenths} - floor({tenths}) = 0.5 and {whole} % 2 = 1)"
    rounded = f"({whole} + case when {up} then 1 else 0 end)"
    return f"cast({rounded} // 10 as varchar) || '.' || cast({rounded} % 10 as varchar) || '%'"


ALERT = (
    "signal_id, strftime(signal_timestamp, '%Y-%m-%d %H:%M') as time, pair_symbol, signal_type, "
    f"{alert_percent('strategy_pnl')} as pnl, "
    "cast(sl_pct as varchar) || '% / ' || cast(ts_activation_pct as varchar) || '% / ' || "
    "cast(ts_callback_pct as varchar) || '%' as params, strategy_pnl > 300 as highlight"
)
DIAGNOSTIC = (
    f"id, {stamp('timestamp')} as timestamp, pair_symbol, trading_pair_id, total_score, "
    "pattern_score, combination_score, indicator_score, score_week, score_month, "
    "recommended_action, patterns_details, combinations_details, last_24h_volume, exchange_id"
)


@query(
    "Q_STD",
    f"select {RECORD} from with_params where {STANDARD} "
    f"and exchange_id in {quoted(CONFIG.exchanges)}",
)
def standard(t):
    return feeds.standard_feed(t, CONFIG, AS_OF)


@query("Q_HIGH", f"select {HIGH_RECORD} from high_rows")
def high(t):
    return feeds.high_score_feed(t, CONFIG, AS_OF)


@query("Q_OPT", f"select {OPTIMIZED_RECORD} from ({OPTIMIZED_ROWS})")
def optimized(t):
    return feeds.optimized_feed(t, CONFIG, AS_OF)


@query(
    "Q_BEST",
    f"select * exclude (signal_timestamp), {stamp('signal_timestamp')} as signal_timestamp "
    f"from ({BEST_ROWS})",
)
def best(t):
    return feeds.best_signals(t, CONFIG, AS_OF)


@query("Q_BEST_alerts", f"select {ALERT} from ({BEST_ROWS})")
def best_alerts(t):
    return feeds.best_signal_alerts(t, CONFIG, AS_OF)


@query(
    "Q_LEGACY",
    f"select {RECORD} from ({LEGACY}) where least(score_week, score_month) > "
    f"{LEGACY_CONFIG.score_threshold} and score_week + score_month is not null",
)
def legacy(t):
    return feeds.legacy_feed(t, LEGACY_CONFIG, AS_OF)


@query(
    "Q_LEGACY5",
    f"select {RECORD} from (select * from ({LEGACY}) where {SCORED} "
    "order by score_week desc nulls last, timestamp desc nulls first, id limit 5)",
)
def legacy_five(t):
    return feeds.legacy_feed(t, CONFIG, AS_OF, limit=5)


@query(
    "Q_DIAG",
    f"select {DIAGNOSTIC} from paired where {SCORED} and {LIVE} and {RECENT}",
)
def diagnostic(t):
    return feeds.diagnostic_feed(t, CONFIG, AS_OF)


@query(
    "Q_CONSUME",
    "select id, exchange_id, score_week, score_month / 100 as score, last_24h_volume as "
    f"entry_price from paired where coalesce(score_month / 100, 0) >= 0.7 and "
    "exchange_id in (1, 2) and coalesce(last_24h_volume, 0) <> 0 "
    "order by coalesce(score_week, 0) desc, timestamp desc nulls first, id limit 5",
)
def consume(t):
    return feeds.consumer_feed(priced_signals(t), 0.7, (1, 2)).drop("timestamp")


def priced_signals(t):
    """Signals with the two columns consumers filter on and the time they are ordered by."""
    return joins.join_pair_by_id(t("scoring_history"), t("trading_pairs")).select(
        "id",
        "timestamp",
        "exchange_id",
        "score_week",
        (F.col("score_month") / 100).alias("score"),
        F.col("last_24h_volume").alias("entry_price"),
    )

"""The feeds.

``as_of`` fixes the time the window is measured from; without it the current time is used.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.config import BEST_SIGNALS, HIGH_SCORE, LEGACY, OPTIMIZED, STANDARD, FeedConfig
from sigloom.operators import aggregates, consumer, filters, joins, ranking, sets, shaping
from sigloom.plans import best_params, strategies
from sigloom.schemas import PARAMETER_COLUMNS
from sigloom.sources.catalog import Catalog

AsOf = datetime | Column | None


def _recent(catalog: Catalog, config: FeedConfig, as_of: AsOf) -> DataFrame:
    return filters.recent_window(catalog("scoring_history"), config.window_minutes, as_of)


def _recent_active(catalog: Catalog, config: FeedConfig, as_of: AsOf) -> DataFrame:
    return filters.active_rows(_recent(catalog, config, as_of))


def standard_rows(catalog: Catalog, config: FeedConfig = STANDARD, as_of: AsOf = None) -> DataFrame:
    """Signals of the standard feed with the parameters of their exchange, unordered."""
    recent = filters.exclude_hours(_recent_active(catalog, config, as_of), *config.quiet_hours)
    pairs = filters.on_exchanges(filters.active_rows(catalog("trading_pairs")), config.exchanges)
    paired = joins.join_pair_by_id(recent, pairs)
    params = best_params.exchange_params(catalog, config)
    return filters.param_threshold(joins.join_exchange_params(paired, params))


def standard_feed(catalog: Catalog, config: FeedConfig = STANDARD, as_of: AsOf = None) -> DataFrame:
    return shaping.signal_record(ranking.order_feed(standard_rows(catalog, config, as_of)))


def high_score_feed(
    catalog: Catalog, config: FeedConfig = HIGH_SCORE, as_of: AsOf = None
) -> DataFrame:
    """Signals with a very high total score and one of the listed patterns.

    Only listed patterns are shown and at least one is required, so an inner join with the listed
    bridge rows says the same as an existence test plus an outer join.  The signals are few and meet
    the bridge before it is folded, so only their own bridge rows are moved.
    """
    recent = filters.high_total_score(
        _recent_active(catalog, config, as_of), config.total_score_threshold
    )
    pairs = filters.market_scope(filters.active_rows(catalog("trading_pairs")))
    signals = joins.join_pair_by_id(recent.drop("pair_symbol"), pairs).withColumnRenamed(
        "listed_symbol", "pair_symbol"
    )
    bridge = strategies.since_first_id(catalog("sh_patterns"), recent)
    listed = filters.pattern_whitelist(catalog("signal_patterns"))
    folded = aggregates.collect_patterns(
        joins.bridge_join(signals, bridge, listed), ["id"], [c for c in signals.columns if c != "id"]
    )
    return shaping.high_score_record(ranking.order_high(folded))


def _eligible_pairs(catalog: Catalog) -> DataFrame:
    return filters.market_scope(filters.active_rows(catalog("trading_pairs")))


def optimized_rows(
    catalog: Catalog, config: FeedConfig = OPTIMIZED, as_of: AsOf = None
) -> DataFrame:
    """For every multi-pattern signal its most profitable matching strategy.

    Patterns and regimes depend on the signal alone, so each is folded per signal before the two
    meet; joining first would multiply every signal by patterns times regimes.
    """
    recent = _recent(catalog, config, as_of)
    # Pairs of one symbol match the same strategies and the smallest number wins, so one per symbol
    # is enough, however many pairs share it.
    pairs = _eligible_pairs(catalog).groupBy("pair_symbol", "exchange_id").agg(
        F.min("id").alias("id")
    )
    signals = joins.join_pair_by_symbol(recent.drop("trading_pair_id"), pairs).select(
        "id",
        "pair_symbol",
        F.col("timestamp").alias("signal_timestamp"),
        "created_at",
        "total_score",
        "score_week",
        "score_month",
        F.col("matched_pair_id").alias("trading_pair_id"),
        "exchange_id",
    )
    profiles = strategies.profiles(
        strategies.since_first_id(catalog("sh_patterns"), recent),
        catalog("signal_patterns"),
        config.min_patterns,
    )
    regimes = strategies.linked_regimes(
        strategies.since_first_id(catalog("sh_regime"), recent), catalog("market_regime")
    )
    keys = ["market_regime"]
    candidates = strategies.strategy_candidates(
        catalog("best_parameters"), keys, config.min_strategy_pnl
    )
    described = (
        signals.join(profiles, "id")
        .join(regimes, "id")
        .select(
            F.col("id").alias("signal_id"),
            *[c for c in signals.columns if c != "id"],
            "patterns",
            F.explode("market_regimes").alias("market_regime"),
        )
    )
    matches = joins.match_strategy(described, candidates, keys).withColumnRenamed(
        "signal_type", "strategy_signal_type"
    )
    best = ranking.best_match_per_signal(matches, "strategy_signal_type", ["trading_pair_id"])
    return best.drop("patterns", "required_patterns")


def optimized_feed(
    catalog: Catalog, config: FeedConfig = OPTIMIZED, as_of: AsOf = None
) -> DataFrame:
    rows = optimized_rows(catalog, config, as_of)
    return shaping.optimized_record(ranking.sort_finished(rows, "signal_id", F.asc("signal_id")))


def best_signals(
    catalog: Catalog, config: FeedConfig = BEST_SIGNALS, as_of: AsOf = None
) -> DataFrame:
    """For every typed multi-pattern signal its best strategy under a regime of the last hour.

    The pair is not shown, so it only has to exist.  Regimes enter as distinct labels per signal.
    """
    recent = _recent(catalog, config, as_of)
    symbols = _eligible_pairs(catalog).select("pair_symbol")
    typed = joins.result_type_join(
        recent.join(symbols, "pair_symbol", "left_semi").select(
            "id", "pair_symbol", "timestamp", "total_score"
        ),
        strategies.since_first_id(catalog("scoring_history_results_v2"), recent),
    )
    profiles = strategies.profiles(
        strategies.since_first_id(catalog("sh_patterns"), recent),
        catalog("signal_patterns"),
        config.min_patterns,
    )
    hour = timedelta(hours=1)
    regimes = (
        filters.recent_window(
            catalog("market_regime"), config.window_minutes + 60, as_of
        )
        .filter(F.col("timeframe") == "15m")
        .select(F.col("timestamp").alias("regime_time"), F.col("regime").alias("market_regime"))
    )
    labelled = joins.interval_labels(
        typed.join(profiles, "id"), regimes, "market_regime", hour
    ).select(
        F.col("id").alias("signal_id"),
        "pair_symbol",
        F.col("timestamp").alias("signal_timestamp"),
        "signal_type",
        "total_score",
        "market_regime",
        "patterns",
    )
    keys = ["signal_type", "market_regime"]
    candidates = strategies.strategy_candidates(
        catalog("best_parameters"), keys, config.min_strategy_pnl
    )
    matches = joins.match_strategy(labelled, candidates, keys)
    return ranking.best_match_per_signal(matches).drop("patterns", "required_patterns")


def best_signal_alerts(
    catalog: Catalog,
    config: FeedConfig = BEST_SIGNALS,
    as_of: AsOf = None,
    seen: DataFrame | None = None,
) -> DataFrame:
    """Display rows of the best signals, oldest first, without those already seen."""
    rows = best_signals(catalog, config, as_of)
    if seen is not None:
        rows = sets.new_since_seen(rows, seen)
    return shaping.alert_row(ranking.replay_order(rows))


def legacy_feed(
    catalog: Catalog, config: FeedConfig = LEGACY, as_of: AsOf = None, limit: int | None = None
) -> DataFrame:
    """The earlier standard feed: one parameter row for all, constant score bounds."""
    recent = filters.score_threshold(
        _recent_active(catalog, config, as_of), config.score_threshold
    )
    paired = joins.join_pair_by_id(recent, filters.active_rows(catalog("trading_pairs")))
    best = best_params.legacy_best_row(catalog("backtest_summary"))
    rows = joins.cross_best_params(paired, best, PARAMETER_COLUMNS)
    ordered = ranking.order_feed(rows) if limit is None else ranking.limit_feed(rows, limit)
    return shaping.signal_record(ordered)


def diagnostic_feed(
    catalog: Catalog, config: FeedConfig = STANDARD, as_of: AsOf = None
) -> DataFrame:
    recent = filters.score_threshold(
        _recent_active(catalog, config, as_of), config.score_threshold
    )
    paired = joins.join_pair_by_id(recent, filters.active_rows(catalog("trading_pairs")))
    return shaping.diagnostic_record(ranking.order_feed(paired))


def consumer_feed(
    feed: DataFrame, min_score: float = 0.7, exchanges: tuple[int, ...] = (), k: int = 5
) -> DataFrame:
    """The top rows a consumer works on."""
    return ranking.consumer_top(consumer.consumer_filter(feed, min_score, exchanges), k)



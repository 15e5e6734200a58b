"""Strategies and the pattern profile of signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions import strategy_patterns
from sigloom.operators import aggregates, filters, joins, ranking


def best_strategies(parameters: DataFrame, minimum: float = 180.0) -> DataFrame:
    """The best variant of every strategy above the profit bound, with its required patterns."""
    profitable = filters.min_strategy_pnl(parameters, minimum)
    return ranking.best_strategy_variant(profitable).withColumn(
        "required_patterns", strategy_patterns("strategy_name")
    )


def strategy_candidates(
    parameters: DataFrame, keys: Sequence[str], minimum: float = 180.0
) -> DataFrame:
    """Per keys and set of required patterns the one strategy a feed can show.

    Strategies asking for the same set match the same signals, and a feed shows one strategy per
    signal, so of all variants and strategies with one set only the most preferred can ever be
    shown.  It is picked in one pass; copies of a set shrink to one row before the shuffle.
    """
    shaped = (
        filters.min_strategy_pnl(parameters, minimum)
        .filter(F.col("strategy_name").isNotNull())
        .select(
            "strategy_name",
            "signal_type",
            "market_regime",
            "sl_pct",
            "ts_activation_pct",
            "ts_callback_pct",
            F.col("total_pnl_pct").alias("strategy_pnl"),
            F.sort_array(F.array_distinct(strategy_patterns("strategy_name"))).alias(
                "required_patterns"
            ),
        )
    )
    # The array itself is the key: joined to text, [''] and [] would be the same set.
    order = [*ranking.strategy_preference(), *ranking.variant_preference()]
    return ranking.distinct_on(shaped, ["required_patterns", *keys], order)


def since_first_id(
    bridge: DataFrame, recent: DataFrame, key: str = "scoring_history_id"
) -> DataFrame:
    """Bridge rows from the smallest id of the recent signals on.

    Rows below it have no recent signal, whatever order numbers come in.  As they grow with time,
    a bridge stored in arrival order is read only in its newest row groups: the bound is one
    scalar subquery, which Spark hands to the Parquet scan as a literal.
    """
    return bridge.filter(F.col(key) >= recent.agg(F.min("id")).scalar())


def profiles(bridge: DataFrame, patterns: DataFrame, minimum: int = 2) -> DataFrame:
    """``(id, patterns)`` of all signals with at least ``minimum`` different patterns.

    Folding the bridge before it meets the signals keeps a signal with very many rows small.
    """
    rows = joins.keyed_pattern_rows(bridge, patterns)
    folded = aggregates.multi_pattern_having(rows, ["scoring_history_id"], minimum)
    return folded.withColumnRenamed("scoring_history_id", "id")


def linked_regimes(bridge: DataFrame, regimes: DataFrame) -> DataFrame:
    """``(id, market_regimes)``: the distinct regimes a signal is linked to.

    Collected per signal, the rows come out partitioned as the other per-signal frames.
    """
    labels = regimes.filter(F.col("regime").isNotNull()).select(
        F.col("id").alias("signal_regime_id"), "regime"
    )
    return (
        bridge.join(labels, "signal_regime_id")
        .groupBy(F.col("scoring_history_id").alias("id"))
        .agg(F.collect_set("regime").alias("market_regimes"))
    )

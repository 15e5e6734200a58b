"""Choosing the parameters a feed runs with."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sigloom.config import FIRST_EXCHANGE, SECOND_EXCHANGE, FeedConfig
from sigloom.operators import filters, joins, ranking, sets, shaping
from sigloom.schemas import PARAMETER_COLUMNS
from sigloom.sources.catalog import Catalog


def best_exchange_row(summary: DataFrame, share: float = 0.95) -> DataFrame:
    """The winning backtest: near the best profit, one per profit value, best win rate.

    The winner is kept as a whole row, so its parameters need no second scan of the table.
    """
    near = filters.near_best_pnl(summary, share)
    return ranking.top_by_win_rate(ranking.best_per_pnl(near))


def exchange_params(catalog: Catalog, config: FeedConfig) -> DataFrame:
    """One row of parameters per exchange the feed may show."""
    tables = {
        FIRST_EXCHANGE: "backtest_summary_binance",
        SECOND_EXCHANGE: "backtest_summary_bybit",
    }
    branches = [
        shaping.tag_source(
            best_exchange_row(catalog(table), config.near_best_share).select(*PARAMETER_COLUMNS),
            exchange,
        )
        for exchange, table in tables.items()
        if exchange in config.exchanges
    ]
    return sets.union_params(*branches)


def legacy_best_row(summary: DataFrame) -> DataFrame:
    """The best win rate among the five rows with the highest final equity."""
    return ranking.top_by_win_rate(ranking.top_by_equity(summary, 5))


def legacy_best_row_by_key(summary: DataFrame) -> DataFrame:
    """The same through a key lookup, for a ``summary_id`` that several rows share."""
    top = ranking.top_by_equity(summary, 5)
    return ranking.top_by_win_rate(joins.in_top(summary, top))

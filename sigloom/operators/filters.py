"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.config import (
    FIRST_EXCHANGE,
    HIGH_SCORE_PATTERNS,
    HIGH_SCORE_TIMEFRAMES,
    PERPETUAL_CONTRACT,
)
from sigloom.functions import moment
from sigloom.sources.layout import DATE_COLUMN


def recent_window(
    df: DataFrame,
    minutes: int,
    as_of: datetime | Column | None = None,
    column: str = "timestamp",
) -> DataFrame:
    """Rows not older than ``minutes`` before ``as_of`` (now if not given), bound included.

    A given ``as_of`` is an upper bound as well, so a feed replayed for an earlier time shows nothing that
    came later.  On a table laid out by day the same bounds are put on the day column, so whole folders are
    pruned.
    """
    end = moment(df, column, as_of)
    start = end - F.make_dt_interval(mins=F.lit(minutes))
    condition = F.col(column) >= start
    if as_of is not None:
        condition = condition & (F.col(column) <= end)
    if DATE_COLUMN in df.columns:
        condition = condition & (F.col(DATE_COLUMN) >= F.to_date(start))
        if as_of is not None:
            condition = condition & (F.col(DATE_COLUMN) <= F.to_date(end))
    return df.filter(condition)


def score_threshold(df: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Both scores strictly above the threshold."""
    return df.filter((F.col("score_week") > threshold) & (F.col("score_month") > threshold))


def param_threshold(df: DataFrame) -> DataFrame:
    """Both scores strictly above the thresholds that came with the row's exchange."""
    return df.filter(
        (F.col("score_week") > F.col("score_week_filter"))
        & (F.col("score_month") > F.col("score_month_filter"))
    )


def on_exchanges(df: DataFrame, exchanges: Sequence[int]) -> DataFrame:
    """Rows of the enabled exchanges; see ``config.enabled_exchanges`` for the switches."""
    if not exchanges:
        raise ValueError("at least one exchange must be enabled")
    return df.filter(F.col("exchange_id").isin(*exchanges))


def exclude_hours(
    df: DataFrame, first: int = 0, last: int = 1, column: str = "timestamp"
) -> DataFrame:
    """Drop rows whose hour of day (UTC) is between ``first`` and ``last``, both included."""
    return df.filter(~F.hour(column).between(first, last))


def active_rows(df: DataFrame, *flags: str) -> DataFrame:
    """Rows whose flags are all true; NULL counts as inactive."""
    for flag in flags or ("is_active",):
        df = df.filter(F.col(flag))
    return df


def market_scope(
    df: DataFrame, exchange: int = FIRST_EXCHANGE, contract_type: int = PERPETUAL_CONTRACT
) -> DataFrame:
    """Rows of one exchange and one contract type."""
    return df.filter(
        (F.col("exchange_id") == exchange) & (F.col("contract_type_id") == contract_type)
    )


def pattern_whitelist(
    df: DataFrame,
    pattern_types: Sequence[str] = HIGH_SCORE_PATTERNS,
    timeframes: Sequence[str] = HIGH_SCORE_TIMEFRAMES,
) -> DataFrame:
    return df.filter(
        F.col("pattern_type").isin(*pattern_types) & F.col("timeframe").isin(*timeframes)
    )


def high_total_score(df: DataFrame, threshold: float = 250.0) -> DataFrame:
    return df.filter(F.col("total_score") > threshold)


def near_best_pnl(df: DataFrame, share: float = 0.95) -> DataFrame:
    """Rows whose profit is at least ``share`` of the table's largest.

    A negative maximum selects nothing, since the bound then lies above it.
    """
    best = df.agg(F.max("total_pnl_usd")).scalar()
    return df.filter(F.col("total_pnl_usd") >= best * F.lit(share))


def min_strategy_pnl(df: DataFrame, minimum: float = 180.0) -> DataFrame:
    return df.filter(F.col("total_pnl_pct") > minimum)


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is NULL."""
    for column in columns:
        df = df.filter(F.col(column).isNotNull())
    return df


def changed_scores(
    changes: DataFrame,
    threshold: float = 50.0,
    watched: Sequence[str] = ("score_week", "score_month", "is_active"),
) -> DataFrame:
    """Update rows whose new scores pass and in which a watched column changed (NULL-safe)."""
    changed = F.lit(False)
    for column in watched:
        changed = changed | ~F.col(f"new.{column}").eqNullSafe(F.col(f"old.{column}"))
    above = (F.col("new.score_week") > threshold) & (F.col("new.score_month") > threshold)
    return changes.filter(above & changed)


def qualifying_event(
    rows: DataFrame,
    as_of: datetime | Column | None = None,
    minutes: int = 32,
    threshold: float = 50.0,
) -> DataFrame:
    """Changed rows worth announcing: active row, active pair, both scores high, recent.

    ``rows`` are new images with the pair's flag as ``pair_is_active``.
    """
    live = active_rows(rows, "is_active", "pair_is_active")
    return recent_window(score_threshold(live, threshold), minutes, as_of)

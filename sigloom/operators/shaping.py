"""Output records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.config import HIGH_SCORE_PARAMETERS, PERPETUAL_CONTRACT
from sigloom.functions import float_or_null, float_or_zero, int_or_null, iso_text

LEGACY_COLUMNS = [
    "id",
    "pair_symbol",
    "recommended_action",
    "score_week",
    "score_month",
    "timestamp",
    "created_at",
    "trading_pair_id",
]
BASIC_COLUMNS = [*LEGACY_COLUMNS, "exchange_id"]
DIAGNOSTIC_COLUMNS = [
    "id",
    "timestamp",
    "pair_symbol",
    "trading_pair_id",
    "total_score",
    "pattern_score",
    "combination_score",
    "indicator_score",
    "score_week",
    "score_month",
    "recommended_action",
    "patterns_details",
    "combinations_details",
    "last_24h_volume",
    "exchange_id",
]


def signal_record(df: DataFrame) -> DataFrame:
    """The 15-field record: missing scores become 0, zero parameters become NULL."""
    return df.select(
        "id",
        "pair_symbol",
        "recommended_action",
        float_or_zero("score_week").alias("score_week"),
        float_or_zero("score_month").alias("score_month"),
        iso_text("timestamp").alias("timestamp"),
        iso_text("created_at").alias("created_at"),
        "trading_pair_id",
        "exchange_id",
        float_or_null("score_week_filter").alias("score_week_filter"),
        float_or_null("score_month_filter").alias("score_month_filter"),
        int_or_null("max_trades_filter").alias("max_trades_filter"),
        float_or_null("stop_loss_filter").alias("stop_loss_filter"),
        float_or_null("trailing_activation_filter").alias("trailing_activation_filter"),
        float_or_null("trailing_distance_filter").alias("trailing_distance_filter"),
    )


def high_score_record(df: DataFrame) -> DataFrame:
    """The 19-field record with the constant parameters; a missing pattern list becomes empty."""
    empty = F.array().cast("array<string>")
    return df.select(
        "id",
        "trading_pair_id",
        "pair_symbol",
        float_or_zero("total_score").alias("total_score"),
        float_or_zero("score_week").alias("score_week"),
        float_or_zero("score_month").alias("score_month"),
        iso_text("timestamp").alias("timestamp"),
        iso_text("created_at").alias("created_at"),
        "exchange_id",
        "contract_type_id",
        F.coalesce("patterns", empty).alias("patterns"),
        F.coalesce("timeframes", empty).alias("timeframes"),
        *[F.lit(value).alias(name) for name, value in HIGH_SCORE_PARAMETERS.items()],
    )


def optimized_record(df: DataFrame) -> DataFrame:
    """The 22-field record: strategy values in the parameter columns, missing numbers become 0."""
    empty = F.array().cast("array<string>")
    score_week, score_month = float_or_zero("score_week"), float_or_zero("score_month")
    return df.select(
        F.col("signal_id").alias("id"),
        "trading_pair_id",
        F.coalesce("pair_symbol", F.lit("")).alias("pair_symbol"),
        float_or_zero("total_score").alias("total_score"),
        score_week.alias("score_week"),
        score_month.alias("score_month"),
        iso_text("signal_timestamp").alias("timestamp"),
        iso_text("created_at").alias("created_at"),
        "exchange_id",
        F.lit(PERPETUAL_CONTRACT).alias("contract_type_id"),
        empty.alias("patterns"),
        empty.alias("timeframes"),
        F.coalesce("strategy_signal_type", F.lit("BUY")).alias("recommended_action"),
        score_week.alias("score_week_filter"),
        score_month.alias("score_month_filter"),
        F.lit(10).alias("max_trades_filter"),
        float_or_zero("sl_pct").alias("stop_loss_filter"),
        float_or_zero("ts_activation_pct").alias("trailing_activation_filter"),
        float_or_zero("ts_callback_pct").alias("trailing_distance_filter"),
        F.coalesce("strategy_name", F.lit("")).alias("strategy_name"),
        F.coalesce("market_regime", F.lit("")).alias("market_regime"),
        float_or_zero("strategy_pnl").alias("strategy_pnl"),
    )


def narrow_record(df: DataFrame, with_exchange: bool = True) -> DataFrame:
    """The 9-field record, or the 8-field one without the exchange."""
    columns = BASIC_COLUMNS if with_exchange else LEGACY_COLUMNS
    shaped = {
        "score_week": float_or_zero("score_week"),
        "score_month": float_or_zero("score_month"),
        "timestamp": iso_text("timestamp"),
        "created_at": iso_text("created_at"),
    }
    return df.select(*[shaped.get(c, F.col(c)).alias(c) for c in columns])


def diagnostic_record(df: DataFrame) -> DataFrame:
    """15 raw columns, sub-scores and details included."""
    return df.select(*DIAGNOSTIC_COLUMNS)


def alert_row(df: DataFrame, highlight_above: float = 300.0) -> DataFrame:
    """One display row per best signal.

    The profit is rounded as a decimal number, half to even.
    """
    profit = F.bround(F.col("strategy_pnl").cast("decimal(18,6)"), 1).cast("decimal(18,1)")
    settings = F.concat(
        F.col("sl_pct").cast("string"),
        F.lit("% / "),
        F.col("ts_activation_pct").cast("string"),
        F.lit("% / "),
        F.col("ts_callback_pct").cast("string"),
        F.lit("%"),
    )
    return df.select(
        "signal_id",
        F.date_format("signal_timestamp", "yyyy-MM-dd HH:mm").alias("time"),
        "pair_symbol",
        "signal_type",
        F.concat(profit.cast("string"), F.lit("%")).alias("pnl"),
        settings.alias("params"),
        (F.col("strategy_pnl") > highlight_above).alias("highlight"),
    )


def tag_source(df: DataFrame, exchange: int) -> DataFrame:
    """Mark the rows as belonging to one exchange."""
    return df.withColumn("exchange_id", F.lit(exchange))

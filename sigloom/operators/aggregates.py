"""Probes, pattern collections, counts and rates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.config import FIRST_EXCHANGE, SECOND_EXCHANGE
from sigloom.functions import moment
from sigloom.operators import filters, joins


def _probe(df: DataFrame) -> DataFrame:
    return df.agg(
        F.max("id").alias("max_id"),
        F.max("timestamp").alias("max_timestamp"),
        F.count(F.lit(1)).alias("total_count"),
    )


def change_probe(
    facts: DataFrame,
    pairs: DataFrame,
    minutes: int,
    as_of: datetime | Column | None = None,
    threshold: float = 50.0,
) -> DataFrame:
    """Newest id, newest time and number of live signals, as one row."""
    recent = filters.recent_window(filters.active_rows(facts), minutes, as_of)
    live = filters.active_rows(pairs)
    return _probe(joins.join_pair_by_id(filters.score_threshold(recent, threshold), live))


def change_probe_high(
    facts: DataFrame,
    pairs: DataFrame,
    minutes: int,
    as_of: datetime | Column | None = None,
    threshold: float = 250.0,
) -> DataFrame:
    """The probe of the high-score feed; patterns are not looked at."""
    recent = filters.recent_window(filters.active_rows(facts), minutes, as_of)
    live = filters.market_scope(filters.active_rows(pairs))
    return _probe(joins.join_pair_by_id(filters.high_total_score(recent, threshold), live))


def change_probe_id(
    facts: DataFrame, minutes: int, as_of: datetime | Column | None = None
) -> DataFrame:
    """Newest id in the window, whatever the row's state."""
    return filters.recent_window(facts, minutes, as_of).agg(F.max("id").alias("max_id"))


def probe_from_query(feed: DataFrame) -> DataFrame:
    """The probe of an arbitrary feed; it sees exactly the rows the feed would publish."""
    return _probe(feed)


def collect_patterns(
    rows: DataFrame, keys: Sequence[str], carried: Sequence[str] = ()
) -> DataFrame:
    """Sorted distinct pattern types and timeframes per group; NULLs are left out.

    ``carried`` columns have one value in a group and come along.
    """
    return rows.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carried],
        F.sort_array(F.collect_set("pattern_type")).alias("patterns"),
        F.sort_array(F.collect_set("timeframe")).alias("timeframes"),
    )


def collect_pattern_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sorted distinct pattern keys per group."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set("pattern_key")).alias("patterns"))


def multi_pattern_having(rows: DataFrame, keys: Sequence[str], minimum: int = 2) -> DataFrame:
    """Pattern keys of the groups with at least ``minimum`` different patterns.

    Two patterns differ exactly if the smallest and largest number do, which costs no set; any other
    minimum counts the collected numbers.  Either way groups are folded before the shuffle.
    """
    keyed = F.sort_array(F.collect_set("pattern_key")).alias("patterns")
    number = F.col("signal_patterns_id")
    if minimum == 2:
        grouped = rows.groupBy(*keys).agg(
            keyed, F.min(number).alias("_low"), F.max(number).alias("_high")
        )
        return grouped.filter(F.col("_low") < F.col("_high")).drop("_low", "_high")
    grouped = rows.groupBy(*keys).agg(keyed, F.size(F.collect_set(number)).alias("_kinds"))
    return grouped.filter(F.col("_kinds") >= minimum).drop("_kinds")


def global_max(df: DataFrame, column: str = "total_pnl_usd") -> DataFrame:
    return df.agg(F.max(column).alias(f"max_{column}"))


def count_by_exchange(feed: DataFrame) -> DataFrame:
    """Signals on either exchange, as one row."""
    return feed.agg(
        F.count_if(F.col("exchange_id") == FIRST_EXCHANGE).alias("first_exchange"),
        F.count_if(F.col("exchange_id") == SECOND_EXCHANGE).alias("second_exchange"),
    )


def pattern_distribution(feed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many signals of the feed carry each pattern."""
    exploded = feed.select(*keys, F.explode("patterns").alias("pattern"))
    return exploded.groupBy(*keys, "pattern").agg(F.count(F.lit(1)).alias("signals"))


def feed_totals(batches: DataFrame) -> DataFrame:
    """Running totals over a batch log ``(batch_id, count, bytes, error)``, as one row."""
    return batches.agg(
        F.count(F.lit(1)).alias("batches"),
        F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("signals"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def signals_last_minute(
    batches: DataFrame, as_of: datetime | Column | None = None, minutes: int = 1
) -> DataFrame:
    """Signals of the batches younger than one minute (bound excluded)."""
    start = moment(batches, "time", as_of) - F.make_dt_interval(mins=F.lit(minutes))
    young = batches.filter(F.col("time") > start)
    return young.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("signals"))


def average_rate(total: Column, uptime_seconds: Column) -> Column:
    """Signals per second; 0 before any time has passed."""
    return F.when(uptime_seconds > 0, total / uptime_seconds).otherwise(F.lit(0.0))


def seconds_since_last(
    batches: DataFrame, as_of: datetime | Column | None = None, column: str = "time"
) -> DataFrame:
    """Seconds since the last batch; NULL if there was none."""
    now = moment(batches, column, as_of)
    last = F.max(column)
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))
    return batches.agg((micros / F.lit(1000000.0)).alias("seconds_since_last"))

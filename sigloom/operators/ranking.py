"""Best row per key, feed order, limits.

Descending sorts put NULLs first unless said otherwise, as the source database does.  Every order
ends in a tie-break, so results do not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key in the given order.

    Spark prunes to one row per key and task before the shuffle, so a hot key moves little data.
    """
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_row", first).filter(F.col("_row") == 1).drop("_row")


def best_per_pnl(df: DataFrame) -> DataFrame:
    """For every profit value the row with the highest win rate."""
    order = [F.desc_nulls_first("win_rate"), F.asc("summary_id")]
    return distinct_on(df, ["total_pnl_usd"], order)


def variant_preference() -> list[Column]:
    """Order among equally profitable variants of one strategy."""
    return [
        F.asc_nulls_last("sl_pct"),
        F.asc_nulls_last("ts_activation_pct"),
        F.asc_nulls_last("ts_callback_pct"),
    ]


def best_strategy_variant(df: DataFrame) -> DataFrame:
    """For every strategy, signal type and regime the variant with the highest profit."""
    order = [F.desc_nulls_first("total_pnl_pct"), *variant_preference()]
    return distinct_on(df, ["strategy_name", "signal_type", "market_regime"], order)


def strategy_preference(pnl: str = "strategy_pnl", signal_type: str = "signal_type") -> list[Column]:
    """Order in which strategies matching the same signal are preferred."""
    return [
        F.desc_nulls_first(pnl),
        F.asc_nulls_last("strategy_name"),
        F.asc_nulls_last(signal_type),
        F.asc_nulls_last("market_regime"),
    ]


def best_match_per_signal(
    matches: DataFrame, signal_type: str = "signal_type", extra: Sequence[str] = ()
) -> DataFrame:
    """For every signal the matching strategy with the highest profit."""
    order = strategy_preference(signal_type=signal_type)
    order += [F.asc_nulls_last(column) for column in extra]
    return distinct_on(matches, ["signal_id"], order)


def top_by_win_rate(df: DataFrame) -> DataFrame:
    """The one row with the highest win rate."""
    return df.orderBy(F.desc_nulls_first("win_rate"), F.asc("summary_id")).limit(1)


def top_by_equity(df: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` rows with the highest final equity."""
    return df.orderBy(F.desc_nulls_first("final_equity"), F.asc("summary_id")).limit(n)


def feed_order() -> list[Column]:
    return [F.desc_nulls_last("score_week"), F.desc_nulls_first("timestamp"), F.asc("id")]


def reversed_feed_order() -> list[Column]:
    return [F.asc_nulls_first("score_week"), F.asc_nulls_last("timestamp"), F.desc("id")]


def sort_finished(df: DataFrame, key: str, *order: Column, costly: bool = True) -> DataFrame:
    """A global sort, of rows that were costly to make unless said otherwise.

    Spark samples the input of a global sort to find its ranges, which runs the stage in front of it
    twice.  Spreading the finished rows by their unique ``key`` first makes that stage a shuffle to
    read back; the rows are few compared with what they were made from.  A hash of the key is
    used, since a shuffle on the key itself would be planned away if the rows already lie that way.
    Rows of a plain scan (``costly`` off) are sorted as they are: sampling them reads the sort columns
    only.
    """
    return (df.repartition(F.xxhash64(key)) if costly else df).orderBy(*order)


def order_feed(df: DataFrame, costly: bool = True) -> DataFrame:
    return sort_finished(df, "id", *feed_order(), costly=costly)


def order_high(df: DataFrame, costly: bool = True) -> DataFrame:
    order = [F.desc_nulls_first("total_score"), F.desc_nulls_first("timestamp"), F.asc("id")]
    return sort_finished(df, "id", *order, costly=costly)


def limit_feed(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows of the feed (planned as a per-task top-n, without a full sort)."""
    return df.orderBy(*feed_order()).limit(n)


def consumer_top(df: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` rows with the highest weekly score, a missing score counting as 0.

    The rows come in feed order and the sort is stable: equal scores keep the newest first.
    """
    newest = [F.desc_nulls_first("timestamp")] if "timestamp" in df.columns else []
    score = F.coalesce("score_week", F.lit(0.0))
    return df.orderBy(score.desc(), *newest, F.asc("id")).limit(k)


def tail_buffer(df: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` rows of the feed, in feed order.

    Taken as the first ``n`` in reversed order, so no row numbers over the whole feed are needed.
    """
    return df.orderBy(*reversed_feed_order()).limit(n).orderBy(*feed_order())


def recent_ring(df: DataFrame, per_batch: int = 10, size: int = 50) -> DataFrame:
    """The head of every batch, newest batch first, capped at ``size`` rows.

    ``batch_id`` numbers the batches and ``pos`` the rows inside one, from 0.
    """
    head = df.filter(F.col("pos") < per_batch)
    return head.orderBy(F.desc("batch_id"), F.asc("pos")).limit(size)


def batch_positions(df: DataFrame, batch: str, order: Sequence[Column], first: int) -> DataFrame:
    """``pos`` of the first ``first`` rows of every batch, in the given order."""
    rank = F.row_number().over(Window.partitionBy(batch).orderBy(*order))
    return (
        df.withColumn("_rank", rank)
        .filter(F.col("_rank") <= first)
        .withColumn("pos", F.col("_rank") - 1)
        .drop("_rank")
    )


def replay_order(
    df: DataFrame, column: str = "signal_timestamp", costly: bool = True
) -> DataFrame:
    """Oldest first, rows without a time before all."""
    order = [F.asc_nulls_first(column), F.asc("signal_id")]
    return sort_finished(df, "signal_id", *order, costly=costly)


def order_violations(
    df: DataFrame, position: str = "pos", batch: str | None = None, span: int = 1000
) -> DataFrame:
    """Rows whose weekly score is above that of the row just before them.

    Positions are distinct inside a batch and may have gaps.
    """
    keys = [batch] if batch else []
    return (
        _with_previous(df, keys, position, "score_week", span)
        .withColumn("previous_score_week", F.col("_previous.score_week"))
        .drop("_previous")
        .filter(F.col("score_week") > F.col("previous_score_week"))
    )


def _with_previous(
    df: DataFrame, keys: list[str], position: str, value: str, span: int, levels: int = 3
) -> DataFrame:
    """``_previous``: a struct with the value at the next lower position of the same keys.

    Rows look inside their span of positions.  The first of a span takes the last value of the
    span before, found the same way over spans of spans, so no task gets one long history.
    """
    lagged = F.lag(F.struct(value))
    if not levels:
        return df.withColumn("_previous", lagged.over(Window.partitionBy(*keys).orderBy(position)))
    name = f"_span{levels}"
    number = F.floor(F.col(position) / span).cast("bigint")
    cut = df.withColumn(name, number)
    last = cut.groupBy(*keys, name).agg(F.max_by(value, position).alias(value))
    before = _with_previous(last, keys, name, value, span, levels - 1).select(
        *keys, name, F.col("_previous").alias("_before")
    )
    inside = Window.partitionBy(*keys, name).orderBy(position)
    return (
        cut.withColumn("_previous", lagged.over(inside))
        .join(before, [*keys, name])
        .withColumn("_previous", F.coalesce("_previous", "_before"))
        .drop(name, "_before")
    )

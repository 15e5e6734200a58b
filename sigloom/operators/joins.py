"""Joins of signals with pairs, parameters, patterns, regimes and strategies.

No side is broadcast on trust: the planner and AQE compare a side's size with the broadcast
threshold and otherwise use a sort-merge join, which splits skewed partitions.  The exceptions are
sides that are one or two rows by construction.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions import contains_all, pattern_key


def _renamed(df: DataFrame, names: dict[str, str], keep: Sequence[str]) -> DataFrame:
    columns = [F.col(old).alias(new) for old, new in names.items() if old in df.columns]
    return df.select(*columns, *[c for c in keep if c in df.columns])


def pair_columns(pairs: DataFrame, key: str) -> DataFrame:
    """The pair table under names that do not clash with the fact's."""
    names = {"is_active": "pair_is_active"}
    if key == "id":
        names = {"id": "trading_pair_id", "pair_symbol": "listed_symbol", **names}
        return _renamed(pairs, names, ["exchange_id", "contract_type_id", "last_24h_volume"])
    names = {"id": "matched_pair_id", **names}
    return _renamed(
        pairs, names, ["pair_symbol", "exchange_id", "contract_type_id", "last_24h_volume"]
    )


def join_pair_by_id(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Facts with their pair; the pair's flag is ``pair_is_active``, its text ``listed_symbol``."""
    return facts.join(pair_columns(pairs, "id"), "trading_pair_id")


def join_pair_by_symbol(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Facts with every pair of the same symbol; the pair's number is ``matched_pair_id``."""
    return facts.join(pair_columns(pairs, "symbol"), "pair_symbol")


def join_exchange_params(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Rows with the parameters of their exchange.

    ``params`` holds one row per exchange.  That it is small is not taken on trust: Spark broadcasts it
    where its estimated or measured size allows, and joins by sorting otherwise.
    """
    return rows.join(params, "exchange_id")


def cross_best_params(rows: DataFrame, best: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every row with the columns of the one row of ``best``; nothing if ``best`` is empty.

    The one row is a scalar subquery, so the plan has no join at all.
    """
    packed = best.select(F.struct(*[F.col(c) for c in columns])).scalar()
    paired = rows.withColumn("_best", packed).filter(F.col("_best").isNotNull())
    return paired.select(*rows.columns, *[F.col(f"_best.{c}").alias(c) for c in columns])


def exists_pattern(
    facts: DataFrame, bridge: DataFrame, patterns: DataFrame, key: str = "id"
) -> DataFrame:
    """Facts that have at least one of the given patterns."""
    hits = bridge.join(
        patterns.select(F.col("id").alias("signal_patterns_id")), "signal_patterns_id", "left_semi"
    ).select(F.col("scoring_history_id").alias(key))
    return facts.join(hits, key, "left_semi")


def in_top(df: DataFrame, top: DataFrame, key: str = "summary_id") -> DataFrame:
    """Rows whose key is among those of ``top``."""
    return df.join(top.select(key), key, "left_semi")


def lookup_by_best_id(df: DataFrame, best: DataFrame, key: str = "summary_id") -> DataFrame:
    """Rows with the key of the one row of ``best`` (a scalar subquery that reaches the scan)."""
    return df.filter(F.col(key) == best.select(key).scalar())


def pattern_rows(bridge: DataFrame, patterns: DataFrame) -> DataFrame:
    """Bridge rows with their pattern."""
    dimension = patterns.select(
        F.col("id").alias("signal_patterns_id"), "pattern_type", "timeframe"
    )
    return bridge.join(dimension, "signal_patterns_id")


def bridge_join(facts: DataFrame, bridge: DataFrame, patterns: DataFrame) -> DataFrame:
    """Facts with each of their patterns; facts without one are dropped."""
    rows = pattern_rows(bridge, patterns).withColumnRenamed("scoring_history_id", "id")
    return facts.join(rows, "id")


def left_join_patterns(facts: DataFrame, bridge: DataFrame, patterns: DataFrame) -> DataFrame:
    """Facts with each bridge row and, where it is among ``patterns``, its pattern.

    The condition belongs to the join: other bridge rows stay, with a NULL pattern.
    """
    dimension = patterns.select(
        F.col("id").alias("signal_patterns_id"), "pattern_type", "timeframe"
    )
    links = bridge.withColumnRenamed("scoring_history_id", "id")
    return facts.join(links, "id", "left").join(dimension, "signal_patterns_id", "left")


def regime_by_bridge(facts: DataFrame, bridge: DataFrame, regimes: DataFrame) -> DataFrame:
    """Facts with each linked market regime, NULL where there is none."""
    links = bridge.withColumnRenamed("scoring_history_id", "id")
    labels = regimes.select(
        F.col("id").alias("signal_regime_id"), F.col("regime").alias("market_regime")
    )
    return (
        facts.join(links, "id", "left")
        .join(labels, "signal_regime_id", "left")
        .drop("signal_regime_id")
    )


def result_type_join(facts: DataFrame, results: DataFrame) -> DataFrame:
    """Facts with the signal type of each of their results; those without a type are dropped."""
    typed = results.filter(F.col("signal_type").isNotNull()).select(
        F.col("scoring_history_id").alias("id"), "signal_type"
    )
    return facts.join(typed, "id")


def event_pair_lookup(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Changed rows with their pair's flag, NULL where the pair is unknown."""
    flags = pairs.select(
        F.col("id").alias("trading_pair_id"), F.col("is_active").alias("pair_is_active")
    )
    return rows.join(flags, "trading_pair_id", "left")


def _bucket(column: Column, length: timedelta) -> Column:
    micros = int(length / timedelta(microseconds=1))
    return F.floor(F.unix_micros(column.cast("timestamp")) / F.lit(micros)).cast("bigint")


def _interval(length: timedelta) -> Column:
    return F.make_dt_interval(secs=F.lit(length.total_seconds()))


def interval_pieces(
    left: DataFrame,
    right: DataFrame,
    length: timedelta = timedelta(hours=1),
    left_time: str = "timestamp",
    right_time: str = "regime_time",
    most: int = 64,
) -> int:
    """Into how many buckets the interval is best cut, from the density of both sides.

    With ``k`` buckets an interval every right row is written ``k + 1`` times, and a left row meets
    the right rows of ``1 + 1 / k`` intervals.  Together that is least where ``k`` squared is the number of
    comparisons in one interval's length by the number of right rows.  Beyond as many buckets as there are left
    rows to a right row the copies would be more rows than both sides hold, for at most as much less to
    compare: there it ends, so what is moved stays in proportion to the input whatever its density.
    """
    left_rows = left.agg(F.count(left_time)).first()[0]
    seen = right.agg(
        F.count(right_time).alias("n"),
        F.max(F.unix_micros(F.col(right_time).cast("timestamp"))).alias("last"),
        F.min(F.unix_micros(F.col(right_time).cast("timestamp"))).alias("first"),
    ).first()
    if not left_rows or not seen["n"]:
        return 1
    micros = length / timedelta(microseconds=1)
    within = seen["n"] * min(1.0, micros / max(1, seen["last"] - seen["first"]))
    best = round(math.sqrt(left_rows * within / seen["n"]))
    return max(1, min(most, best, left_rows // seen["n"]))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    length: timedelta = timedelta(hours=1),
    left_time: str = "timestamp",
    right_time: str = "regime_time",
    how: str = "left",
    salts: int = 1,
    pieces: int = 1,
    crowd: int | None = None,
) -> DataFrame:
    """Left rows with every right row not later than them and less than ``length`` earlier.

    Time is cut into buckets, ``pieces`` to the interval's length (``interval_pieces`` measures how many
    are best).  A right row goes to its own bucket and the ``pieces`` that follow; a left row only to its
    own.  That gives an equi-join on the bucket with the exact range as residual, and no pair twice.

    ``crowd`` deals the left rows of a bucket with more of them than that to several tasks and copies the
    right rows of these buckets alone.  They are counted first, in a job of its own, and the driver gets those
    buckets, of which there is at most one to ``crowd`` left rows; so no side is moved just to learn its tasks.
    Where nothing can be counted, as in stateful streams, ``salts`` deals the left rows of every bucket to
    that many tasks.
    """
    if crowd is not None and salts > 1:
        raise ValueError("salts are for every bucket, a crowd for counted ones")
    # Rounded up, so that an interval never reaches over more than ``pieces`` bounds.
    width = timedelta(microseconds=-(-(length // timedelta(microseconds=1)) // pieces))
    bucket = _bucket(F.col(left_time), width)
    home = _bucket(F.col(right_time), width)
    later = F.array(*[home + k for k in range(pieces + 1)])
    # The start of a left row's interval, once for the row and not for every pair.
    bucketed = left.withColumn("_bucket", bucket).withColumn(
        "_since", F.col(left_time) - _interval(length)
    )
    spread = right.filter(F.col(right_time).isNotNull()).select(
        "*", F.explode(later).alias("_right_bucket")
    )
    place = F.xxhash64(*left.columns)
    if crowd is not None:
        crowds = (
            bucketed.where(F.col("_bucket").isNotNull())
            .groupBy("_bucket")
            .agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("_tasks"))
            .where(F.col("_tasks") > 1)
        )
        # As local rows their size is known to the planner.
        crowds = left.sparkSession.createDataFrame(crowds.toArrow())
        dealt_to = F.coalesce("_tasks", F.lit(1))
        bucketed = (
            bucketed.join(crowds, "_bucket", "left")
            .withColumn("_salt", F.pmod(place, dealt_to).cast("int"))
            .drop("_tasks")
        )
        spread = (
            spread.join(crowds.withColumnRenamed("_bucket", "_right_bucket"), "_right_bucket", "left")
            .withColumn("_right_salt", F.explode(F.sequence(F.lit(0), dealt_to - 1)))
            .drop("_tasks")
        )
    else:
        salt = F.pmod(place, F.lit(salts)) if salts > 1 else F.lit(0)
        bucketed = bucketed.withColumn("_salt", salt.cast("int"))
        copies = F.array(*[F.lit(i) for i in range(salts)])
        spread = spread.withColumn("_right_salt", F.explode(copies))
    condition = (
        (F.col("_bucket") == F.col("_right_bucket"))
        & (F.col("_salt") == F.col("_right_salt"))
        & (F.col(right_time) <= F.col(left_time))
        & (F.col(right_time) > F.col("_since"))
    )
    helpers = ["_bucket", "_since", "_salt", "_right_bucket", "_right_salt"]
    return bucketed.join(spread, condition, how).drop(*helpers)


def interval_labels(
    left: DataFrame,
    right: DataFrame,
    label: str,
    length: timedelta = timedelta(hours=1),
    left_time: str = "timestamp",
    right_time: str = "regime_time",
) -> DataFrame:
    """Left rows with every distinct label that ``interval_join`` would give them.

    In one bucket and for one label, a right row of the same bucket matches exactly if the earliest
    of them is not later than the left row, and one of the bucket before exactly if the latest of
    them is less than ``length`` earlier.  So each (bucket, label) shrinks to two times before
    the join, and the join never yields a label twice for one left row.
    """
    home = _bucket(F.col(right_time), length)
    times = F.col(right_time)
    extremes = (
        right.filter(times.isNotNull() & F.col(label).isNotNull())
        .groupBy(home.alias("_home"), F.col(label))
        .agg(F.min(times).alias("_earliest"), F.max(times).alias("_latest"))
    )
    own = F.struct(
        F.col("_home").alias("_bucket"),
        F.col("_earliest").alias("_from"),
        F.lit(None).cast(right.schema[right_time].dataType).alias("_until"),
    )
    following = F.struct(
        (F.col("_home") + 1).alias("_bucket"),
        F.lit(None).cast(right.schema[right_time].dataType).alias("_from"),
        (F.col("_latest") + _interval(length)).alias("_until"),
    )
    cover = (
        extremes.select(label, F.explode(F.array(own, following)).alias("_span"))
        .groupBy("_span._bucket", label)
        .agg(F.min("_span._from").alias("_from"), F.max("_span._until").alias("_until"))
    )
    bucketed = left.withColumn("_bucket", _bucket(F.col(left_time), length))
    inside = F.coalesce(F.col(left_time) >= F.col("_from"), F.lit(False)) | F.coalesce(
        F.col(left_time) < F.col("_until"), F.lit(False)
    )
    return bucketed.join(cover, "_bucket").filter(inside).drop("_bucket", "_from", "_until")


def pattern_signature(patterns: str) -> Column:
    """64 bits, one set for each pattern of the list; a list holds another only if its bits do."""
    bit = "shiftleft(1L, cast(pmod(xxhash64(x), 64) as int))"
    return F.expr(f"aggregate({patterns}, 0L, (bits, x) -> bits | {bit})")


def pattern_frequency(signals: DataFrame) -> DataFrame:
    """``(pattern, n)``: how many signals carry each pattern; as small as the dictionary of patterns."""
    carried = signals.select(F.explode(F.array_distinct("patterns")).alias("pattern"))
    return carried.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def indexed_strategies(strategies: DataFrame, frequency: DataFrame | None = None) -> DataFrame:
    """Every strategy with its rarest required pattern as ``_index``, NULL if it requires none.

    ``frequency`` (``pattern``, ``n``) counts the signals that carry a pattern; without it the strategies that
    require it are counted, which deals them evenly.  A pattern not in it is the rarest of all.
    """
    listed = strategies.filter(F.col("required_patterns").isNotNull()).withColumn(
        "_strategy", F.monotonically_increasing_id()
    )
    needed = listed.select("*", F.explode_outer(F.array_distinct("required_patterns")).alias("_pattern"))
    if frequency is None:
        strategies_with = strategies.withColumnRenamed("required_patterns", "patterns")
        frequency = pattern_frequency(strategies_with.select("patterns"))
    counted = needed.join(
        frequency.select(F.col("pattern").alias("_pattern"), "n"), "_pattern", "left"
    )
    rarity = F.when(
        F.col("_pattern").isNotNull(), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "_pattern")
    )
    return (
        counted.groupBy("_strategy")
        .agg(
            F.min(rarity)["_pattern"].alias("_index"),
            *[F.first(c).alias(c) for c in strategies.columns],
        )
        .select(*strategies.columns, "_index", pattern_signature("required_patterns").alias("_need"))
    )


def looking(signals: DataFrame) -> DataFrame:
    """A row for each index a signal's strategies may have: its patterns, and NULL."""
    nothing = F.array(F.lit(None).cast("string"))
    owned = F.array_except("patterns", nothing)
    return signals.withColumn("_have", pattern_signature("patterns")).select(
        "*", F.explode(F.concat(owned, nothing)).alias("_look")
    )


def match_strategy(
    signals: DataFrame,
    strategies: DataFrame,
    keys: Sequence[str] = ("market_regime",),
    frequency: DataFrame | None = None,
) -> DataFrame:
    """Signals with every strategy of equal keys whose required patterns they all have.

    ``signals`` has ``patterns``, ``strategies`` has ``required_patterns``; both have the keys.
    Joining on the keys alone would compare every signal of a regime with every strategy of it.
    Here a strategy is indexed under the rarest pattern it requires and a signal looks under each of its
    own, so a pair meets at most once, and a signal makes as many rows as it has patterns and one.
    Bits of the lists rule most false pairs out before the lists are compared.  ``signals`` should
    be narrow: join what else is shown to the rows that are chosen.
    """
    clash = (set(signals.columns) & set(strategies.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    looked = looking(signals)
    same = [F.col(f"signal.{k}") == F.col(f"strategy.{k}") for k in keys]
    same += [
        F.col("signal._look").eqNullSafe(F.col("strategy._index")),
        F.col("signal._have").bitwiseAND(F.col("strategy._need")) == F.col("strategy._need"),
    ]
    indexed = indexed_strategies(strategies, frequency).alias("strategy")
    joined = looked.alias("signal").join(indexed, same)
    longer = F.size("strategy.required_patterns") > 1
    joined = joined.filter(
        ~longer | contains_all("signal.patterns", "strategy.required_patterns")
    )
    return joined.select(
        *[F.col(f"signal.{c}") for c in signals.columns],
        *[F.col(f"strategy.{c}") for c in strategies.columns if c not in keys],
    )


def match_strategy_typed(
    signals: DataFrame, strategies: DataFrame, frequency: DataFrame | None = None
) -> DataFrame:
    """``match_strategy`` with the signal type as a second key."""
    return match_strategy(signals, strategies, ("signal_type", "market_regime"), frequency)


def keyed_pattern_rows(bridge: DataFrame, patterns: DataFrame) -> DataFrame:
    """Bridge rows with their pattern and its ``pattern_key``."""
    return pattern_rows(bridge, patterns).withColumn(
        "pattern_key", pattern_key("pattern_type", "timeframe")
    )

"""Signal tables derived from the generated test data.

Every column is one SQL expression that Spark and DuckDB read alike, so the engine and the check
SQL share them.  All source rows are used.
"""

from __future__ import annotations

import functools
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from sigloom.sources.catalog import Catalog

AS_OF = datetime(2024, 1, 31)
WINDOW_MINUTES = 10080

_SYMBOL = "concat('PAIR', cast(cast(floor({0}/2) as bigint) as string))"
_PAIR_OF_EVENT = "((event_id*7) % 200)"


def _pattern_type(number: str) -> str:
    return (
        f"case ({number}) % 6 when 0 then 'SQUEEZE_IGNITION' when 1 then 'OI_EXPLOSION' "
        "when 2 then 'PAT2' when 3 then 'PAT3' when 4 then 'PAT4' else 'PAT5' end"
    )


def _timeframe(number: str) -> str:
    return (
        f"case cast(floor(({number})/6) as bigint) when 0 then '15m' when 1 then '1h' "
        "when 2 then '4h' else '1d' end"
    )


_SIDE = "case when c_custkey % 2 = 0 then 'BUY' else 'SELL' end"
_REGIME = "case c_custkey % 3 when 0 then 'BULL' when 1 then 'BEAR' else 'FLAT' end"
_FIRST, _SECOND = "c_custkey % 24", "c_nationkey % 24"
_STRATEGY = (
    f"concat('[', chr(39), {_pattern_type(_FIRST)}, '_', {_timeframe(_FIRST)}, chr(39), ', ', "
    f"chr(39), {_pattern_type(_SECOND)}, '_', {_timeframe(_SECOND)}, chr(39), ']|', "
    f"{_SIDE}, '|', {_REGIME})"
)


def _score(factor: int) -> str:
    return f"cast((event_id*{factor}) % 1000 as double)/10"


_BACKTEST = {
    "summary_id": "c_custkey",
    "total_pnl_usd": "floor(c_acctbal/100)*cast(100 as double)",
    "win_rate": "case when c_custkey % 13 = 0 then null else cast(c_nationkey*4 as double) end",
    "final_equity": "c_acctbal + 10000",
    "score_week_filter": "cast(20 as double) + (c_custkey % 5)*5",
    "score_month_filter": "cast(15 as double) + (c_custkey % 4)*5",
    "max_trades_filter": "cast(1 + c_custkey % 9 as int)",
    "stop_loss_filter": "cast(c_custkey % 6 as double)",
    "trailing_activation_filter": "cast(2 as double) + c_custkey % 4",
    "trailing_distance_filter": "cast(0.5 as double) + c_custkey % 2",
}

# table -> (source, condition, distinct, columns); the two exchange summaries share the customers.
DEFINITIONS: dict[str, tuple[str, str | None, bool, dict[str, str]]] = {
    "trading_pairs": (
        "part",
        None,
        False,
        {
            "id": "p_partkey",
            "pair_symbol": _SYMBOL.format("p_partkey"),
            "exchange_id": "cast(1 + p_partkey % 2 as int)",
            "contract_type_id": "case when p_partkey % 5 = 0 then 2 else 1 end",
            "is_active": "p_size % 10 <> 0",
            "last_24h_volume": "p_retailprice * p_size",
        },
    ),
    "scoring_history": (
        "events",
        None,
        False,
        {
            "id": "event_id",
            "trading_pair_id": _PAIR_OF_EVENT,
            "pair_symbol": _SYMBOL.format(_PAIR_OF_EVENT),
            "recommended_action": "case when event_id % 3 = 0 then 'SELL' else 'BUY' end",
            "score_week": f"case when event_id % 41 = 0 then null else {_score(37)} end",
            "score_month": _score(53),
            "total_score": "value*5",
            "pattern_score": _score(11),
            "combination_score": _score(13),
            "indicator_score": _score(17),
            "patterns_details": "props",
            "combinations_details": "props",
            "timestamp": "ts",
            "created_at": "ts + interval '18' minute",
            "is_active": "event_type <> 'error'",
        },
    ),
    "signal_patterns": (
        "part",
        None,
        True,
        {
            "id": "p_partkey % 24",
            "pattern_type": _pattern_type("p_partkey % 24"),
            "timeframe": _timeframe("p_partkey % 24"),
        },
    ),
    "sh_patterns": (
        "lineitem",
        None,
        False,
        {"scoring_history_id": "l_orderkey", "signal_patterns_id": "l_partkey % 24"},
    ),
    "market_regime": (
        "events",
        None,
        False,
        {
            "id": "event_id",
            "timeframe": "case when event_id % 4 = 0 then '15m' else '1h' end",
            "timestamp": "ts",
            "regime": "case event_id % 3 when 0 then 'BULL' when 1 then 'BEAR' else 'FLAT' end",
        },
    ),
    "sh_regime": (
        "events",
        None,
        False,
        {
            "scoring_history_id": "event_id",
            "signal_regime_id": "case when event_id % 10 = 0 then null "
            "else cast(floor(event_id/4)*4 as bigint) end",
        },
    ),
    "scoring_history_results_v2": (
        "events",
        None,
        False,
        {
            "scoring_history_id": "event_id",
            "signal_type": "case when event_id % 7 = 0 then null "
            "when event_id % 3 = 0 then 'SELL' else 'BUY' end",
        },
    ),
    "best_parameters": (
        "customer",
        None,
        False,
        {
            "strategy_name": _STRATEGY,
            "signal_type": _SIDE,
            "market_regime": _REGIME,
            "sl_pct": "cast(1 as double) + c_custkey % 5",
            "ts_activation_pct": "cast(2 as double) + c_custkey % 7",
            "ts_callback_pct": "cast(0.5 as double) + c_custkey % 3",
            "total_pnl_pct": "c_acctbal/20",
        },
    ),
    "backtest_summary": ("customer", None, False, _BACKTEST),
    "backtest_summary_binance": ("customer", "1 + c_custkey % 2 = 1", False, _BACKTEST),
    "backtest_summary_bybit": ("customer", "1 + c_custkey % 2 = 2", False, _BACKTEST),
}


def derive(rows: DataFrame, name: str) -> DataFrame:
    """Table ``name`` from its source rows; the rows may also be a stream."""
    _, condition, distinct, columns = DEFINITIONS[name]
    if condition:
        rows = rows.filter(condition)
    frame = rows.selectExpr(*[f"{text} as {column}" for column, text in columns.items()])
    return frame.distinct() if distinct else frame


@functools.lru_cache(maxsize=64)
def _source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def standin_catalog(spark: SparkSession, folder: str) -> Catalog:
    """The signal tables over the test data in ``folder``; a table is read when first asked for."""

    @functools.cache
    def table(name: str) -> DataFrame:
        return derive(_source(spark, folder, DEFINITIONS[name][0]), name)

    return Catalog(spark, {name: functools.partial(table, name) for name in DEFINITIONS})


def standin_sql(name: str) -> str:
    """The same table as one SQL select."""
    source, condition, distinct, columns = DEFINITIONS[name]
    listed = ", ".join(f"{text} as {column}" for column, text in columns.items())
    where = f" where {condition}" if condition else ""
    return f"select {'distinct ' if distinct else ''}{listed} from {source}{where}"

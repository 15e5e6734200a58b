"""Registration of queries and assembly of their check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.config import (
    FIRST_EXCHANGE,
    HIGH_SCORE_PATTERNS,
    HIGH_SCORE_TIMEFRAMES,
    PERPETUAL_CONTRACT,
    SECOND_EXCHANGE,
    FeedConfig,
)
from sigloom.sources.catalog import Catalog
from sigloom.standins import AS_OF, DEFINITIONS, WINDOW_MINUTES, standin_catalog, standin_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CONFIG = FeedConfig(window_minutes=WINDOW_MINUTES)
LEGACY_CONFIG = FeedConfig(window_minutes=WINDOW_MINUTES, score_threshold=55.0)

NOW = f"timestamp '{AS_OF.isoformat(sep=' ')}'"
RECENT = f"timestamp between {NOW} - interval '{WINDOW_MINUTES}' minute and {NOW}"

PARAMETERS = (
    "score_week_filter, score_month_filter, max_trades_filter, stop_loss_filter, "
    "trailing_activation_filter, trailing_distance_filter"
)


def iso(column: str) -> str:
    """ISO text of a time in DuckDB."""
    return (
        f"(strftime({column}, '%Y-%m-%dT%H:%M:%S') || case when microsecond({column}) % 1000000 = 0 "
        f"then '' else strftime({column}, '.%f') end || '+00:00')"
    )


def stamp(column: str) -> str:
    """Full text of a time in DuckDB, as ``comparable`` writes it."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def joined_list(column: str) -> str:
    return f"array_to_string({column}, ',')"


def comparable(df: DataFrame) -> DataFrame:
    """Lists and times as text, so that two engines' results compare by plain values."""
    shown = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column, ",")
        elif isinstance(field.dataType, T.TimestampType | T.TimestampNTZType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        shown.append(column.alias(field.name))
    return df.select(*shown)


def quoted(values) -> str:
    """Values as the list of an SQL ``in``."""
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


# Conditions, from the settings the engine uses.
LISTED = f"pattern_type in {quoted(HIGH_SCORE_PATTERNS)} and timeframe in {quoted(HIGH_SCORE_TIMEFRAMES)}"
LIVE = "is_active and pair_is_active"
SCOPED = f"exchange_id = {FIRST_EXCHANGE} and contract_type_id = {PERPETUAL_CONTRACT}"
SCORED = f"score_week > {CONFIG.score_threshold} and score_month > {CONFIG.score_threshold}"
HIGH = f"total_score > {CONFIG.total_score_threshold}"
QUIET = quoted(range(CONFIG.quiet_hours[0], CONFIG.quiet_hours[1] + 1))
STANDARD = (
    f"{RECENT} and {LIVE} and score_week - score_week_filter > 0 and score_month - "
    f"score_month_filter > 0 and hour(timestamp) not in {QUIET}"
)

HIGHEST_RATE = "win_rate desc nulls first, summary_id"
VARIANTS = "total_pnl_pct desc, sl_pct, ts_activation_pct, ts_callback_pct"
PREFERRED = "pnl desc, strategy_name, signal_type nulls last, market_regime"


def _summary_row(table: str, among: str) -> str:
    """The row of ``table`` whose number comes first by win rate among some."""
    chosen = f"select first(summary_id order by {HIGHEST_RATE}) from ({among})"
    return f"select * from {table} where summary_id = ({chosen})"


def _best_of(table: str) -> str:
    top = f"select max(total_pnl_usd) * {CONFIG.near_best_share} as least from {table}"
    return _summary_row(table, f"select * from {table}, ({top}) where total_pnl_usd >= least")


def _division(regimes: str) -> str:
    """Relational division: pairs of a signal and a strategy of its regime with no requirement open."""
    return (
        f"select id, market_regime, code from {regimes} join owned using (id) join requirements "
        "using (pattern_key, market_regime) group by all having count(*) = max(size) union all "
        f"select r.id, r.market_regime, s.code from {regimes} r join strategies s using "
        "(market_regime) where s.size = 0 and r.id in (select scoring_history_id from keyed)"
    )


def _chosen(matches: str, condition: str = "true") -> str:
    """For every signal the matching strategy that is preferred."""
    return (
        f"select id, first(code order by {PREFERRED}) as code from {matches} "
        f"join strategies using (code, market_regime) where {condition} group by id"
    )


# Named selects the check SQL may use; each may use the ones before it.
FRAGMENTS: dict[str, str] = {
    "paired": (
        "select * from scoring_history join (select id as trading_pair_id, pair_symbol as "
        "listed_symbol, is_active as pair_is_active, exchange_id, contract_type_id, "
        "last_24h_volume from trading_pairs) using (trading_pair_id)"
    ),
    "best_first": _best_of("backtest_summary_binance"),
    "best_second": _best_of("backtest_summary_bybit"),
    "exchange_params": (
        f"select exchange_id, {PARAMETERS} from (select {FIRST_EXCHANGE} as exchange_id, * from "
        f"best_first union all select {SECOND_EXCHANGE}, * from best_second)"
    ),
    "with_params": "select * from paired join exchange_params using (exchange_id)",
    "legacy_best": _summary_row(
        "backtest_summary",
        "select *, row_number() over (order by final_equity desc nulls first, summary_id) as place "
        "from backtest_summary qualify place <= 5",
    ),
    "keyed": (
        "select scoring_history_id, signal_patterns_id, pattern_type, timeframe, "
        "pattern_type || '_' || timeframe as pattern_key from sh_patterns join "
        "(select id as signal_patterns_id, pattern_type, timeframe from signal_patterns) "
        "using (signal_patterns_id)"
    ),
    # A strategy by the first of its variants, and what it requires.
    "strategies": (
        "select *, row_number() over (order by strategy_name, signal_type, market_regime) as code, "
        "len(list_distinct(needed)) as size from (select strategy_name, signal_type, market_regime, "
        f"first(sl_pct order by {VARIANTS}) as sl_pct, first(ts_activation_pct order by {VARIANTS}) "
        f"as ts_activation_pct, first(ts_callback_pct order by {VARIANTS}) as ts_callback_pct, "
        "max(total_pnl_pct) as pnl, list_filter(string_split(translate(split_part(strategy_name, "
        "'|', 1), '[]' || chr(39), ''), ', '), lambda x: x <> '') as needed from best_parameters "
        f"where total_pnl_pct > {CONFIG.min_strategy_pnl} "
        "group by strategy_name, signal_type, market_regime)"
    ),
    "requirements": (
        "select code, size, market_regime, unnest(list_distinct(needed)) as pattern_key "
        "from strategies"
    ),
    "owned": (
        "select distinct scoring_history_id as id, pattern_key from keyed "
        "where pattern_key is not null"
    ),
    "several": (
        "select scoring_history_id as id from keyed group by scoring_history_id "
        "having min(signal_patterns_id) < max(signal_patterns_id)"
    ),
    "linked_regimes": (
        "select distinct scoring_history_id as id, regime as market_regime from sh_regime, "
        "market_regime w where w.id = signal_regime_id and regime is not null"
    ),
    # The distinct regimes of a signal's last hour.
    "hour_regimes": (
        "select f.id, unnest(list(distinct w.regime)) as market_regime from (select id, timestamp "
        f"from scoring_history where {RECENT}) f join market_regime w on f.timestamp >= w.timestamp "
        "and w.timestamp > f.timestamp - interval '3600' second where w.timeframe = '15m' "
        "and w.regime is not null group by f.id"
    ),
    "linked_matches": _division("linked_regimes"),
    "hour_matches": _division("hour_regimes"),
    "result_types": (
        "select distinct scoring_history_id as id, signal_type as result_type "
        "from scoring_history_results_v2 where signal_type is not null"
    ),
    "linked_best": _chosen("linked_matches"),
    "linked_typed_best": _chosen(
        "linked_matches join result_types using (id)", "result_type = signal_type"
    ),
    "hour_typed_best": _chosen(
        "hour_matches join result_types using (id)", "result_type = signal_type"
    ),
    "scoped_symbols": (
        "select pair_symbol, exchange_id, min(id) as pair_id from trading_pairs "
        f"where is_active and {SCOPED} group by all"
    ),
    "high_rows": (
        "select * exclude (pair_symbol), listed_symbol as pair_symbol from paired join (select "
        "scoring_history_id as id, list_sort(list(distinct pattern_type)) as patterns, "
        "list_sort(list(distinct timeframe)) as timeframes from keyed "
        f"where {LISTED} group by 1) using (id) where {HIGH} and {LIVE} and {SCOPED} and {RECENT}"
    ),
}


def assemble(sql: str, standins: bool = True) -> str:
    """Put the stand-in tables and fragments a statement uses in front of it.

    Without stand-ins the signal tables have to exist under their own names.
    """
    tables = {name: standin_sql(name) for name in DEFINITIONS} if standins else {}
    parts = {**tables, **FRAGMENTS}
    used: set[str] = set()

    def visit(text: str) -> None:
        for name in parts:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                visit(parts[name])

    visit(sql)
    ctes = ", ".join(f"{name} as ({parts[name]})" for name in parts if name in used)
    if not ctes:
        return sql
    body = sql.strip()
    for start in ("with recursive ", "with "):
        if body.lower().startswith(start):
            return f"{start}{ctes}, {body[len(start):]}"
    return f"with {ctes} {body}"


def _catalog(spark: SparkSession, folder: str) -> Catalog:
    """The stand-in tables; the check SQL knows times in UTC only."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return standin_catalog(spark, folder)


def query(name: str, oracle: str | None = None):
    """Register ``f(catalog) -> DataFrame`` under ``name`` with its check SQL."""

    def register(build: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, folder: comparable(build(_catalog(spark, folder)))
        if oracle is not None:
            ORACLES[name] = assemble(oracle)
        return build

    return register


def stream_query(name: str, oracle: str | None = None):
    """Like ``query`` for ``f(spark, folder, catalog)`` that drives a streaming query."""

    def register(build: Callable[[SparkSession, str, Catalog], DataFrame]):
        QUERIES[name] = lambda spark, folder: comparable(
            build(spark, folder, _catalog(spark, folder))
        )
        if oracle is not None:
            ORACLES[name] = assemble(oracle)
        return build

    return register

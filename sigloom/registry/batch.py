"""Single operators in batch form, over whole tables unless the operator is a time window."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from sigloom.config import HIGH_SCORE_PARAMETERS, enabled_exchanges
from sigloom.functions import float_or_zero, iso_text, pattern_key, strategy_patterns
from sigloom.operators import (
    aggregates,
    consumer,
    filters,
    joins,
    positions,
    ranking,
    sets,
    shaping,
)
from sigloom.plans import best_params, feeds, monitoring, strategies
from sigloom.registry.base import (
    CONFIG,
    HIGH,
    HIGHEST_RATE,
    LISTED,
    LIVE,
    NOW,
    PARAMETERS,
    QUIET,
    RECENT,
    SCOPED,
    SCORED,
    STANDARD,
    VARIANTS,
    WINDOW_MINUTES,
    iso,
    joined_list,
    query,
    stamp,
)
from sigloom.registry.feeds import (
    DIAGNOSTIC,
    RECORD,
    SCORES,
    alert_percent,
    priced_signals,
)
from sigloom.registry.streams import updates
from sigloom.schemas import PARAMETER_COLUMNS
from sigloom.session import working_folder
from sigloom.sources import messages
from sigloom.sources.catalog import scan_tables
from sigloom.standins import AS_OF, DEFINITIONS

LIST_OF = (
    "string_split(regexp_replace(split_part(strategy_name, '|', 1), '[\\[\\]'']', '', 'g'), ', ')"
)


def paired(t):
    return joins.join_pair_by_id(t("scoring_history"), t("trading_pairs"))


def with_params(t):
    return joins.join_exchange_params(paired(t), best_params.exchange_params(t, CONFIG))


def best_strategy_rows(t):
    return strategies.best_strategies(t("best_parameters"))


# --- sources and messages -------------------------------------------------------------------


@query(
    "S1_scan_tables",
    " union all ".join(
        f"select '{name}' as table_name, count(*) as row_count from {name}" for name in DEFINITIONS
    ),
)
def s1(t):
    return scan_tables(t)


@query(
    "S2_recent_window",
    f"select id, {stamp('timestamp')} as timestamp from scoring_history where {RECENT}",
)
def s2(t):
    facts = t("scoring_history").select("id", "timestamp")
    return filters.recent_window(facts, WINDOW_MINUTES, AS_OF)


#: Text a message of the query below may have.
MESSAGE_BYTES = 20_000
SENT = ["id", "pair_symbol", "recommended_action", "score_week", "score_month"]
_SENT_TEXT = ", ".join(f"'{c}': {c}" for c in SENT)
_MESSAGE_HEAD = (
    f"'{{\"type\":\"signals\",\"timestamp\":\"' || {iso(NOW)} || '\",\"count\":' || n || "
    "',\"part\":' || part || ',\"parts\":' || parts || ',\"data\":[' || data || ']}'"
)


@query(
    "S6_envelope",
    "with texts as (select cast(to_json({" + _SENT_TEXT + "}) as varchar) as text, row_number() "
    "over (order by score_week desc nulls last, timestamp desc nulls first, id) as place "
    "from scoring_history), "
    "sizes as (select *, strlen(text) + 1 as size from texts), "
    "begun as (select text, place, sum(size) over (order by place) - size as begins from sizes), "
    f"wide as (select {MESSAGE_BYTES} - {messages.MESSAGE_OVERHEAD} - max(size) + 1 as width "
    "from sizes), "
    "cut as (select text, place, floor(begins / width) as stretch from begun cross join wide), "
    "gathered as (select stretch, count(*) as n, string_agg(text, ',' order by place) as data "
    "from cut group by stretch), "
    "counted as (select *, row_number() over (order by stretch) - 1 as part, count(*) over () "
    "as parts from gathered) "
    f"select part, parts, cast(n as int) as count, {_MESSAGE_HEAD} as value from counted",
)
def s6(t):
    rows = ranking.order_feed(t("scoring_history")).select(*SENT)
    return messages.envelope(rows, AS_OF, MESSAGE_BYTES)


@query(
    "S7_parse_envelope",
    f"select {RECORD}, row_number() over (order by score_week desc nulls last, "
    "timestamp desc nulls first, id) - 1 as place from with_params",
)
def s7_envelope(t):
    """Whole records sent in messages of bounded size, parsed and in order again."""
    sent = messages.envelope(
        shaping.signal_record(ranking.order_feed(with_params(t))), AS_OF, MESSAGE_BYTES
    )
    received = messages.parse_feed(sent)
    number = Window.orderBy("part")
    before = received.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", (F.sum("n").over(number) - F.col("n")).alias("before")
    )
    return received.join(before, "part").select(
        *[c for c in received.columns if c not in ("part", "pos")],
        (F.col("before") + F.col("pos")).alias("place"),
    )


@query(
    "S7_complete_snapshot",
    "select id, pair_symbol, recommended_action, score_week, score_month, row_number() over "
    "(partition by part order by place) - 1 as pos, part from (select *, dense_rank() over "
    "(order by stretch) - 1 as part from (select *, floor((sum(size) over (order by place) - size) "
    f"/ ({MESSAGE_BYTES} - {messages.MESSAGE_OVERHEAD} - max(size) over () + 1)) as stretch from "
    "(select *, strlen(cast(to_json({" + _SENT_TEXT + "}) as varchar)) + 1 as size, row_number() "
    "over (order by score_week desc nulls last, timestamp desc nulls first, id) as place "
    "from scoring_history where is_active)))",
)
def s7_complete(t):
    """Three snapshots in mixed messages; the newest lacks its last part, so the second is served."""
    facts = ranking.order_feed(t("scoring_history")).select(*SENT, "is_active")
    active = facts.where("is_active").drop("is_active")
    sent = [
        messages.envelope(rows, AS_OF + timedelta(seconds=k), MESSAGE_BYTES)
        for k, rows in enumerate([facts.drop("is_active"), active, facts.drop("is_active")])
    ]
    sent[2] = sent[2].where(F.col("part") < F.col("parts") - 1)
    received = sent[2].unionByName(sent[0]).unionByName(sent[1]).unionByName(sent[1])
    return messages.complete_snapshot(received).select(*SENT, "part", "pos")


def feed_messages(t):
    """One message per signal: well-formed feeds, other kinds, and broken text."""
    record = F.struct(
        "id",
        "pair_symbol",
        float_or_zero("score_week").alias("score_week"),
        iso_text("timestamp").alias("timestamp"),
    )
    feed = F.to_json(
        F.struct(
            F.lit("signals").alias("type"), F.lit(1).alias("count"), F.array(record).alias("data")
        ),
        messages.JSON_OPTIONS,
    )
    text = (
        F.when(F.col("recommended_action") == "BUY", feed)
        .when(F.col("is_active"), F.lit('{"type": "pong"}'))
        .otherwise(F.concat(F.lit('{"type": "signals", "data": ['), F.col("id").cast("string")))
    )
    return t("scoring_history").select(text.alias("value"))


@query(
    "S7_parse_feed",
    f"select id, pair_symbol, coalesce(score_week, 0) as score_week, {iso('timestamp')} as timestamp "
    "from scoring_history where recommended_action = 'BUY'",
)
def s7(t):
    return messages.parse_feed(feed_messages(t)).select(
        "id", "pair_symbol", "score_week", "timestamp"
    )


@query(
    "S7_malformed",
    "select '{\"type\": \"signals\", \"data\": [' || cast(id as varchar) as text "
    "from scoring_history where recommended_action = 'SELL' and not is_active",
)
def s7_bad(t):
    return messages.malformed_messages(feed_messages(t))


# --- projections ----------------------------------------------------------------------------


@query("P1_signal_record", f"select {RECORD} from with_params")
def p1(t):
    return shaping.signal_record(with_params(t))


@query(
    "P4_narrow_record",
    f"select id, pair_symbol, recommended_action, {SCORES}, trading_pair_id, exchange_id from paired",
)
def p4(t):
    return shaping.narrow_record(paired(t))


@query(
    "P4_legacy_record",
    f"select id, pair_symbol, recommended_action, {SCORES}, trading_pair_id from scoring_history",
)
def p4_legacy(t):
    return shaping.narrow_record(t("scoring_history"), with_exchange=False)


@query("P5_diagnostic_record", f"select {DIAGNOSTIC} from paired")
def p5(t):
    return shaping.diagnostic_record(paired(t))


@query(
    "P6_parse_strategy_patterns",
    f"select strategy_name, {joined_list(LIST_OF)} as required_patterns from best_parameters",
)
def p6(t):
    return t("best_parameters").select(
        "strategy_name", strategy_patterns("strategy_name").alias("required_patterns")
    )


@query(
    "P7_pattern_key",
    "select id, pattern_type || '_' || timeframe as pattern_key from signal_patterns",
)
def p7(t):
    return t("signal_patterns").select(
        "id", pattern_key("pattern_type", "timeframe").alias("pattern_key")
    )


@query(
    "P8_iso_timestamp",
    f"select id, {iso('timestamp')} as iso, "
    f"{iso(chr(39).join(['date_trunc(', 'minute', ', timestamp)']))} as iso_minute "
    "from scoring_history",
)
def p8(t):
    minute = F.date_trunc("minute", "timestamp")
    return t("scoring_history").select(
        "id", iso_text("timestamp").alias("iso"), iso_text(minute).alias("iso_minute")
    )


@query(
    "P10_tag_source",
    f"select 1 as exchange_id, {PARAMETERS} from backtest_summary_binance union all "
    f"select 2 as exchange_id, {PARAMETERS} from backtest_summary_bybit",
)
def p10(t):
    first = shaping.tag_source(t("backtest_summary_binance").select(*PARAMETER_COLUMNS), 1)
    second = shaping.tag_source(t("backtest_summary_bybit").select(*PARAMETER_COLUMNS), 2)
    return sets.union_params(first, second)


# --- filters --------------------------------------------------------------------------------

IDS = "select id from scoring_history where"


@query("F1_score_threshold", f"{IDS} {SCORED}")
def f1(t):
    return filters.score_threshold(t("scoring_history")).select("id")


@query(
    "F2_param_threshold",
    "select id from with_params where score_week - score_week_filter > 0 "
    "and score_month - score_month_filter > 0",
)
def f2(t):
    return filters.param_threshold(with_params(t)).select("id")


@query("F3_enabled_exchanges", "select id, exchange_id from trading_pairs where exchange_id in (2)")
def f3(t):
    chosen = enabled_exchanges(first=False, second=True)
    return filters.on_exchanges(t("trading_pairs"), chosen).select("id", "exchange_id")


@query("F4_exclude_hours", f"{IDS} hour(timestamp) not in {QUIET}")
def f4(t):
    return filters.exclude_hours(t("scoring_history")).select("id")


@query("F5_active_pair_and_signal", f"select id from paired where {LIVE}")
def f5(t):
    return filters.active_rows(paired(t), "is_active", "pair_is_active").select("id")


@query(
    "F6_market_scope",
    f"select id from trading_pairs where {SCOPED}",
)
def f6(t):
    return filters.market_scope(t("trading_pairs")).select("id")


@query(
    "F7_pattern_whitelist",
    f"select scoring_history_id, signal_patterns_id from keyed where {LISTED}",
)
def f7(t):
    rows = joins.pattern_rows(t("sh_patterns"), t("signal_patterns"))
    return filters.pattern_whitelist(rows).select("scoring_history_id", "signal_patterns_id")


@query("F8_high_total_score", f"{IDS} {HIGH}")
def f8(t):
    return filters.high_total_score(t("scoring_history")).select("id")


@query(
    "F9_near_best_pnl",
    f"select summary_id, total_pnl_usd from (select *, {CONFIG.near_best_share} * "
    "max(total_pnl_usd) over () as least from backtest_summary) where total_pnl_usd >= least",
)
def f9(t):
    return filters.near_best_pnl(t("backtest_summary")).select("summary_id", "total_pnl_usd")


@query(
    "F10_min_strategy_pnl",
    "select strategy_name, total_pnl_pct from best_parameters "
    f"where total_pnl_pct > {CONFIG.min_strategy_pnl}",
)
def f10(t):
    return filters.min_strategy_pnl(t("best_parameters")).select("strategy_name", "total_pnl_pct")


TYPED_REGIMES = (
    "select f.id, signal_type, market_regime from scoring_history f left join "
    "(select scoring_history_id as id, signal_type from scoring_history_results_v2) using (id) "
    "left join (select scoring_history_id as id, regime as market_regime from sh_regime left join "
    "market_regime w on w.id = signal_regime_id) using (id)"
)


@query(
    "F11_require_regime_and_type",
    f"select * from ({TYPED_REGIMES}) where signal_type is not null and market_regime is not null",
)
def f11(t):
    results = t("scoring_history_results_v2").withColumnRenamed("scoring_history_id", "id")
    typed = t("scoring_history").select("id").join(results, "id", "left")
    labelled = joins.regime_by_bridge(typed, t("sh_regime"), t("market_regime"))
    return filters.require_columns(labelled, "signal_type", "market_regime").select(
        "id", "signal_type", "market_regime"
    )


PRICED = (
    "select id, timestamp, exchange_id, score_week, score_month / 100 as score, last_24h_volume as "
    "entry_price from paired"
)
CONSUMABLE = (
    f"select * from ({PRICED}) where coalesce(score, 0) >= 0.7 and exchange_id in (1) "
    "and coalesce(entry_price, 0) <> 0"
)


@query("F12_consumer_filter", f"select * exclude (timestamp) from ({CONSUMABLE})")
def f12(t):
    return consumer.consumer_filter(priced_signals(t), 0.7, [1]).drop("timestamp")


# --- joins ----------------------------------------------------------------------------------


@query("J1_join_pair_by_id", "select id, trading_pair_id, listed_symbol, exchange_id from paired")
def j1(t):
    return paired(t).select("id", "trading_pair_id", "listed_symbol", "exchange_id")


@query(
    "J2_join_pair_by_symbol",
    "select f.id, c.pair_id as matched_pair_id, c.exchange_id from scoring_history f join "
    "(select id as pair_id, pair_symbol, exchange_id from trading_pairs) c using (pair_symbol)",
)
def j2(t):
    rows = joins.join_pair_by_symbol(t("scoring_history"), t("trading_pairs"))
    return rows.select("id", "matched_pair_id", "exchange_id")


@query("J3_join_exchange_params", f"select id, exchange_id, {PARAMETERS} from with_params")
def j3(t):
    return with_params(t).select("id", "exchange_id", *PARAMETER_COLUMNS)


@query(
    "J4_cross_best_params",
    f"select f.id, {PARAMETERS} from scoring_history f, legacy_best",
)
def j4(t):
    best = best_params.legacy_best_row(t("backtest_summary"))
    return joins.cross_best_params(t("scoring_history").select("id"), best, PARAMETER_COLUMNS)


@query(
    "J5_exists_pattern",
    f"select f.id from scoring_history f semi join (select * from keyed where {LISTED}) k "
    "on k.scoring_history_id = f.id",
)
def j5(t):
    listed = filters.pattern_whitelist(t("signal_patterns"))
    return joins.exists_pattern(t("scoring_history"), t("sh_patterns"), listed).select("id")


@query(
    "J6_in_top_n",
    "select summary_id, final_equity from backtest_summary where summary_id in (select summary_id "
    "from backtest_summary order by final_equity desc nulls first, summary_id limit 5)",
)
def j6(t):
    summary = t("backtest_summary")
    return joins.in_top(summary, ranking.top_by_equity(summary)).select("summary_id", "final_equity")


@query(
    "J7_lookup_by_best_id",
    f"select summary_id, {PARAMETERS} from backtest_summary_binance where summary_id = "
    "any (select summary_id from best_first)",
)
def j7(t):
    summary = t("backtest_summary_binance")
    best = best_params.best_exchange_row(summary)
    return joins.lookup_by_best_id(summary, best).select("summary_id", *PARAMETER_COLUMNS)


@query(
    "J8_left_join_with_on_filter",
    "select f.id, l.signal_patterns_id, p.pattern_type, p.timeframe from scoring_history f "
    "left join sh_patterns l on l.scoring_history_id = f.id left join (select id as number, "
    f"pattern_type, timeframe from signal_patterns where {LISTED}) p "
    "on p.number = l.signal_patterns_id",
)
def j8(t):
    listed = filters.pattern_whitelist(t("signal_patterns"))
    rows = joins.left_join_patterns(t("scoring_history").select("id"), t("sh_patterns"), listed)
    return rows.select("id", "signal_patterns_id", "pattern_type", "timeframe")


@query(
    "J9_bridge_join",
    "select f.id, k.pattern_type, k.timeframe from scoring_history f join keyed k "
    "on f.id = k.scoring_history_id",
)
def j9(t):
    rows = joins.bridge_join(t("scoring_history"), t("sh_patterns"), t("signal_patterns"))
    return rows.select("id", "pattern_type", "timeframe")


@query("J10_regime_by_bridge", f"select id, market_regime from ({TYPED_REGIMES})")
def j10(t):
    rows = joins.regime_by_bridge(
        t("scoring_history").select("id"), t("sh_regime"), t("market_regime")
    )
    return rows.select("id", "market_regime")


INTERVAL = (
    "from scoring_history f left join (select * from market_regime where timeframe = '15m') w "
    "on w.timestamp <= f.timestamp and f.timestamp < w.timestamp + interval '60' minute"
)


def quarter_hour_regimes(t):
    return t("market_regime").filter(F.col("timeframe") == "15m").select(
        F.col("id").alias("regime_id"),
        F.col("timestamp").alias("regime_time"),
        F.col("regime").alias("market_regime"),
    )


@query(
    "J11_regime_interval",
    f"select f.id, w.id as regime_id, w.regime as market_regime {INTERVAL}",
)
def j11(t):
    facts, regimes = t("scoring_history").select("id", "timestamp"), quarter_hour_regimes(t)
    hour = timedelta(hours=1)
    pieces = joins.interval_pieces(facts, regimes, hour)
    rows = joins.interval_join(facts, regimes, hour, pieces=pieces, crowd=100_000)
    return rows.select("id", "regime_id", "market_regime")


@query(
    "J11_interval_labels",
    f"select distinct f.id, w.regime as market_regime {INTERVAL} where w.regime is not null",
)
def j11_labels(t):
    facts = t("scoring_history").select("id", "timestamp")
    rows = joins.interval_labels(facts, quarter_hour_regimes(t), "market_regime")
    return rows.select("id", "market_regime")


@query(
    "J12_result_type_join",
    "select f.id, o.signal_type from scoring_history f join scoring_history_results_v2 o "
    "on f.id = o.scoring_history_id where o.signal_type is not null",
)
def j12(t):
    return joins.result_type_join(t("scoring_history"), t("scoring_history_results_v2")).select(
        "id", "signal_type"
    )


def profiled(t):
    """Every signal with its patterns, its result's type and its linked regime."""
    rows = aggregates.collect_pattern_keys(
        joins.keyed_pattern_rows(t("sh_patterns"), t("signal_patterns")), ["scoring_history_id"]
    )
    labelled = joins.regime_by_bridge(
        rows.withColumnRenamed("scoring_history_id", "id"), t("sh_regime"), t("market_regime")
    )
    results = t("scoring_history_results_v2").withColumnRenamed("scoring_history_id", "id")
    return (
        filters.require_columns(labelled, "market_regime")
        .join(results, "id")
        .withColumnRenamed("id", "signal_id")
    )


MATCHED = (
    "from linked_matches m join strategies g using (code, market_regime) "
    "join scoring_history_results_v2 o on o.scoring_history_id = m.id"
)


@query(
    "J13_match_strategy",
    "select m.id as signal_id, market_regime, g.strategy_name, g.signal_type as "
    f"strategy_signal_type, g.pnl as total_pnl_pct {MATCHED}",
)
def j13(t):
    signals = profiled(t).drop("signal_type")
    rows = joins.match_strategy(signals, best_strategy_rows(t))
    return rows.select(
        "signal_id",
        "market_regime",
        "strategy_name",
        F.col("signal_type").alias("strategy_signal_type"),
        "total_pnl_pct",
    )


@query(
    "J14_match_strategy_typed",
    "select m.id as signal_id, o.signal_type, market_regime, g.strategy_name, g.pnl as "
    f"total_pnl_pct {MATCHED} where g.signal_type = o.signal_type",
)
def j14(t):
    rows = joins.match_strategy_typed(profiled(t), best_strategy_rows(t))
    return rows.select(
        "signal_id", "signal_type", "market_regime", "strategy_name", "total_pnl_pct"
    )


@query(
    "J15_event_pair_lookup",
    "select f.id, c.is_active as pair_is_active from scoring_history f left join "
    "trading_pairs c on f.trading_pair_id = c.id",
)
def j15(t):
    rows = joins.event_pair_lookup(t("scoring_history"), t("trading_pairs"))
    return rows.select("id", "pair_is_active")


# --- aggregates -----------------------------------------------------------------------------

PROBE = f"select max(id) as max_id, {stamp('max(timestamp)')} as max_timestamp, count(*) as total_count"


@query(
    "A1_change_probe",
    f"{PROBE} from paired where {SCORED} and {LIVE} and {RECENT}",
)
def a1(t):
    return aggregates.change_probe(
        t("scoring_history"), t("trading_pairs"), WINDOW_MINUTES, AS_OF
    )


@query(
    "A1_probe_from_query",
    f"{PROBE} from with_params where {STANDARD}",
)
def a1_safe(t):
    return aggregates.probe_from_query(feeds.standard_rows(t, CONFIG, AS_OF))


@query(
    "A2_change_probe_high",
    f"{PROBE} from paired where {HIGH} and {LIVE} and {SCOPED} and {RECENT}",
)
def a2(t):
    return aggregates.change_probe_high(
        t("scoring_history"), t("trading_pairs"), WINDOW_MINUTES, AS_OF
    )


@query("A3_change_probe_id", f"select max(id) as max_id from scoring_history where {RECENT}")
def a3(t):
    return aggregates.change_probe_id(t("scoring_history"), WINDOW_MINUTES, AS_OF)


def _sorted_list(column: str) -> str:
    return joined_list(f"list_sort(list(distinct {column}))")


@query(
    "A4_collect_patterns",
    f"select scoring_history_id, {_sorted_list('pattern_type')} as patterns, "
    f"{_sorted_list('timeframe')} as timeframes from keyed group by scoring_history_id",
)
def a4(t):
    rows = joins.pattern_rows(t("sh_patterns"), t("signal_patterns"))
    return aggregates.collect_patterns(rows, ["scoring_history_id"])


@query(
    "A5_collect_pattern_keys",
    f"select scoring_history_id, {_sorted_list('pattern_key')} as patterns from keyed "
    "group by scoring_history_id",
)
def a5(t):
    rows = joins.keyed_pattern_rows(t("sh_patterns"), t("signal_patterns"))
    return aggregates.collect_pattern_keys(rows, ["scoring_history_id"])


@query(
    "A6_multi_pattern_having",
    f"select scoring_history_id, {_sorted_list('pattern_key')} as patterns from keyed "
    "group by scoring_history_id having count(distinct signal_patterns_id) >= 2",
)
def a6(t):
    rows = joins.keyed_pattern_rows(t("sh_patterns"), t("signal_patterns"))
    return aggregates.multi_pattern_having(rows, ["scoring_history_id"])


@query(
    "A6_three_patterns",
    f"select scoring_history_id, {_sorted_list('pattern_key')} as patterns from keyed "
    "group by scoring_history_id having count(distinct signal_patterns_id) >= 3",
)
def a6_three(t):
    rows = joins.keyed_pattern_rows(t("sh_patterns"), t("signal_patterns"))
    return aggregates.multi_pattern_having(rows, ["scoring_history_id"], 3)


@query("A7_global_max", "select max(total_pnl_usd) as max_total_pnl_usd from backtest_summary")
def a7(t):
    return aggregates.global_max(t("backtest_summary"))


@query(
    "A8_count_by_exchange",
    "select count(*) filter (where exchange_id = 1) as first_exchange, "
    "count(*) filter (where exchange_id = 2) as second_exchange from paired",
)
def a8(t):
    return aggregates.count_by_exchange(paired(t))


@query(
    "A9_pattern_distribution",
    "select pattern, count(*) as signals from (select scoring_history_id, "
    "unnest(list(distinct pattern_type)) as pattern from keyed group by scoring_history_id) "
    "group by pattern",
)
def a9(t):
    rows = joins.pattern_rows(t("sh_patterns"), t("signal_patterns"))
    return aggregates.pattern_distribution(
        aggregates.collect_patterns(rows, ["scoring_history_id"])
    )


BATCHES = (
    "select cast(date_diff('day', date '2024-01-01', cast(timestamp as date)) as int) as batch_id, "
    "max(timestamp) as time, count(*) as count, "
    "sum(octet_length(encode(patterns_details))) as bytes, "
    "case when max(case when is_active then total_score end) > 1500 then 'late' end as error, "
    "max(timestamp) as first_timestamp from scoring_history group by cast(timestamp as date)"
)


def batch_log(t):
    """One batch per day of signals."""
    day = F.to_date("timestamp")
    top = F.max(F.when(F.col("is_active"), F.col("total_score")))
    return (
        t("scoring_history")
        .groupBy(F.datediff(day, F.lit("2024-01-01").cast("date")).alias("batch_id"))
        .agg(
            F.max("timestamp").alias("time"),
            F.count(F.lit(1)).alias("count"),
            F.sum(F.octet_length("patterns_details")).alias("bytes"),
            F.when(top > 1500, F.lit("late")).alias("error"),
            F.max("timestamp").alias("first_timestamp"),
        )
    )


@query(
    "A10_feed_totals",
    "select count(*) as batches, cast(sum(count) as bigint) as signals, "
    f"cast(sum(bytes) as bigint) as bytes, count(error) as errors from ({BATCHES})",
)
def a10(t):
    return aggregates.feed_totals(batch_log(t))


MINUTES = (
    "select max(timestamp) as time, count(*) as count from scoring_history "
    "group by date_trunc('minute', timestamp)"
)


def minute_log(t):
    minute = F.date_trunc("minute", "timestamp")
    return (
        t("scoring_history")
        .groupBy(minute.alias("minute"))
        .agg(F.max("timestamp").alias("time"), F.count(F.lit(1)).alias("count"))
    )


@query(
    "A11_signals_last_minute",
    f"select cast(sum(count) as bigint) as signals from ({MINUTES}) where time > "
    f"(select max(time) from ({MINUTES})) - interval '1' minute",
)
def a11(t):
    log = minute_log(t)
    return aggregates.signals_last_minute(log, log.agg(F.max("time")).scalar())


@query(
    "A12_average_rate",
    "select batch_id, case when up > 0 then count / up else 0 end as rate from (select batch_id, "
    f"count, date_diff('second', timestamp '2024-01-01 00:00:00', time) as up from ({BATCHES}))",
)
def a12(t):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    uptime = F.unix_seconds(F.col("time").cast("timestamp")) - F.unix_seconds(start)
    return batch_log(t).select(
        "batch_id", aggregates.average_rate(F.col("count"), uptime).alias("rate")
    )


@query(
    "A13_seconds_since_last",
    f"select (epoch_us({NOW}) - epoch_us(max(time))) / 1000000.0::double as seconds_since_last "
    f"from ({MINUTES})",
)
def a13(t):
    return aggregates.seconds_since_last(minute_log(t), AS_OF)


# --- ranking --------------------------------------------------------------------------------


@query(
    "W1_best_per_pnl",
    f"select first(summary_id order by {HIGHEST_RATE}) as summary_id, first(win_rate order by "
    f"{HIGHEST_RATE}) as win_rate, total_pnl_usd from backtest_summary group by total_pnl_usd",
)
def w1(t):
    return ranking.best_per_pnl(t("backtest_summary")).select(
        "summary_id", "win_rate", "total_pnl_usd"
    )


@query(
    "W2_best_strategy_variant",
    "select strategy_name, signal_type, market_regime, max(total_pnl_pct) as total_pnl_pct, "
    f"first(sl_pct order by {VARIANTS}) as sl_pct, first(ts_activation_pct order by {VARIANTS}) as "
    f"ts_activation_pct, first(ts_callback_pct order by {VARIANTS}) as ts_callback_pct "
    "from best_parameters group by strategy_name, signal_type, market_regime",
)
def w2(t):
    return ranking.best_strategy_variant(t("best_parameters"))


@query(
    "W3_best_match_per_signal",
    "select id as signal_id, market_regime, strategy_name, pnl as strategy_pnl "
    "from linked_typed_best join strategies using (code)",
)
def w3(t):
    rows = joins.match_strategy_typed(profiled(t), best_strategy_rows(t))
    best = ranking.best_match_per_signal(rows.withColumnRenamed("total_pnl_pct", "strategy_pnl"))
    return best.select("signal_id", "market_regime", "strategy_name", "strategy_pnl")


# --- records of whole tables, missing values included ------------------------------------------

# Every signal with its patterns and its best strategy, either of which it may lack.
CARRIED = (
    "select scoring_history_id as id, list_sort(list(distinct pattern_type)) as patterns, "
    "list_sort(list(distinct timeframe)) as timeframes from keyed group by scoring_history_id"
)
CHOSEN = "(select * from linked_typed_best join strategies using (code))"
TO_ZERO = ("total_score", "score_week", "score_month")
_ZEROED = ", ".join(f"ifnull(f.{c}, 0) as {c}" for c in TO_ZERO)
_TIMES = f"{iso('f.timestamp')} as timestamp, {iso('f.created_at')} as created_at"


def chosen_strategy(t):
    """For every signal that matches one its best strategy."""
    rows = joins.match_strategy_typed(
        profiled(t), best_strategy_rows(t), joins.pattern_frequency(pattern_lists(t))
    )
    return ranking.best_match_per_signal(rows.withColumnRenamed("total_pnl_pct", "strategy_pnl"))


def pattern_lists(t):
    return aggregates.collect_pattern_keys(
        joins.keyed_pattern_rows(t("sh_patterns"), t("signal_patterns")), ["scoring_history_id"]
    )


@query(
    "P2_high_score_record",
    f"select f.id, f.trading_pair_id, f.pair_symbol, {_ZEROED}, {_TIMES}, f.exchange_id, "
    "f.contract_type_id, ifnull(array_to_string(c.patterns, ','), '') as patterns, "
    "ifnull(array_to_string(c.timeframes, ','), '') as timeframes, "
    + ", ".join(
        f"'{v}' as {k}" if isinstance(v, str) else f"{v!r}::{'double' if isinstance(v, float) else 'int'} as {k}"
        for k, v in HIGH_SCORE_PARAMETERS.items()
    )
    + f" from paired f left join ({CARRIED}) c on c.id = f.id",
)
def p2(t):
    """All signals; those without patterns have lists that are NULL before they become records."""
    lists = aggregates.collect_patterns(
        joins.pattern_rows(t("sh_patterns"), t("signal_patterns")), ["scoring_history_id"]
    ).withColumnRenamed("scoring_history_id", "id")
    return shaping.high_score_record(paired(t).join(lists, "id", "left"))


@query(
    "P3_optimized_record",
    f"select f.id, f.trading_pair_id, f.pair_symbol, {_ZEROED}, {_TIMES}, f.exchange_id, "
    "1 as contract_type_id, '' as patterns, '' as timeframes, "
    "ifnull(c.signal_type, 'BUY') as recommended_action, ifnull(f.score_week, 0) as "
    "score_week_filter, ifnull(f.score_month, 0) as score_month_filter, 10 as max_trades_filter, "
    "ifnull(c.sl_pct, 0) as stop_loss_filter, ifnull(c.ts_activation_pct, 0) as "
    "trailing_activation_filter, ifnull(c.ts_callback_pct, 0) as trailing_distance_filter, "
    "ifnull(c.strategy_name, '') as strategy_name, ifnull(c.market_regime, '') as "
    f"market_regime, ifnull(c.pnl, 0) as strategy_pnl from paired f left join {CHOSEN} c "
    "on c.id = f.id",
)
def p3(t):
    """All signals; without a strategy its numbers become 0 and its texts empty."""
    chosen = chosen_strategy(t).select(
        "signal_id",
        F.col("signal_type").alias("strategy_signal_type"),
        "market_regime",
        "strategy_name",
        "strategy_pnl",
        "sl_pct",
        "ts_activation_pct",
        "ts_callback_pct",
    )
    signals = paired(t).withColumnsRenamed({"id": "signal_id", "timestamp": "signal_timestamp"})
    return shaping.optimized_record(signals.join(chosen, "signal_id", "left"))


@query(
    "P9_alert_row",
    "select f.id as signal_id, strftime(f.timestamp, '%Y-%m-%d %H:%M') as time, f.pair_symbol, "
    f"c.signal_type, {alert_percent('c.pnl')} as pnl, c.sl_pct::varchar || '% / ' || "
    "c.ts_activation_pct::varchar || '% / ' || c.ts_callback_pct::varchar || '%' as "
    f"params, c.pnl > 300 as highlight from scoring_history f join {CHOSEN} c on c.id = f.id",
)
def p9(t):
    signals = t("scoring_history").select(
        F.col("id").alias("signal_id"), "pair_symbol", F.col("timestamp").alias("signal_timestamp")
    )
    return shaping.alert_row(signals.join(chosen_strategy(t), "signal_id"))


@query("W4_top1_by_win_rate", "select summary_id, win_rate from best_first")
def w4(t):
    return best_params.best_exchange_row(t("backtest_summary_binance")).select(
        "summary_id", "win_rate"
    )


@query("W5_top5_then_best", "select summary_id, win_rate, final_equity from legacy_best")
def w5(t):
    return best_params.legacy_best_row(t("backtest_summary")).select(
        "summary_id", "win_rate", "final_equity"
    )


FEED_SQL_ORDER = "score_week desc nulls last, timestamp desc nulls first, id"


def placed(df):
    """The rows with their place in the frame's order, from 0."""
    stored = positions.written_in_order(df, working_folder(df.sparkSession, "ordered"))
    return positions.positioned(stored, positions.starts(positions.part_totals(stored)))


@query(
    "W6_order_feed",
    f"select id, score_week, {stamp('timestamp')} as timestamp, row_number() over (order by "
    f"{FEED_SQL_ORDER}) - 1 as pos from scoring_history",
)
def w6(t):
    facts = t("scoring_history").select("id", "score_week", "timestamp")
    return placed(ranking.order_feed(facts, costly=False))


@query(
    "W7_order_high",
    f"select id, total_score, {stamp('timestamp')} as timestamp, row_number() over (order by "
    "total_score desc nulls first, timestamp desc nulls first, id) - 1 as pos from scoring_history",
)
def w7(t):
    facts = t("scoring_history").select("id", "total_score", "timestamp")
    return placed(ranking.order_high(facts, costly=False))


@query(
    "W12_replay_order",
    f"select id as signal_id, {stamp('timestamp')} as signal_timestamp, row_number() over (order by "
    "timestamp nulls first, id) - 1 as pos from scoring_history",
)
def w12(t):
    facts = t("scoring_history").select(
        F.col("id").alias("signal_id"), F.col("timestamp").alias("signal_timestamp")
    )
    return placed(ranking.replay_order(facts, costly=False))


@query(
    "W8_limit_n",
    f"select id, score_week from scoring_history order by {FEED_SQL_ORDER} limit 5",
)
def w8(t):
    return ranking.limit_feed(t("scoring_history")).select("id", "score_week")


@query(
    "W9_consumer_topk",
    "select id, score_week from scoring_history order by coalesce(score_week, 0) desc, "
    "timestamp desc nulls first, id limit 5",
)
def w9(t):
    facts = t("scoring_history").select("id", "score_week", "timestamp")
    return ranking.consumer_top(facts).drop("timestamp")


@query(
    "W10_tail_buffer",
    "select id, score_week from (select *, row_number() over (order by "
    f"{FEED_SQL_ORDER}) as rn, count(*) over () as n from scoring_history) where rn > n - 100",
)
def w10(t):
    return ranking.tail_buffer(t("scoring_history")).select("id", "score_week")


@query(
    "W11_recent_ring",
    "select batch_id, pos, id from (select id, "
    "cast(date_diff('day', date '2024-01-01', cast(timestamp as date)) as int) as batch_id, "
    f"cast(row_number() over (partition by cast(timestamp as date) order by {FEED_SQL_ORDER}) - 1 "
    "as int) as pos from scoring_history) where pos < 10 order by batch_id desc, pos limit 50",
)
def w11(t):
    day = F.datediff(F.to_date("timestamp"), F.lit("2024-01-01").cast("date"))
    rows = t("scoring_history").withColumn("batch_id", day)
    positioned = ranking.batch_positions(rows, "batch_id", ranking.feed_order(), 10)
    return ranking.recent_ring(positioned).select("batch_id", "pos", "id")


@query(
    "W13_order_violations",
    "select id, score_week, previous_score_week from (select id, score_week, lag(score_week) over "
    "(order by id) as previous_score_week from scoring_history) "
    "where score_week > previous_score_week",
)
def w13(t):
    received = t("scoring_history").select("id", F.col("id").alias("pos"), "score_week")
    return ranking.order_violations(received).select("id", "score_week", "previous_score_week")


# --- sets and user code ---------------------------------------------------------------------


@query("U1_union_params", "select * from exchange_params")
def u1(t):
    return best_params.exchange_params(t, CONFIG)


@query(
    "U2_new_since_seen",
    "select id as signal_id from scoring_history where id not in "
    "(select scoring_history_id from sh_patterns)",
)
def u2(t):
    seen = t("sh_patterns").select(F.col("scoring_history_id").alias("signal_id"))
    rows = t("scoring_history").select(F.col("id").alias("signal_id"))
    return sets.new_since_seen(rows, seen)


def _handler():
    def handle(signal):
        if signal["exchange_id"] == 2:
            raise RuntimeError("exchange closed")

    return handle


@query(
    "X2_process_top",
    "select id, case when exchange_id = 2 then 'error' else 'processed' end as status, "
    "case when exchange_id = 2 then 'exchange closed' end as error from (select * from "
    f"({PRICED}) order by coalesce(score_week, 0) desc, timestamp desc nulls first, id limit 100)",
)
def x2(t):
    top = ranking.consumer_top(priced_signals(t), 100)
    return consumer.process_rows(top, _handler())


KEPT = CONSUMABLE.replace("in (1)", "in (1, 2)")


@query(
    "X2_processing_totals",
    f"select (select count(*) from ({PRICED})) as total_received, "
    f"(select count(*) from ({PRICED})) - (select count(*) from ({KEPT})) as filtered_out, "
    "count(*) filter (where exchange_id <> 2) as processed, "
    "count(*) filter (where exchange_id = 2) as errors "
    f"from (select * from ({KEPT}) order by coalesce(score_week, 0) desc, "
    "timestamp desc nulls first, id limit 100)",
)
def x2_totals(t):
    received, good = priced_signals(t), consumer.consumable(0.7, [1, 2])
    top = ranking.consumer_top(received.filter(good), 100)
    return consumer.processing_totals(received, good, consumer.process_rows(top, _handler()))


# --- change handling in batch form ----------------------------------------------------------

CHANGED_BEFORE = (
    "select *, case when id % 4 = 0 then score_week else score_week - 5 end as old_score_week, "
    "case when id % 8 = 0 then not is_active else is_active end as old_is_active "
    "from scoring_history"
)


@query(
    "F13_changed_scores",
    f"select id from ({CHANGED_BEFORE}) where {SCORED} and "
    "(score_week is distinct from old_score_week or is_active is distinct from old_is_active)",
)
def f13(t):
    return filters.changed_scores(updates(t("scoring_history"))).select("new.id")


@query(
    "F14_qualifying_event",
    f"select id from paired where {SCORED} and {LIVE} and {RECENT}",
)
def f14(t):
    rows = joins.event_pair_lookup(t("scoring_history"), t("trading_pairs"))
    return filters.qualifying_event(rows, AS_OF, WINDOW_MINUTES).select("id")


@query(
    "T8_sliding_lookback",
    f"select '2024-01-24 00:00:00' as as_of, id from scoring_history where timestamp >= "
    f"timestamp '2024-01-24 00:00:00' - interval '{WINDOW_MINUTES}' minute and timestamp <= "
    "timestamp '2024-01-24 00:00:00' union all "
    f"select '2024-01-31 00:00:00', id from scoring_history where {RECENT} and timestamp <= "
    "timestamp '2024-01-31 00:00:00'",
)
def t8(t):
    moments = [datetime(2024, 1, 24), AS_OF]
    return monitoring.snapshot_at(t("scoring_history"), WINDOW_MINUTES, moments).select(
        "as_of", "id"
    )


@query(
    "T9_feed_stats",
    f"select (epoch_us({NOW}) - epoch_us(min(time))) / 1000000.0::double as uptime_seconds, "
    "count(*) as queries_executed, cast(sum(count) as bigint) as signals_sent, "
    f"count(error) as errors, {stamp('arg_max(first_timestamp, batch_id)')} as last_query "
    f"from ({BATCHES})",
)
def t9(t):
    return monitoring.feed_stats(batch_log(t), AS_OF)

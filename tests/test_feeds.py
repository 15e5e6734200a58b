"""Feeds on random small tables against their literal SQL form."""

from __future__ import annotations

import random
from datetime import timedelta

import duckdb
import pytest

from sigloom.config import FeedConfig
from sigloom.plans import feeds
from sigloom.registry import base
from sigloom.registry import feeds as feed_sql
from sigloom.schemas import TABLES
from sigloom.sources.catalog import Catalog
from sigloom.standins import AS_OF, WINDOW_MINUTES

CONFIG = FeedConfig(window_minutes=WINDOW_MINUTES)
SQL_TYPES = {
    "bigint": "bigint",
    "int": "integer",
    "double": "double",
    "string": "varchar",
    "boolean": "boolean",
    "timestamp": "timestamp",
}


def random_tables(seed):
    """Tables full of NULLs, ties and edges; one signal and one regime hold a third of the rows."""
    pick = random.Random(seed)
    regimes = ["BULL", "BEAR", None]
    kinds = ["SQUEEZE_IGNITION", "OI_EXPLOSION", "PAT2"]
    frames = ["15m", "1h", "1d"]
    edge = AS_OF - timedelta(minutes=WINDOW_MINUTES)

    def maybe(value, share=0.1):
        return None if pick.random() < share else value

    def moment():
        kind = pick.random()
        if kind < 0.3:
            return edge + timedelta(hours=5, minutes=pick.randrange(60))
        if kind < 0.4:
            return edge + timedelta(hours=pick.choice([-1, 0, 1]), microseconds=pick.choice([-1, 0]))
        return AS_OF - timedelta(minutes=pick.randrange(2 * WINDOW_MINUTES))

    def score():
        return maybe(pick.choice([50.0, 55.0, 50.1, 55.1, 60.0, 80.0, 0.0]))

    def hot(values):
        return 1 if pick.random() < 0.33 else pick.choice(values)

    ids = list(range(1, 61))
    tables = {name: [] for name in TABLES}
    for i in ids:
        tables["scoring_history"].append(
            (
                i, maybe(pick.randrange(12)), maybe(f"S{pick.randrange(4)}"), pick.choice(["BUY", "SELL"]),
                score(), score(), maybe(pick.choice([250.0, 250.5, 400.0])), 1.0, 2.0, 3.0, "{}", None,
                moment(), maybe(moment()), maybe(pick.random() < 0.85),
            )
        )
    for i in range(12):
        tables["trading_pairs"].append(
            (i, f"S{i % 4}", pick.choice([1, 1, 2]), pick.choice([1, 1, 2]), maybe(i != 3), 5.0)
        )
    for i in range(9):
        tables["signal_patterns"].append((i, maybe(kinds[i % 3]), maybe(frames[i // 3])))
    for _ in range(220):
        tables["sh_patterns"].append((hot(ids + [99]), pick.randrange(11)))
    for i in range(40):
        tables["market_regime"].append(
            (i, pick.choice(["15m", "15m", "1h"]), maybe(moment(), 0.05), pick.choice(regimes))
        )
    for _ in range(80):
        tables["sh_regime"].append((hot(ids), maybe(pick.randrange(44))))
    for i in ids:
        for _ in range(pick.choice([0, 1, 1, 2])):
            tables["scoring_history_results_v2"].append((i, pick.choice(["BUY", "SELL", None])))
    keys = [f"{k}_{f}" for k in kinds for f in frames]
    for _ in range(80):
        need = pick.sample(keys, pick.choice([0, 1, 1, 2, 2, 3]))
        name = "[" + ", ".join(f"'{k}'" for k in need) + "]|T|R"
        tables["best_parameters"].append(
            (
                maybe(name, 0.03), pick.choice(["BUY", "SELL", None]), pick.choice(regimes),
                maybe(float(pick.randrange(3))), maybe(1.5), 0.5, pick.choice([180.0, 181.0, 300.0, 301.0]),
            )
        )
    for name in ("backtest_summary", "backtest_summary_binance", "backtest_summary_bybit"):
        for i in range(20):
            tables[name].append(
                (
                    i, maybe(float(pick.randrange(5)), 0.2), maybe(pick.choice([100.0, 96.0, 95.0, 94.9])),
                    maybe(float(pick.randrange(6))), pick.choice([0.0, 50.0]), pick.choice([0.0, 55.0]),
                    maybe(pick.randrange(3)), maybe(0.0), 2.0, maybe(0.5),
                )
            )
    return tables


def load(spark, tables):
    """The same rows for both engines, with times without a zone."""
    frames, connection = {}, duckdb.connect()
    for name, data in tables.items():
        types = [(f.name, f.dataType.simpleString()) for f in TABLES[name].fields]
        text = ", ".join(f"{c} {t.replace('timestamp', 'timestamp_ntz')}" for c, t in types)
        frames[name] = spark.createDataFrame(data, text).repartition(3).cache()
        listed = ", ".join(f"{c} {SQL_TYPES[t]}" for c, t in types)
        connection.execute(f"create table {name} ({listed})")
        if data:
            marks = ", ".join("?" for _ in types)
            connection.executemany(f"insert into {name} values ({marks})", data)
    return Catalog(spark, frames), connection


def plain(value):
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else value


def compare(df, connection, sql):
    df = base.comparable(df)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cursor = connection.execute(base.assemble(sql, standins=False))
    order = [c[0] for c in cursor.description]
    assert sorted(order) == names
    expected = [tuple(plain(r[order.index(c)]) for c in names) for r in cursor.fetchall()]
    assert got == sorted(expected, key=repr)
    return len(got)


@pytest.fixture(params=[11, 12, 13])
def world(request, spark):
    catalog, connection = load(spark, random_tables(request.param))
    yield catalog, connection
    for name in catalog.names():
        catalog(name).unpersist()


def test_feeds_equal_their_literal_sql(world):
    catalog, connection = world
    best = (
        f"select * exclude (signal_timestamp), {base.stamp('signal_timestamp')} as "
        f"signal_timestamp from ({feed_sql.BEST_ROWS})"
    )
    recent = f"{base.RECENT} and is_active and pair_is_active"
    cases = {
        "standard": (
            feeds.standard_feed(catalog, CONFIG, AS_OF),
            f"select {feed_sql.RECORD} from with_params where {recent} and score_week > "
            "score_week_filter and score_month > score_month_filter and "
            "hour(timestamp) not between 0 and 1",
        ),
        "high": (
            feeds.high_score_feed(catalog, CONFIG, AS_OF),
            f"select {feed_sql.HIGH_RECORD} from high_rows",
        ),
        "optimized": (
            feeds.optimized_feed(catalog, CONFIG, AS_OF),
            f"select {feed_sql.OPTIMIZED_RECORD} "
            f"from ({feed_sql.OPTIMIZED_ROWS})",
        ),
        "best": (feeds.best_signals(catalog, CONFIG, AS_OF), best),
        "legacy": (
            feeds.legacy_feed(catalog, base.LEGACY_CONFIG, AS_OF),
            f"select {feed_sql.RECORD} from ({feed_sql.LEGACY} and score_week > 55 and "
            "score_month > 55)",
        ),
        "diagnostic": (
            feeds.diagnostic_feed(catalog, CONFIG, AS_OF),
            f"select {feed_sql.DIAGNOSTIC} from paired where {recent} and score_week > 50 and "
            "score_month > 50",
        ),
    }
    sizes = {name: compare(df, connection, sql) for name, (df, sql) in cases.items()}
    assert all(sizes[name] for name in ("standard", "optimized", "best", "diagnostic")), sizes


def test_large_sides_give_the_same(spark, world):
    """No side is broadcast: every join shuffles, as it would with large tables."""
    catalog, connection = world
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        optimized = feeds.optimized_rows(catalog, CONFIG, AS_OF)
        plan = optimized._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Cartesian" not in plan
        compare(
            feeds.optimized_feed(catalog, CONFIG, AS_OF),
            connection,
            f"select {feed_sql.OPTIMIZED_RECORD} from ({feed_sql.OPTIMIZED_ROWS})",
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_one_exchange_needs_one_summary(spark, world):
    catalog, _ = world
    only = FeedConfig(window_minutes=WINDOW_MINUTES, exchanges=(2,))
    shown = feeds.standard_feed(catalog, only, AS_OF)
    assert {r["exchange_id"] for r in shown.collect()} <= {2}


def test_alerts_leave_out_what_was_seen(spark, world):
    catalog, _ = world
    everything = feeds.best_signal_alerts(catalog, CONFIG, AS_OF)
    ids = [r["signal_id"] for r in everything.collect()]
    seen = spark.createDataFrame([(i,) for i in ids[:3]], "signal_id long")
    left = feeds.best_signal_alerts(catalog, CONFIG, AS_OF, seen)
    assert [r["signal_id"] for r in left.collect()] == ids[3:]


def test_old_rows_are_gone_later(spark, world):
    catalog, _ = world
    later = AS_OF + timedelta(minutes=WINDOW_MINUTES + 1)
    assert feeds.diagnostic_feed(catalog, CONFIG, later).isEmpty()

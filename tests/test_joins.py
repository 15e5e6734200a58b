from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from sigloom.operators import joins
from sigloom.operators.ranking import distinct_on, strategy_preference
from sigloom.plans.strategies import best_strategies, since_first_id, strategy_candidates
from tests.conftest import rows

START = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


def timeline(seed, left, right):
    """Random times, a third of them in one hour, many exactly on hour bounds."""
    pick = random.Random(seed)

    def moment():
        kind = pick.random()
        if kind < 0.33:
            return START + timedelta(hours=7, microseconds=pick.randrange(3_600_000_000))
        if kind < 0.5:
            return START + timedelta(hours=pick.randrange(24))
        return START + timedelta(microseconds=pick.randrange(86_400_000_000))

    facts = [(i, moment()) for i in range(left)]
    regimes = [(i, moment(), pick.choice(["BULL", "BEAR", "FLAT", None])) for i in range(right)]
    return facts, regimes


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("length", [HOUR, timedelta(minutes=17)])
def test_interval_joins_equal_brute_force(spark, seed, length):
    facts, regimes = timeline(seed, 60, 80)
    left = spark.createDataFrame(facts, "id int, timestamp timestamp_ntz")
    right = spark.createDataFrame(
        regimes, "regime_id int, regime_time timestamp_ntz, market_regime string"
    )
    pairs = [(i, r, m) for i, t in facts for r, s, m in regimes if t - length < s <= t]
    for salts in (1, 3):
        joined = joins.interval_join(left, right, length, how="inner", salts=salts)
        expected = sorted(((i, r) for i, r, _ in pairs), key=repr)
        assert rows(joined, "id", "regime_id") == expected

    for pieces, crowd in ((1, 4), (3, None), (7, 2), (64, 1)):
        joined = joins.interval_join(left, right, length, how="inner", pieces=pieces, crowd=crowd)
        assert rows(joined, "id", "regime_id") == expected

    gapped = left.union(spark.createDataFrame([(99, None)], left.schema))
    outer = joins.interval_join(gapped, right, length, pieces=5, crowd=3)
    assert outer.filter("id = 99 and regime_id is null").count() == 1
    assert outer.filter("regime_id is not null").count() == len(pairs)
    outer = joins.interval_join(left, right, length, salts=2).filter("regime_id is null")
    assert {r["id"] for r in outer.collect()} == {i for i, _ in facts} - {i for i, *_ in pairs}

    labels = joins.interval_labels(left, right, "market_regime", length)
    expected = {(i, m) for i, _, m in pairs if m is not None}
    assert rows(labels, "id", "market_regime") == sorted(expected, key=repr)


def test_interval_bounds(spark):
    left = spark.createDataFrame([(1, START + HOUR)], "id int, timestamp timestamp_ntz")
    right = spark.createDataFrame(
        [
            ("at", START + HOUR),
            ("oldest", START + timedelta(microseconds=1)),
            ("too old", START),
            ("later", START + HOUR + timedelta(microseconds=1)),
        ],
        "market_regime string, regime_time timestamp_ntz",
    )
    assert rows(joins.interval_join(left, right), "market_regime") == [("at",), ("oldest",)]
    labels = joins.interval_labels(left, right, "market_regime")
    assert rows(labels, "market_regime") == [("at",), ("oldest",)]


def test_interval_join_is_an_equi_join(spark):
    left = spark.createDataFrame([(1, START)], "id int, timestamp timestamp_ntz")
    right = spark.createDataFrame([("x", START)], "market_regime string, regime_time timestamp_ntz")
    plan = joins.interval_join(left, right)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_interval_pieces_follow_the_density(spark):
    def ticks(count, name):
        return spark.range(count).selectExpr(
            f"timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, cast(id as double) * 86400 / {count}) as {name}"
        )

    crowded, thin = ticks(50_000, "timestamp"), ticks(96, "regime_time")
    assert joins.interval_pieces(crowded, thin) > joins.interval_pieces(ticks(500, "timestamp"), thin) > 1
    assert joins.interval_pieces(crowded, thin, most=4) == 4
    assert joins.interval_pieces(crowded.limit(0), thin) == joins.interval_pieces(crowded, thin.limit(0)) == 1
    with pytest.raises(ValueError):
        joins.interval_join(crowded, thin, salts=2, crowd=5)


def test_interval_join_moves_in_proportion_to_its_rows(spark):
    def ticks(count, name):
        step = f"make_dt_interval(0, 0, 0, cast(id as double) * 86400 / {count})"
        return spark.range(count).selectExpr("id as " + name[0], f"timestamp_ntz'2024-01-01' + {step} as {name}")

    for facts, regimes in ((20_000, 5_000), (20_000, 20_000), (5_000, 20_000)):
        left, right = ticks(facts, "timestamp"), ticks(regimes, "regime_time")
        pieces = joins.interval_pieces(left, right)
        assert pieces == 1 or (pieces + 1) * regimes <= facts + regimes

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")  # neither side is below, the crowds are
    try:
        for crowd in (100, 100_000):  # every bucket is one, none is
            joined = joins.interval_join(left, right, HOUR, how="left", crowd=crowd)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 2
            seen = joined.where("r is not null").selectExpr("count(*)", "sum(t)", "sum(r)").first()
            # A fact a 17.28 s, a regime a 4.32 s: 833 of them in the hour, and that of the fact's own time.
            pairs = [(k, r) for k in range(5_000) for r in range(max(0, 4 * k - 833), 4 * k + 1)]
            assert tuple(seen) == (len(pairs), sum(k for k, _ in pairs), sum(r for _, r in pairs))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def random_signals(seed, count, longest):
    pick = random.Random(seed)
    vocabulary = [f"P{i}_1h" for i in range(7)] + [None]
    regimes = ["BULL", "BEAR", None]
    # A third of the signals share one regime and profile.
    hot = ("BULL", ["P0_1h", "P1_1h", "P2_1h"])
    signals = []
    for i in range(count):
        if pick.random() < 0.33:
            signals.append((i, *hot))
        else:
            patterns = pick.sample(vocabulary, pick.randrange(len(vocabulary)))
            signals.append((i, pick.choice(regimes), patterns))
    strategies = []
    for i in range(40):
        need = [pick.choice(vocabulary[:-1]) for _ in range(pick.randrange(longest + 1))]
        strategies.append((f"s{i}", pick.choice(regimes), None if i == 0 else need))
    return signals, strategies


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("longest", [2, 4])
def test_strategy_match_equals_brute_force(spark, broadcast, longest):
    signals, strategies = random_signals(longest, 80, longest)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old if broadcast else "-1")
    try:
        left = spark.createDataFrame(
            signals, "signal_id int, market_regime string, patterns array<string>"
        )
        right = spark.createDataFrame(
            strategies,
            "strategy_name string, market_regime string, required_patterns array<string>",
        )
        got = rows(joins.match_strategy(left, right), "signal_id", "strategy_name")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    expected = [
        (i, name)
        for i, regime, have in signals
        for name, wanted, need in strategies
        if regime is not None and regime == wanted and need is not None and set(need) <= set(have)
    ]
    assert got == sorted(expected, key=repr)
    assert expected


def test_signals_explode_in_proportion_to_their_patterns(spark):
    """A signal looks under each of its patterns and once for strategies that require none."""
    patterns = [f"P{k}" for k in range(40)]
    left = spark.createDataFrame([(1, "BULL", patterns)], "signal_id int, market_regime string, patterns array<string>")
    needs = [[], ["P3"], ["P3", "P9"], ["P3", "absent"], patterns, ["P9", "P9"]]
    right = spark.createDataFrame(
        [(f"s{k}", "BULL", need) for k, need in enumerate(needs)],
        "strategy_name string, market_regime string, required_patterns array<string>",
    )
    frequency = spark.createDataFrame([(p, 100 - k) for k, p in enumerate(patterns)], "pattern string, n long")
    indexed = joins.indexed_strategies(right, frequency)
    assert rows(indexed, "strategy_name", "_index") == [
        ("s0", None), ("s1", "P3"), ("s2", "P9"), ("s3", "absent"), ("s4", "P39"), ("s5", "P9"),
    ]
    got = joins.match_strategy(left, right, frequency=frequency)
    assert rows(got, "strategy_name") == [("s0",), ("s1",), ("s2",), ("s4",), ("s5",)]
    assert joins.looking(left).count() == len(patterns) + 1


def test_reduced_strategies_show_the_same_best_match(spark):
    pick = random.Random(5)
    parameters = spark.createDataFrame(
        [
            (
                "['{}', '{}']|{}".format(*pick.choices(["A", "B", "C", "D"], k=2), i % 9),
                pick.choice(["BUY", "SELL", None]),
                pick.choice(["BULL", "BEAR"]),
                float(pick.randrange(3)),
                float(pick.randrange(3)),
                1.0,
                float(pick.choice([150, 180, 181, 300, 300])),
            )
            for i in range(120)
        ],
        "strategy_name string, signal_type string, market_regime string, sl_pct double, "
        "ts_activation_pct double, ts_callback_pct double, total_pnl_pct double",
    )
    signals = spark.createDataFrame(
        [(1, "BULL", ["A", "B", "C"]), (2, "BEAR", ["D"]), (3, "BULL", ["B", "D"])],
        "signal_id int, market_regime string, patterns array<string>",
    )
    shown = ["signal_id", "strategy_name", "signal_type", "sl_pct", "ts_activation_pct"]
    plain = joins.match_strategy(signals, best_strategies(parameters)).withColumnRenamed(
        "total_pnl_pct", "strategy_pnl"
    )
    reduced = joins.match_strategy(signals, strategy_candidates(parameters, ["market_regime"]))
    order = strategy_preference()
    expected = rows(distinct_on(plain, ["signal_id"], order), *shown)
    assert rows(distinct_on(reduced, ["signal_id"], order), *shown) == expected
    assert len(expected) == 3


def test_strategy_match_refuses_ambiguous_columns(spark):
    left = spark.createDataFrame([], "market_regime string, patterns array<string>, x int")
    right = spark.createDataFrame([], "market_regime string, required_patterns array<string>, x int")
    with pytest.raises(ValueError):
        joins.match_strategy(left, right)


def test_one_row_parameters_without_a_join(spark):
    facts = spark.createDataFrame([(1,), (2,)], "id int")
    best = spark.createDataFrame([(7, 0.5)], "a int, b double").limit(1)
    joined = joins.cross_best_params(facts, best, ["a", "b"])
    assert rows(joined) == [(1, 7, 0.5), (2, 7, 0.5)]
    assert joins.cross_best_params(facts, best.filter("a = 8"), ["a", "b"]).isEmpty()


def test_symbol_may_match_several_pairs(spark):
    facts = spark.createDataFrame([(1, "X"), (2, "Y")], "id int, pair_symbol string")
    pairs = spark.createDataFrame(
        [(10, "X", 1, True), (11, "X", 2, True)],
        "id int, pair_symbol string, exchange_id int, is_active boolean",
    )
    got = rows(joins.join_pair_by_symbol(facts, pairs), "id", "matched_pair_id", "exchange_id")
    assert got == [(1, 10, 1), (1, 11, 2)]


def test_condition_of_an_outer_join_keeps_other_rows(spark):
    facts = spark.createDataFrame([(1,), (2,)], "id int")
    bridge = spark.createDataFrame(
        [(1, 100), (1, 101)], "scoring_history_id int, signal_patterns_id int"
    )
    listed = spark.createDataFrame([(100, "A", "1h")], "id int, pattern_type string, timeframe string")
    got = rows(joins.left_join_patterns(facts, bridge, listed), "id", "pattern_type")
    assert got == [(1, "A"), (1, None), (2, None)]
    assert rows(joins.exists_pattern(facts, bridge, listed)) == [(1,)]


def test_regimes_may_be_missing_or_several(spark):
    facts = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    bridge = spark.createDataFrame(
        [(1, 5), (1, 6), (2, None)], "scoring_history_id int, signal_regime_id int"
    )
    regimes = spark.createDataFrame([(5, "BULL"), (6, "BEAR")], "id int, regime string")
    got = rows(joins.regime_by_bridge(facts, bridge, regimes), "id", "market_regime")
    assert got == [(1, "BEAR"), (1, "BULL"), (2, None), (3, None)]


def test_unknown_pair_gives_no_flag(spark):
    changed = spark.createDataFrame([(1, 7), (2, 8)], "id int, trading_pair_id int")
    pairs = spark.createDataFrame([(7, True)], "id int, is_active boolean")
    got = rows(joins.event_pair_lookup(changed, pairs), "id", "pair_is_active")
    assert got == [(1, True), (2, None)]


def test_first_id_bound_skips_old_row_groups(spark, folder):
    """The bound is a subquery, yet the scan gets it as a literal and leaves out row groups."""
    bridge = spark.range(0, 200_000).selectExpr("id as scoring_history_id", "id % 7 as x")
    bridge.coalesce(1).write.option("parquet.block.size", 65536).parquet(folder)
    stored = spark.read.parquet(folder)
    recent = spark.createDataFrame([(199_990,), (199_995,)], "id long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept = since_first_id(stored, recent)
        assert len(kept.collect()) == 10
        leaf = kept._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert 10 <= leaf.metrics().apply("numOutputRows").value() < 100_000
        assert since_first_id(stored, recent.filter("id < 0")).isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigloom.functions import (
    contains_all,
    float_or_null,
    float_or_zero,
    int_or_null,
    iso_text,
    pattern_key,
    strategy_patterns,
)


def evaluate(spark, expression, schema, *values):
    return spark.createDataFrame([values], schema).select(expression.alias("r")).first()["r"]


def test_missing_score_is_zero_and_zero_parameter_is_missing(spark):
    df = spark.createDataFrame(
        [(1, None), (2, Decimal("0")), (3, Decimal("2.5"))], "id int, x decimal(10,2)"
    )
    got = df.select(float_or_zero("x"), float_or_null("x")).collect()
    assert [tuple(r) for r in got] == [(0.0, None), (0.0, None), (2.5, 2.5)]


def test_integer_parameter_truncates_after_the_zero_test(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (7.9,), (None,)], "x double")
    assert [r[0] for r in df.select(int_or_null("x")).collect()] == [None, 0, 7, None]


def test_iso_text_prints_microseconds_only_if_any(spark):
    whole, part = datetime(2025, 10, 21, 2, 15), datetime(2025, 10, 21, 2, 33, 2, 231292)
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame([(whole,), (part,), (None,)], f"t {kind}")
        assert [r[0] for r in df.select(iso_text("t")).collect()] == [
            "2025-10-21T02:15:00+00:00",
            "2025-10-21T02:33:02.231292+00:00",
            None,
        ]


def test_pattern_key_with_a_missing_part_is_null(spark):
    df = spark.createDataFrame([("A", "1h"), ("A", None), (None, "1h")], "p string, t string")
    assert [r[0] for r in df.select(pattern_key("p", "t")).collect()] == ["A_1h", None, None]


def test_strategy_patterns(spark):
    cases = {
        "['PAT1', 'PAT2']|TYPE|REGIME": ["PAT1", "PAT2"],
        "['ONE_15m']|BUY|BULL": ["ONE_15m"],
        "[]|BUY|BULL": [],
        "": [],
        "A, B": ["A", "B"],
    }
    df = spark.createDataFrame([(name,) for name in cases], "name string")
    got = [r[0] for r in df.select(strategy_patterns("name")).collect()]
    assert got == list(cases.values())
    assert evaluate(spark, strategy_patterns("name"), "name string", None) is None


def test_containment_with_empty_null_and_repeated_elements(spark):
    cases = [
        (["a", "b"], ["a"], True),
        (["a", "b"], ["a", "c"], False),
        (["a", None], ["a"], True),
        (["a", None], ["b"], False),
        ([], [], True),
        (["a"], [], True),
        (["a"], ["a", "a"], True),
        ([], ["a"], False),
    ]
    df = spark.createDataFrame(
        [(h, n) for h, n, _ in cases], "have array<string>, need array<string>"
    )
    got = [r[0] for r in df.select(contains_all("have", "need")).collect()]
    assert got == [expected for *_, expected in cases]
    unknown = evaluate(
        spark, contains_all("have", "need"), "have array<string>, need array<string>", ["a"], None
    )
    assert not unknown


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sets(st.sampled_from("abcd")), st.sets(st.sampled_from("abcd"))), min_size=1))
def test_containment_is_superset(spark, cases):
    data = [(sorted(h), sorted(n)) for h, n in cases]
    df = spark.createDataFrame(data, "have array<string>, need array<string>").coalesce(1)
    got = [r[0] for r in df.select(contains_all("have", "need")).collect()]
    assert got == [h >= n for h, n in cases]
    assert df.filter(F.col("have").isNull()).isEmpty()

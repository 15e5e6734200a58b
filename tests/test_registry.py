"""Every registered query against its SQL, and the plans of the feeds."""

from __future__ import annotations

import glob
import os
from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as entry_points
from sigloom.registry import ORACLES, QUERIES
from sigloom.registry.base import CONFIG
from sigloom.plans import feeds
from sigloom.standins import AS_OF, standin_catalog
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    database = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        database.execute(f"create view {name} as select * from '{path}'")
    return database


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    return repr(float(value)) if isinstance(value, int | float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, connection, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = connection.execute(ORACLES[name])
    order = [c[0] for c in cursor.description]
    assert sorted(order) == columns
    expected = sorted(
        tuple(plain(r[order.index(c)]) for c in columns) for r in cursor.fetchall()
    )
    assert got == expected


def test_every_inventory_item_is_registered():
    families = {"S": 8, "P": 10, "F": 14, "J": 15, "A": 13, "W": 13, "U": 2, "T": 11, "X": 2}
    heads = {name.split("_")[0] for name in QUERIES}
    missing = [f"{k}{i}" for k, n in families.items() for i in range(1, n + 1) if f"{k}{i}" not in heads]
    assert missing == []
    composites = {"STD", "HIGH", "OPT", "BEST", "LEGACY", "LEGACY5", "DIAG", "CONSUME"}
    assert composites <= {n.removeprefix("Q_") for n in QUERIES if n.startswith("Q_")}


def test_entry_points(spark):
    # All of the library's own queries have check SQL; the optional text queries may have none.
    assert QUERIES.keys() <= entry_points.oracle_sql().keys() <= entry_points.queries().keys()
    assert len(entry_points.entry(spark).columns) == 15


@pytest.mark.parametrize(
    "feed",
    [
        feeds.standard_feed,
        feeds.high_score_feed,
        feeds.optimized_feed,
        feeds.best_signals,
        feeds.legacy_feed,
        feeds.diagnostic_feed,
    ],
)
def test_feed_plans(spark, feed):
    plan = feed(standin_catalog(spark, FOLDER), CONFIG, AS_OF)._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert "GreaterThanOrEqual(ts," in text
    assert "Python" not in text


def test_regime_interval_keeps_every_regime_of_the_hour(spark, folder):
    minutes = {4: 0, 8: 3, 12: 3, 13: 10, 16: 62}  # numbers divisible by four are also regimes at 15m
    events = spark.createDataFrame(
        [(k, START + timedelta(minutes=m), "view", 1.0, "{}") for k, m in minutes.items()],
        "event_id long, ts timestamp, event_type string, value double, props string",
    )
    events.write.parquet(f"{folder}/events.parquet")
    got = rows(QUERIES["J11_regime_interval"](spark, folder), "id", "regime_id")
    seen = {4: [4], 8: [4, 8, 12], 12: [4, 8, 12], 13: [4, 8, 12], 16: [8, 12, 16]}
    assert got == sorted(((k, r) for k, some in seen.items() for r in some), key=repr)

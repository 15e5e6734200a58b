"""Feeds over tables stored the way the README proposes."""

from __future__ import annotations

import os

import pytest

from sigloom.plans import feeds, strategies
from sigloom.registry.base import CONFIG
from sigloom.schemas import TABLES
from sigloom.sources.catalog import Catalog
from sigloom.sources.layout import write_bucketed, write_by_date
from sigloom.standins import AS_OF, standin_catalog
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stored"))
    plain = standin_catalog(spark, FOLDER)
    locations = {}
    for name in TABLES:
        if name in ("scoring_history", "market_regime"):
            write_by_date(plain(name), f"{root}/{name}")
            locations[name] = f"{root}/{name}"
        elif name.startswith("sh_") or name == "scoring_history_results_v2":
            write_bucketed(plain(name), f"stored_{name}", "scoring_history_id", 4)
            locations[name] = f"stored_{name}"
        else:
            plain(name).write.parquet(f"{root}/{name}")
            locations[name] = f"{root}/{name}"
    return plain, Catalog(spark, locations)


@pytest.mark.parametrize(
    "feed",
    [feeds.standard_feed, feeds.high_score_feed, feeds.optimized_feed, feeds.best_signals],
)
def test_stored_tables_give_the_same_feeds(stored, feed):
    plain, laid_out = stored
    expected = rows(feed(plain, CONFIG, AS_OF))
    assert rows(feed(laid_out, CONFIG, AS_OF)) == expected
    assert expected


def test_days_outside_the_window_are_not_read(stored):
    _, laid_out = stored
    plan = feeds.standard_feed(laid_out, CONFIG, AS_OF)._jdf.queryExecution()
    assert "PartitionFilters: [isnotnull(event_date" in plan.executedPlan().toString()


def test_bucketed_bridge_is_folded_in_place(stored):
    _, laid_out = stored
    folded = strategies.profiles(laid_out("sh_patterns"), laid_out("signal_patterns"))
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(scoring_history_id" not in plan

"""Streaming queries over a stored table do not depend on how it is stored."""

from __future__ import annotations

import os

import pytest

from sigloom.registry import QUERIES
from tests.conftest import rows

SMALL = "/root/testdata/sf0.001"
TABLES = ("events", "customer", "part", "supplier", "orders", "lineitem", "nation", "region")


@pytest.fixture(scope="module")
def in_parts(spark, tmp_path_factory):
    """The tables, with ``events`` as a folder of four files, the newest rows first."""
    root = tmp_path_factory.mktemp("parts")
    for name in TABLES:
        os.symlink(f"{SMALL}/{name}.parquet", root / f"{name}.parquet")
    os.unlink(root / "events.parquet")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    time = next(f.name for f in events.schema if f.dataType.typeName().startswith("timestamp"))
    events.orderBy(events[time].desc()).repartition(4).write.parquet(str(root / "events.parquet"))
    return str(root)


@pytest.mark.parametrize("name", ["S3_change_source", "T6_dedup_seen", "T7_rate_per_minute"])
def test_folder_and_single_file_agree(spark, in_parts, name):
    one, many = (rows(QUERIES[name](spark, folder)) for folder in (SMALL, in_parts))
    assert one and one == many

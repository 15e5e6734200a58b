"""Logical table names resolved to DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.schemas import TABLES

# Where a table may come from: a frame or a function giving one, a folder path or table name, or
# reader options with a ``format`` entry (such as ``{"format": "jdbc", "url": ..., "dbtable": ...}``).
Location = DataFrame | Callable[[], DataFrame] | str | Mapping[str, Any]


class Catalog:
    """Maps the logical tables of the signal schema to wherever they are stored.

    A path or table name is read anew at every call, so that files added since are seen.
    """

    def __init__(self, spark: SparkSession, locations: Mapping[str, Location]):
        unknown = set(locations) - set(TABLES)
        if unknown:
            raise KeyError(f"unknown tables: {sorted(unknown)}")
        self.spark = spark
        self._locations = dict(locations)

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str) -> Catalog:
        """One Parquet folder per logical table below ``folder``."""
        return cls(spark, {name: f"{folder.rstrip('/')}/{name}" for name in TABLES})

    def __call__(self, name: str) -> DataFrame:
        location = self._locations[name]
        if isinstance(location, DataFrame):
            return location
        if callable(location):
            return location()
        if isinstance(location, str):
            if "/" in location:
                return self.spark.read.parquet(location)
            return self.spark.table(location)
        options = dict(location)
        return self.spark.read.format(options.pop("format")).options(**options).load()

    def names(self) -> Iterable[str]:
        return self._locations.keys()


def scan_tables(catalog: Catalog, names: Iterable[str] | None = None) -> DataFrame:
    """Row count of every named table, one row each."""
    counts = [
        catalog(name).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name in (names or catalog.names())
    ]
    return reduce(DataFrame.unionByName, counts)

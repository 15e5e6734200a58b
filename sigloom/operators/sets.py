"""Unions and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union_params(*branches: DataFrame) -> DataFrame:
    """All parameter rows of the exchanges, matched by column name."""
    result = branches[0]
    for branch in branches[1:]:
        result = result.unionByName(branch)
    return result


def new_since_seen(rows: DataFrame, seen: DataFrame, key: str = "signal_id") -> DataFrame:
    """Rows whose key was not seen before."""
    return rows.join(seen.select(key), key, "left_anti")

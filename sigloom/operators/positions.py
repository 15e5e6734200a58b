"""Places and running sums over a whole ordered frame, while no task sees more than its part of it.

A global sort leaves the rows in order inside each task and the tasks in order among each other.  So a
row knows its task and its place there, and what lies in the tasks before it is one number per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

PART, PLACE = "_part", "_place"
_IN_TASK = (1 << 33) - 1


def marked(df: DataFrame) -> DataFrame:
    """The rows with their task and, from 0, their place in it.

    Write the result before using the marks: run again, a plan may deal its rows to other tasks.
    """
    clash = {PART, PLACE} & set(df.columns)
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_TASK))
    return df.select("*", F.spark_partition_id().alias(PART), place.alias(PLACE))


def written_in_order(df: DataFrame, path: str) -> DataFrame:
    """The marked rows, written in the frame's own order and read back."""
    rows = marked(df)
    rows.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def part_totals(rows: DataFrame, *totals: Column) -> list[Row]:
    """The given aggregates of every task's rows, in order; one row per task of the sort."""
    counted = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("rows"), *totals)
    return sorted(counted.collect(), key=lambda r: r[PART])


def starts(parts: Sequence[Row], total: str = "rows") -> dict[int, int]:
    """For every task the sum of ``total`` over the tasks before it."""
    out, so_far = {}, 0
    for part in parts:
        out[part[PART]] = so_far
        so_far += part[total] or 0
    return out


def _started(rows: DataFrame, before: dict[int, int], name: str) -> DataFrame:
    # One row per task of the sort, so the broadcast has a size that is known.
    table = rows.sparkSession.createDataFrame(list(before.items()), f"{PART} int, {name} bigint")
    return rows.join(F.broadcast(table), PART)


def positioned(rows: DataFrame, before: dict[int, int], position: str = "pos") -> DataFrame:
    """Marked rows with their place in the whole frame, from 0, in place of the marks."""
    if position in rows.columns:
        raise ValueError(f"column already there: {position}")
    found = _started(rows, before, "_start").withColumn(position, F.col("_start") + F.col(PLACE))
    return found.drop("_start", PART, PLACE)


def running_before(rows: DataFrame, column: str, before: dict[int, int], name: str) -> DataFrame:
    """Marked rows with the sum of ``column`` over all rows before each."""
    earlier = Window.partitionBy(PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(column).over(earlier), F.lit(0))
    return _started(rows, before, "_start").withColumn(name, F.col("_start") + inside).drop("_start")

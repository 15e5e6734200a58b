"""Storage layout that lets the feeds prune files and skip shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE_COLUMN = "event_date"


def write_by_date(df: DataFrame, path: str, column: str = "timestamp", mode: str = "append") -> None:
    """Write a time-stamped table in one folder per day, sorted by time inside its files.

    Rows are range-partitioned by time, so that a day holding a large share of the rows is spread
    over several tasks instead of being written by one.
    """
    (
        df.withColumn(DATE_COLUMN, F.to_date(column))
        .repartitionByRange(DATE_COLUMN, column)
        .sortWithinPartitions(DATE_COLUMN, column)
        .write.mode(mode)
        .partitionBy(DATE_COLUMN)
        .parquet(path)
    )


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, mode: str = "overwrite") -> None:
    """Write a table bucketed and sorted by its join key.

    Two tables bucketed alike (fact on ``id``, bridges on ``scoring_history_id``) join without
    a shuffle on either side.
    """
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)

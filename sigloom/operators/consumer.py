"""What a consumer of the feeds does: filter, take the top, run its own code."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOME_SCHEMA = "id bigint, status string, error string"


def consumable(
    min_score: float = 0.7,
    exchanges: Sequence[int | str] = (),
    score: str = "score",
    price: str = "entry_price",
) -> Column:
    """Whether a row has a high enough score, an allowed exchange and an entry price.

    A missing score counts as 0; a missing or zero price does not do.  No exchanges given means
    all are allowed.
    """
    good = (F.coalesce(score, F.lit(0.0)) >= min_score) & (F.coalesce(price, F.lit(0.0)) != 0)
    if exchanges:
        allowed = F.col("exchange_id").cast("string").isin(*[str(e) for e in exchanges])
        good &= F.coalesce(allowed, F.lit(False))
    return good


def consumer_filter(
    feed: DataFrame,
    min_score: float = 0.7,
    exchanges: Sequence[int | str] = (),
    score: str = "score",
    price: str = "entry_price",
) -> DataFrame:
    """The ``consumable`` rows."""
    return feed.filter(consumable(min_score, exchanges, score, price))


def process_rows(rows: DataFrame, handler: Callable[[dict[str, Any]], None]) -> DataFrame:
    """Run ``handler`` for every row on the executors; one outcome row each.

    An exception marks its own row as failed and stops nothing else.  The handler may run again
    for a row if a task is retried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, statuses, errors = [], [], []
            for record in batch.to_pylist():
                try:
                    handler(record)
                    status, error = "processed", None
                except Exception as problem:  # noqa: BLE001 - any failure of user code counts
                    status, error = "error", str(problem)
                ids.append(record.get("id"))
                statuses.append(status)
                errors.append(error)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(statuses, pa.string()),
                    pa.array(errors, pa.string()),
                ],
                names=["id", "status", "error"],
            )

    return rows.mapInArrow(run, OUTCOME_SCHEMA)


def processing_totals(received: DataFrame, kept: Column, outcomes: DataFrame) -> DataFrame:
    """Rows received, filtered out, processed and failed, as one row.

    ``kept`` tells which received rows were kept; both are counted in one pass.
    """
    counted = outcomes.agg(
        F.count_if(F.col("status") == "processed").alias("processed"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )
    dropped = F.count_if(~F.coalesce(kept, F.lit(False)))
    seen = received.agg(F.struct(F.count(F.lit(1)).alias("all"), dropped.alias("dropped"))).scalar()
    return counted.withColumn("_seen", seen).select(
        F.col("_seen.all").alias("total_received"),
        F.col("_seen.dropped").alias("filtered_out"),
        "processed",
        "errors",
    )

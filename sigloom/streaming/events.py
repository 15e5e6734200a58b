"""Change events: what a row trigger on the fact table would announce.

Stateless: a change row carries both images, and the pair table is a static side.  ``as_of``
defaults to the time of the micro-batch.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions import iso_text
from sigloom.operators import filters, joins
from sigloom.schemas import CHANGE_EVENT
from sigloom.sources.messages import json_text

DEFAULT_CHANNEL = "new_signals"


def _announce(
    changes: DataFrame,
    event: str,
    pairs: DataFrame,
    as_of: datetime | Column | None,
    minutes: int,
    threshold: float,
    channel: str,
) -> DataFrame:
    rows = joins.event_pair_lookup(changes.select("new.*"), pairs)
    live = filters.qualifying_event(rows, as_of, minutes, threshold)
    fields = {
        "event": F.lit(event),
        "timestamp": iso_text("timestamp"),
        "action": F.col("recommended_action"),
    }
    shaped = live.select(*[fields.get(c, F.col(c)).alias(c) for c in CHANGE_EVENT.names])
    return shaped.select(F.lit(channel).alias("channel"), json_text(shaped).alias("value"))


def insert_events(
    changes: DataFrame,
    pairs: DataFrame,
    as_of: datetime | Column | None = None,
    minutes: int = 32,
    threshold: float = 50.0,
    channel: str = DEFAULT_CHANNEL,
) -> DataFrame:
    """``(channel, value)`` for every inserted row worth announcing."""
    inserted = changes.filter(F.col("op") == "INSERT")
    return _announce(inserted, "INSERT", pairs, as_of, minutes, threshold, channel)


def update_events(
    changes: DataFrame,
    pairs: DataFrame,
    as_of: datetime | Column | None = None,
    minutes: int = 32,
    threshold: float = 50.0,
    channel: str = DEFAULT_CHANNEL,
) -> DataFrame:
    """``(channel, value)`` for every update that moved a score or the flag of such a row."""
    updated = filters.changed_scores(changes.filter(F.col("op") == "UPDATE"), threshold)
    return _announce(updated, "UPDATE", pairs, as_of, minutes, threshold, channel)

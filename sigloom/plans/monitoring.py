"""Batch forms of the monitoring figures: batch logs, probe histories, windows over time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


AsOf = datetime | Column | None


def gate_history(
    probes: DataFrame,
    feed: str = "feed",
    time: str = "probe_time",
    span: str = "hour",
    number: str | None = None,
    by_time: bool = True,
    error: str | None = None,
) -> DataFrame:
    """Which probes of a history announce a change.

    Without ``by_time`` only the ids count, see ``id_gate_history``.  Where the column ``error`` says that
    a probe failed, that is a change, and the kept values stay.

    A probe is compared with the values kept at the last change: it is a change if its newest time
    differs or its newest id is larger.  While the newest time stays the same, the kept id is
    the largest one met so far.  So it is enough to know the previous probe's time and the largest
    id earlier in the same stretch of equal times.  Probes of an empty window are no change and
    leave the kept values alone.  Probes of one time follow each other by the column ``number``, or
    else by newest time and id.

    No task has to see a whole history.  Windows cover one feed and one ``span`` of time, so a group
    is at most the probes made in it (3,600 an hour at one a second; take a shorter span for faster
    probing).  What a span takes over from the ones before it is worked out on one row per span.
    """
    if error is not None:
        failed = F.col(error).isNotNull()
        walked = gate_history(probes.filter(~failed), feed, time, span, number, by_time)
        return walked.unionByName(probes.filter(failed).withColumn("changed", F.lit(True)))
    if not by_time:
        return id_gate_history(probes, feed, time, span, number)
    order = [time, number] if number else [time, "max_timestamp", "max_id"]
    empty = F.coalesce("max_id", F.lit(0)) == 0
    filled = probes.filter(~empty).withColumn("_span", F.date_trunc(span, time))
    spans = Window.partitionBy(feed).orderBy("_span")
    inside = Window.partitionBy(feed, "_span").orderBy(*order)

    # Time before the first probe of a span, then stretches of equal times inside the span; stretch
    # 0 goes on from the span before.
    ends = filled.groupBy(feed, "_span").agg(F.max_by("max_timestamp", F.struct(*order)).alias("_end"))
    starts = ends.select(feed, "_span", F.lag("_end").over(spans).alias("_start"))
    before = F.coalesce(F.lag("max_timestamp").over(inside), F.col("_start"))
    moved = filled.join(starts, [feed, "_span"]).withColumn(
        "_moved", ~F.col("max_timestamp").eqNullSafe(before)
    )
    cut = moved.withColumn("_stretch", F.count_if("_moved").over(inside))

    # Largest id of the stretch that a span hands on: its last stretch, together with the spans
    # before as far as that stretch reaches back.
    tops = cut.groupBy(feed, "_span").agg(
        F.max(F.struct("_stretch", "max_id")).alias("_last")
    )
    reach = tops.select(
        feed,
        "_span",
        F.col("_last.max_id").alias("_top"),
        F.count_if(F.col("_last._stretch") > 0).over(spans).alias("_chain"),
    )
    chain = Window.partitionBy(feed, "_chain").orderBy("_span")
    handed = reach.withColumn("_top", F.max("_top").over(chain)).select(
        feed, "_span", F.lag("_top").over(spans).alias("_handed")
    )

    stretch = Window.partitionBy(feed, "_span", "_stretch").orderBy(*order)
    kept = F.greatest(
        F.max("max_id").over(stretch.rowsBetween(Window.unboundedPreceding, -1)),
        F.when(F.col("_stretch") == 0, F.col("_handed")),
    )
    decided = (
        cut.join(handed, [feed, "_span"])
        .withColumn("_kept", F.coalesce(kept, F.lit(0)))
        .select(
            *probes.columns,
            (F.col("_moved") | (F.col("max_id") > F.col("_kept"))).alias("changed"),
        )
    )
    return decided.unionByName(probes.filter(empty).withColumn("changed", F.lit(False)))


def id_gate_history(
    probes: DataFrame,
    feed: str = "feed",
    time: str = "probe_time",
    span: str = "hour",
    number: str | None = None,
) -> DataFrame:
    """Which probes announce a change where only ids count: those above every id before them.

    The running maximum has two levels: over the spans of a feed, one row each, and over the probes
    inside a span.
    """
    order = [time, number] if number else [time, "max_id"]
    spans = Window.partitionBy(feed).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(feed, "_span").orderBy(*order)
    cut = probes.withColumn("_span", F.date_trunc(span, time))
    tops = cut.groupBy(feed, "_span").agg(F.max("max_id").alias("_top"))
    handed = tops.select(feed, "_span", F.max("_top").over(spans).alias("_handed"))
    earlier = F.max("max_id").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return (
        cut.withColumn("_earlier", earlier)
        .join(handed, [feed, "_span"])
        .select(
            *probes.columns,
            (
                F.coalesce("max_id", F.lit(0))
                > F.coalesce(F.greatest("_earlier", "_handed"), F.lit(0))
            ).alias("changed"),
        )
    )


def refresh_due(changed: Column, seconds_since_last: Column, force_seconds: int | None) -> Column:
    """Refresh when something changed or, with a forced interval, when the last one is too old."""
    if force_seconds is None:
        return changed
    return changed | (seconds_since_last >= force_seconds)


def snapshot_at(df: DataFrame, minutes: int, moments: list[datetime]) -> DataFrame:
    """The lookback window as seen at several times, from one scan.

    At each time it holds the rows that are there by then and not older than the window.
    """
    kind = df.schema["timestamp"].dataType

    def at(moment: datetime) -> Column:
        return F.lit(moment.isoformat(sep=" ")).cast(kind)

    width = F.make_dt_interval(mins=F.lit(minutes))
    seen = df.filter(
        F.col("timestamp").between(at(min(moments)) - width, at(max(moments)))
    ).withColumn("as_of", F.explode(F.array(*(at(m) for m in moments))))
    inside = F.col("timestamp").between(F.col("as_of") - width, F.col("as_of"))
    text = F.date_format("as_of", "yyyy-MM-dd HH:mm:ss")
    return seen.filter(inside).withColumn("as_of", text)


def feed_stats(batches: DataFrame, as_of: datetime) -> DataFrame:
    """Uptime, queries run, rows sent, errors and newest batch of a feed, as one row.

    ``batches`` is a log ``(batch_id, time, count, error, first_timestamp)``; ``first_timestamp`` is
    the time of the snapshot's first row.
    """
    now = F.lit(as_of.isoformat(sep=" ")).cast(batches.schema["time"].dataType)
    start = F.min("time")
    uptime = F.unix_micros(now.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return batches.agg(
        (uptime / F.lit(1000000.0)).alias("uptime_seconds"),
        F.count(F.lit(1)).alias("queries_executed"),
        F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("signals_sent"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.max_by("first_timestamp", "batch_id").alias("last_query"),
    )

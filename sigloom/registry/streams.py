"""Operators driven by streaming queries over the test data, run until the input is used up."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from sigloom.operators import aggregates, joins, ranking, shaping
from sigloom.plans import feeds, monitoring
from sigloom.registry.base import (
    CONFIG,
    LIVE,
    RECENT,
    SCORED,
    STANDARD,
    WINDOW_MINUTES,
    iso,
    stamp,
    stream_query,
)
from sigloom.registry.feeds import DIAGNOSTIC, RECORD
from sigloom.session import working_folder
from sigloom.sources import changes, sinks
from sigloom.sources.batches import BatchTable
from sigloom.sources.changes import change_rows
from sigloom.standins import AS_OF, DEFINITIONS, derive
from sigloom.streaming import dedup, events, rates, refresh, stats


def streamed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stand-in table as a stream over its source, a single file or a folder of files.

    A stored table is read whole in one micro-batch, so the number of its files changes nothing.
    """
    source = DEFINITIONS[name][0]
    schema = spark.read.parquet(f"{folder}/{source}.parquet").schema
    rows = changes.change_source(
        spark,
        # Only a pattern may name a single file as well as a folder.
        f"{folder}/{source}.parque[t]",
        source_format="parquet",
        schema=schema,
        max_files=None,
    )
    return derive(rows, name)


#: Rows of one staged file, about; the files of a micro-batch are read and written by tasks of their own.
FILE_ROWS = 250_000


def staged(
    rows: DataFrame, purpose: str, order: Column, batches: int = 4, file_rows: int = FILE_ROWS
) -> tuple[str, T.StructType, int]:
    """The rows as a folder of files that streams take in the given order, and how many at a time.

    Ranges of the order are written one by one, each as the same number of files in its own folder: as
    many as the largest range needs, the missing ones without rows.
    """
    spark = rows.sparkSession
    root = working_folder(spark, purpose)
    rows.withColumn("_at", order).write.parquet(f"{root}/all")
    ranked = spark.read.parquet(f"{root}/all")
    cuts = ranked.approxQuantile("_at", [k / batches for k in range(1, batches)], 0.001)
    parts = []
    for low, high in pairwise([None, *cuts, None]):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (F.col("_at") >= low)
        if high is not None:
            inside = inside & (F.col("_at") < high)
        parts.append(inside)
    sizes = ranked.agg(*[F.count_if(inside).alias(f"n{k}") for k, inside in enumerate(parts)]).first()
    files = max(1, -(-max(sizes) // file_rows))
    for number, inside in enumerate(parts):
        path = f"{root}/batch={number:04d}"
        part = ranked.where(inside).drop("_at")
        part = part.coalesce(1) if files == 1 else part.repartition(files)
        part.write.option("maxRecordsPerFile", 0).parquet(path)
        for _ in range(files - file_count(spark, path)):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(path)
    return f"{root}/batch=*", rows.schema, files


def file_count(spark: SparkSession, path: str) -> int:
    """How many data files a folder on any file system holds."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*.parquet")
    return len(target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target))


def in_batches(
    rows: DataFrame,
    purpose: str,
    order: Column | None = None,
    batches: int = 4,
    file_rows: int = FILE_ROWS,
) -> DataFrame:
    """The rows as a stream of several micro-batches (by id, if no order is given)."""
    order = F.col("id") if order is None else order
    path, schema, files = staged(rows, purpose, order, batches, file_rows)
    return changes.change_source(
        rows.sparkSession, path, source_format="parquet", schema=schema, max_files=files
    )


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def drain(writer: DataStreamWriter, path: str | None = None) -> StreamingQuery:
    """Run the query over everything there is, then stop."""
    query = writer.trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


def drained(spark: SparkSession, stream: DataFrame, purpose: str) -> DataFrame:
    """The rows of an append-only stream, through a table."""
    root = working_folder(spark, purpose)
    writer = stream.writeStream.outputMode("append").format("parquet")
    drain(writer.option("checkpointLocation", f"{root}/checkpoint"), f"{root}/rows")
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def updates(facts: DataFrame) -> DataFrame:
    """Every signal as an update that moved its score, its flag, both or neither."""
    number = F.col("id")
    return change_rows(
        facts,
        "UPDATE",
        {
            "score_week": F.when(number % 4 == 0, F.col("score_week")).otherwise(
                F.col("score_week") - 5
            ),
            "is_active": F.when(number % 8 == 0, ~F.col("is_active")).otherwise(
                F.col("is_active")
            ),
        },
    )


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Every signal once as an insert and once as an update."""
    inserts = change_rows(streamed(spark, folder, "scoring_history"), "INSERT")
    return inserts.unionByName(updates(streamed(spark, folder, "scoring_history")))


EVENT_TEXT = (
    "cast(to_json({{'event': '{0}', 'id': id, 'pair_symbol': pair_symbol, 'score_week': score_week, "
    f"'score_month': score_month, 'timestamp': {iso('timestamp')}, "
    "'action': recommended_action}}) as varchar)"
)
QUALIFYING = f"{SCORED} and {LIVE} and {RECENT}"
MOVED = "id % 4 <> 0 or id % 8 = 0"


@stream_query(
    "S3_change_source",
    "select 'INSERT' as op, id, score_week as new_score, cast(null as double) as old_score from "
    "scoring_history union all select 'UPDATE', id, score_week, case when id % 4 = 0 then "
    "score_week else score_week - 5 end from scoring_history",
)
def s3(spark, folder, t):
    rows = change_stream(spark, folder).select(
        "op",
        "new.id",
        F.col("new.score_week").alias("new_score"),
        F.col("old.score_week").alias("old_score"),
    )
    return drained(spark, rows, "changes")


@stream_query(
    "S4_event_sink",
    f"select 'new_signals' as channel, {EVENT_TEXT.format('INSERT')} as value from paired "
    f"where {QUALIFYING}",
)
def s4(spark, folder, t):
    announced = events.insert_events(
        change_stream(spark, folder), t("trading_pairs"), AS_OF, WINDOW_MINUTES
    )
    root = working_folder(spark, "events")
    drain(sinks.event_sink(announced, f"{root}/checkpoint"), f"{root}/lines")
    return spark.read.text(f"{root}/lines").select("channel", "value")


@stream_query(
    "T1_insert_events",
    f"select {EVENT_TEXT.format('INSERT')} as value from paired where {QUALIFYING}",
)
def t1(spark, folder, t):
    announced = events.insert_events(
        change_stream(spark, folder), t("trading_pairs"), AS_OF, WINDOW_MINUTES
    )
    return drained(spark, announced.select("value"), "inserts")


@stream_query(
    "T2_update_events",
    f"select {EVENT_TEXT.format('UPDATE')} as value from paired where {QUALIFYING} "
    f"and ({MOVED})",
)
def t2(spark, folder, t):
    announced = events.update_events(
        change_stream(spark, folder), t("trading_pairs"), AS_OF, WINDOW_MINUTES
    )
    return drained(spark, announced.select("value"), "updates")


FEED_ORDER = "score_week desc nulls last, timestamp desc nulls first, id"


def numbered(columns: str, order: str = FEED_ORDER) -> str:
    """Columns and the place in an order, from 0."""
    return f"{columns}, row_number() over (order by {order}) - 1 as pos"


@stream_query("T3_snapshot_refresh", f"select {numbered(RECORD)} from with_params where {STANDARD}")
def t3(spark, folder, t):
    root = working_folder(spark, "refresh")
    table = sinks.SnapshotTable(spark, f"{root}/snapshot")
    drain(
        refresh.snapshot_refresh(
            change_stream(spark, folder),
            lambda: feeds.standard_feed(t, CONFIG, AS_OF),
            table,
            f"{root}/checkpoint",
        )
    )
    return table.latest()


@stream_query("S5_snapshot_sink", f"select {numbered(DIAGNOSTIC)} from paired")
def s5(spark, folder, t):
    signals = joins.join_pair_by_id(t("scoring_history"), t("trading_pairs"))
    table = sinks.SnapshotTable(spark, working_folder(spark, "snapshot"))
    table.replace(shaping.diagnostic_record(ranking.order_feed(signals)), 0)
    return table.latest()


@stream_query(
    "S8_latest_snapshot",
    f"select {numbered('id, score_week, ' + stamp('timestamp') + ' as timestamp')} "
    "from scoring_history",
)
def s8(spark, folder, t):
    """A version per weekday's signals, then the whole table; the last one is served."""
    facts = t("scoring_history").select("id", "score_week", "timestamp")
    table = sinks.SnapshotTable(spark, working_folder(spark, "snapshot"))
    table.replace(facts.where(F.dayofweek("timestamp") == 1), 0)
    table.replace(ranking.order_feed(facts), 1)
    return table.latest()


@stream_query(
    "T6_dedup_seen",
    f"select id as signal_id, {stamp('timestamp')} as signal_timestamp from scoring_history "
    "where id in (select scoring_history_id from sh_patterns)",
)
def t6(spark, folder, t):
    """Alerts come newest first, one signal in many rows and micro-batches."""
    signals = t("scoring_history").withColumnRenamed("id", "scoring_history_id")
    alerts = t("sh_patterns").join(signals, "scoring_history_id").select(
        F.col("scoring_history_id").alias("signal_id"),
        F.col("timestamp").cast("timestamp").alias("signal_timestamp"),
    )
    # Every second row of a signal comes a quarter of the history later.
    late = F.pmod(F.monotonically_increasing_id(), F.lit(2)) * F.lit(10**12)
    stream = in_batches(alerts, "alerts", late - micros("signal_timestamp"))
    root = working_folder(spark, "seen")
    shown = BatchTable(spark, f"{root}/shown")
    drain(dedup.show_once(stream, shown, dedup.SeenKeys(spark, f"{root}/keys"), f"{root}/checkpoint"))
    return shown.read().select("signal_id", "signal_timestamp")


@stream_query(
    "T7_rate_per_minute",
    f"select {stamp(chr(39).join(['date_trunc(', 'minute', ', timestamp)']))} as window_start, "
    "count(*) as signals from scoring_history group by date_trunc('minute', timestamp)",
)
def t7(spark, folder, t):
    root = working_folder(spark, "rates")
    facts = t("scoring_history").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    stream = in_batches(facts, "facts", micros("timestamp"))
    table = rates.window_table(spark, f"{root}/windows", keep_minutes=None, every=3)
    drain(rates.keep_updates(rates.rate_per_minute(stream), table, f"{root}/checkpoint"))
    return rates.current_windows(table, None).select("window_start", "signals")


@stream_query(
    "T9_observed_rows",
    "select 4 as queries_executed, count(*) as signals_sent, 0 as errors from scoring_history",
)
def t9(spark, folder, t):
    root = working_folder(spark, "observed")
    stream = in_batches(t("scoring_history").select("id", "timestamp"), "facts")
    sent = BatchTable(spark, f"{root}/rows")
    log = BatchTable(spark, f"{root}/log", every=3)
    drain(stats.logged(stream, sent.put, log, f"{root}/checkpoint", first=F.max("timestamp")))
    totals = monitoring.feed_stats(log.read(), AS_OF)
    return totals.select("queries_executed", "signals_sent", "errors")


DAY_MESSAGE = "date_diff('day', timestamp '2024-01-01', timestamp)"


@stream_query(
    "T10_buffer_replace",
    "select id, score_week, row_number() over (order by score_week desc nulls last, "
    "timestamp desc nulls first, id) - 1 as pos from (select *, row_number() over (order by "
    "score_week desc nulls last, timestamp desc nulls first, id) as rn, count(*) over () as n "
    f"from scoring_history where {DAY_MESSAGE} = (select max({DAY_MESSAGE}) from scoring_history)) "
    "where rn > n - 100",
)
def t10(spark, folder, t):
    """A message a day, several of them in a micro-batch; the buffer holds the end of the newest."""
    feed = t("scoring_history").select(
        "id",
        "score_week",
        "timestamp",
        F.datediff(F.to_date("timestamp"), F.lit("2024-01-01")).alias("message"),
    )
    stream = in_batches(feed, "messages", F.col("message"))
    root = working_folder(spark, "buffer")
    table = sinks.SnapshotTable(spark, f"{root}/snapshot")
    drain(
        refresh.buffer_replace(
            stream, ranking.tail_buffer, table, f"{root}/checkpoint", message="message"
        )
    )
    return table.latest().select("id", "score_week", "pos")


#: Signals of one message of the queries below.
MESSAGE_SIGNALS = 500


@stream_query(
    "T11_pattern_rate",
    f"select cast(floor(scoring_history_id / {MESSAGE_SIGNALS}) as bigint) as message, pattern, "
    "count(*) as signals from (select scoring_history_id, unnest(list(distinct pattern_type)) as "
    "pattern from keyed group by scoring_history_id) group by all",
)
def t11(spark, folder, t):
    root = working_folder(spark, "patterns")
    signal = F.col("scoring_history_id")
    sent = t("sh_patterns").withColumn("message", F.floor(signal / MESSAGE_SIGNALS))
    table = BatchTable(spark, f"{root}/counts")

    def collect(batch):
        rows = joins.pattern_rows(batch, t("signal_patterns"))
        return aggregates.collect_patterns(rows, ["message", "scoring_history_id"])

    stream = in_batches(sent, "messages", signal)
    drain(rates.pattern_rate(stream, collect, table, f"{root}/checkpoint"))
    return rates.message_totals(table.read(), ["message", "pattern"])


@stream_query(
    "X1_on_batch",
    f"select cast(floor(id / {MESSAGE_SIGNALS}) as bigint) as message, count(*) as signals, "
    "max(score_week) as best from scoring_history group by 1",
)
def x1(spark, folder, t):
    root = working_folder(spark, "hook")
    table = BatchTable(spark, f"{root}/counts")

    def callback(batch, batch_id):
        counted = batch.groupBy("message").agg(
            F.count(F.lit(1)).alias("signals"), F.max("score_week").alias("best")
        )
        table.put(counted, batch_id)

    signals = t("scoring_history").select(
        "id", "score_week", F.floor(F.col("id") / MESSAGE_SIGNALS).alias("message")
    )
    drain(rates.on_batch(in_batches(signals, "messages"), callback, f"{root}/checkpoint"))
    return table.read().groupBy("message").agg(
        F.sum("signals").alias("signals"), F.max("best").alias("best")
    )

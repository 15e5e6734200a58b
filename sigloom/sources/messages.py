"""JSON feed messages and events: building and parsing them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.functions import iso_text
from sigloom.operators import positions
from sigloom.schemas import CHANGE_EVENT, FEED_MESSAGE
from sigloom.session import working_folder

# JSON keys are written even when the value is NULL.
JSON_OPTIONS = {"ignoreNullFields": "false"}
_CORRUPT = "_corrupt"

#: Bound on the text of a message, and what all of it but the records takes at most.
MAX_MESSAGE_BYTES = 1 << 20
MESSAGE_OVERHEAD = 256


def json_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in columns or df.columns]), JSON_OPTIONS)


def envelope(
    df: DataFrame, as_of: datetime, max_bytes: int = MAX_MESSAGE_BYTES, folder: str | None = None
) -> DataFrame:
    """A snapshot as ``signals`` messages of bounded size, in the frame's own order.

    Each row is one message: ``value`` holds its JSON text with ``type``, ``timestamp``, ``count``,
    ``part``, ``parts`` and the array ``data``; ``count`` is the length of its own ``data``.  A snapshot
    that fits is one message, an empty one is a message without data.  Parts are cut by the running
    size of the records, so no task gathers more than a message; a record of more than half the bound
    is a message of its own.  ``folder`` takes the records on their way (default: a fresh one below
    ``spark.checkpoint.dir``).
    """
    spark = df.sparkSession
    root = folder or working_folder(spark, "messages")
    room = max_bytes - MESSAGE_OVERHEAD
    text = json_text(df).alias("text")
    sized = df.select(text).withColumn("size", F.octet_length("text").cast("bigint") + 1)
    alone = (F.col("size") > room / 2).cast("bigint")
    stored = positions.written_in_order(sized.withColumn("alone", alone), f"{root}/records")
    parts = positions.part_totals(
        stored,
        F.sum("size").alias("bytes"),
        F.sum("alone").alias("alone"),
        F.max(F.when(F.col("alone") == 0, F.col("size"))).alias("largest"),
    )
    # Records that begin in one stretch of this width fit into a message together.
    largest = max((p["largest"] or 0 for p in parts), default=0)
    width = max(1, room - largest + 1)
    begun = positions.running_before(stored, "size", positions.starts(parts, "bytes"), "_begins")
    begun = positions.running_before(begun, "alone", positions.starts(parts, "alone"), "_before")
    cut = positions.positioned(begun, positions.starts(parts)).select(
        F.floor(F.col("_begins") / width).cast("bigint").alias("stretch"),
        # A record of its own ends the message before it and begins another behind it.
        (2 * F.col("_before") + F.col("alone")).alias("apart"),
        F.struct("pos", "text").alias("record"),
    )
    gathered = (
        cut.groupBy("stretch", "apart")
        .agg(F.array_sort(F.collect_list("record")).alias("records"))
        .orderBy("stretch", "apart")
        .select(
            F.size("records").alias("count"),
            F.array_join(F.col("records.text"), ",").alias("data"),
        )
    )
    written = positions.written_in_order(gathered, f"{root}/parts")
    numbers = positions.part_totals(written)
    total = sum(p["rows"] for p in numbers)
    if not total:
        nothing = spark.range(1).select(F.lit(0).alias("count"), F.lit("").alias("data"))
        messages = nothing.withColumn("part", F.lit(0).cast("bigint"))
        total = 1
    else:
        messages = positions.positioned(written, positions.starts(numbers), "part")
    stamp = iso_text(F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz"))
    value = F.format_string(
        '{"type":"signals","timestamp":"%s","count":%d,"part":%d,"parts":%d,"data":[%s]}',
        stamp,
        "count",
        "part",
        F.lit(total).cast("bigint"),
        "data",
    )
    return messages.select(
        "part", F.lit(total).cast("bigint").alias("parts"), "count", value.alias("value")
    )


def _parsed(messages: DataFrame, value: str, schema: T.StructType) -> DataFrame:
    with_corrupt = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    return messages.withColumn("message", F.from_json(F.col(value), with_corrupt, options))


def parse_feed(
    messages: DataFrame, value: str = "value", schema: T.StructType = FEED_MESSAGE
) -> DataFrame:
    """The signals in ``signals`` messages, one row each.

    ``pos`` is the place in a message, and ``part`` the message's number where the snapshot was sent in
    several (0 otherwise): their order is the snapshot's.

    Malformed texts and messages of another type yield nothing here; see ``malformed_messages``
    and ``messages_of_type``.
    """
    good = _parsed(messages, value, schema).filter(
        F.col(f"message.{_CORRUPT}").isNull() & (F.col("message.type") == "signals")
    )
    part = F.coalesce("message.part", F.lit(0)) if "part" in schema.names else F.lit(0)
    return good.select(
        part.cast("bigint").alias("part"), F.posexplode("message.data").alias("pos", "signal")
    ).select("signal.*", "part", "pos")


def complete_snapshot(
    messages: DataFrame, value: str = "value", schema: T.StructType = FEED_MESSAGE
) -> DataFrame:
    """The signals of the newest snapshot of which all messages are there, with ``part`` and ``pos``.

    Messages of one ``timestamp`` are one snapshot; one without ``parts`` is a snapshot of its own.  Parts may come
    in any order, mixed with those of other snapshots, and more than once.  While a snapshot still lacks a
    part, the one before it is the newest; nothing comes out before the first is complete.
    """
    good = _parsed(messages, value, schema).filter(
        F.col(f"message.{_CORRUPT}").isNull() & (F.col("message.type") == "signals")
    )
    numbered = good.select(
        F.col("message.timestamp").alias("_sent"),
        F.coalesce("message.part", F.lit(0)).cast("bigint").alias("part"),
        F.coalesce("message.parts", F.lit(1)).cast("bigint").alias("_parts"),
        F.col("message.data").alias("_data"),
    )
    newest = (
        numbered.groupBy("_sent", "_parts")
        .agg(F.count_distinct("part").alias("_there"))
        .where(F.col("_there") == F.col("_parts"))
        .agg(F.max("_sent"))
        .scalar()
    )
    whole = numbered.where(F.col("_sent") == newest).dropDuplicates(["part"])
    rows = whole.select("part", F.posexplode("_data").alias("pos", "signal"))
    return rows.select("signal.*", "part", "pos")


def messages_of_type(messages: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """Well-formed messages of one type (``pong``, ``stats``, ``error``), as read."""
    rows = _parsed(messages, value, FEED_MESSAGE)
    good = F.col(f"message.{_CORRUPT}").isNull() & (F.col("message.type") == kind)
    return rows.filter(good).select(value, "message.message")


def malformed_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Texts that are not valid JSON."""
    bad = _parsed(messages, value, FEED_MESSAGE).filter(
        F.col(value).isNull() | F.col(f"message.{_CORRUPT}").isNotNull()
    )
    return bad.select(F.col(value).alias("text"))


def parse_events(messages: DataFrame, value: str = "value") -> DataFrame:
    """Change events from their JSON text.

    A malformed payload still announces a change, so its row stays, with NULL fields and
    ``malformed`` set.
    """
    rows = _parsed(messages, value, CHANGE_EVENT)
    bad = F.col("message").isNull() | F.col(f"message.{_CORRUPT}").isNotNull()
    return rows.select(
        *[F.when(~bad, F.col(f"message.{c}")).alias(c) for c in CHANGE_EVENT.names],
        bad.alias("malformed"),
    )

"""Streams of inserted and updated fact rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.schemas import CHANGE_ROW, SCORING_HISTORY


def change_source(
    spark: SparkSession,
    path: str,
    *,
    source_format: str = "json",
    schema: T.StructType = CHANGE_ROW,
    max_files: int | None = 1000,
    **options: str,
) -> DataFrame:
    """Change rows ``(op, old, new, commit_ts)`` from a folder of files that keeps growing."""
    reader = spark.readStream.format(source_format).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


def kafka_change_source(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """The same rows from a Kafka topic of JSON values (needs the Kafka connector on the classpath)."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
    )
    for key, value in options.items():
        reader = reader.option(key, value)
    rows = F.from_json(F.col("value").cast("string"), CHANGE_ROW).alias("row")
    return reader.load().select(rows).select("row.*")


def change_rows(
    facts: DataFrame, op: str, old_columns: dict[str, Column] | None = None
) -> DataFrame:
    """Shape plain fact rows as change rows.

    ``old_columns`` gives, for an update, the columns whose previous value differs from the
    new one.  Inserts have a NULL old image.
    """
    earlier = old_columns or {}

    def image(columns: dict[str, Column]) -> Column:
        fields = SCORING_HISTORY.fields
        return F.struct(
            *[columns.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in fields]
        )

    old = F.lit(None).cast(SCORING_HISTORY) if op == "INSERT" else image(earlier)
    return facts.select(
        F.lit(op).alias("op"),
        old.alias("old"),
        image({}).alias("new"),
        F.col("timestamp").cast("timestamp").alias("commit_ts"),
    )

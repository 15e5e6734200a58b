"""Output of micro-batches that stays small: compaction and retention."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.sources.sinks import read_if_present

BATCH = "batch_id"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class BatchTable:
    """Rows of every micro-batch, written once however often the batch is repeated.

    A batch has its own folder, which a repetition overwrites.  After every ``every`` batches the folders
    are merged into one base, together with the base before; ``merge`` says what is kept, rows
    keep the number of their batch.  Folders that the base before already held are removed, so a reader
    that has just listed the folders still finds them, and there are at most ``2 * every`` of them
    and two bases.  ``layout`` names columns the base is laid out by, such as a window's day or a
    bucket of the key.  One writer at a time.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        merge: Callable[[DataFrame], DataFrame] | None = None,
        every: int = 50,
        layout: Sequence[str] = (),
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.merge = merge or (lambda rows: rows)
        self.every = every
        self.layout = list(layout)

    def _bases(self) -> dict[int, T.StructType]:
        """Last batches of the complete bases and their columns, newest first."""
        heads = read_if_present(self.spark, f"{self.root}/heads/*", "upto bigint, columns string")
        found = [] if heads is None else sorted(heads.collect(), reverse=True)
        return {r["upto"]: T.StructType.fromJson(json.loads(r["columns"])) for r in found}

    def put(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/open/{BATCH}={batch_id}")
        if batch_id % self.every == self.every - 1:
            self.compact(batch_id)

    def written(self, batch_id: int) -> DataFrame:
        """The rows just put for a batch."""
        return self.spark.read.parquet(f"{self.root}/open/{BATCH}={batch_id}")

    def compact(self, upto: int) -> None:
        """Merge everything up to a batch into a new base."""
        bases = list(self._bases())
        if bases and bases[0] >= upto:
            return
        merged = self.merge(self.read().where(F.col(BATCH) <= upto))
        if self.layout:
            merged = merged.repartition(*self.layout)
        writer = merged.write.mode("overwrite")
        if self.layout:
            writer = writer.partitionBy(*self.layout)
        writer.parquet(f"{self.root}/base/upto={upto}")
        # A base without rows has no file that could tell its columns.
        head = self.spark.range(1).select(
            F.lit(upto).cast("bigint").alias("upto"), F.lit(merged.schema.json()).alias("columns")
        )
        head.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/heads/upto={upto}")
        for old in bases[1:]:
            remove(self.spark, f"{self.root}/heads/upto={old}")
            remove(self.spark, f"{self.root}/base/upto={old}")
        if bases:
            first = bases[1] + 1 if len(bases) > 1 else 0
            for batch in range(first, bases[0] + 1):
                remove(self.spark, f"{self.root}/open/{BATCH}={batch}")

    def read(self) -> DataFrame:
        """The rows of all batches as far as they are kept, with ``batch_id``."""
        bases = self._bases()
        upto = max(bases, default=-1)
        frames = []
        if bases:
            base = self.spark.read.schema(bases[upto]).parquet(f"{self.root}/base/upto={upto}")
            frames.append(base)
        opened = self._opened()
        if opened is not None:
            frames.append(opened.where(F.col(BATCH) > upto))
        if not frames:
            raise LookupError(f"no batch under {self.root}")
        rows = frames[0]
        for frame in frames[1:]:
            rows = rows.unionByName(frame)
        return rows.withColumn(BATCH, F.col(BATCH).cast("bigint"))

    def _opened(self) -> DataFrame | None:
        path = f"{self.root}/open"
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(target):
            return None
        return self.spark.read.option("basePath", path).parquet(f"{path}/{BATCH}=*")

    def empty(self) -> bool:
        return not self._bases() and self._opened() is None

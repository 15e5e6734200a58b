"""Session defaults and the shared working folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the plans rely on.  AQE starts from ``spark.sql.shuffle.partitions`` and merges what is small to
# ``advisoryPartitionSizeInBytes``; it never makes more of them.  On a cluster set that number to the
# largest shuffle by the advisory size (Spark's own 200 are meant for some 25 GB).  Joins carry no size-blind broadcast hints; a side is broadcast only when
# its estimated or measured size is under the threshold, and sort-merge joins split skewed keys.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Call sites of column expressions are for interactive use; noting them slows plan building.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "sigloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="sigloom-")


def working_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for checkpoints and snapshots below ``spark.checkpoint.dir``.

    On a cluster the setting must name a shared folder.  Only a local session without the setting
    gets a temporary folder, since there driver and executors share one disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = _local_root()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"

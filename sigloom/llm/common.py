"""Helpers shared by the text operators."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.session import working_folder

#: ASCII white space; a word is a longest run of other characters.
WHITE = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder; also tells Python workers where this package is, for local runs."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written as a table below ``spark.checkpoint.dir`` and read back.

    Cuts the lineage, so that what follows may use the rows several times and an executor lost
    later costs no recomputation.
    """
    spark = df.sparkSession
    path = working_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_batch(
    df: DataFrame, schema: str, columns: Callable[..., dict[str, list]], *args
) -> DataFrame:
    """``mapInArrow`` with a function from a batch (and ``args``) to the columns of its result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield record_batch(columns(batch, *args), arrow)

    arrow = arrow_schema(df.sparkSession, schema)
    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def record_batch(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [
        x if isinstance(x := columns[field.name], pa.Array) else pa.array(x, field.type)
        for field in schema
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def under_hash_bound(rows: DataFrame, place: Column, wanted: int, kept: int | None = None) -> DataFrame:
    """Rows among which are the ``wanted`` ones with the smallest ``place`` (a hash, long).

    Counted first, all but about three times that many are left out where they are, so that what
    follows may sort them.  Rows beyond the bound are taken only where too few are under it.
    """
    n = rows.count()
    if n <= 4 * wanted:
        return rows
    bound = int((3 * wanted / n) * (1 << 64)) - (1 << 63)
    under = rows.where(place < F.lit(bound))
    return under if under.limit(kept or wanted).count() >= (kept or wanted) else rows


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def crc32_of_id(column: str = "doc_id") -> Column:
    """CRC-32 of the id as text, as a long."""
    return F.crc32(F.col(column).cast("string").cast("binary"))

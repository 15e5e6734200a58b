"""Bloom filters of limited size, built on Spark, tested in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import shuffle_partitions

#: Bits for each key, and at most; a fuller filter only lets more through.
BITS_PER_KEY = 16
MAX_BITS = 1 << 28
#: Bits of a stretch of the filter, which a task packs and the driver receives as one value.
STRETCH_BITS = 1 << 19


def _packed(batches: Iterator[pa.RecordBatch], stretch: int) -> Iterator[pa.RecordBatch]:
    """(number of the stretch, its bits) from positions in the filter, all those of a stretch in one task."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        bit = batch.column("bit").to_numpy()
        number = bit // stretch
        for k in np.unique(number).tolist():
            if k not in found:
                found[k] = np.zeros(stretch, bool)
            found[k][bit[number == k] - k * stretch] = True
    for k, flags in found.items():
        packed = np.packbits(flags, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([packed])], ["stretch", "packed"])


def bloom_filter(keys: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """A filter of a column of hashes (long): its number of bits, and its 64-bit words.

    The driver receives at most ``MAX_BITS`` bits, whatever the number of keys, as bytes that tasks packed:
    a row for each word would take a hundred times their size there.
    """
    bits, n = 1 << 12, keys.count()
    while bits < MAX_BITS and bits < BITS_PER_KEY * n:
        bits *= 2
    stretch = min(bits, STRETCH_BITS)
    a = F.col(column).bitwiseAND(F.lit(bits - 1))
    b = F.shiftright(column, 32).bitwiseAND(F.lit(bits - 1))
    at = keys.select(F.explode(F.array(a, b)).alias("bit"))
    number = F.shiftright("bit", stretch.bit_length() - 1)
    stretches = at.repartition(shuffle_partitions(keys.sparkSession), number).mapInArrow(
        lambda batches: _packed(batches, stretch), "stretch long, packed binary"
    )
    out = np.zeros(bits // 64, np.int64)
    for row in stretches.collect():
        first = row["stretch"] * (stretch // 64)
        out[first : first + stretch // 64] = np.frombuffer(row["packed"], np.int64)
    return bits, out


def holds(bloom: tuple[int, np.ndarray], values: np.ndarray) -> np.ndarray:
    bits, words = bloom
    out = np.ones(len(values), bool)
    for bit in (values & (bits - 1), (values >> 32) & (bits - 1)):
        out &= (words[bit >> 6] >> (bit & 63)) & 1 == 1
    return out

"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text; a chunk ends where it meets a mask.  Chunking is
normalised: up to the normal size a stricter mask is asked for and beyond it a looser one, which
keeps sizes close to the normal one, between fixed limits.  Boundaries depend on the bytes near
them only, so they move along with text that is inserted before them.  A fingerprint is the set of
chunk digests with their lengths, in the order of the digests; likeness is containment: the share
of the first text's chunk bytes whose chunks occur in the second.

Null text is empty, with an empty fingerprint: fully contained in anything, and nothing but empty
texts is contained in it.  Equal texts have equal fingerprints.

Texts of any length are read whole.  An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import arrow_schema, by_batch, record_batch, shuffle_partitions, texts

LEAST, NORMAL, MOST = 24, 64, 256
STRICT, LOOSE = 0xFF000000, 0xF0000000
SEED = 20
#: Most neighbour buckets, whose bounds every task holds.
MAX_BUCKETS = 65_536
BUCKET_CHARS = 8_000_000
_BLOCK = 1 << 22
_ENTRY = np.dtype([("digest", ">u8"), ("length", ">u2")])

GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), SEED) for b in range(256)], np.uint32)


def _gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte, over the 32 bytes up to it: h = 2 h + GEAR[byte]."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] += h[:-shift] << np.uint32(shift)
    return h


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n, every = len(data), np.frombuffer(data, np.uint8)
    strict, loose = [], []
    for at in range(0, n, _BLOCK):
        before = min(at, 31)
        h = _gear(every[at - before : at + _BLOCK])[before:]
        some = np.flatnonzero(h & np.uint32(LOOSE) == 0)
        loose += (some + at + 1).tolist()
        strict += (some[h[some] & np.uint32(STRICT) == 0] + at + 1).tolist()
    ends, start = [], 0
    s = w = 0
    while start < n:
        end = min(start + MOST, n)
        s = bisect_left(strict, start + LEAST, s)
        if s < len(strict) and strict[s] < start + NORMAL:
            end = strict[s]
        else:
            w = bisect_left(loose, start + NORMAL, w)
            if w < len(loose):
                end = min(end, loose[w])
        ends.append(end)
        start = end
    return ends


def chunks(text: str) -> np.ndarray:
    """Distinct chunks as (digest, length), in the order of the digests."""
    data, start, out = text.encode(), 0, {}
    digest = xxhash.xxh3_64_intdigest
    for end in boundaries(data):
        out[digest(data[start:end])] = end - start
        start = end
    found = np.empty(len(out), _ENTRY)
    found["digest"] = list(out)
    found["length"] = list(out.values())
    return np.sort(found)


def written(found: np.ndarray) -> str:
    return base64.b64encode(found.tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), _ENTRY)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a):
        return 1.0
    inside = np.isin(a["digest"].astype("u8"), b["digest"].astype("u8"))
    return float(a["length"][inside].sum() / a["length"].sum())


def _fingerprints(batch) -> dict[str, list]:
    return {
        "doc_id": batch.column("doc_id"),
        "fingerprint": [written(chunks(t)) for t in texts(batch)],
    }


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every text."""
    return by_batch(
        docs.select("doc_id", "text"), "doc_id long, fingerprint string", _fingerprints
    )


def with_next(docs: DataFrame) -> DataFrame:
    """Rows placed so that each partition reads, bucket by bucket, ids in descending order.

    A bucket is a range of ids and closes with a copy of the row that follows its last one (after
    the smallest id, the largest).  So each text is shuffled once, one more per bucket.  Null ids
    come after all others; rows of one id are ordered by a hash of their text.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("doc_id", F.lit(-(2**63))).alias("key"),
    )
    size = rows.agg(F.sum(F.length("text")).alias("chars")).first()["chars"] or 0
    partitions = shuffle_partitions(spark)
    buckets = min(MAX_BUCKETS, max(4 * partitions, size // BUCKET_CHARS))
    cuts = rows.agg(
        F.percentile_approx("key", [k / buckets for k in range(1, buckets)], 4 * buckets)
    ).first()[0]
    bounds = spark.sparkContext.broadcast(np.unique(np.array(cuts or [], np.int64)))

    @F.pandas_udf("long")
    def bucket_of(keys):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds.value, keys.to_numpy(), "right"))

    tops = (
        rows.select("key", bucket_of("key").alias("bucket"))
        .groupBy("bucket")
        .agg(F.max("key").alias("top"))
        .orderBy("bucket")
        .collect()  # one row per bucket
    )
    # The row after a bucket's last is the first of the next lower bucket, or of all.
    goes: dict[int, list[int]] = {}
    for k, row in enumerate(tops):
        follower = tops[k - 1]["top"] if k else tops[-1]["top"]
        goes.setdefault(follower, []).append(row["bucket"])
    shared = spark.sparkContext.broadcast(goes)

    @F.pandas_udf("array<long>")
    def copies_of(keys):
        import pandas as pd

        return pd.Series([shared.value.get(k, []) for k in keys.tolist()])

    placed = rows.withColumn("bucket", bucket_of("key")).withColumn("copies", copies_of("key"))
    both = placed.withColumn(
        "at",
        F.explode(
            F.concat(
                F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("copy"))),
                F.transform(
                    "copies", lambda b: F.struct(b.alias("bucket"), F.lit(True).alias("copy"))
                ),
            )
        ),
    ).select("doc_id", "text", "key", "at.bucket", "at.copy")
    return both.repartition(partitions, "bucket").sortWithinPartitions(
        "bucket", "copy", F.desc("key"), F.xxhash64("text")
    )


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and likeness to it and to the next."""
    arrow = arrow_schema(docs.sparkSession, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, bucket = None, None
        for batch in batches:
            out = {name: [] for name in arrow.names}
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "copy")]
            for doc_id, text, own_bucket, copy in zip(*columns):
                if own_bucket != bucket:
                    waiting, bucket = None, own_bucket
                if copy and waiting is None:
                    continue  # more rows of the id that followed
                current = doc_id, text, chunks(text)
                if waiting is not None:
                    _, before, found = waiting
                    changed = edited(before, text)
                    changed_found = chunks(changed)
                    out["doc_id"].append(waiting[0])
                    out["n_chars"].append(len(before))
                    out["edited_sha256"].append(hashlib.sha256(changed.encode()).hexdigest())
                    out["fingerprint"].append(written(found))
                    out["edited_fingerprint"].append(written(changed_found))
                    out["near_edited"].append(containment(found, changed_found))
                    out["near_next"].append(containment(found, current[2]))
                waiting = None if copy else current
            yield record_batch(out, arrow)

    return with_next(docs).mapInArrow(run, SCHEMA)

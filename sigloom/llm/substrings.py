"""Removal of repeated passages, by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words.  Its minimiser is the run of ``MINIMISER`` words in it
with the smallest hash, and consecutive windows with one minimiser travel together as one packed
string (words joined by single spaces) to the partition of that minimiser.  Equal windows have
equal minimisers, so they meet; there, sorted by document and position, every window but the
first of its words is a repetition, compared by its full text.

What need not travel stays:

* Windows repeated within a block of documents of one task are found there, so of a passage that very
  many documents share one window a block is sent.
* A first pass counts minimisers.  Those that occur once cannot have a partner; a Bloom filter of
  limited size holds the others.  When it is too full it only lets more through.
* A second filter holds minimisers of over ``HOT`` runs.  Their windows travel one by one under a
  hash of the whole window, so a group has only equal windows in it.

Null text has no words.  A null id counts as smaller than all others.  Repeated rows (equal id and
text) keep their words, as none of them starts earlier than the other.  Texts of any length are
read whole.

Rows of one id and different texts count as one document: a window that both have at the same place
stays in both.  An empty table gives no row.  ``kept_words`` ignores other columns, ``stripped`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.blooms import bloom_filter, holds
from sigloom.llm.common import (
    WORD,
    arrow_schema,
    by_batch,
    record_batch,
    saved,
    shuffle_partitions,
    texts,
)
from sigloom.llm.windows import Words, leftmost_minimum

WINDOW = 20
MINIMISER = 8
HOT = 5_000
BLOCK_BYTES = 6_000_000
_RUNS = "key long, version long, start long, windows int, at long, packed binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list[bytes]]]:
    """Rows in blocks of about ``BLOCK_BYTES``, each in the order of ids."""
    rows, size = [], 0
    for batch in batches:
        keys, versions = batch.column("key").to_pylist(), batch.column("version").to_pylist()
        for key, version, text in zip(keys, versions, texts(batch)):
            rows.append((key, version, text.encode()))
            size += len(rows[-1][2])
            if size >= BLOCK_BYTES:
                yield tuple(zip(*sorted(rows)))
                rows, size = [], 0
    if rows:
        yield tuple(zip(*sorted(rows)))


class Block:
    """Windows of a block: which are there, their minimisers, and runs of them."""

    def __init__(self, found: list[bytes]):
        self.words = Words(found)
        self.valid = self.words.inside(WINDOW)
        mers = self.words.window_hashes(MINIMISER)
        self.best = leftmost_minimum(mers, WINDOW - MINIMISER + 1)
        self.minimiser = mers[self.best].view(np.int64)

    def runs(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each stretch of chosen windows that are
        consecutive, in one text, and share a minimiser."""
        at = np.flatnonzero(chosen)
        if not len(at):
            return at, at
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (self.best[at[1:]] != self.best[at[:-1]])
        first = np.flatnonzero(new)
        return at[first], np.diff(np.append(first, len(at)))

    def repeated_here(self, keys: list) -> np.ndarray:
        """Windows that also start earlier in this block."""
        out = np.zeros(len(self.valid), bool)
        at = np.flatnonzero(self.valid)
        if len(at) < 2:
            return out
        hashes = self.words.window_hashes(WINDOW)[at]
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        group = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        head = order[np.searchsorted(group, group)]
        later, first = at[order], at[head]
        pair = later != first
        later, first = later[pair], first[pair]
        same = np.ones(len(later), bool)
        for k in range(WINDOW):
            same &= self.words.hashes[later + k] == self.words.hashes[first + k]
        key = np.array(keys, np.int64)
        text = self.words.text
        # Rows of one id: a window at the same place of an equal row is no earlier one.
        place = np.arange(len(text)) - self.words.first[text]
        same &= (key[text[later]] != key[text[first]]) | (place[later] > place[first])
        out[later[same]] = True
        return out


def _minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, found in _blocks(batches):
        block = Block(found)
        first, _ = block.runs(block.valid)
        values, counts = np.unique(block.minimiser[first], return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(values), pa.array(counts.astype(np.int64))], ["minimiser", "runs"]
        )


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(key, version, start, windows): stretches of windows whose words also start earlier.

    ``docs`` has key (id, never null), version (a hash of the text) and text.
    """
    spark = docs.sparkSession
    counted = saved(
        docs.mapInArrow(_minimisers, "minimiser long, runs long")
        .groupBy("minimiser")
        .agg(F.sum("runs").alias("runs"))
        .where(F.col("runs") > 1),
        "minimisers",
    )
    repeated = spark.sparkContext.broadcast(bloom_filter(counted, "minimiser"))
    hot = spark.sparkContext.broadcast(bloom_filter(counted.where(F.col("runs") > HOT), "minimiser"))
    arrow = arrow_schema(spark, _RUNS)

    def sent_of(keys: list, versions: list, found: list[bytes]) -> pa.RecordBatch:
        block = Block(found)
        words, data = block.words, block.words.data
        here = block.repeated_here(keys)
        out = {c: [] for c in arrow.names}

        def put(first, count, at, packed):
            text = int(words.text[first])
            out["key"].append(keys[text])
            out["version"].append(versions[text])
            out["start"].append(int(first - words.first[text]))
            out["windows"].append(int(count))
            out["at"].append(at)
            out["packed"].append(packed)

        flagged, length = block.runs(here)
        for first, count in zip(flagged.tolist(), length.tolist()):
            put(first, count, keys[int(words.text[first])], None)
        travels = block.valid & ~here
        travels[travels] = holds(repeated.value, block.minimiser[travels])
        single = travels.copy()
        single[travels] = holds(hot.value, block.minimiser[travels])
        first, count = block.runs(travels & ~single)
        at, n = np.flatnonzero(single), np.ones(int(single.sum()), np.int64)
        to = np.concatenate(
            [block.minimiser[first], words.window_hashes(WINDOW)[at].view(np.int64)]
        )
        first, count = np.concatenate([first, at]), np.concatenate([count, n])
        begins = words.starts[first].tolist()
        ends = words.ends[first + count + WINDOW - 2].tolist()
        for f, c, t, b, e in zip(first.tolist(), count.tolist(), to.tolist(), begins, ends):
            put(f, c, t, b" ".join(data[b:e].split()))
        return record_batch(out, arrow)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One block at a time: what a call holds is free again before the next block is read.
        for block in _blocks(batches):
            yield sent_of(*block)

    sent = docs.mapInArrow(send, _RUNS)
    return (
        sent.repartition(shuffle_partitions(spark), "at")
        .sortWithinPartitions("at", "key", "start")
        .mapInArrow(_repetitions, "key long, version long, start long, windows int")
    )


def _repetitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in the order of minimiser, document and position; keeps the windows of one minimiser."""
    group, seen = None, {}
    for batch in batches:
        out: tuple[list, list, list, list] = [], [], [], []
        columns = [c.to_pylist() for c in batch.columns]
        for key, version, start, windows, at, packed in zip(*columns):
            if packed is None:
                _put(out, key, version, start, windows)
                continue
            if at != group:
                group, seen = at, {}
            words = packed.split(b" ")
            ends = np.cumsum([len(w) + 1 for w in words]).tolist()
            begin = 0
            for k in range(windows):
                window = packed[begin : ends[k + WINDOW - 1] - 1]
                begin = ends[k]
                place = key, start + k
                if seen.setdefault(window, place) != place:
                    _put(out, key, version, start + k, 1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(out[0], pa.int64()),
                pa.array(out[1], pa.int64()),
                pa.array(out[2], pa.int64()),
                pa.array(out[3], pa.int32()),
            ],
            ["key", "version", "start", "windows"],
        )


def _put(out, key: int, version: int, start: int, windows: int) -> None:
    """Adds a stretch, to the last one if it goes on from there."""
    if out[0] and out[0][-1] == key and out[1][-1] == version and out[2][-1] + out[3][-1] == start:
        out[3][-1] += windows
        return
    for column, value in zip(out, (key, version, start, windows)):
        column.append(value)


def with_repetitions(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, with ``repetitions``: an array of (start, windows)."""
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    keyed = docs.select(
        key.alias("key"), F.xxhash64("text").alias("version"), F.col("text").alias("text")
    )
    found = (
        repeated_windows(keyed)
        .groupBy("key", "version")
        .agg(F.collect_set(F.struct("start", "windows")).alias("repetitions"))
    )
    own = docs.select(
        F.struct("*").alias("row"), key.alias("key"), F.xxhash64("text").alias("version")
    )
    return own.join(found, ["key", "version"], "left").select("row.*", "repetitions")


def removed_words(n: int, repetitions: list[dict] | None) -> np.ndarray:
    """Which of n words are covered by a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    for r in repetitions or ():
        edge[r["start"]] += 1
        edge[r["start"] + r["windows"] + WINDOW - 1] -= 1
    return np.cumsum(edge)[:n] > 0


def _kept(batch) -> dict[str, list]:
    out = {"doc_id": batch.column("doc_id"), "n_words": [], "n_removed": [], "kept_sha256": []}
    for text, repetitions in zip(texts(batch), batch.column("repetitions").to_pylist()):
        words = text.encode().split()
        gone = 0
        if repetitions:
            removed = removed_words(len(words), repetitions)
            gone = int(removed.sum())
            kept = [w for w, r in zip(words, removed.tolist()) if not r]
        else:
            kept = words
        out["n_words"].append(len(words))
        out["n_removed"].append(gone)
        out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def kept_words(docs: DataFrame) -> DataFrame:
    """Per document its words, how many are covered by repeated windows, and a digest of the rest."""
    return by_batch(
        with_repetitions(docs.select("doc_id", "text")),
        "doc_id long, n_words long, n_removed long, kept_sha256 string",
        _kept,
    )


def without(text: str, repetitions: list[dict]) -> str:
    """The text without covered words; what stood between kept words stays, and a gap becomes a
    line end if it held one, or else a space."""
    spans = [m.span() for m in WORD.finditer(text)]
    removed = removed_words(len(spans), repetitions).tolist()
    out, last = [], None
    for k, (start, end) in enumerate(spans):
        if removed[k]:
            continue
        if last is not None:
            gap = text[spans[last][1] : start]
            out.append(gap if last == k - 1 else "\n" if "\n" in gap else " ")
        out.append(text[start:end])
        last = k
    return "".join(out)


def _stripped(batch) -> dict[str, list]:
    out = {c: batch.column(c) for c in batch.schema.names if c != "repetitions"}
    found = batch.column("text").to_pylist()
    marks = batch.column("repetitions").to_pylist()
    return out | {"text": [without(t, r) if r else t for t, r in zip(found, marks)]}


def stripped(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, without repeated passages; emptied ones have empty text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return by_batch(with_repetitions(docs), schema, _stripped)

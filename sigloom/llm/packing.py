"""Best-fit-decreasing packing of token sequences.

Lengths are whole numbers up to the capacity, so pieces of one length are interchangeable and the
order of best-fit decreasing is known from the number of pieces of each length alone.  The plan is
therefore made on that histogram: a segment tree over remaining capacities finds the tightest open
bins in logarithmic time, and all bins of equal history are filled in one step.  Histogram and plan
are bounded by the capacity, not by the corpus.  Pieces are then numbered within their length on
Spark and look their place up in the plan.  The result is the one of best-fit decreasing over
the whole corpus at once; nothing is packed in separate parts.

Null text is empty: one piece holding only the end id.  Repeated rows and null ids are packed as
rows of their own.  An empty table gives no rows.  Pieces of equal length are placed in the order
of a hash of their id, then by id and position.

Texts of any length are encoded whole.  Other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigloom.llm.common import WORD, by_batch, saved, texts
from sigloom.llm.tokens import Cache

CAPACITY = 2048
END_ID = 0
#: Rows of one numbering shard, about; shards keep equal lengths from meeting in one task.
SHARD_ROWS = 200_000


def default_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Token ids of a text, for a tokenizer that drops white space and never joins across it.

    A stretch of plain Latin letters, punctuation and ASCII white space is lower-cased and split as the
    vocabulary's own pattern does, into runs that are encoded once and kept.  Where a line holds anything
    else, it is read by units between white space, and a unit that is not plain goes through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {ord(c): level.pre_tokenize_str(c)[0][0] for c in _PROBES[-1]}
        # A byte-level vocabulary gives its model the bytes of a run of letters; other runs take the whole way.
        self.model = self.tokenizer.model
        self.direct = all(self._of_model(r) == self._ids(r) for r in _PROBES)
        self.runs = Cache(self._run)
        self.units = Cache(self._ids)

    def _ids(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _of_model(self, run: str) -> bytes:
        tokens = self.model.tokenize(run.translate(self.shown))
        return np.array([token.id for token in tokens], "<u4").tobytes()

    def _run(self, run: str) -> bytes:
        if self.direct and _LETTERS.fullmatch(run):
            return self._of_model(run)
        return self._ids(run)

    def encode(self, text: str) -> np.ndarray:
        runs = _split(text)
        parts = list(map(self.runs.get, runs))
        if None in parts:
            for i, part in enumerate(parts):
                if part is None:
                    run = runs[i]
                    parts[i] = self.runs[run] if _PLAIN.fullmatch(run) else self.units[run]
        return np.frombuffer(b"".join(parts), "<u4")


_CHARACTERS = r"A-Za-zÀ-ÖØ-öø-į.,;:!?*#$%&()|\-"
_PLAIN = re.compile(f"[{_CHARACTERS}]+")
_PLAIN_TEXT = re.compile(rf"[{_CHARACTERS} \t\n\x0b\f\r]*")
_LETTERS = re.compile(r"[a-zß-öø-į]+")
_RUNS = re.compile(r"[a-zß-öø-į]+|[^a-zß-öø-į \t\n\x0b\f\r]+")
#: Every letter of a run that is lower case, alone and in some company.
_LOWER = "".join(c for c in map(chr, range(0x61, 0x130)) if _LETTERS.fullmatch(c.lower()) and c.lower() == c)
_PROBES = [*_LOWER, "the", "thinking", "zyxwvutsrqponm", "ciónueueco", "lønnstillæg", _LOWER]


def _split(text: str) -> list[str]:
    """Runs of plain stretches and units that are not plain, in order."""
    # Letters below U+0130 lower-case one by one and are already composed.
    if _PLAIN_TEXT.fullmatch(text):
        return _RUNS.findall(text.lower())
    runs = []
    for line in text.split("\n"):
        if _PLAIN_TEXT.fullmatch(line):
            runs += _RUNS.findall(line.lower())
            continue
        for unit in WORD.findall(line):
            if _PLAIN.fullmatch(unit):
                runs += _RUNS.findall(unit.lower())
            else:
                runs.append(unit)
    return runs


@functools.lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _pieces(batch, path: str, capacity: int) -> dict[str, list]:
    own = tokenizer(path)
    out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
    end = np.array([END_ID], "<u4")
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
        ids = np.concatenate([own.encode(text), end])
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            out["doc_id"].append(doc_id)
            out["piece"].append(piece)
            out["start"].append(start)
            out["length"].append(len(part))
            out["ids_crc32"].append(zlib.crc32(part.tobytes()))
    return out


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: ids of its text and the end id, cut at the capacity."""
    return by_batch(
        docs.select("doc_id", "text"),
        "doc_id long, piece int, start long, length long, ids_crc32 long",
        _pieces,
        path or default_vocabulary(),
        capacity,
    )


class RemainingTree:
    """Which remaining capacities have open bins; a binary segment tree over 0..capacity."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, remaining: int, is_open: bool) -> None:
        at = self.leaves + remaining
        self.any[at] = is_open
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int:
        """The smallest remaining capacity of at least ``least`` with an open bin, or -1."""
        at = self.leaves + least
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return -1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Best-fit decreasing on a histogram of lengths.

    Rows (length, rank, first_bin, bins, each, offset): from ``rank`` on, pieces of ``length`` fill
    ``bins`` bins from ``first_bin``, ``each`` of them per bin, beginning at ``offset``.
    """
    tree = RemainingTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}
    rows, next_bin = [], 0

    def put(first: int, bins: int, remaining: int) -> None:
        if remaining:
            stretches = open_bins.setdefault(remaining, [])
            if not stretches:
                tree.set(remaining, True)
            stretches.append((first, bins))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining < 0:
                remaining, first = capacity, next_bin
                bins = -(-left // (capacity // length))
                next_bin += bins
            else:
                first, bins = open_bins[remaining].pop()
                if not open_bins[remaining]:
                    tree.set(remaining, False)
            each = remaining // length
            full = min(bins, left // each)
            if full:
                rows.append((length, rank, first, full, each, capacity - remaining))
                put(first, full, remaining - each * length)
                rank, left = rank + full * each, left - full * each
            rest = bins - full
            if rest and left:
                # The last bin used takes fewer pieces than it could.
                rows.append((length, rank, first + full, 1, left, capacity - remaining))
                put(first + full, 1, remaining - left * length)
                full, rest, left = full + 1, rest - 1, 0
            if rest:
                put(first + full, rest, remaining)
    return rows


def _placed(batch, table) -> dict[str, list]:
    starts, rows = table.value
    length = batch.column("length").to_numpy()
    rank = batch.column("rank").to_numpy()
    found = np.searchsorted(starts, length * (1 << 48) + rank, "right") - 1
    _, base, first, _, each, offset = rows[found].T
    inside = rank - base
    out = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
    out["sequence_id"] = first + inside // each
    out["offset"] = offset + inside % each * length
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset``.  ``cut`` must be a stored table."""
    spark = cut.sparkSession
    sizes = cut.groupBy("length").count().collect()  # at most one row per length
    total = sum(r["count"] for r in sizes)
    rows = np.array(
        plan({r["length"]: r["count"] for r in sizes}, capacity) or [(0,) * 6], np.int64
    )
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    table = spark.sparkContext.broadcast((rows[:, 0] * (1 << 48) + rows[:, 1], rows))

    # Number pieces of a length: within a shard, after those of earlier shards.
    shards = total // SHARD_ROWS + 1
    sharded = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    before = (
        sharded.groupBy("length", "shard")
        .count()
        .withColumn(
            "before",
            F.sum("count").over(
                Window.partitionBy("length")
                .orderBy("shard")
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select("length", "shard", F.coalesce("before", F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("shard", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        sharded.withColumn("within", F.row_number().over(within) - 1)
        .join(before, ["shard", "length"])
        .withColumn("rank", F.col("before") + F.col("within"))
    )
    return by_batch(
        ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, "
        "offset long",
        _placed,
        table,
    )


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Documents cut into pieces and packed into as few sequences as best-fit decreasing needs."""
    return pack(saved(pieces(docs, path, capacity), "pieces"), capacity)

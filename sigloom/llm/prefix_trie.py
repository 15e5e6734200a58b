"""The trie of conversation prefixes, with sums over subtrees.

Conversations are ordered by a range sort.  A turn sequence has two rolling values modulo a prime,
which compose: the values of a conversation that goes over several tasks are finished from one row
per task, and those of a rebuilt conversation come from the values of its two parts.  A node
is a distinct pair of values.

Sums over subtrees come from node tables.  A node with at most ``SHARD_TURNS`` turns below it
is light; a whole light subtree goes to one shard.  There a minimal perfect hash gives every
node a slot, the counts are scattered into flat arrays, and each depth, from the deepest, is added to
its parents' slots.  The few heavy nodes above (at most the number of turns by ``SHARD_TURNS`` at any
depth) are summed on Spark, over ancestors twice as far in every round, so a single conversation of
any length is no chain of jobs.

Defined results: a null ``conv_id`` belongs to no conversation and is left out; turns of one number follow
each other by role and text; repeated rows are turns like others; an empty table has no node; other
columns are ignored, whatever their names; texts may be of any length.  ``%`` keeps the sign, so a
negative id's base lies towards zero.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import (
    arrow_schema,
    by_batch,
    crc32_of_id,
    record_batch,
    saved,
    shuffle_partitions,
)

#: Conversations of one block of ids start with the same turns.
BLOCK = 5
#: A conversation takes over fewer turns than this.
SHARED = 9

#: Turns below a node, member by member, up to which its subtree goes to one shard.
SHARD_TURNS = 100_000
#: Nodes a shard holds, about.
SHARD_NODES = 300_000
#: Ids joined to one text before they meet; two to this power.
IDS_BITS = 10

PRIME = (1 << 61) - 1
#: For each of the two values, its base and what it starts from.
BASES = (0x15A4E35F1C9B7D31, 0x0F3C6EF372FE94F9)
STARTS = (0x1B873593CC9E2D51, 0x027D4EB2F165667D)

_NODE = ("d1", "d2")


def _lanes(row: Column | str) -> list[Column]:
    """Two hashes of a turn's role and text."""
    return [F.xxhash64(F.lit(k), "role", "text").alias(f"t{k}") for k in (1, 2)]


# --- order and rolling values ---------------------------------------------------------------


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Place and values of every turn, counted from the start of its conversation or task.

    ``opening`` marks the conversation a task starts with, which may go on from the task before.  The
    task's last row follows once more with ``closing`` set.
    """
    conv, values, place, opening, last = None, STARTS, 0, True, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "part", "t1", "t2", "bytes")]
        out: dict[str, list] = {c: [] for c in _SCAN}
        for conv_id, part, t1, t2, size in zip(*columns):
            if conv_id != conv:
                opening, conv, values, place = conv is None, conv_id, STARTS, 0
            before = values
            values = (
                (before[0] * BASES[0] + t1) % PRIME,
                (before[1] * BASES[1] + t2) % PRIME,
            )
            place += 1
            last = (conv_id, part, place, *values, *before, size, t1, opening, False)
            for c, x in zip(_SCAN, last):
                out[c].append(x)
        yield out
    if last is not None:
        yield {c: [x] for c, x in zip(_SCAN, (*last[:-1], True))}


_SCAN = ("conv_id", "part", "place", "d1", "d2", "q1", "q2", "bytes", "t1", "opening", "closing")
_SCAN_SCHEMA = (
    "conv_id long, part int, place long, d1 long, d2 long, q1 long, q2 long, bytes long, t1 long, "
    "opening boolean, closing boolean"
)


def _moved(value: int, lane: int, steps: int, by: int) -> int:
    """A value whose sequence started ``by`` higher, ``steps`` turns ago."""
    return (value + by * pow(BASES[lane], steps, PRIME)) % PRIME


def _carried(closings: list) -> dict[int, tuple[int, int, int, int]]:
    """For each task the conversation going on from the task before: id, turns so far, values."""
    carried, going = {}, None
    for row in sorted(closings, key=lambda r: r["part"]):
        first = row["first_conv"]
        state = (row["conv_id"], row["place"], row["d1"], row["d2"])
        if going is not None and going[0] == first:
            carried[row["part"]] = going
            if row["opening"]:  # the whole task is part of that conversation
                turns = row["place"]
                values = [
                    _moved(row[f"d{k + 1}"], k, turns, going[2 + k] - STARTS[k]) for k in (0, 1)
                ]
                state = (row["conv_id"], going[1] + turns, *values)
        going = state
    return carried


def turns(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every turn with its place (from 1), the values after (``d``) and before it (``q``)."""
    spark = conversations.sparkSession
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    )
    order = ["conv_id", "turn", "role", "text"]
    ordered = (
        rows.repartitionByRange(partitions or shuffle_partitions(spark), *order)
        .sortWithinPartitions(*order)
        .select(
            "conv_id",
            F.spark_partition_id().alias("part"),
            *_lanes("text"),
            F.octet_length("text").cast("long").alias("bytes"),
        )
    )
    arrow = arrow_schema(spark, _SCAN_SCHEMA)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _scan(batches):
            yield record_batch(columns, arrow)

    scanned = saved(ordered.mapInArrow(scan, _SCAN_SCHEMA), "turns")
    # One row for every task of the sort.
    firsts = scanned.where("opening").groupBy("part").agg(F.max("conv_id").alias("first_conv"))
    closings = scanned.where("closing").join(firsts, "part").collect()
    carried = _carried(closings)
    body = scanned.where(~F.col("closing"))
    if not carried:
        return body.drop("part", "opening", "closing")
    going_on = F.lit(False)
    for part, going in carried.items():
        going_on |= (F.col("part") == part) & (F.col("conv_id") == going[0])
    plain = ["conv_id", "place", "d1", "d2", "q1", "q2", "bytes", "t1"]
    finished = by_batch(
        body.where(going_on).select("part", *plain),
        "conv_id long, place long, d1 long, d2 long, q1 long, q2 long, bytes long, t1 long",
        _finished,
        carried,
    )
    return body.where(~going_on).select(*plain).unionByName(finished)


def _finished(batch: pa.RecordBatch, carried: dict) -> dict[str, list]:
    out = {c: batch.column(c).to_pylist() for c in batch.schema.names}
    rows = zip(*(out[c] for c in ("part", "place", "d1", "d2", "q1", "q2")))
    for i, (part, place, *values) in enumerate(rows):
        _, before, *ends = carried[part]
        by = [ends[k] - STARTS[k] for k in (0, 1)]
        out["place"][i] = before + place
        for k in (0, 1):
            out[f"d{k + 1}"][i] = _moved(values[k], k, place, by[k])
            out[f"q{k + 1}"][i] = _moved(values[2 + k], k, place - 1, by[k])
    return out


# --- rebuilt conversations ------------------------------------------------------------------


def _at(heads: str, place: Column, lane: int) -> Column:
    """A value of a conversation after its first ``place`` turns."""
    return F.when(place == 0, F.lit(STARTS[lane])).otherwise(
        F.element_at(F.col(heads), F.greatest(place, F.lit(1)).cast("int"))[f"d{lane + 1}"]
    )


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of all rebuilt conversations as node rows, and the conversations with their lengths.

    Of a base only its first eight turns count, so each conversation hands at most 32 rows on.
    """
    fields = ("place", "d1", "d2", "q1", "q2", "bytes", "t1")
    head = F.when(F.col("place") < SHARED, F.struct(*fields))
    convs = saved(
        own.groupBy("conv_id").agg(
            F.max("place").alias("n"), F.array_sort(F.collect_list(head)).alias("heads")
        ),
        "conversations",
    )
    base = convs.select(
        F.col("conv_id").alias("base_id"),
        F.col("n").alias("base_n"),
        F.col("heads").alias("base_heads"),
    )
    rest = F.col("conv_id") % BLOCK
    h = F.when(rest == 0, F.lit(0)).otherwise(crc32_of_id("conv_id") % SHARED)
    planned = convs.withColumn("base_id", F.col("conv_id") - rest).withColumn("skip", h)
    shared = F.least("skip", F.coalesce("base_n", F.lit(0)))
    joined = planned.join(base, "base_id", "left").withColumn("shared", shared)
    tail = F.greatest(F.col("n") - F.col("skip"), F.lit(0))
    plans = joined.select(
        "conv_id",
        "skip",
        "shared",
        (F.col("shared") + tail).alias("length"),
        F.slice("base_heads", F.lit(1), F.col("shared").cast("int")).alias("taken"),
        *[
            F.when(
                F.col("n") > F.col("skip"),
                _at("base_heads", F.col("shared"), k) - _at("heads", F.col("skip"), k),
            ).alias(f"by{k + 1}")
            for k in (0, 1)
        ],
    )
    plans = saved(plans, "plans")
    columns = ["conv_id", "length", "depth", "d1", "d2", "q1", "q2", "bytes", "t1"]
    taken = (
        plans.select("conv_id", "length", F.explode("taken").alias("x"))
        .select("conv_id", "length", F.col("x.place").alias("depth"), "x.*")
        .select(*columns)
    )
    kept = own.join(plans.drop("taken"), "conv_id").where(F.col("place") > F.col("skip"))
    kept = kept.withColumn("steps", F.col("place") - F.col("skip")).withColumn(
        "depth", F.col("shared") + F.col("steps")
    )
    same = (F.col("by1") == 0) & (F.col("by2") == 0)
    moved = by_batch(
        kept.where(~same).select(*columns, "steps", "by1", "by2"),
        "conv_id long, length long, depth long, d1 long, d2 long, q1 long, q2 long, bytes long, "
        "t1 long",
        _rebased,
    )
    rows = taken.unionByName(kept.where(same).select(*columns)).unionByName(moved)
    return rows, plans.select("conv_id", "length")


def _rebased(batch: pa.RecordBatch) -> dict[str, list]:
    out = {c: batch.column(c).to_pylist() for c in batch.schema.names}
    for k, base in enumerate(BASES):
        d, q, by = (out[f"{c}{k + 1}"] for c in ("d", "q", "by"))
        for i, steps in enumerate(out["steps"]):
            change = by[i] * pow(base, steps - 1, PRIME)
            q[i] = (q[i] + change) % PRIME
            d[i] = (d[i] + change * base) % PRIME
    return out


# --- nodes ----------------------------------------------------------------------------------


def nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Distinct prefixes, the root included; ``turns`` counts the turns from there on, of all members.

    Two different prefixes with equal values would differ in depth, parent or last turn; that is
    looked at for every node, and such a pair ends the job.
    """
    told = F.struct("depth", "q1", "q2", "t1", "bytes")
    clash = F.raise_error(F.lit("two prefixes have equal values"))
    inner = (
        rows.groupBy(*_NODE)
        .agg(
            F.min("conv_id").alias("owner"),
            F.count(F.lit(1)).alias("n_convs"),
            F.sum(F.col("length") - F.col("depth") + 1).alias("turns"),
            F.min(told).alias("told"),
            F.max(told).alias("_other"),
        )
        .withColumn("told", F.when(F.col("told") == F.col("_other"), F.col("told")).otherwise(clash))
        .select(*_NODE, "told.q1", "told.q2", "told.depth", "told.bytes", "owner", "n_convs", "turns")
    )
    root = convs.agg(
        F.min("conv_id").alias("owner"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.col("length") + 1).alias("turns"),
    ).where(F.col("n_convs") > 0)
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    top = root.select(
        *[F.lit(x).alias(c) for x, c in zip(STARTS, _NODE)],
        none.alias("q1"), none.alias("q2"), zero.alias("depth"), zero.alias("bytes"),
        "owner", "n_convs", "turns",
    )
    return inner.unionByName(top)


def ends(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """``(d1, d2, ends_sha256)`` of the nodes at which conversations end.

    Ids are joined in spans of ``2 ** IDS_BITS`` before those of a node meet, and the digest of a
    node is taken span by span, so many copies of a conversation are few short rows.
    """
    finishing = rows.where(F.col("depth") == F.col("length")).select(*_NODE, "conv_id")
    turnless = convs.where(F.col("length") == 0).select(
        *[F.lit(x).alias(c) for x, c in zip(STARTS, _NODE)], "conv_id"
    )
    spans = (
        finishing.unionByName(turnless)
        .groupBy(*_NODE, F.shiftright("conv_id", IDS_BITS).alias("span"))
        .agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
        .repartition(shuffle_partitions(rows.sparkSession), *_NODE)
        .sortWithinPartitions(*_NODE, "span")
    )
    schema = "d1 long, d2 long, ends_sha256 string"
    arrow = arrow_schema(rows.sparkSession, schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            out: dict[str, list] = {"d1": [], "d2": [], "ends_sha256": []}
            for d1, d2, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids"))):
                if (d1, d2) == node:
                    digest.update(b",")
                else:
                    _put(out, node, digest)
                    node, digest = (d1, d2), hashlib.sha256()
                digest.update(ids.encode())
            yield record_batch(out, arrow)
        out = {"d1": [], "d2": [], "ends_sha256": []}
        _put(out, node, digest)
        yield record_batch(out, arrow)

    return spans.mapInArrow(digests, schema)


def _put(out: dict[str, list], node: tuple | None, digest) -> None:
    if node is not None:
        for c, x in zip(out, (*node, digest.hexdigest())):
            out[c].append(x)


# --- subtrees -------------------------------------------------------------------------------


class PerfectHash:
    """Distinct numbers from 0 for distinct pairs of values, without holes.

    Each round gives a bit of its own to every key that has one to itself; the others go on to the next
    round.  A key's number is the rank of its bit.  Numbers of other keys mean nothing, so the
    table keeps the keys by slot, and ``slots`` answers -1 where they differ.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.rounds: list[tuple[np.ndarray, np.ndarray, int]] = []
        left, given = np.arange(len(first)), 0
        while len(left):
            size = 2 * len(left) + 1
            bit = self._bits(first[left], second[left], len(self.rounds), size)
            alone = np.bincount(bit, minlength=size) == 1
            self.rounds.append((alone, np.cumsum(alone) - alone + given, size))
            given += int(alone.sum())
            left = left[~alone[bit]]
        self.first, self.second = np.empty_like(first), np.empty_like(second)
        slots = self._numbers(first, second)
        self.first[slots], self.second[slots] = first, second

    @staticmethod
    def _bits(first: np.ndarray, second: np.ndarray, number: int, size: int) -> np.ndarray:
        mixed = first.astype(np.uint64) ^ (second.astype(np.uint64) * np.uint64(2 * number + 3))
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        return (mixed % np.uint64(size)).astype(np.int64)

    def _numbers(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.full(len(first), -1)
        left = np.arange(len(first))
        for number, (alone, ranks, size) in enumerate(self.rounds):
            bit = self._bits(first[left], second[left], number, size)
            hit = alone[bit]
            out[left[hit]] = ranks[bit[hit]]
            left = left[~hit]
        return out

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = self._numbers(first, second)
        known = out >= 0
        known[known] = (self.first[out[known]] == first[known]) & (
            self.second[out[known]] == second[known]
        )
        return np.where(known, out, -1)


def subtree_sums(table: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Children, leaves, savings and the parent's owner of all nodes of a shard, by slot.

    A parent that is not in the shard has slot -1, and the node there no parent's owner (``found`` is false).
    """
    numbers = PerfectHash(table["d1"], table["d2"])
    slot = numbers.slots(table["d1"], table["d2"])
    flat = {c: np.empty_like(x) for c, x in table.items()}
    for c, x in table.items():
        flat[c][slot] = x
    parent = numbers.slots(flat["q1"], flat["q2"])
    found = parent >= 0
    children = np.bincount(parent[found], minlength=len(slot))
    leaves = (children == 0).astype(np.int64)
    savings = (flat["n_convs"] - 1) * flat["bytes"]
    order = np.argsort(flat["depth"], kind="stable")
    starts = np.flatnonzero(np.diff(flat["depth"][order], prepend=-1))
    for level in reversed(np.split(order, starts[1:])):
        level = level[found[level]]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(savings, parent[level], savings[level])
    owner = np.where(found, flat["owner"][parent], 0)
    return {**flat, "n_children": children, "n_leaves": leaves, "saved_tokens": savings,
            "parent_owner": owner, "found": found}


_SUMS = ("d1", "d2", "q1", "q2", "depth", "owner", "n_convs", "n_children", "n_leaves", "saved_tokens")


def _light(table: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """Sums of the light nodes, whole subtrees to a shard."""
    light = table.where((F.col("turns") <= limit) & (F.col("depth") > 0))
    heavy = table.where((F.col("turns") > limit) | (F.col("depth") == 0))
    above = heavy.select(F.col("d1").alias("q1"), F.col("d2").alias("q2"))
    tops = light.join(above, ["q1", "q2"], "left_semi").select(*_NODE)
    # Below its last heavy node a conversation stays in one light subtree.
    shard_of = rows.join(tops, list(_NODE)).select(
        F.col("conv_id").alias("owner"), F.xxhash64(*_NODE).alias("shard")
    )
    spark = table.sparkSession
    parts = max(shuffle_partitions(spark), -(-table.count() // SHARD_NODES))
    dealt = light.join(shard_of, "owner").repartition(parts, "shard").drop("shard", "turns")
    schema = ", ".join(f"{c} long" for c in (*_SUMS, "parent_owner")) + ", found boolean"
    arrow = arrow_schema(spark, schema)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            whole = pa.Table.from_batches(held)
            columns = {c: whole.column(c).to_numpy() for c in whole.schema.names}
            yield record_batch(
                {c: pa.array(x) for c, x in subtree_sums(columns).items()}, arrow
            )

    return dealt.mapInArrow(sums, schema)


def _heavy(table: DataFrame, light: DataFrame, limit: int) -> DataFrame:
    """Sums of the heavy nodes: their light children first, then each other, twice as far every round."""
    heavy = table.where((F.col("turns") > limit) | (F.col("depth") == 0))
    below = heavy.where(F.col("depth") > 0).select(
        "q1", "q2", F.lit(1).alias("c"), F.lit(0).alias("l"), F.lit(0).alias("s")
    )
    tops = light.where(~F.col("found")).select(
        "q1", "q2", F.lit(1).alias("c"), F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s")
    )
    given = (
        below.unionByName(tops)
        .groupBy(F.col("q1").alias("d1"), F.col("q2").alias("d2"))
        .agg(*[F.sum(x).alias(x) for x in "cls"])
    )
    many = F.coalesce("c", F.lit(0))
    state = saved(
        heavy.join(given, list(_NODE), "left").select(
            *_NODE, "q1", "q2", "depth", "owner", "n_convs",
            many.cast("long").alias("n_children"),
            (F.coalesce("l", F.lit(0)) + F.when(many == 0, 1).otherwise(0)).cast("long").alias("n_leaves"),
            (F.coalesce("s", F.lit(0)) + (F.col("n_convs") - 1) * F.col("bytes")).cast("long").alias("saved_tokens"),
            F.col("q1").alias("a1"), F.col("q2").alias("a2"),
        ),
        "heavy",
    )
    deepest = state.agg(F.max("depth")).first()[0] or 0
    for _ in range(int(deepest).bit_length()):
        sums = (
            state.where(F.col("a1").isNotNull())
            .groupBy(F.col("a1").alias("d1"), F.col("a2").alias("d2"))
            .agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        )
        further = state.select(
            F.col("d1").alias("a1"), F.col("d2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2")
        )
        state = saved(
            state.join(sums, list(_NODE), "left")
            .join(further, ["a1", "a2"], "left")
            .select(
                *_SUMS[:-2],
                (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"),
                F.col("b1").alias("a1"),
                F.col("b2").alias("a2"),
            ),
            "heavy",
        )
    return state.select(*_SUMS)


def prefix_nodes(
    conversations: DataFrame, shard_turns: int = SHARD_TURNS, partitions: int | None = None
) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``."""
    rows, convs = rebuilt(saved(turns(conversations, partitions), "places"))
    rows = saved(rows, "rebuilt")
    table = saved(nodes(rows, convs), "nodes")
    light = saved(_light(table, rows, shard_turns), "light")
    heavy = _heavy(table, light, shard_turns)
    upper = heavy.select(
        F.col("d1").alias("q1"), F.col("d2").alias("q2"), F.col("owner").alias("parent_owner")
    )
    outside = light.where(~F.col("found")).select(*_SUMS).unionByName(heavy)
    summed = (
        light.where("found")
        .select(*_SUMS, "parent_owner")
        .unionByName(outside.join(upper, ["q1", "q2"], "left").select(*_SUMS, "parent_owner"))
    )
    return summed.join(ends(rows, convs), list(_NODE), "left").select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.col("parent_owner").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )

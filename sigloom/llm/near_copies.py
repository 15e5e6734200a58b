"""Near-copies by weighted sketches.

A document is the multiset of its five-word shingles; similarity is weighted Jaccard (sum of the
smaller counts over sum of the larger).  DartMinHash throws darts into the region of each shingle:
the area of its weight times a rank axis, cut into cells whose darts are a function of
shingle and cell only.  Every dart is hashed to a coordinate, and the earliest rank of each
coordinate is the signature, so two documents agree in a coordinate with the probability of
their similarity.  Coordinates are joined in bands.

Equal texts are one node.  Within a bucket, members are compared with a centre, not with each other:
first in buckets of one band, then in those of two bands at once, where the nearest meet.  What
proved similar is merged, and only members of different components meet again, at last all of
them that have a size at which they could still be similar.  Every comparison is exact, on the texts.  A class is a component.

Null text, or one without words, is a class of its own.  A text of fewer than five words is one
shingle.  Rows of one id and text count as one document, rows of one id and different texts as several;
null ids come after all others, in the order of a hash of the text, which names a class of nulls only.

Texts are compared whole, whatever their length.  A class is named by its smallest id, so equally similar
members make no difference.  An empty table gives no row.  ``near_classes`` ignores other columns,
``one_of_each`` keeps them.
"""

from __future__ import annotations

import functools

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.blooms import bloom_filter, holds
from sigloom.llm.common import by_batch, saved, texts
from sigloom.llm.windows import Words, mixed

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
#: Bits kept of each coordinate, and how many coordinates of a similar pair may differ in them:
#: the expected number at the least similarity and 3.5 standard deviations (one link in 4,000 at
#: exactly that similarity is above it, and far fewer beyond).
PLANES = 4
_DIFFER = (1 - SIMILARITY) * (1 - 2**-PLANES)
MOST_DIFFERENT = int(COORDINATES * _DIFFER + 3.5 * (COORDINATES * _DIFFER * (1 - _DIFFER)) ** 0.5)
#: Places that the shingles of a text are hashed to, a multiple of 64.
PLACES = 1024
_CELL = 0xA0761D6478BD642F
_DART = np.uint64(0xE7037ED1A0B428DB)
_WEIGHT = np.uint64(0x8EBC6AF09C88C6E3)


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and how often each occurs."""
    words = Words([text.encode()])
    n = len(words.starts)
    return np.unique(words.window_hashes(min(n, SHINGLE)) if n else words.hashes, return_counts=True)


def _uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signature(hashes: np.ndarray, weights: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """The dart that comes first in each of k coordinates.

    A shingle's weight axis is cut into cells [0, 1), [1, 2), [2, 4), ...; darts fall into a cell as
    a Poisson process along the rank axis.  All darts up to a rank bound are thrown, about
    k (ln k + 3) of them, and the bound is doubled while a coordinate is empty.
    """
    cells, widths, tops, lows = [], [], [], []
    low, width, number = 0.0, 1.0, 0
    while (inside := weights > low).any():
        cells.append(mixed(hashes[inside] + np.uint64(_CELL * number % 2**64)))
        widths.append(np.full(inside.sum(), width))
        lows.append(np.full(inside.sum(), low))
        tops.append(weights[inside])
        low, width, number = low + width, max(1.0, low + width), number + 1
    cell, width, low, top = map(np.concatenate, (cells, widths, lows, tops))
    bound = k * (np.log(k) + 3) / weights.sum()
    while True:
        ranks, darts = _thrown(cell, width, bound)
        owner, dart, rank = darts[0], darts[1], ranks
        if (top < low + width).any():
            hit = low[owner] + width[owner] * _uniform(mixed(dart * _WEIGHT)) < top[owner] + 1e-12
            dart, rank = dart[hit], rank[hit]
        out, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
        coordinate = (dart % np.uint64(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        out[coordinate[order]] = dart[order]  # the earliest is written last
        filled[coordinate] = True
        if filled.all():
            return out
        bound *= 2


def _thrown(cell: np.ndarray, width: np.ndarray, bound: float):
    """Ranks below the bound, with the cell and the hash of each dart."""
    ranks, owners, darts = [], [], []
    alive, reached, first = np.arange(len(cell)), np.zeros(len(cell)), 0
    while len(alive):
        mean = bound * width[alive].max()
        steps = int(min(mean + 3 * np.sqrt(mean) + 3, max(4, 2_000_000 // len(alive))))
        number = np.arange(first, first + steps, dtype=np.uint64)
        dart = mixed(cell[alive, None] + _DART * (number + np.uint64(1)))
        gaps = -np.log(_uniform(dart)) / width[alive, None]
        rank = reached[alive, None] + np.cumsum(gaps, axis=1)
        under = rank < bound
        row, _ = np.nonzero(under)
        ranks.append(rank[under])
        owners.append(alive[row])
        darts.append(dart[under])
        reached[alive] = rank[:, -1]
        alive, first = alive[under[:, -1]], first + steps
    return np.concatenate(ranks), (np.concatenate(owners), mixed(np.concatenate(darts)))


def bands(signed: np.ndarray) -> np.ndarray:
    """A hash of each band's number and coordinates."""
    rows = signed.reshape(BANDS, ROWS)
    h = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    for k in range(ROWS):
        h = mixed(h + rows[:, k])
    return h.view(np.int64)


def planes(signed: np.ndarray) -> np.ndarray:
    """The high bits of all coordinates, one plane after the other, as 64-bit words.

    The low bits of a dart are those of its coordinate's number.
    """
    bits = signed[None, :] >> np.arange(63, 63 - PLANES, -1, dtype=np.uint64)[:, None]
    bits &= np.uint64(1)
    padded = np.zeros((PLANES, -(-COORDINATES // 64) * 64), np.uint8)
    padded[:, :COORDINATES] = bits
    return np.packbits(padded, axis=1).view(np.int64).ravel()


def places(hashes: np.ndarray) -> np.ndarray:
    """Which places hold a shingle, one bit each, as 64-bit words."""
    held = np.zeros(PLACES, np.uint8)
    held[(mixed(hashes) % np.uint64(PLACES)).astype(np.int64)] = 1
    return np.packbits(held).view(np.int64)


def _reachable(x: Column, y: Column, total: Column) -> Column:
    """Whether two texts with ``total`` shingles in all can be similar, by their places.

    A place held in one text only has a shingle that the other lacks.  With d such places at most
    (total - d) / 2 shingles are shared, so this never rules out a similar pair.
    """
    bits = F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    single = F.aggregate(bits, F.lit(0), lambda n, more: n + more)
    return single * (1 + SIMILARITY) <= total * (1 - SIMILARITY) + 1e-6


def _differing(x: Column, y: Column) -> Column:
    """In how many coordinates two arrays of planes differ."""
    words = -(-COORDINATES // 64)
    total = F.lit(0)
    for k in range(words):
        any_plane = x[k].bitwiseXOR(y[k])
        for p in range(1, PLANES):
            any_plane = any_plane.bitwiseOR(x[p * words + k].bitwiseXOR(y[p * words + k]))
        total = total + F.bit_count(any_plane)
    return total


def _sketched(batch) -> dict[str, list]:
    out = {"key": batch.column("key"), "content": [], "weight": [], "bands": [], "planes": [], "places": []}
    for text in texts(batch):
        hashes, counts = shingles(text)
        out["content"].append(xxhash.xxh3_128_hexdigest(b" ".join(text.encode().split())))
        out["weight"].append(int(counts.sum()))
        if len(hashes):
            signed = signature(hashes, counts.astype(np.float64))
            out["bands"].append(bands(signed).tolist())
            out["planes"].append(planes(signed).tolist())
            out["places"].append(places(hashes).tolist())
        else:
            out["bands"].append([])
            out["planes"].append([])
            out["places"].append([])
    return out


@functools.lru_cache(64)
def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    return shingles(text)


def similarity(a: str, b: str) -> float:
    """Weighted Jaccard similarity of two texts."""
    (x, n), (y, m) = _counted(a), _counted(b)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = np.minimum(n[i], m[j]).sum()
    total = n.sum() + m.sum() - shared
    return float(shared / total) if total else 0.0


def _compared(batch) -> dict[str, list]:
    a, b = texts(batch, "text_a"), texts(batch, "text_b")
    return {
        "a": batch.column("a"),
        "b": batch.column("b"),
        "similar": [similarity(x, y) >= SIMILARITY for x, y in zip(a, b)],
    }


def _similar(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose texts are similar.  ``candidates`` has key and text, by key."""
    left = candidates.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = candidates.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    found = by_batch(joined, "a binary, b binary, similar boolean", _compared)
    return saved(found.where("similar").select("a", "b"), "similar")


def components(edges: DataFrame) -> DataFrame:
    """(key, class): for every end of an edge the smallest key it is connected with.

    Each step takes the smallest label of a node's neighbours and then the label of that label.
    """
    both = saved(
        edges.union(edges.select("b", "a")).toDF("key", "other").distinct(), "edges"
    )
    labels = both.groupBy("key").agg(F.min("other").alias("n")).select(
        "key", F.least("key", "n").alias("class")
    )
    while True:
        labels = saved(labels, "labels")
        near = (
            both.join(labels.select(F.col("key").alias("other"), "class"), "other")
            .groupBy("key")
            .agg(F.min("class").alias("near"))
        )
        jump = labels.select(F.col("key").alias("near"), F.col("class").alias("beyond"))
        stepped = (
            labels.join(near, "key")
            .withColumn("near", F.least("class", "near"))
            .join(jump, "near", "left")
            .select(
                "key",
                F.coalesce("beyond", "near").alias("to"),
                (F.coalesce("beyond", "near") < F.col("class")).alias("moved"),
            )
        )
        stepped = saved(stepped, "labels")
        labels = stepped.select("key", F.col("to").alias("class"))
        if stepped.where("moved").isEmpty():
            return labels


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Which classes the links (a, b) connect: links of earlier steps are in the classes and not walked again."""
    a, b = labels.toDF("a", "class_a"), labels.toDF("b", "class_b")
    return links.join(a, "a").join(b, "b").select(
        F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")
    ).distinct()


def _in_company(sketched: DataFrame) -> DataFrame:
    """Members of buckets that hold two or more, with ``others``: in how much company a key is."""
    buckets = sketched.select("key", "weight", F.explode("buckets").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    held = saved(buckets.join(sizes, "bucket"), "buckets")
    company = held.groupBy("key").agg(F.sum("n").alias("others"))
    return saved(held.drop("n").join(company, "key"), "company")


def _apart(pairs: DataFrame) -> DataFrame:
    """Pairs of different classes whose sizes allow the similarity, each once."""
    fits = F.least("weight", "weight_b") >= SIMILARITY * F.greatest("weight", "weight_b")
    return (
        pairs.where((F.col("class") != F.col("class_b")) & fits)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _with_centre(placed: DataFrame, sketched: DataFrame) -> DataFrame:
    """Each member of a bucket with the one that has most company, if its class is another.

    The text that others were copied from shares buckets with most of them, so it is the centre
    of most buckets it is in.
    """
    rank = F.struct("others", "key", "class", "weight")
    centre = placed.groupBy("bucket").agg(F.max(rank).alias("c"))
    return _apart(
        placed.join(centre, "bucket").select(
            F.col("key").alias("a"),
            F.col("c.key").alias("b"),
            "class",
            F.col("c.class").alias("class_b"),
            "weight",
            F.col("c.weight").alias("weight_b"),
        )
    )


def _across_classes(placed: DataFrame, sketched: DataFrame) -> DataFrame:
    """Pairs of a bucket that are in different classes and whose sketches and places leave it open.

    A pair with several common buckets comes from the first of them only, and a pair with a common
    bucket among ``compared`` was made in an earlier step: if it is still apart, it is dissimilar.
    """
    several = (
        placed.groupBy("bucket")
        .agg(F.min("class").alias("least"), F.max("class").alias("most"))
        .where(F.col("least") < F.col("most"))
        .select("bucket")
    )
    rest = (
        placed.join(several, "bucket")
        .join(sketched.select("key", "planes", "places", "buckets", "compared"), "key")
        .select(
            "bucket",
            F.col("key").alias("a"),
            *"class weight planes places buckets compared".split(),
        )
    )
    other = rest.toDF(
        *"bucket_b b class_b weight_b planes_b places_b buckets_b compared_b".split()
    )
    first = F.array_intersect("buckets", "buckets_b")[0] == F.col("bucket")
    open_yet = _differing(F.col("planes"), F.col("planes_b")) <= MOST_DIFFERENT
    fits = F.least("weight", "weight_b") >= SIMILARITY * F.greatest("weight", "weight_b")
    total = F.col("weight") + F.col("weight_b")
    reachable = _reachable(F.col("places"), F.col("places_b"), total)
    return _apart(
        rest.join(
            other,
            (F.col("bucket") == F.col("bucket_b"))
            & (F.col("class") < F.col("class_b"))
            & fits
            & open_yet
            & reachable
            & first
            & ~F.arrays_overlap("compared", "compared_b"),
        )
    )


def _key() -> Column:
    """Id and hash of the text as bytes in their order, null ids last."""

    def ordered(number: Column) -> Column:
        return F.lpad(F.hex(number.bitwiseXOR(F.lit(-(2**63)))), 16, "0")

    version = F.xxhash64("text")
    return F.unhex(
        F.concat(
            F.when(F.col("doc_id").isNull(), "01").otherwise("00"),
            ordered(F.coalesce(F.col("doc_id").cast("long"), version)),
            ordered(version),
        )
    )


def _named(key: Column) -> Column:
    """The id in a key, or the hash in its place."""
    number = F.conv(F.hex(F.substring(key, 2, 8)), 16, 10).cast("decimal(20,0)")
    return (number - F.lit(2**63 - 1).cast("decimal(20,0)") - F.lit(1)).cast("long")


def near_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): class_id is the smallest id of the documents in the class."""
    return _classes(docs).select("doc_id", _named(F.col("class_key")).alias("class_id"))


def _classes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, class_key) per row: class_key is the smallest key of the class."""
    keyed = docs.select("doc_id", _key().alias("key"), F.col("text").alias("text"))
    sketches = saved(
        by_batch(
            keyed.select("key", "text"),
            "key binary, content string, weight long, bands array<long>, planes array<long>, places array<long>",
            _sketched,
        ),
        "sketches",
    )
    spoken = sketches.where(F.size("bands") > 0)
    nodes = saved(spoken.groupBy("content").agg(F.min("key").alias("node")), "nodes")
    represent = nodes.select(F.col("node").alias("key")).distinct()
    own = saved(
        spoken.join(represent, "key", "left_semi")
        .select("key", "weight", "bands", "planes", "places")
        .distinct(),
        "represented",
    )
    pairs_of_bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 2)),
        lambda i: F.xxhash64(F.col("bands")[i], F.col("bands")[i + 1]),
    )
    wide = own.select(
        "key",
        "weight",
        "planes",
        "places",
        F.col("bands").alias("buckets"),
        pairs_of_bands.alias("compared"),
    )
    narrow = own.select(
        "key",
        "weight",
        "planes",
        "places",
        pairs_of_bands.alias("buckets"),
        F.array().cast("array<long>").alias("compared"),
    )
    members, close = _in_company(wide), _in_company(narrow)

    # The texts that are compared at all; a filter of limited size keeps the others from moving.
    needed = members.select("key").distinct()
    bloom = docs.sparkSession.sparkContext.broadcast(
        bloom_filter(needed.select(F.xxhash64("key").alias("h")), "h")
    )

    @F.pandas_udf("boolean")
    def maybe(hashes):
        import pandas as pd

        return pd.Series(holds(bloom.value, hashes.to_numpy()))

    candidates = saved(
        keyed.where(maybe(F.xxhash64("key")))
        .join(needed, "key", "left_semi")
        .select("key", "text")
        .dropDuplicates(["key"]),
        "candidates",
    )

    labels = needed.select("key", F.col("key").alias("class"))
    done, merged = None, False
    # First with centres, in buckets of one band and of two; then whatever is still apart.
    for buckets, sketched, pairing in [
        (members, wide, _with_centre),
        (close, narrow, _with_centre),
        (close, narrow, _across_classes),
        (members, wide, _across_classes),
    ]:
        pairs = pairing(buckets.join(labels, "key"), sketched)
        pairs = saved(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        done = pairs if done is None else done.union(pairs)
        if pairs.isEmpty():
            continue
        found = _similar(pairs, candidates)
        if not found.isEmpty():
            joined = components(_between(found, labels) if merged else found)
            labels = saved(
                labels.join(joined.toDF("class", "to"), "class", "left").select(
                    "key", F.coalesce("to", "class").alias("class")
                ),
                "classes",
            )
            merged = True
    node_class = labels.select(F.col("key").alias("node"), F.col("class"))
    return (
        keyed.select("doc_id", "key")
        .join(sketches.select("key", "content").dropDuplicates(["key"]), "key", "left")
        .join(nodes, "content", "left")
        .join(node_class, "node", "left")
        .select("doc_id", "key", F.coalesce("class", "node", "key").alias("class_key"))
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, without all but the smallest id and text of each class."""
    kept = _classes(docs).where(F.col("key") == F.col("class_key")).select("key").distinct()
    # Of rows of one key, which have one text, the first by a hash of the columns that have one.
    hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select(_key().alias("key"), F.struct("*").alias("row"), F.xxhash64(*hashed).alias("at"))
    single = rows.groupBy("key").agg(F.min_by("row", "at").alias("row"))
    return single.join(kept, "key", "left_semi").select("row.*")

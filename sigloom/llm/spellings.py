"""Spelling variants: words one edit apart, each led to its commonest form.

Every word has a vector: how many of its letters fall into each of ``GROUPS`` letter groups.  One
inserted, deleted or replaced letter raises at most one count and lowers at most one, by one.  The
vectors of a bucket of words form a trie, one level a group; a depth-first search walks it for
blocks of words at once, each with a budget of one surplus and one deficit, and compares the words of
the leaves it reaches letter by letter.

The top levels of the trie are the buckets that Spark deals to tasks.  As many levels are used as make the
largest bucket small enough; a bucket that stays too large is cut into slices, and its searchers
visit every slice.  Each pair of words meets in one bucket only: the word that lacks a letter of
the top levels (or, of two replaced ones, of the earlier level) visits the other's bucket.

Defined results: a null text has no words; a null ``doc_id`` counts as an empty id text; repeated rows
count as often as they are there; an empty table gives no row; words of one count are told apart
by code-point order; other columns are ignored, whatever their names; texts and words may be of any
length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import arrow_schema, record_batch, saved, shuffle_partitions

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
_LOWER = {c: c + 32 for c in range(65, 91)}

#: One run in so many loses a letter.
DAMAGED = 97
MIN_LETTERS = 5
MIN_COUNT = 3
#: A form is at least so many times as frequent.
FORM_RATIO = 2

GROUPS = 12
#: Counts above it are taken for it; vectors of words one edit apart still differ by one at most.
MOST = 90
_ZERO = 33
#: Words of one bucket of the trie, so that a task can hold it.
BUCKET_WORDS = 20_000
#: Different words a task counts before it hands them on.
COUNTED = 500_000
#: Search states, and pairs of words, held at a time.
BLOCK = 200_000


def damaged_runs(doc_id: str, text: str) -> Iterator[tuple[str, int]]:
    """Words of a text with their counts; some runs lose a letter, by a rule on id and run."""
    for run, n in Counter(RUN.findall(text)).items():
        word = run.lower() if run.isascii() else run.translate(_LOWER)
        h = crc32(f"{doc_id}:{word}".encode())
        if h % DAMAGED == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def vocabulary(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of every word long and frequent enough, counted over whole texts."""
    schema = "word string, n long"
    arrow = arrow_schema(docs.sparkSession, schema)

    def hand_on(counts: Counter) -> pa.RecordBatch:
        return record_batch({"word": list(counts), "n": list(counts.values())}, arrow)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                for word, n in damaged_runs(doc_id, text):
                    if len(word) >= MIN_LETTERS:
                        counts[word] += n
                if len(counts) > COUNTED:
                    yield hand_on(counts)
                    counts.clear()
        yield hand_on(counts)

    texts = docs.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text"
    )
    words = texts.mapInArrow(count, schema).groupBy("word").agg(F.sum("n").alias("n"))
    return words.where(F.col("n") >= MIN_COUNT)


def letter_groups(words: DataFrame) -> list[str]:
    """The letters dealt to ``GROUPS`` groups of about equal use, the commonest first.

    The driver receives one row: the number of each letter over the words.
    """
    used = words.agg(
        *[
            F.sum(F.length("word") - F.length(F.replace("word", F.lit(c)))).alias(f"u{i}")
            for i, c in enumerate(LETTERS)
        ]
    ).first()
    groups, load = [""] * GROUPS, [0] * GROUPS
    for use, letter in sorted(((u or 0, c) for u, c in zip(used, LETTERS)), key=lambda x: (-x[0], x[1])):
        at = min(range(GROUPS), key=lambda g: (load[g], len(groups[g]), g))
        groups[at] += letter
        load[at] += use
    return groups


def vector(groups: list[str]) -> Column:
    """The counts of all groups, one character each."""
    counts = [
        F.length("word") - F.length(F.translate("word", letters, "")) for letters in groups
    ]
    return F.concat(*[F.char(F.least(c, F.lit(MOST)) + F.lit(_ZERO)) for c in counts])


def bucket_levels(words: DataFrame, most: int) -> int:
    """How many levels name a bucket: the fewest that leave no bucket larger than ``most``."""
    levels = [F.substring("vector", g + 1, 1).alias(f"g{g}") for g in range(GROUPS)]
    prefixes = words.select(*levels).rollup(*[f"g{g}" for g in range(GROUPS)])
    sizes = prefixes.agg(
        F.count(F.lit(1)).alias("size"), F.grouping_id().alias("left_out")
    )
    # All levels but the last j are grouped by where the id is 2 ** j - 1.
    largest = {
        GROUPS - r["left_out"].bit_length(): r["size"]
        for r in sizes.groupBy("left_out").agg(F.max("size").alias("size")).collect()
    }
    return next((k for k in range(1, GROUPS) if largest.get(k, 0) <= most), GROUPS)


def visited(levels: int) -> Column:
    """Buckets a word visits: its own, with a letter more, and with a letter exchanged.

    ``budget`` is 3 with surplus and deficit left, 1 with a deficit left, 0 with none left.
    """

    def part(start: int, stop: int) -> Column:
        return F.substring("vector", start + 1, stop - start)

    def changed(changes: dict[int, int]) -> Column:
        pieces, at, real = [], 0, F.lit(True)
        for level, by in sorted(changes.items()):
            code = F.ascii(part(level, level + 1))
            real &= code < _ZERO + MOST if by > 0 else code > _ZERO
            pieces += [part(at, level), F.char(code + by)]
            at = level + 1
        return F.when(real, F.concat(*pieces, part(at, levels)))

    def visit(bucket: Column, budget: int) -> Column:
        return F.struct(bucket.alias("bucket"), F.lit(budget).cast("tinyint").alias("budget"))

    more = [visit(changed({i: 1}), 1) for i in range(levels)]
    exchanged = [
        visit(changed({i: 1, j: -1}), 0) for i in range(levels) for j in range(i + 1, levels)
    ]
    return F.array(visit(part(0, levels), 3), *more, *exchanged)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes one of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class Trie:
    """The words of a bucket by the levels of their vectors below the bucket's own."""

    def __init__(self, words: list[str], counts: list[int], vectors: np.ndarray):
        order = np.lexsort(vectors.T[::-1]) if vectors.shape[1] else np.arange(len(words))
        self.words = [words[i] for i in order]
        self.counts = np.array(counts, np.int64)[order]
        self.halves = _halves(self.words)
        #: For each level the sorted keys ``parent * 256 + count``; the place is the node.
        self.children, node = [], np.zeros(len(words), np.int64)
        for level in vectors[order].T:
            keys, node = np.unique(node * 256 + level, return_inverse=True)
            self.children.append(keys)
        self.starts = np.searchsorted(node, np.arange(node[-1] + 2))

    def search(
        self, words: list[str], vectors: np.ndarray, surplus: np.ndarray, deficit: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of searching words and of words here that may be one edit apart."""
        halves = _halves(words)
        start = np.arange(len(words))
        stack = [(0, start, np.zeros(len(words), np.int64), surplus, deficit)]
        while stack:
            level, who, node, more, less = stack.pop()
            if level == len(self.children):
                yield from self._leaves(who, node, halves)
                continue
            keys, reached = self.children[level], []
            for by in (0, 1, -1):
                may = slice(None) if by == 0 else np.flatnonzero((more if by > 0 else less) > 0)
                w, m, d = who[may], more[may], less[may]
                key = node[may] * 256 + vectors[w, level] + by
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                reached.append((w[hit], at[hit], m[hit] - (by > 0), d[hit] - (by < 0)))
            states = [np.concatenate(x) for x in zip(*reached)]
            for k in range(0, len(states[0]), BLOCK):
                stack.append((level + 1, *(x[k : k + BLOCK] for x in states)))

    def _leaves(
        self, who: np.ndarray, leaf: np.ndarray, halves: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = self.starts[leaf + 1] - self.starts[leaf]
        ends = np.cumsum(sizes)
        for low in range(0, int(ends[-1]) if len(ends) else 0, BLOCK):
            pair = np.arange(low, min(low + BLOCK, ends[-1]))
            state = np.searchsorted(ends, pair, side="right")
            here = self.starts[leaf[state]] + pair - (ends[state] - sizes[state])
            there = who[state]
            a, b = halves[:, there], self.halves[:, here]
            longer = a[0] - b[0]
            # One edit leaves the part before or the part behind the middle of the shorter as it is.
            like = (longer == 0) & ((a[1] == b[1]) | (a[2] == b[2]))
            like |= (longer == 1) & ((a[3] == b[1]) | (a[4] == b[2]))
            like |= (longer == -1) & ((a[1] == b[3]) | (a[2] == b[4]))
            yield there[like], here[like]


def _halves(words: list[str]) -> np.ndarray:
    """Length; hashes of both halves; hashes of what they are if one letter was put in."""
    out = np.empty((5, len(words)), np.int64)
    for k, w in enumerate(words):
        n = len(w)
        h, g = n // 2, (n - 1) // 2
        out[:, k] = n, hash(w[:h]), hash(w[h:]), hash(w[:g]), hash(w[g + 1 :])
    return out


def _near_in_buckets(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[dict[str, list]]:
    """Near pairs, both ways; rows come by bucket, first the words of it, then its visitors."""
    trie, bucket, held = None, None, []
    for name, budget, rows in _runs(batches):
        if name != bucket:
            trie, bucket, held = None, name, []
        if budget < 0:
            held.append(rows)
            continue
        if trie is None and held:
            trie = Trie(
                [w for words, _, _ in held for w in words],
                [n for _, counts, _ in held for n in counts],
                np.concatenate([_levels_of(vectors, levels) for _, _, vectors in held]),
            )
            held = []
        if trie is not None:
            yield _pairs(trie, budget, *rows, levels)


def _levels_of(vectors: list[str], levels: int) -> np.ndarray:
    flat = np.frombuffer("".join(vectors).encode("ascii"), np.uint8)
    return flat.reshape(-1, GROUPS)[:, levels:].astype(np.int64)


def _pairs(
    trie: Trie, budget: int, words: list[str], counts: list[int], vectors: list[str], levels: int
) -> dict[str, list]:
    more = np.full(len(words), int(budget == 3))
    less = np.full(len(words), int(budget > 0))
    out: dict[str, list] = {"word": [], "near": [], "near_n": []}
    for there, here in trie.search(words, _levels_of(vectors, levels), more, less):
        for i, j in zip(there.tolist(), here.tolist()):
            a, b = words[i], trie.words[j]
            # In its own bucket a pair is met from both sides; one of them counts.
            if (budget < 3 or a < b) and one_edit(a, b):
                out["word"] += (a, b)
                out["near"] += (b, a)
                out["near_n"] += (int(trie.counts[j]), counts[i])
    return out


def _runs(
    batches: Iterator[pa.RecordBatch],
) -> Iterator[tuple[tuple[str, int], int, tuple[list, list, list]]]:
    """Stretches of rows of one bucket and budget (-1: words of the bucket)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = list(zip(batch.column("bucket").to_pylist(), batch.column("slice").to_pylist()))
        budgets = batch.column("budget").to_pylist()
        rows = [batch.column(c).to_pylist() for c in ("word", "n", "vector")]
        start = 0
        for k in range(1, batch.num_rows + 1):
            if k == batch.num_rows or names[k] != names[start] or budgets[k] != budgets[start]:
                yield names[start], budgets[start], tuple(x[start:k] for x in rows)
                start = k


def near_pairs(words: DataFrame, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """``(word, near, near_n)`` for every word and every word one edit from it.

    ``words`` has ``word``, ``n`` and ``vector``; it should be a stored table, it is read often.
    """
    levels = bucket_levels(words, bucket_words)
    own = F.substring("vector", 1, levels)
    # Buckets that all levels leave too large; at most one for every ``bucket_words`` words.
    # Stored, their number is known to Spark before it plans the joins.
    large = saved(
        words.groupBy(own.alias("bucket"))
        .agg(F.ceil(F.count(F.lit(1)) / bucket_words).cast("int").alias("slices"))
        .where(F.col("slices") > 1),
        "large",
    )
    rows = ("word", "n", "vector")

    def sliced(df: DataFrame, slices: Column) -> DataFrame:
        whole = F.coalesce("slices", F.lit(1))
        return df.join(large, "bucket", "left").select(
            "bucket", slices(whole).alias("slice"), "budget", *rows
        )

    members = sliced(
        words.select(own.alias("bucket"), F.lit(-1).cast("tinyint").alias("budget"), *rows),
        lambda n: F.pmod(F.hash("word"), n),
    )
    visitors = sliced(
        words.select(*rows, F.explode(visited(levels)).alias("visit"))
        .where(F.col("visit.bucket").isNotNull())
        .select("visit.bucket", "visit.budget", *rows),
        lambda n: F.explode(F.sequence(F.lit(0), n - 1)),
    )
    dealt = (
        members.unionByName(visitors)
        .repartition(shuffle_partitions(words.sparkSession), "bucket", "slice")
        .sortWithinPartitions("bucket", "slice", "budget")
    )
    schema = "word string, near string, near_n long"
    arrow = arrow_schema(words.sparkSession, schema)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs in _near_in_buckets(iter(batches), levels):
            if pairs["word"]:
                yield record_batch(pairs, arrow)

    return dealt.mapInArrow(search, schema)


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of every word with a form: the end of its chain of forms.

    Every round follows twice as many forms.  Counts at least double along a chain, so it has
    fewer than 64 words and six rounds are the most.
    """
    ends = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = ends.join(further, "root", "left")
        following = saved(
            longer.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")),
            "roots",
        )
        ends = following.drop("_moved")
        if following.where("_moved").isEmpty():
            return ends


def variants(docs: DataFrame, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``."""
    counted = saved(vocabulary(docs.select("doc_id", "text")), "vocabulary")
    words = saved(counted.withColumn("vector", vector(letter_groups(counted))), "vectors")
    best = (
        near_pairs(words, bucket_words)
        .groupBy("word")
        .agg(
            F.count(F.lit(1)).alias("n_near"),
            F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"),
        )
    )
    found = counted.join(best, "word", "left")
    leads = -F.col("best.less") >= FORM_RATIO * F.col("n")
    formed = saved(
        found.select(
            "word",
            F.when(leads, F.col("best.form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(leads, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    return formed.join(roots(formed.where(F.col("form").isNotNull())), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

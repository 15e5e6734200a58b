"""Toxic spans by a linear-chain conditional random field, and scores of documents from them.

The field has two labels, clean and toxic.  A word's part of the score comes from hashed features of the
word alone (itself, its beginnings and endings); neighbours count through the chain.  Labels are known for
documents only, so the tokens it is trained on get theirs from a comparison: a word or beginning
is a marker if it is met in toxic documents much more often than chance allows, and a token of
a toxic document is toxic if it has one.  Contexts are counted, not documents: a word between the same
two neighbours counts once, or every word of a much copied toxic document would be a marker.

Forward-backward marginals of whole texts give a document's strongest token, its expected number and share
of toxic tokens; a logistic curve over these, fitted to labelled documents, is the score.

The field is fitted to at most about ``SAMPLE[1]`` toxic and ``SAMPLE[0]`` clean labelled documents,
``SAMPLE_WORDS`` words of each, the curve to the same documents as a whole.  The driver holds these alone.

Defined results: a null or empty text has no token and the score of a text without toxic ones; a document
with unlike labels is toxic; labels of a null ``doc_id`` or with a null label are left out; a null id
is not held out; repeated rows are scored each; without labels of both kinds every score is
the share of toxic ones (0 without any); an empty table gives no row; other columns are ignored, whatever
their names; texts and words may be of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import by_batch, crc32_of_id, texts

#: Labels are learnt where the remainder of the id's CRC-32 is another.
FOLDS, HELD_OUT = 4, 2
#: A document is toxic from this score on.
THRESHOLD = 0.3

#: Labelled documents the field is fitted to, clean and toxic, and the words of each.
SAMPLE = (6000, 2000)
SAMPLE_WORDS = 300

WORD = re.compile(r"\w+")
BEGINNINGS = range(3, 9)
ENDINGS = (3, 4)
BUCKETS = 1 << 18
SLOTS = 2 + len(BEGINNINGS) + len(ENDINGS)
#: A marker's contexts are toxic in this share or more, and its log-likelihood ratio is so much.
MARKER_SHARE, MARKER_RATIO = 0.6, 26.0

EPOCHS, RATE, DECAY, DOCS_A_STEP = 6, 0.3, 1e-5, 256
#: A token counts for its document from this marginal on.
LEAST = 0.05
#: Odd numbers that make one of three.
_MIX = (0x2545F4914F6CDD1D, 0x165667B19E3779F9, 0x1F83D9ABFB41BD6B)
#: Positions a block of the scan has; messages go block by block along a text.
BLOCK = 64
#: Words a worker remembers, and their length.
REMEMBERED, REMEMBERED_LETTERS = 500_000, 40
#: Tokens whose marginals are worked out at a time, unless one text has more.
TOKENS = 400_000


def word_features(word: str) -> list[int]:
    """Buckets of the word, its beginnings and its endings; ``BUCKETS`` where there is none.

    All words share the first, so one never met is as clean as words are on the whole.
    """
    w = word.lower()
    parts = ["*", f"={w}"]
    parts += [f"<{w[:n]}" if len(w) > n else "" for n in BEGINNINGS]
    parts += [f">{w[-n:]}" if len(w) > n else "" for n in ENDINGS]
    return [crc32(p.encode()) % BUCKETS if p else BUCKETS for p in parts]


# --- the chain ------------------------------------------------------------------------------


class Chain:
    """Texts of different lengths cut into blocks, so that a scan goes over all of them at once."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        blocks = -(-lengths // BLOCK)
        self.first = np.cumsum(blocks) - blocks
        self.blocks = blocks
        doc = np.repeat(np.arange(len(lengths)), lengths)
        start = np.cumsum(lengths) - lengths
        within = np.arange(int(lengths.sum())) - start[doc]
        self.cell = (self.first[doc] + within // BLOCK) * BLOCK + within % BLOCK
        self.rows = int(blocks.sum())
        self.real = np.zeros(self.rows * BLOCK, bool)
        self.real[self.cell] = True
        self.real = self.real.reshape(self.rows, BLOCK)
        self.full = self.real.all(axis=0)

    def grid(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(self.rows * BLOCK)
        out[self.cell] = values
        return out.reshape(self.rows, BLOCK)

    def _messages(self, steps: np.ndarray, start: float, backward: bool) -> np.ndarray:
        """Ratio of toxic to clean entering every block, through the blocks before (or behind) it.

        ``steps`` (clean to clean, toxic to clean, clean to toxic, toxic to toxic; each by row) turns the
        weights entering a block into those leaving it.
        """
        entering = np.full(self.rows, start)
        row = self.first + (self.blocks - 1 if backward else 0)
        for k in range(1, int(self.blocks.max(initial=0))):
            docs = np.flatnonzero(self.blocks > k)
            here = row[docs] - k + 1 if backward else row[docs] + k - 1
            ratio, (cc, tc, ct, tt) = entering[here], steps[:, here]
            entering[here + (-1 if backward else 1)] = (ct + tt * ratio) / (cc + tc * ratio)
        return entering

    def _through(self, grid: np.ndarray, m: np.ndarray, backward: bool) -> np.ndarray:
        """What each block as a whole does to the weights that enter it; no matter in which scale."""
        one, none = np.ones(self.rows), np.zeros(self.rows)
        steps = np.array([one, none, none, one])
        for k in reversed(range(BLOCK)) if backward else range(BLOCK):
            e, (cc, tc, ct, tt) = grid[:, k], steps
            if backward:
                ct, tt = e * ct, e * tt
                new = np.array(
                    [m[0, 0] * cc + m[0, 1] * ct, m[0, 0] * tc + m[0, 1] * tt,
                     m[1, 0] * cc + m[1, 1] * ct, m[1, 0] * tc + m[1, 1] * tt]
                )
            else:
                new = np.array(
                    [m[0, 0] * cc + m[1, 0] * ct, m[0, 0] * tc + m[1, 0] * tt,
                     e * (m[0, 1] * cc + m[1, 1] * ct), e * (m[0, 1] * tc + m[1, 1] * tt)]
                )
            new /= new.max(axis=0)
            steps = new if self.full[k] else np.where(self.real[:, k], new, steps)
        return steps

    def forward_backward(self, emission: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ratios before, emissions, and ratios behind every token, in the order of the tokens.

        ``emission`` and ``moves`` (from, to) are weights, not logarithms.
        """
        grid = self.grid(emission)
        if not self.rows:
            return np.zeros(0), np.zeros(0), np.zeros(0)
        (m00, m01), (m10, m11) = moves
        # A text starts after a clean token and ends with nothing behind it.  Texts of one block need no more.
        before, behind = np.zeros(self.rows), np.ones(self.rows)
        if self.rows > np.count_nonzero(self.lengths):
            before = self._messages(self._through(grid, moves, False), 0.0, backward=False)
            behind = self._messages(self._through(grid, moves, True), 1.0, backward=True)
        left, right = np.empty_like(grid), np.empty_like(grid)
        for k in range(BLOCK):
            left[:, k] = (m01 + m11 * before) / (m00 + m10 * before)
            before = np.where(self.real[:, k], left[:, k] * grid[:, k], before)
            j = BLOCK - 1 - k
            right[:, j] = behind
            after = grid[:, j] * behind
            behind = np.where(self.real[:, j], (m10 + m11 * after) / (m00 + m01 * after), behind)
        flat = (x.reshape(-1)[self.cell] for x in (left, grid, right))
        return tuple(flat)


def marginals(lengths: np.ndarray, scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability that a token is toxic, for texts laid one after the other."""
    left, own, right = Chain(lengths).forward_backward(np.exp(scores), np.exp(moves))
    odds = left * own * right
    return odds / (1 + odds)


# --- training -------------------------------------------------------------------------------


@dataclass
class Model:
    """Weights of the features (the last is that of no feature) and of the moves (from, to)."""

    weights: np.ndarray
    moves: np.ndarray
    curve: np.ndarray
    constant: float | None = None
    _scores: dict[str, float] = field(default_factory=dict, repr=False)

    def scores(self, words: list[str]) -> np.ndarray:
        """The words' part of the score of their tokens; words met before are looked up."""
        found = list(map(self._scores.get, words))
        if None in found:
            new = list({w for w, x in zip(words, found) if x is None})
            features = np.array([word_features(w) for w in new], np.int64)
            made = dict(zip(new, np.clip(self.weights[features].sum(axis=1), -30, 30).tolist()))
            found = [made[w] if x is None else x for w, x in zip(words, found)]
            if len(self._scores) + len(made) > REMEMBERED:
                self._scores.clear()
            short = (w for w in made if len(w) <= REMEMBERED_LETTERS)
            self._scores.update((w, made[w]) for w in islice(short, REMEMBERED))
        return np.array(found, float)

    def tagged(self, documents: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """Words of each text and their marginals."""
        held, tokens = [], 0
        for k, text in enumerate(documents):
            held.append(WORD.findall(text))
            tokens += len(held[-1])
            if tokens >= TOKENS or k == len(documents) - 1:
                lengths = np.array([len(w) for w in held], np.int64)
                scores = self.scores(list(chain.from_iterable(held)))
                probable = marginals(lengths, scores, self.moves)
                yield from zip(held, np.split(probable, np.cumsum(lengths)[:-1]))
                held, tokens = [], 0


def markers(words: np.ndarray, starts: np.ndarray, toxic: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Which features (by bucket) are markers, from tokens given as numbers of words.

    ``starts`` marks the first token of a text, ``toxic`` the tokens of toxic texts.
    """
    before = np.where(starts, -1, np.roll(words, 1))
    behind = np.where(np.roll(starts, -1), -1, np.roll(words, -1))
    context = (words * _MIX[0] + before * _MIX[1] + behind * _MIX[2]) * 2 + toxic
    _, once = np.unique(context, return_index=True)
    counts = np.zeros((2, BUCKETS + 1))
    for label in (0, 1):
        inside = words[once[toxic[once] == label]]
        used, times = np.unique(inside, return_counts=True)
        counts[label] = np.bincount(
            features[used].ravel(), np.repeat(times, SLOTS), minlength=BUCKETS + 1
        )
    clean, bad = counts
    n = np.maximum(clean + bad, 1)
    base = bad[: BUCKETS].sum() / max(1, counts[:, :BUCKETS].sum())
    share = bad / n
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (
            np.where(bad > 0, bad * np.log(share / base), 0)
            + np.where(clean > 0, clean * np.log((1 - share) / (1 - base)), 0)
        )
    found = (share >= MARKER_SHARE) & (share > base) & (ratio >= MARKER_RATIO)
    found[BUCKETS] = False
    return found


def fitted(documents: list[str], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and moves, by stochastic gradients of the likelihood of token labels.

    ``documents`` are words joined by blanks.
    """
    numbers: dict[str, int] = {}
    words = [
        np.array([numbers.setdefault(w, len(numbers)) for w in d.split()], np.int64) for d in documents
    ]
    lengths = np.array([len(w) for w in words], np.int64)
    features = np.array([word_features(w) for w in numbers], np.int64).reshape(-1, SLOTS)
    flat = np.concatenate([*words, np.zeros(0, np.int64)])
    starts = np.zeros(len(flat), bool)
    starts[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    of_toxic = np.repeat(toxic.astype(np.int64), lengths)
    marked = markers(flat, starts, of_toxic, features)[features].any(axis=1)
    labels = np.split(marked[flat] & (of_toxic == 1), np.cumsum(lengths)[:-1])

    weights, moves = np.zeros(BUCKETS + 1), np.zeros((2, 2))
    past, past_moves = np.full(BUCKETS + 1, 1e-8), np.full((2, 2), 1e-8)
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        order = rng.permutation(len(documents))
        for k in range(0, len(order), DOCS_A_STEP):
            chosen = order[k : k + DOCS_A_STEP]
            size = lengths[chosen]
            token = np.concatenate([words[i] for i in chosen])
            label = np.concatenate([labels[i] for i in chosen]).astype(float)
            if not len(token):
                continue
            used, place = np.unique(token, return_inverse=True)
            own = weights[features[used]].sum(axis=1)
            left, e, right = Chain(size).forward_backward(np.exp(np.clip(own[place], -30, 30)), np.exp(moves))
            odds = left * e * right
            wrong = np.bincount(place, label - odds / (1 + odds), minlength=len(used))
            slope = np.bincount(
                features[used].ravel(), np.repeat(wrong, SLOTS), minlength=BUCKETS + 1
            )
            slope -= DECAY * len(token) * weights
            slope[BUCKETS] = 0
            past += slope**2
            weights += RATE * slope / np.sqrt(past)
            step = _moves_slope(size, left * e, e * right, label, moves)
            past_moves += step**2
            moves += RATE * step / np.sqrt(past_moves)
    return weights, moves


def _moves_slope(
    lengths: np.ndarray, so_far: np.ndarray, from_here: np.ndarray, label: np.ndarray, moves: np.ndarray
) -> np.ndarray:
    """Observed less expected number of each move; from clean to clean stays at nought.

    ``so_far`` are ratios up to and with a token, ``from_here`` from a token on.
    """
    last = np.zeros(len(label), bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    a, b = np.flatnonzero(~last), np.flatnonzero(~last) + 1
    first = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    m = np.exp(moves)
    expected = np.zeros((2, 2))
    pair = np.array(
        [[np.full(len(a), m[0, 0]), m[0, 1] * from_here[b]], [m[1, 0] * so_far[a], m[1, 1] * so_far[a] * from_here[b]]]
    )
    expected += (pair / pair.sum(axis=(0, 1))).sum(axis=2)
    toxic = m[0, 1] * from_here[first]
    share = toxic / (m[0, 0] + toxic)
    expected[0] += (1 - share).sum(), share.sum()
    observed = np.zeros((2, 2))
    np.add.at(observed, (label[a].astype(int), label[b].astype(int)), 1)
    np.add.at(observed, (0, label[first].astype(int)), 1)
    slope = observed - expected
    slope[0, 0] = 0
    return slope


def summary(probable: np.ndarray) -> list[float]:
    """What a document's score depends on: strongest token, expected number and share of toxic ones.

    Tokens under ``LEAST`` are not expected to be toxic: any number of them makes no toxic one.
    """
    strongest = float(probable.max(initial=0.0))
    expected = float(probable[probable >= LEAST].sum())
    logit = np.log((strongest + 1e-4) / (1 - strongest + 1e-4))
    return [1.0, float(logit), float(np.log1p(expected)), float(np.log(expected / max(1, len(probable)) + 1e-4))]


def logistic(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted logistic curve by Newton steps, slightly held back."""
    held = np.diag([1e-6, *[1.0] * (rows.shape[1] - 1)])
    curve = np.zeros(rows.shape[1])
    for _ in range(50):
        p = _sigmoid(rows @ curve)
        slope = rows.T @ (weights * (labels - p)) - held @ curve
        bend = (rows * (weights * p * (1 - p))[:, None]).T @ rows + held
        step = np.linalg.solve(bend, slope)
        curve += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return curve


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, toxic)`` to learn from, one row per id."""
    learnt = labels.where(F.col("toxic").isNotNull() & (crc32_of_id() % FOLDS != HELD_OUT))
    return learnt.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def _sample(batch: pa.RecordBatch, words: int) -> dict[str, list]:
    """Words of a text, from a place that its length decides where it has more than ``words``."""
    out: dict[str, list] = {"words": [], "toxic": batch.column("toxic").to_pylist()}
    for text in texts(batch):
        found = WORD.findall(text)
        start = crc32(str(len(text)).encode()) % max(1, len(found) - words)
        out["words"].append(" ".join(found[start : start + words]))
    return out


def _summaries(batch: pa.RecordBatch, model: Model) -> dict[str, list]:
    tagged = model.tagged(texts(batch))
    return {"toxic": batch.column("toxic").to_pylist(), "summary": [summary(p) for _, p in tagged]}


def trained(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model:
    """The field and the curve, from a sample of labelled documents that a hash of them decides."""
    nothing = np.zeros(BUCKETS + 1), np.zeros((2, 2)), np.zeros(4)
    known = _labelled(docs, labels)
    counts = {r["toxic"]: r["n"] for r in docs.select("doc_id").join(known, "doc_id").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    there = [counts.get(k, 0) for k in (0, 1)]
    if not all(there):
        return Model(*nothing, constant=float(there[1] > 0))
    # Rows whose hash is under the bound of the larger share are read on, then those of each label.
    shares = [min(1.0, n / m) for n, m in zip(sample, there)]
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    bounds = [int(s * (1 << 40)) for s in shares]
    picked = (
        docs.select("doc_id", "text", place.alias("_place"))
        .where(F.col("_place") < max(bounds))
        .join(known, "doc_id")
        .where(F.col("_place") < F.when(F.col("toxic") == 1, bounds[1]).otherwise(bounds[0]))
        .select("text", "toxic")
    )
    # Only rows repeated very often could be more.
    most = 2 * sum(sample)
    rows = by_batch(picked, "words string, toxic int", _sample, SAMPLE_WORDS).limit(most).toPandas()
    if rows["toxic"].nunique() < 2:
        return Model(*nothing, constant=there[1] / sum(there))
    toxic = rows["toxic"].to_numpy()
    order = np.lexsort([rows["words"].map(lambda w: crc32(w.encode())), toxic])
    documents = [rows["words"][i] for i in order]
    model = Model(*fitted(documents, toxic[order]), nothing[2])
    told = by_batch(picked, "toxic int, summary array<double>", _summaries, model)
    told = told.limit(most).toPandas()
    label = told["toxic"].to_numpy(float)
    weight = np.array(there) / np.bincount(label.astype(int), minlength=2)
    model.curve = logistic(np.stack(told["summary"]), label, weight[label.astype(int)])
    model._scores.clear()
    return model


# --- scoring --------------------------------------------------------------------------------


def _scored(batch: pa.RecordBatch, model: Model) -> dict[str, list]:
    documents = texts(batch)
    out: dict[str, list] = {"doc_id": batch.column("doc_id"), "score": [], "spans": []}
    for text, (words, probable) in zip(documents, model.tagged(documents)):
        if model.constant is None:
            out["score"].append(float(_sigmoid(np.dot(model.curve, summary(probable)))))
        else:
            out["score"].append(model.constant)
        out["spans"].append(toxic_spans(text, probable))
    return out


def toxic_spans(text: str, probable: np.ndarray) -> str:
    """``start:end`` of runs of toxic tokens, comma-joined."""
    spans: list[list[int]] = []
    if probable.max(initial=0.0) >= 0.5:
        last = -2
        for k, m in enumerate(WORD.finditer(text)):
            if probable[k] >= 0.5:
                if k == last + 1:
                    spans[-1][1] = m.end()
                else:
                    spans.append([m.start(), m.end()])
                last = k
    return ",".join(f"{a}:{b}" for a, b in spans)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, spans``."""
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = trained(plain, labels.select("doc_id", "toxic"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = by_batch(plain, f"doc_id {id_type}, score double, spans string", _scored, model)
    score = F.round("score", 6)
    return rows.select(
        "doc_id",
        F.coalesce(crc32_of_id() % FOLDS == HELD_OUT, F.lit(False)).alias("held_out"),
        score.alias("score"),
        (score >= THRESHOLD).cast("int").alias("predicted"),
        "spans",
    )

"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

The graph of a document has one node per candidate word (with a digit or ``@``; every other word
can only be plain text and separates chains).  Neighbouring candidates are linked, and so is each
candidate with the previous one of the same digits or the same letters, however distant.  Loopy
message passing over both kinds of links gives each node's probability of every label; words in
spans of the patterns are observed.  An observed word is also linked directly with every later or
earlier word like it up to the next observed one, so its evidence is one link away at any distance.
Messages pass until they settle.  Spans above ``MIN_PROBABILITY`` that no pattern found are
added; found ones stay.

The weights are fitted by pseudo-likelihood on at most ``SAMPLE_DOCS`` documents that hold
candidates, labelled by the patterns and taken in the order of a hash of their text.

Null text is empty and has no spans.  Every pattern is scanned in linear time, so long texts are
read whole.  Repeated rows and null ids keep one result each; without any candidate in the corpus
only the patterns decide.

Of labels equally probable the first counts.  An empty table gives no row.  ``personal_data`` ignores other
columns, ``redacted`` keeps them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import WORD, by_batch, texts, under_hash_bound

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["plain", *KINDS]
SAMPLE_DOCS = 600
#: Words of a sample document the fit looks at, so that one long document is a bounded share.
SAMPLE_NODES = 500
MIN_PROBABILITY = 0.97
#: Messages have settled when none changes by more than this.  The rounds are bounded, as loops need not
#: settle, by so many and twice the links of the longest run of equal tokens.
TOLERANCE = 1e-3
ROUNDS = 100

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match always begins at the start of a run of digits: what follows decides for the whole run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_EDGE = "\"'[]{}<>.,;:!?*#$%&|="


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every pattern match that passes its test, in order."""
    spans = [(start, 0, end) for start, end in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m.group().split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start():
                digits = _NO_DIGIT.sub("", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


class Graph:
    """Nodes and links of one document."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]], most: int | None = None):
        self.nodes: list[tuple[int, int, int]] = []  # start, end, number of the word
        self.features: list[list[str]] = []
        self.observed: list[int] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        #: From a word to the nearest observed words like it, where ``skip`` does not link them.
        self.far: list[tuple[int, int]] = []
        groups: dict[str, list[int]] = {}
        before, first = "", 0
        for number, m in enumerate(WORD.finditer(text)):
            word = m.group()
            if not ("@" in word or _DIGIT.search(word)):
                before = word
                continue
            core = word.strip(_EDGE) or word
            start = m.start() + word.find(core)
            end, node = start + len(core), len(self.nodes)
            if most is not None and node >= most:
                break
            while first < len(spans) and spans[first][2] <= start:
                first += 1
            label = next((k for s, k, e in spans[first : first + 4] if s < end and start < e), None)
            self.nodes.append((start, end, number))
            self.observed.append(-1 if label is None else label + 1)
            self.features.append(features(word, core, before))
            if node and self.nodes[node - 1][2] == number - 1:
                self.chain.append((node - 1, node))
            digits = _NO_DIGIT.sub("", core)
            key = digits if len(digits) >= 4 and "@" not in core else core.lower()
            group = groups.setdefault(key, [])
            if group:
                self.skip.append((group[-1], node))
            group.append(node)
            before = word
        self.longest = max(map(len, groups.values()), default=0)
        for group in groups.values():
            seen = [k for k, node in enumerate(group) if self.observed[node] >= 0]
            for k, node in enumerate(group if seen else ()):
                if self.observed[node] < 0:
                    at = bisect_left(seen, k)
                    if at and seen[at - 1] < k - 1:
                        self.far.append((group[seen[at - 1]], node))
                    if at < len(seen) and seen[at] > k + 1:
                        self.far.append((node, group[seen[at]]))


def features(word: str, core: str, before: str) -> list[str]:
    shape = re.sub(r"[A-Za-zÀ-ɏ]+", "a", re.sub(r"[0-9]+", "9", core))[:24]
    digits = _NO_DIGIT.sub("", core)
    out = ["bias", f"shape={shape}", f"digits={min(len(digits), 20)}", f"runs={_DIGIT.sub('9', core)[:24]}"]
    if "@" in core:
        out.append("at")
    if word[:1] in "+(":
        out.append(f"opens={word[0]}")
    if 12 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}")
    if _DIGIT.search(before) is None:
        out.append(f"before={before.strip(_EDGE).lower()[:12]}")
    return out


class Model:
    """Weights of features, chain links and skip links, for all labels."""

    def __init__(self, index: dict[str, int], unary, chain, skip):
        self.index, self.unary, self.chain, self.skip = index, unary, chain, skip

    def scores(self, graphs: list[Graph]) -> np.ndarray:
        rows, cols, n = [], [], 0
        for g in graphs:
            for names in g.features:
                known = [self.index[f] for f in names if f in self.index]
                rows += [n] * len(known)
                cols += known
                n += 1
        out = np.zeros((n, len(LABELS)))
        np.add.at(out, np.array(rows, int), self.unary[np.array(cols, int)])
        return out

    def beliefs(self, graphs: list[Graph]) -> np.ndarray:
        """Label probabilities of all nodes by loopy sum-product message passing."""
        observed = np.array([o for g in graphs for o in g.observed], int)
        local = self.scores(graphs)
        seen = np.flatnonzero(observed >= 0)
        local[seen] = -50.0
        local[seen, observed[seen]] = 0.0
        ends, tables, base = [], [], 0
        for g in graphs:
            ends += [(base + i, base + j) for i, j in g.chain + g.skip + g.far]
            tables += [0] * len(g.chain) + [1] * (len(g.skip) + len(g.far))
            base += len(g.nodes)
        if ends:
            pair = np.array(ends)
            table = np.stack([self.chain, self.skip])[np.array(tables)]
            source = np.concatenate([pair[:, 0], pair[:, 1]])
            target = np.concatenate([pair[:, 1], pair[:, 0]])
            table = np.concatenate([table, table.transpose(0, 2, 1)])
            back = np.roll(np.arange(len(source)), len(pair))
            messages = np.zeros((len(source), len(LABELS)))
            for _ in range(ROUNDS + 2 * max(g.longest for g in graphs)):
                total = local.copy()
                np.add.at(total, target, messages)
                x = (total[source] - messages[back])[:, :, None] + table
                top = x.max(axis=1, keepdims=True)
                new = np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]
                change = new - new.max(axis=1, keepdims=True) - messages
                messages += 0.5 * change
                if np.abs(change).max() < TOLERANCE:
                    break
            np.add.at(local, target, messages)
        p = np.exp(local - local.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit(graphs: list[Graph], steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """Pseudo-likelihood: each node given its features and the labels of its neighbours."""
    names = sorted({f for g in graphs for fs in g.features for f in fs})
    index = {f: i for i, f in enumerate(names)}
    labels = np.array([max(o, 0) for g in graphs for o in g.observed], int)
    n, k = len(labels), len(LABELS)
    rows, cols, ends, kinds, base = [], [], [], [], 0
    for g in graphs:
        for i, fs in enumerate(g.features):
            rows += [base + i] * len(fs)
            cols += [index[f] for f in fs]
        ends += [(base + i, base + j) for i, j in g.chain + g.skip]
        kinds += [0] * len(g.chain) + [1] * len(g.skip)
        base += len(g.nodes)
    rows, cols = np.array(rows, int), np.array(cols, int)
    unary, link = np.zeros((len(names), k)), np.zeros((2, k, k))
    ends, kinds = np.array(ends, int).reshape(-1, 2), np.array(kinds, int)
    a, b = ends[:, 0], ends[:, 1]
    true = np.eye(k)[labels]
    grown_u, grown_l = np.full(unary.shape, 1e-8), np.full(link.shape, 1e-8)
    for _ in range(steps if n else 0):
        z = np.zeros((n, k))
        np.add.at(z, rows, unary[cols])
        np.add.at(z, a, link[kinds][np.arange(len(a)), :, labels[b]])
        np.add.at(z, b, link[kinds][np.arange(len(a)), labels[a], :])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        error = p / p.sum(axis=1, keepdims=True) - true
        gu = np.zeros_like(unary)
        np.add.at(gu, cols, error[rows])
        gl = np.zeros_like(link)
        np.add.at(gl, (kinds, slice(None), labels[b]), error[a])
        np.add.at(gl, (kinds, labels[a], slice(None)), error[b])
        gu, gl = gu / n + decay * unary, gl / n + decay * link
        grown_u, grown_l = grown_u + gu**2, grown_l + gl**2
        unary -= rate * gu / np.sqrt(grown_u)
        link -= rate * gl / np.sqrt(grown_l)
    # Repeated words draw each other to one label whatever the sample holds.
    return Model(index, unary, link[0], link[1] + 2.0 * np.eye(k))


def trained(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model fitted on the sample; the driver holds at most ``sample_docs`` documents' words.

    Texts are cut to their lines with candidates where they are read, and only some times
    ``sample_docs`` of them, by a bound on the hash, are sorted.
    """
    place = F.xxhash64("text")
    candidates = docs.where(F.col("text").rlike("[0-9@]")).select("text")
    near = under_hash_bound(candidates, place, sample_docs)
    cut = by_batch(
        near.select("text", place.alias("place"), F.length("text").alias("size")),
        "text string, place long, size int",
        _around_candidates,
    )
    marked = cut.orderBy("place", "size").limit(sample_docs).collect()
    return fit([Graph(r["text"], base_spans(r["text"]), SAMPLE_NODES) for r in marked])


def _around_candidates(batch) -> dict[str, list]:
    """Only the lines with candidates, up to a bound, travel to the driver."""
    out = []
    for text in texts(batch):
        lines = [x[:4000] for x in text.split("\n") if _DIGIT.search(x) or "@" in x]
        out.append("\n".join(lines[:50]))
    return {"text": out, "place": batch.column("place"), "size": batch.column("size")}


def all_spans(found: list[str], model: Model) -> list[tuple[list, list]]:
    """For each text the spans of the patterns and those with the model's added."""
    base = [base_spans(t) for t in found]
    which = [i for i, t in enumerate(found) if "@" in t or _DIGIT.search(t)]
    graphs = [Graph(found[i], base[i]) for i in which]
    out = [(b, b) for b in base]
    if any(g.nodes for g in graphs):
        beliefs = model.beliefs(graphs)
        at = 0
        for i, g in zip(which, graphs):
            p = beliefs[at : at + len(g.nodes)]
            at += len(g.nodes)
            added: list[tuple[int, int, int]] = []
            joined = -2
            for k in range(len(g.nodes)):
                label = int(p[k].argmax())
                if g.observed[k] >= 0 or not label or p[k, label] < MIN_PROBABILITY:
                    continue
                start, end, number = g.nodes[k]
                if added and joined == number - 1 and added[-1][1] == label - 1:
                    start = added.pop()[0]
                added.append((start, label - 1, end))
                joined = number
            out[i] = base[i], sorted(base[i] + added)
    return out


def _found(batch, model: Model) -> dict[str, list]:
    out = {c: [] for c in (*(f"n_{k}" for k in KINDS), "base_sha256", "spans")}
    for base, spans in all_spans(texts(batch), model):
        for k, kind in enumerate(KINDS):
            out[f"n_{kind}"].append(sum(s[1] == k for s in base))
        out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
        out["spans"].append(written(spans))
    return out | {"doc_id": batch.column("doc_id")}


def personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document the counts and digest of pattern spans, and all spans as text."""
    return by_batch(
        docs.select("doc_id", "text"),
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
        "spans string",
        _found,
        model or trained(docs),
    )


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the union goes."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents, all columns kept, with every span replaced by ``<kind>``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return by_batch(docs, schema, _redacted, model or trained(docs))


def _redacted(batch, model: Model) -> dict[str, list]:
    found = texts(batch)
    clean = [redact(t, spans) for t, (_, spans) in zip(found, all_spans(found, model))]
    nulls = batch.column("text").is_null().to_pylist()
    out = {c: batch.column(c) for c in batch.schema.names}
    return out | {"text": [None if null else t for t, null in zip(clean, nulls)]}

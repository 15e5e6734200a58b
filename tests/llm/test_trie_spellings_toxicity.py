"""The conversation trie, the spelling variants and the toxic spans against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from sigloom.llm import prefix_trie, spellings, toxicity
from sigloom.llm.common import read_table

SMALL = "/root/testdata/sf0.001"
CONVERSATIONS = "conv_id long, turn long, role string, text string, d1 long, n int"


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    """Python workers know where the package is."""
    read_table(spark, SMALL, "documents")


# --- conversation trie ----------------------------------------------------------------------


def some_conversations():
    """Nulls, repeated turns, ties, negative ids, copies, two long conversations."""
    rng = random.Random(1)
    rows = []
    for conv in [*range(-12, 60), None]:
        if rng.random() < 0.15:
            continue
        for turn in range(rng.choice([1, 2, 3, 5, 12])):
            for _ in range(rng.choice([1, 1, 1, 2])):
                role = rng.choice(["user", "assistant", None])
                text = rng.choice(["a", "b", "é", None, ""])
                rows.append((conv, rng.choice([turn, turn, None]), role, text))
    rows += [(conv, turn, "user", "a") for conv in (7, 8) for turn in range(300)]
    rows += [(1000 + k, 0, "user", "a") for k in range(40)]
    rows += [(2005, 0, "user", "long " * 50_000)]
    return [(*row, 5, None) for row in rows]


def trie_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [x[2:] for x in sorted(turns)] for conv, turns in own.items()}
    members = defaultdict(list)
    whole = {}
    for conv, turns in own.items():
        rest = conv % 5 if conv >= 0 else -(-conv % 5)
        h = crc32(str(conv).encode()) % 9
        start = own.get(conv - rest, [])[:h] if rest else turns[:h]
        whole[conv] = tuple(start + turns[h:])
        for depth in range(len(whole[conv]) + 1):
            members[whole[conv][:depth]].append(conv)
    children = Counter(path[:-1] for path in members if path)
    leaves, savings = Counter(), Counter()
    for path, convs in members.items():
        for depth in range(len(path) + 1):
            leaves[path[:depth]] += not children[path]
            if path:
                savings[path[:depth]] += (len(convs) - 1) * len(path[-1][1].encode())
    for path, convs in members.items():
        ended = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(path))
        yield (
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs),
            children[path], leaves[path], savings[path], hashlib.sha256(ended.encode()).hexdigest(),
        )


@pytest.mark.parametrize(("shard_turns", "partitions"), [(100_000, None), (40, 9), (0, 3)])
def test_trie(spark, shard_turns, partitions):
    rows = some_conversations()
    df = spark.createDataFrame(rows, CONVERSATIONS)
    found = prefix_trie.prefix_nodes(df, shard_turns, partitions)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(trie_by_hand(rows), key=repr)


def test_trie_of_table(spark):
    df = read_table(spark, "/root/testdata/sf0.01", "conversations")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    found = prefix_trie.prefix_nodes(df, 300).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(trie_by_hand(rows), key=repr)


def test_empty_trie(spark):
    assert prefix_trie.prefix_nodes(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(2)
    first, second = rng.integers(0, 1 << 61, (2, 5000))
    numbers = prefix_trie.PerfectHash(first, second)
    assert sorted(numbers.slots(first, second)) == list(range(5000))
    assert (numbers.slots(second, first) == -1).all()


def test_unequal_prefixes_with_equal_values_end_the_job(spark):
    rows = [(c, 1, 1, 5, 6, 7, 8, 9, t1) for c, t1 in ((0, 3), (1, 4))]
    names = ["conv_id", "length", "depth", "d1", "d2", "q1", "q2", "bytes", "t1"]
    df = spark.createDataFrame(rows, names)
    with pytest.raises(Exception, match="two prefixes have equal values"):
        prefix_trie.nodes(df, df.select("conv_id", "length")).collect()


# --- spelling variants ----------------------------------------------------------------------


def variants_by_hand(rows):
    counts = Counter()
    for doc_id, text in rows:
        if text is not None:
            for run in spellings.RUN.findall(text):
                run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
                h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                at = h % len(run)
                counts[run if h % 97 else run[:at] + run[at + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    alphabet = set("".join(words))
    near = {}
    for w in words:
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        edited = {a + b[1:] for a, b in cuts if b}
        edited |= {a + c + b for a, b in cuts for c in alphabet}
        edited |= {a + c + b[1:] for a, b in cuts if b for c in alphabet}
        near[w] = [v for v in edited if v != w and v in words]
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 2 * words[w]:
            forms[w] = best
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        yield w, forms.get(w), root, n, len(near[w]), words.get(forms.get(w))


def some_texts():
    rng = random.Random(3)
    stems = ["tables", "Straße", "éclair", "aaaaaa", "ababab", "ÀÉÎÕÜ", "abcdefgh", "×÷àÿz", "x" * 130]
    rows = [(1, None), (2, ""), (None, "tables tables"), (None, None), (3, "tables " * 2000)]
    for k in range(200):
        words = []
        for _ in range(30):
            word = list(rng.choice(stems))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(word))
                word[at : at + rng.choice([0, 1])] = rng.choice(["", "a", "B", "é"])
            words.append("".join(word))
        rows.append((k % 150, rng.choice([" ", ", ", "\n", "7"]).join(words)))
    return rows


@pytest.mark.parametrize("bucket_words", [20_000, 30, 1])
def test_variants(spark, bucket_words):
    rows = some_texts()
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, n int, word string")
    found = spellings.variants(df, bucket_words)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(variants_by_hand(rows), key=repr)


def test_variants_of_table(spark):
    df = read_table(spark, SMALL, "documents")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    found = spellings.variants(df, 200).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(variants_by_hand(rows), key=repr)


def test_no_texts_no_variants(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spellings.variants(empty).count() == 0


def test_roots_follow_long_chains(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(37)]
    found = spellings.roots(spark.createDataFrame(chain, "word string, form string"))
    assert {r["root"] for r in found.collect()} == {"w37"}


def test_one_edit():
    words = ["".join(w) for n in range(4) for w in itertools.product("ab", repeat=n)]
    for a, b in itertools.product(words, words):
        cut = {a[:i] + a[i + 1 :] for i in range(len(a))}
        changed = {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "ab"} - {a}
        grown = {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "ab"}
        assert spellings.one_edit(a, b) == (b in cut | changed | grown)


# --- toxic spans ----------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 6, 9])
def test_marginals_equal_enumeration(n):
    rng = np.random.default_rng(n)
    scores, moves = rng.normal(size=n) * 2, rng.normal(size=(2, 2))
    whole, toxic = 0.0, np.zeros(n)
    for path in itertools.product((0, 1), repeat=n):
        steps = sum(moves[a, b] for a, b in zip((0, *path), path))
        weight = np.exp(np.dot(scores, path) + steps)
        whole += weight
        toxic += weight * np.array(path)
    others = rng.normal(size=5)
    joined = np.concatenate([others[:3], scores, others[3:]])
    found = toxicity.marginals(np.array([3, n, 0, 2]), joined, moves)
    assert np.allclose(found[3 : 3 + n], toxic / whole)


def test_marginals_of_long_texts():
    rng = np.random.default_rng(5)
    n = 3 * toxicity.BLOCK + 7
    scores, moves = rng.normal(size=n) * 3, rng.normal(size=(2, 2))
    m, behind, after = np.exp(moves), np.ones(n), 1.0
    for t in range(n - 2, -1, -1):
        after = np.exp(scores[t + 1]) * behind[t + 1]
        behind[t] = (m[1, 0] + m[1, 1] * after) / (m[0, 0] + m[0, 1] * after)
    ratio, want = 0.0, []
    for t in range(n):
        ratio = np.exp(scores[t]) * (m[0, 1] + m[1, 1] * ratio) / (m[0, 0] + m[1, 0] * ratio)
        want.append(ratio * behind[t] / (1 + ratio * behind[t]))
    assert np.allclose(toxicity.marginals(np.array([n]), scores, moves), want)


def test_slope_of_the_moves():
    """The slope equals the change of the likelihood, by enumeration."""
    scores, label = np.array([0.4, -1.0, 0.7]), np.array([1.0, 0.0, 1.0])
    moves = np.array([[0.0, 0.3], [-0.2, 0.5]])

    def likelihood(m):
        def weight(path):
            return np.dot(scores, path) + sum(m[a, b] for a, b in zip((0, *path), path))

        paths = list(itertools.product((0, 1), repeat=3))
        return weight(tuple(label.astype(int))) - np.log(sum(np.exp(weight(p)) for p in paths))

    left, e, right = toxicity.Chain(np.array([3])).forward_backward(np.exp(scores), np.exp(moves))
    slope = toxicity._moves_slope(np.array([3]), left * e, e * right, label, moves)
    for a, b in ((0, 1), (1, 0), (1, 1)):
        step = np.zeros((2, 2))
        step[a, b] = 1e-5
        change = (likelihood(moves + step) - likelihood(moves - step)) / 2e-5
        assert abs(slope[a, b] - change) < 1e-6


def test_held_out_toxicity(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    toxic = found[found.toxic == 1]
    assert toxic.predicted.mean() > 0.9
    assert found[found.toxic == 0].predicted.mean() < 0.04
    assert ((found.score >= 0.3) == (found.predicted == 1)).all()


def test_spans_and_awkward_rows(spark):
    rng = random.Random(6)
    plain = [f"word{k}" for k in range(200)]
    rows, marks = [], []
    for k in range(400):
        words = rng.choices(plain, k=30)
        bad = k % 3 == 0
        if bad:
            words[rng.randrange(30)] = rng.choice(["vile", "nasty"])
        rows.append((k, " ".join(words), "x", 1))
        marks.append((k, int(bad)))
    rows += [(1000, "word1 vile, nasty word2\nword3 vile", "x", 1), (1001, None, None, None), (1002, "", "x", 1), (None, "vile", "x", 1)]
    rows += [(1003, "w" * 300_000, "x", 1), (1004, "word1 " * 60_000, "x", 1), (1002, "", "x", 1)]
    marks += [(None, 1), (1002, None), (3, 1), (0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score int")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[1000]["spans"] == "6:17,30:34"
    assert by_id[1000]["predicted"] == 1 and by_id[None]["predicted"] == 1
    assert not by_id[None]["held_out"]
    # Nothing is known of the one word of 1003; it is scored, either way.
    assert [by_id[k]["predicted"] for k in (1001, 1002, 1004)] == [0, 0, 0]
    for none in (labels.where("false"), labels.where("toxic = 0")):
        assert {r["score"] for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0

"""Secret scan: candidate values found by shape, false positives removed by a random forest.

A candidate is a long run of key-like characters with a digit in it, or a value assigned to a
name.  Its features are length, transitions between character classes and between characters,
coverage by dictionary words, the path it stands in, and the words beside it.  The forest is
trained on labelled findings: a bounded sample of the corpus's own candidates, labelled where
name and shape leave no doubt, and findings written by rule for cases a corpus may lack, such as
placeholders, checksums and identifiers.

Null text is empty and has no candidates.  Values of any length are measured whole.  Repeated rows
and null ids keep their findings; a document without candidates has no row.  Without labelled
findings of the corpus the written ones alone train the forest.

Of candidates that overlap the first counts.  An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import by_batch, saved, texts, under_hash_bound

#: Corpus findings the forest may learn from, and findings written by rule.
SAMPLE_FINDINGS = 4_000
WRITTEN_FINDINGS = 1_200
TREES, DEPTH, SEED = 40, 8, 17
THRESHOLD = 0.5
BESIDE = 40

# Words of credential names, of harmless values, and of path parts.
SECRET_NAMES = set("token secret password passwd pwd key apikey auth credential credentials bearer private access".split())
HARMLESS_NAMES = set("commit sha sha1 sha256 md5 hash checksum digest uuid guid id version build revision etag isbn order invoice tracking".split())
PLACEHOLDERS = set("example sample placeholder changeme dummy your test todo insert here fake none null redacted xxxx".split())
TEST_PATHS = set("test tests spec example examples sample samples fixture fixtures mock doc docs lock".split())
DICTIONARY = set(
    "able about access account after again also application back base been before best body call change check "
    "class client code come config connection content control copy count create data date default delete "
    "design digest document does down each edit email enter error event example field file find first "
    "follow form free from function general good group have help here high home host house image index "
    "info input insert into item just keep know large last left level life like line link list little "
    "load local long look made mail main make many menu message method model more most name network never "
    "next node note number object only open option order other over page park part password path people "
    "place placeholder plain point post print private process profile program project public query read "
    "record release report request response result return right role root rule same save school script "
    "search second secret section server service session show side site size small some source start state "
    "still stop store string style such support system table take task template test text than that their "
    "them then there these they thing think this time title token tool type under unit update upload user "
    "value version very view want water week well were what when where which while will with word work "
    "world would write year your".split()
)

_KEYLIKE = re.compile(r"[A-Za-z0-9+/=_\-]{16,}")
_ASSIGNED = re.compile(r"[=:][ \t]*[\"']?([^\s\"']{6,})")
_DIGIT = re.compile(r"[0-9]")
_NAME = re.compile(r"[A-Za-z]+")
_FEATURES = [
    "length", "digits", "uppers", "lowers", "classes", "letters_turn", "distinct", "entropy",
    "pairs", "dictionary", "hex", "run", "assigned", "quoted", "secret_name", "harmless_name",
    "placeholder", "test_path", "path_depth",
]


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of values worth judging, in order, not overlapping."""
    spans = []
    for m in _KEYLIKE.finditer(text):
        value = m.group().rstrip("=")
        start = m.start()
        if "=" in value:  # name=value in one run
            start += value.rfind("=") + 1
        if m.end() - start >= 12 and _DIGIT.search(text, start, m.end()):
            spans.append((start, m.end()))
    if "=" in text or ":" in text:
        taken = Counter(s for s, _ in spans)
        for m in _ASSIGNED.finditer(text):
            name = _NAME.findall(text[max(0, m.start() - BESIDE) : m.start()])
            if name and name[-1].lower() in SECRET_NAMES and m.start(1) not in taken:
                spans.append((m.start(1), m.end(1)))
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def _covered(value: str) -> float:
    """Share of the value's characters inside dictionary words, longest first from the left."""
    low, at, inside = value.lower(), 0, 0
    while at < len(low):
        for n in range(min(12, len(low) - at), 3, -1):
            if low[at : at + n] in DICTIONARY:
                inside += n
                at += n
                break
        else:
            at += 1
    return inside / len(low)


def measured(text: str, start: int, end: int, path: str) -> list[float]:
    """Features of one candidate, in the order of ``_FEATURES``."""
    value = text[start:end]
    n, kinds = len(value), [_kind(c) for c in value]
    counts = Counter(value)
    pairs = Counter(zip(value.lower(), value.lower()[1:]))
    run = longest = 1
    for a, b in zip(value, value[1:]):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    before = text[max(0, start - BESIDE) : start]
    beside = [w.lower() for w in _NAME.findall(before)[-3:]]
    around = beside + [w.lower() for w in _NAME.findall(text[end : end + BESIDE])[:2]]
    parts = [p for p in re.split(r"[^a-z0-9]+", path.lower()) if p]
    inside = {w.lower() for w in _NAME.findall(value)}
    return [
        float(n),
        kinds.count(0) / n,
        kinds.count(2) / n,
        kinds.count(1) / n,
        float(len(set(kinds))),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        len(counts) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        len(pairs) / max(1, n - 1),
        _covered(value),
        float(set(value.lower()) <= set("0123456789abcdef")),
        longest / n,
        float(before.rstrip("\"' \t")[-1:] in ("=", ":")),
        float(before[-1:] in ("\"", "'")),
        float(bool(set(beside[-2:]) & SECRET_NAMES)),
        float(bool(set(around) & HARMLESS_NAMES)),
        float(bool((inside | set(around)) & PLACEHOLDERS)),
        float(bool(set(parts) & TEST_PATHS)),
        float(len(parts)),
    ]


def _certain(features: list[float]) -> float | None:
    """The label where name and shape leave no doubt, or None."""
    f = dict(zip(_FEATURES, features, strict=True))
    if f["placeholder"] or f["harmless_name"] or f["run"] > 0.4 or f["dictionary"] > 0.5:
        return 0.0
    if f["assigned"] and f["secret_name"] and f["entropy"] >= 2.8 and 0 < f["digits"] < 1:
        return 1.0
    if f["digits"] == 1 or (not f["assigned"] and f["digits"] < 0.1):
        return 0.0
    return None


def _found(batch, path_column: str) -> dict[str, list]:
    out = {c: [] for c in ("doc_id", "start", "end", "value_sha256", "features", "certain")}
    paths = [str(p or "") for p in batch.column(path_column).to_pylist()]
    for doc_id, text, path in zip(batch.column("doc_id").to_pylist(), texts(batch), paths):
        for start, end in candidates(text):
            features = measured(text, start, end, path)
            out["doc_id"].append(doc_id)
            out["start"].append(start)
            out["end"].append(end)
            out["value_sha256"].append(hashlib.sha256(text[start:end].encode()).hexdigest())
            out["features"].append(features)
            out["certain"].append(_certain(features))
    return out


def findings(docs: DataFrame, path_column: str = "source") -> DataFrame:
    """All candidates of all texts with their features; the value itself only as a digest."""
    return by_batch(
        docs.select("doc_id", "text", F.col(path_column).cast("string").alias(path_column)),
        "doc_id long, start long, end long, value_sha256 string, features array<double>, "
        "certain double",
        _found,
        path_column,
    )


def written_findings(n: int = WRITTEN_FINDINGS) -> list[tuple[list[float], float]]:
    """Labelled findings made by rule: random values in settings that tell what they are."""
    rng = random.Random(SEED)
    letters = "abcdefghijklmnopqrstuvwxyz"
    hexes, mixed = "0123456789abcdef", letters + letters.upper() + "0123456789"
    words = sorted(DICTIONARY)

    def some(alphabet: str, least: int, most: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(least, most)))

    def secret() -> tuple[str, str, str, float]:
        value = some(rng.choice([hexes, mixed, mixed + "+/"]), 16, 64)
        return rng.choice(sorted(SECRET_NAMES)), rng.choice([" = \"", "=", ": ", "='"]), value, 1.0

    def placeholder() -> tuple[str, str, str, float]:
        value = rng.choice(["x" * rng.randint(16, 40), "your_token_here_1234", "changeme" * 3 + "1", "0123456789" * 3])
        return rng.choice(sorted(SECRET_NAMES)), "=", value, 0.0

    def checksum() -> tuple[str, str, str, float]:
        return rng.choice(sorted(HARMLESS_NAMES)), rng.choice([": ", " ", "="]), some(hexes, 32, 64), 0.0

    def phrase() -> tuple[str, str, str, float]:
        value = rng.choice("_-").join(rng.choice(words) for _ in range(4)) + some("0123456789", 1, 2)
        return rng.choice(words), rng.choice([" ", "="]), value, 0.0

    def number() -> tuple[str, str, str, float]:
        return rng.choice(words), " ", some("0123456789", 16, 20), 0.0

    out = []
    for k in range(n):
        name, sign, value, label = (secret, placeholder, checksum, phrase, secret, number)[k % 6]()
        carrier = f"{rng.choice(words)} {rng.choice(words)} {name}{sign}"
        path = rng.choice(["src/main.py", "config/app.env", "tests/test_app.py", "src3", ""])
        text = f"{carrier}{value} {rng.choice(words)}"
        out.append((measured(text, len(carrier), len(carrier) + len(value), path), label))
    return out


def trained(spark: SparkSession, found: DataFrame) -> RandomForestClassificationModel:
    """The forest, from at most ``SAMPLE_FINDINGS`` labelled rows of ``found`` and written ones."""
    certain, place = found.where(F.col("certain").isNotNull()), F.xxhash64("value_sha256", "start")
    sample = (
        under_hash_bound(certain, place, SAMPLE_FINDINGS)
        .orderBy(place, "doc_id")
        .limit(SAMPLE_FINDINGS)
        .select("features", F.col("certain").alias("label"))
        .collect()
    )
    rows = [(list(r["features"]), r["label"]) for r in sample] + written_findings()
    labelled = spark.createDataFrame(sorted(rows), "features array<double>, label double")
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED
    )
    return forest.fit(labelled.coalesce(1).withColumn("vector", array_to_vector("features")))


def secrets(docs: DataFrame, path_column: str = "source") -> DataFrame:
    """One row per candidate: its place, a digest of the value, ``score`` and ``is_secret``."""
    found = saved(findings(docs, path_column), "findings")
    model = trained(docs.sparkSession, found)
    scored = model.transform(found.withColumn("vector", array_to_vector("features")))
    score = vector_to_array("probability")[1]
    return scored.select(
        "doc_id",
        "start",
        "end",
        "value_sha256",
        F.round(score, 6).alias("score"),
        (score >= THRESHOLD).alias("is_secret"),
    )

"""The text operators against brute force and the libraries they must agree with."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sigloom.llm import (
    blooms,
    bpe,
    fingerprints,
    language,
    near_copies,
    packing,
    pages,
    pii,
    quality,
    secrets,
    substrings,
)
from sigloom.llm.common import read_table, saved, under_hash_bound
from sigloom.llm.tokens import Cache
from sigloom.llm.windows import Words, leftmost_minimum

SMALL = "/root/testdata/sf0.001"
WORDS = "the of and to in alpha beta gamma delta river stone cloud paper tree house".split()
COLUMNS = "doc_id long, text string, lang string, source string, words string, bands int, key int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


def awkward():
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(4)
    shared, base = prose(rng, 40), prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, shared + "\nend " + prose(rng, 30)),
        (6, prose(rng, 25) + " " + shared), (7, base), (8, " ".join(near)), (9, base), (9, base),
        (None, base), (10, prose(rng, 30_000)), (11, "x " * 300), (12, "y" * 30_000),
        (13, "mail a.b@c.example.org, call +1 (200) 555-0199 or 10.0.0.1"), (None, None),
    ]
    return [(i, t, None if k % 3 else "en", None, "w", 1, 2) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    read_table(spark, SMALL, "documents")
    return spark.createDataFrame(awkward(), COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


OPERATORS = [
    quality.quality,
    near_copies.near_classes,
    packing.packed,
    secrets.secrets,
    language.languages,
    substrings.kept_words,
    bpe.digests,
    pii.personal_data,
    fingerprints.compared,
]


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__module__.rsplit(".")[-1])
def test_awkward_and_empty_tables(docs, none, operator):
    assert operator(none).count() == 0
    got = operator(docs).collect()
    if operator not in (packing.packed, secrets.secrets):
        assert len(got) == docs.count()


def test_quality_counts(docs):
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    assert got[1]["n_words"] == got[2]["n_words"] == got[3]["n_words"] == 0
    assert got[11]["n_repeat_words"] == 300 and got[11]["base_failed"]
    assert got[7]["word_chars"] == len(awkward()[6][1].replace(" ", ""))
    assert not got[1]["kept"]


def test_quality_keeps_clean_text_of_any_labelled_language(spark):
    real = read_table(spark, SMALL, "documents").select("doc_id", "text", "lang")
    rng = random.Random(6)

    def text(common, letters):
        rare = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(200)]
        return " ".join(rng.choice(common if rng.random() < 0.3 else rare) for _ in range(300)) + "."

    russian = "и в не на я что он с как это по но из у за".split(), "абвгдеклмнопрст"
    georgian = "და არ ეს რომ ის მე რა".split(), "აბგდევზთიკლმნოპრსტ"
    rows = [(10_000 + k, text(*russian), "ru") for k in range(4)]
    rows += [(10_010 + k, text(*georgian), "ka") for k in range(4)]
    rows += [(10_020, text(*russian), "en"), (10_021, "%$# 17 " * 60 + text(["#"], "0123456789"), "ru")]
    rows += [(10_022, "коротко", "bg"), (10_023, text(*russian), None)]
    got = quality.quality(real.union(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert all(kept[k] for k in (*range(10_000, 10_004), *range(10_010, 10_014), 10_020, 10_023))
    assert not kept[10_021] and not kept[10_022]
    before = {r["doc_id"]: r["kept"] for r in quality.quality(real).collect()}
    assert {k: v for k, v in kept.items() if k < 10_000} == before
    # A label whose only document fails the base rules has no reference: no distance, no verdict.
    alone = spark.createDataFrame([(1, text(*russian), "xx")], "doc_id long, text string, lang string")
    refs = quality.references(saved(quality.measures(real), "real"))
    judged = quality.judged(saved(quality.measures(alone), "alone"), refs).first()
    assert judged["kept"] and judged["class_distance"] is judged["word_distance"] is None


def copies_by_brute_force(rows):
    sets, parent = {}, {}
    for i, t in rows:
        ws = (t or "").split()
        n = min(5, len(ws))
        sets[i] = Counter(tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)) if ws else Counter()
        parent[i] = i

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both, either = sum((sets[a] & sets[b]).values()), sum((sets[a] | sets[b]).values())
            if a < b and either and both / either >= 0.8:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in sets}


def test_near_copies(spark, docs):
    rows = [(r[0], r[1]) for r in awkward() if r[0] is not None]
    got = {r["doc_id"]: r["class_id"] for r in near_copies.near_classes(docs).collect()}
    want = copies_by_brute_force(rows)
    # The row without an id has the text of 7: its class may be named by its own key.
    assert {i: got[i] for i in want if want[i] != 7} == {i: c for i, c in want.items() if c != 7}
    assert len({got[7], got[8], got[9]}) == 1
    real = read_table(spark, SMALL, "documents")
    want = copies_by_brute_force([(r["doc_id"], r["text"]) for r in real.collect()])
    assert {r["doc_id"]: r["class_id"] for r in near_copies.near_classes(real).collect()} == want


@pytest.mark.parametrize("top", [1, 4])
def test_signature_estimates_weighted_similarity(top):
    rng = random.Random(top)
    errors = []
    for _ in range(15):
        keys = [rng.getrandbits(63) for _ in range(150)]
        a = {x: rng.randint(1, top) for x in keys[:120]}
        b = {x: a.get(x, 1) for x in keys[15:]}
        signed = [
            near_copies.signature(
                np.array(sorted(x), np.uint64), np.array([float(x[k]) for k in sorted(x)]), 512
            )
            for x in (a, b)
        ]
        real = sum((Counter(a) & Counter(b)).values()) / sum((Counter(a) | Counter(b)).values())
        errors.append((signed[0] == signed[1]).mean() - real)
    assert abs(np.mean(errors)) < 0.02


def packed_by_brute_force(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        k = min((k for k in range(len(bins)) if bins[k] >= n), key=lambda k: bins[k], default=None)
        if k is None:
            bins.append(capacity - n)
        else:
            bins[k] -= n
    return sorted(bins)


def test_packing_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(80):
        capacity = rng.choice([10, 50, 200])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 100))]
        used, placed = Counter(), Counter()
        for n, _, first, bins, each, _ in packing.plan(Counter(lengths), capacity):
            placed[n] += bins * each
            for k in range(bins):
                used[first + k] += n * each
        assert placed == Counter(lengths)
        assert sorted(capacity - x for x in used.values()) == packed_by_brute_force(lengths, capacity)


def test_packing_of_documents(spark):
    real = read_table(spark, SMALL, "documents")
    own = Tokenizer.from_file(packing.default_vocabulary())
    want = {}
    for row in real.collect():
        ids = own.encode(row["text"], add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4").tobytes()
            want[row["doc_id"], k // 2048] = k, len(part) // 4, zlib.crc32(part)
    got = packing.packed(real).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    bins = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 2048
    assert len(bins) == len(packed_by_brute_force([r["length"] for r in got], 2048))


def test_bpe_agrees_with_the_library():
    own = bpe.tokenizer(bpe.default_vocabulary())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    for alphabet in (" \n\t  \x85\x1caAbez019'.,!é漢😀#sdmtlv", "etaoinshrdlu"):
        for k in range(800):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))
            text += "<|endoftext|> x" * (k % 40 == 0)
            ids = own.encode(text)
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
            assert own.decode(ids) == text.encode()


def test_bpe_round_trip(docs):
    texts = [r["text"] or "" for r in docs.orderBy("text").select("text").collect()]
    back = bpe.decoded(bpe.encoded(docs)).orderBy("text").collect()
    assert sorted(texts) == sorted(r["text"] for r in back)


BASE = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def spans_by_brute_force(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in pattern.finditer(text):
            digits = re.sub(r"\D", "", m.group(), flags=re.A)
            ok = (
                kind == 0
                or kind == 1 and all(int(x) <= 255 for x in m.group().split("."))
                or kind == 2 and 12 <= len(digits) <= 19 and pii.luhn(digits)
                or kind == 3 and 9 <= len(digits) <= 15
            )
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_pii_patterns():
    rng = random.Random(2)
    for _ in range(8000):
        text = "".join(rng.choice("0123456789.@-+ ()ab%\n0042") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == spans_by_brute_force(text), text


def test_pii_model_adds_repeated_phone(spark):
    model = pii.trained(read_table(spark, "/root/testdata/sf0.01", "documents"))
    text = "Write to +1 (988) 555-2485 now, or later to (988) 555-2485 again. In 2024 it was 12."
    base, spans = pii.all_spans([text], model)[0]
    assert [text[s:e] for s, _, e in base] == ["+1 (988) 555-2485"]
    assert set(base) < set(spans) and all(pii.KINDS[k] == "phone" for _, k, _ in spans)
    assert pii.redact(text, spans).count("<phone>") >= 2
    assert pii.all_spans(["nothing here but 7 words"], model)[0] == ([], [])


def test_pii_evidence_reaches_every_repeat(spark):
    model = pii.trained(read_table(spark, "/root/testdata/sf0.01", "documents"))
    number, repeat = "+1 (988) 555-2485", "(988) 555-2485"
    for text in (
        f"Call {number} now" + f" or later to {repeat} again" * 30,
        f"Call {repeat} now" + f" or later to {repeat} again" * 29 + f" that is {number}",
        f"Call {number} now" + " or later to 555-2485 again" * 30,
    ):
        spans = pii.all_spans([text], model)[0][1]
        for m in re.finditer("555-2485", text):
            assert any(s <= m.start() and m.end() <= e and k == 3 for s, k, e in spans), m
    # The observed word is one link from each word like it, on either side.
    graph = pii.Graph(text, pii.base_spans(text))
    near = {frozenset(x) for x in graph.skip + graph.far}
    seen = [k for k, o in enumerate(graph.observed) if o >= 0 and "555" in text[slice(*graph.nodes[k][:2])]]
    rest = [k for k, o in enumerate(graph.observed) if o < 0]
    assert len(rest) == 30 and all(frozenset((seen[0], k)) in near for k in rest)


def repeated_by_brute_force(rows):
    seen, out = {}, {}
    for k, t in sorted(rows):
        ws = t.split()
        for p in range(len(ws) - 19):
            seen.setdefault(tuple(ws[p : p + 20]), (k, p))
    for k, t in rows:
        ws = t.split()
        gone = {
            q
            for p in range(len(ws) - 19)
            if seen[tuple(ws[p : p + 20])] < (k, p)
            for q in range(p, p + 20)
        }
        kept = [w for q, w in enumerate(ws) if q not in gone]
        out[k] = len(ws), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()
    return out


@pytest.mark.parametrize("hot", [1, 5_000])
def test_substrings(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    real = read_table(spark, SMALL, "documents").select("doc_id", "text")
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select(
        (F.col("doc_id") + 1000).alias("doc_id"), "text"
    )
    both = real.union(unique)
    rows = [(r["doc_id"], r["text"] or "") for r in both.collect()]
    got = {
        r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"])
        for r in substrings.kept_words(both).collect()
    }
    assert got == repeated_by_brute_force(rows)


@pytest.mark.parametrize("count", [0, 3, 200_000])
def test_bloom_filter_reaches_the_driver_packed(spark, count):
    keys = spark.range(count).select(F.xxhash64("id").alias("h"))
    tracemalloc.start()
    bits, words = blooms.bloom_filter(keys, "h")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * bits // 8 + 1_000_000  # rows for the words of the largest took 37 MB

    hashes = np.array([r["h"] for r in keys.collect()], np.int64)
    expected = np.zeros(bits, bool)
    for bit in (hashes & (bits - 1), (hashes >> 32) & (bits - 1)):
        expected[bit] = True
    assert bits >= min(blooms.MAX_BITS, blooms.BITS_PER_KEY * count)
    assert np.array_equal(np.packbits(expected, bitorder="little").view(np.int64), words)
    assert blooms.holds((bits, words), hashes).all()


def test_repeated_rows_keep_their_words(docs):
    got = [r["n_removed"] for r in substrings.kept_words(docs.where("doc_id = 9")).collect()]
    assert got == [0, 0]


def test_windows():
    rng = random.Random(3)
    texts = [
        b" ".join(rng.choice([b"a", b"b", b"cc", b"d\n", b"\te"]) for _ in range(rng.randint(0, 40)))
        for _ in range(8)
    ]
    words, seq = Words(texts), [x for t in texts for x in t.split()]
    for n in (1, 3, 8, 20):
        of = {}
        for p, h in enumerate(words.window_hashes(n).tolist()):
            assert of.setdefault(tuple(seq[p : p + n]), h) == h
        assert len(set(of.values())) == len(of)
    v = np.array([rng.randint(0, 5) for _ in range(40)])
    assert leftmost_minimum(v, 13).tolist() == [p + v[p : p + 13].argmin() for p in range(28)]


def test_pages():
    html = (
        "<html><head><title>t</title></head><body><header>Top</header><nav>Menu</nav>"
        '<div class="cookie-notice">We use</div><div>Site line</div><p>One &amp; two<br>three<p>Four'
        '</p><form>f</form><section id="comments"><p>x</p></section><script>if (a<b) "</p>"</script>'
    )
    assert pages.main_text(html, []).split("\n\n") == ["Site line", "One & two three", "Four"]
    found = pages.lines(html)
    site = [k for k, x in enumerate(found) if x.text == "Site line"]
    assert pages.main_text(html, site).split("\n\n") == ["One & two three", "Four"]
    assert pages.main_text("", []) == pages.main_text("<p>", []) == ""
    assert pages.common_subsequence([1, 2, 3, 4, 5, 9], [1, 7, 3, 5, 4, 9]) in ([0, 2, 4, 5], [0, 2, 3, 5])


def test_pages_differ_from_their_neighbours(spark):
    read_table(spark, SMALL, "documents")
    page = "<body><div>Welcome to the site</div><p>{}</p><div>Copyright of the site</div></body>"
    rows = [(k, f"http://h.example.com/a/{k}", page.format(f"Own text {k}"), 1) for k in range(6)]
    rows += [(6, None, None, 1), (None, "http://alone.example.com/", "<p>Alone</p>", 1), rows[0]]
    got = pages.extracted(
        spark.createDataFrame(rows, "page_id long, url string, html string, key int")
    ).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert [text[k] for k in range(6)] == [f"Own text {k}" for k in range(6)]
    assert text[6] == "" and text[None] == "Alone"
    assert pages.extracted(
        spark.createDataFrame([], "page_id long, url string, html string")
    ).count() == 0


def test_classes_of_furniture_count_by_full_name():
    def text(body):
        return pages.main_text(body, []).split("\n\n")

    for body in (
        '<body class="has-sidebar"><p>Own</p></body>',
        '<main class="with-sidebar"><p>Own</p></main>',
        '<article class="post no-comments"><p>Own</p></article>',
        '<div class="social-studies"><p>Own</p></div>',
        '<article data-id="ad-42" data-class="ad"><p>Own</p></article>',
        '<article class="ad"><p>Own</p></article>',
        '<body id="menu"><div class="widget"><div>Own</div></div><main>Own</main></body>',
        '<div class="sidebar layout"><article><p>Own</p></article></div>',
        '<div title="a class=ad"><p>Own</p></div>',
        '<div class="post ad"><p>Gone</p></div><div ID=menu>Gone</div><p>Own</p>',
        '<article><div class="share">Gone</div><p>Own</p></article>',
    ):
        assert text(body) == ["Own"], body
    assert text('<p>Before <span class="share">a <span>b</span> c</span> after</p><p>Own</p>') == [
        "Before", "after", "Own",
    ]


@pytest.mark.parametrize("partitions", ["1", "4", "9"])
def test_copies_and_menus_do_not_hide_the_site(spark, partitions):
    read_table(spark, SMALL, "documents")
    menu = "<nav>" + "".join(f"<li>Link {k}</li>" for k in range(60)) + "</nav>"

    def html(name):
        return f"{menu}<body><div>Site line</div>" + "".join(f"<p>Own {k} of {name}</p>" for k in range(5))

    rows = [(k, f"http://h.example.com/a/{k:02}", html("copy")) for k in range(12)]
    rows += [(20 + k, f"http://h.example.com/b/{k}", html(f"page {k}")) for k in range(3)]
    rows += [(30, "http://h.example.com/b/00", "<nav>no text</nav>")]
    rows += [(40 + k, f"http://only.example.com/{k}", html("copy")) for k in range(3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = pages.extracted(
            spark.createDataFrame(rows, "page_id long, url string, html string")
        ).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    text = {r["page_id"]: r["text"].split("\n\n") for r in got}
    own = {name: [f"Own {k} of {name}" for k in range(5)] for name in ("copy", *(f"page {k}" for k in range(3)))}
    assert len(got) == len(rows) and text[30] == [""]
    assert all(text[k] == own["copy"] for k in range(12))
    assert all(text[20 + k] == own[f"page {k}"] for k in range(3))
    # Nothing but copies on a host: no line can be told to be the site's.
    assert all(text[40 + k] == ["Site line", *own["copy"]] for k in range(3))


def test_fingerprints(spark, docs):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(((r["doc_id"], r["text"] or "") for r in unique.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.compared(unique).collect()}
    prints = {}
    for k, (i, text) in enumerate(rows):
        changed = fingerprints.edited(text, rows[(k + 1) % len(rows)][1])
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert prints.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert 0.3 < got[10]["near_edited"] < 0.7
    long = prose(random.Random(9), 3000)
    a, b = fingerprints.chunks(long), fingerprints.chunks("put before " + long)
    assert fingerprints.containment(a, b) > 0.95  # all but the chunks up to the next common end


def test_boundaries_follow_their_rule():
    rng = random.Random(5)
    data = bytes(rng.choice(b"abcdefgh ") for _ in range(4000))
    h, hashes, ends, start = 0, [], [], 0
    for b in data:
        h = (2 * h + int(fingerprints.GEAR[b])) % 2**32
        hashes.append(h)
    while start < len(data):
        end = min(start + fingerprints.MOST, len(data))
        for e in range(start + fingerprints.LEAST, end):
            strict = e < start + fingerprints.NORMAL
            if hashes[e - 1] & (fingerprints.STRICT if strict else fingerprints.LOOSE) == 0:
                end = e
                break
        ends.append(end)
        start = end
    assert fingerprints.boundaries(data) == ends


def test_languages_on_held_out(spark):
    real = read_table(spark, "/root/testdata/sf0.01", "documents")
    got = language.languages(real).join(real.select("doc_id", "lang", "text"), "doc_id").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    test = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in test) / len(test) > 0.97


def test_every_label_is_learned(spark):
    read_table(spark, SMALL, "documents")
    rng = random.Random(7)
    rows = []
    for k in range(70):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(20)]
        rows += [(" ".join(rng.choice(words) for _ in range(12)), f"l{k:02}") for _ in range(8)]
    got = language.dictionaries(spark.createDataFrame(rows, "text string, lang string"))
    assert len(got) == 70 and all(len(x) > 500 for x in got.values())
    own = language.Compressors(got)
    assert all(own.sizes(language.letters(text))[0][1] == lang for text, lang in rows)


def test_secrets(spark):
    real = read_table(spark, "/root/testdata/sf0.01", "documents")
    text = {r["doc_id"]: r["text"] for r in real.collect()}
    got = secrets.secrets(real).collect()
    hit = {(r["doc_id"], r["start"], r["end"]) for r in got if r["is_secret"]}
    planted = {
        (i, *m.span(1)) for i, t in text.items() for m in re.finditer(r"token = \"([0-9a-f]{40})\"", t)
    }
    assert planted and planted <= hit
    for r in got:
        value = text[r["doc_id"]][r["start"] : r["end"]]
        assert r["value_sha256"] == hashlib.sha256(value.encode()).hexdigest()
        assert not (r["is_secret"] and value.isdigit())


@pytest.mark.parametrize(
    "part",
    ["<a ", "<" + "a" * 50, "<div class=ad>x", '<a "', '<a "<b \'', "</span><div>", "<script></script", "<!"],
)
def test_broken_pages_take_time_in_proportion(part):
    """A megabyte of what never ends, or of elements in each other, as quick as any other page."""
    html = part * (1_000_000 // len(part))
    start = time.perf_counter()
    pages.lines(html)
    pages.lines(html + ">")
    assert time.perf_counter() - start < 20


def test_tags_that_do_not_end_are_text():
    for html, want in {
        "a < b <i>c</i> <p": "a < b c <p",
        "<p>one <a href='x>y'>two</a> <b \"three</p>": "one two <b \"three",
        "x <a \"b <p>c": "x <a \"b\nc",
        "<a\"x y\">z": "z",
    }.items():
        assert "\n".join(x.text for x in pages.lines(html)) == want


def test_deep_elements_clear_those_around_them():
    depth = 30_000
    html = "<div class=ad>" * depth + "<main>inside</main>" + "</div>" * depth
    assert [(x.text, x.furniture) for x in pages.lines(html)] == [("inside", False)]
    html = "<div class=ad>" * depth + "lost" + "</div>" * depth + "<p>kept"
    assert [(x.text, x.furniture) for x in pages.lines(html)] == [("lost", True), ("kept", False)]


def test_hash_bound_keeps_the_smallest(spark):
    place = F.xxhash64("id")
    for n, wanted in ((50, 30), (1000, 40), (20_000, 40)):
        rows = spark.range(n)
        near = under_hash_bound(rows, place, wanted)
        first = [r["id"] for r in rows.orderBy(place).limit(wanted).collect()]
        assert [r["id"] for r in near.orderBy(place).limit(wanted).collect()] == first
        assert near.count() <= max(n if n <= 4 * wanted else 0, 5 * wanted)
    # Rows of one hash alone: too few are under the bound, so all are taken.
    same = spark.range(1000).select(F.lit(5).alias("id"))
    assert under_hash_bound(same, place, 10).count() in (0, 1000)
    assert under_hash_bound(same, place, 10).limit(10).count() == 10


def test_token_cache_is_bounded_by_its_text():
    made = []
    cache = Cache(lambda unit: made.append(unit) or len(unit), entries=50)
    for k in range(2000):
        assert cache[f"{k:040d}"] == 40
        assert len(cache) <= 50
    assert cache["x" * 5000] == 5000 and "x" * 5000 not in cache
    cache.learn(["ab", "y" * 900], [1, 2])
    assert cache["ab"] == 1 and "y" * 900 not in cache
    before = len(made)
    assert cache["ab"] == 1 and len(made) == before


def test_texts_without_spaces_are_not_kept():
    own = bpe.Tokenizer(bpe.default_vocabulary())
    words = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(8)
    for _ in range(20):
        text = "".join(rng.choice("abcdefghij") for _ in range(5000))
        own.encode(text)
        words.encode(text)
    kept = [own.pieces, own.first, own.after_space, words.runs, words.units]
    assert sum(len(unit) for cache in kept for unit in cache) < 5000


@pytest.mark.parametrize("seed", range(3))
def test_packing_ids_are_those_of_the_library(seed):
    """Plain stretches, odd units beside them, all kinds of white space; runs of letters skip the library's encoding."""
    own = packing.WordTokenizer(packing.default_vocabulary())
    rng = random.Random(seed)
    odd = " \t\n\x0b\f\r\x1c\x85\xa0\u200bİıſßẞÀéÿ×÷ĀįĮŁABC.,;:!?*#$%&()|-'\"01_@漢é😀"
    words = ["".join(rng.choices("abcdefghijéßñäøœī", k=rng.randrange(1, 12))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=60)).capitalize() + "." for _ in range(40)]
    texts += ["".join(rng.choices(odd + "abcd  ", k=rng.randrange(40))) for _ in range(800)]
    for text in texts:
        want = own.tokenizer.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == want
    calls, whole = [], own._ids
    own._ids = lambda text: calls.append(text) or whole(text)
    own.runs.make = own._run
    own.encode(" ".join("".join(rng.choices("klmnopqrstéüñ", k=15)) for _ in range(100)))
    assert not calls


@pytest.mark.parametrize("seed", range(4))
def test_beliefs_equal_enumeration(seed):
    """On trees of links of all kinds loopy message passing gives the exact marginals."""
    rng = np.random.default_rng(seed)
    n, k = 6, len(pii.LABELS)
    index = {f"f{i}": i for i in range(5)}
    model = pii.Model(
        index, rng.normal(size=(5, k)), rng.normal(size=(k, k)), rng.normal(size=(k, k)) + 1
    )
    links = [(int(rng.integers(0, j)), j, int(rng.integers(0, 3))) for j in range(1, n)]
    graph = SimpleNamespace(
        nodes=[(i, i + 1, i) for i in range(n)],
        features=[[f"f{x}" for x in rng.choice(5, 2, replace=False)] for _ in range(n)],
        observed=[int(rng.integers(0, k)) if i in (1, 4) else -1 for i in range(n)],
        **{name: [(i, j) for i, j, t in links if t == c] for c, name in enumerate(("chain", "skip", "far"))},
        longest=n,
    )
    exact = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        if any(o >= 0 and o != x for o, x in zip(graph.observed, labels)):
            continue
        score = sum(model.unary[index[f], x] for fs, x, o in zip(graph.features, labels, graph.observed) if o < 0 for f in fs)
        for i, j, t in links:
            score += (model.chain if t == 0 else model.skip)[labels[i], labels[j]]
        exact[np.arange(n), labels] += np.exp(score)
    exact /= exact.sum(axis=1, keepdims=True)
    assert np.allclose(model.beliefs([graph]), exact, atol=5e-3)


def test_links_of_earlier_steps_are_not_walked_again(spark, monkeypatch):
    """Each step joins the classes so far; walking all links anew grew with the links times the steps."""
    rng = random.Random(3)
    chain = [[f"w{rng.randrange(10**6)}" for _ in range(120)]]
    for _ in range(59):
        words = list(chain[-1])
        words[rng.randrange(120)] = f"w{rng.randrange(10**6)}"
        chain.append(words)
    walked, walk, centred = [], near_copies.components, near_copies._with_centre

    def counted(links):
        walked.append({(bytes(r["a"]), bytes(r["b"])) for r in links.collect()})
        return walk(links)

    # Half of the pairs are not looked at in the first steps, so that later ones find links too.
    half = F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 0
    monkeypatch.setattr(near_copies, "_with_centre", lambda *args: centred(*args).where(half))
    monkeypatch.setattr(near_copies, "components", counted)
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(chain)], "doc_id long, text string")
    got = near_copies.near_classes(docs).collect()
    assert len(got) == 60 and {r["class_id"] for r in got} == {0}
    assert len(walked) > 1
    for k, links in enumerate(walked[1:], 1):
        assert not links & set().union(*walked[:k])
        assert len(links) < len(walked[0])

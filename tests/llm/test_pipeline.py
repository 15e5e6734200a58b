"""Every stage of the pipeline against what it must do to its own input."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

from sigloom.llm import near_copies, pii, quality, substrings
from sigloom.llm.common import read_table, saved
from tests.llm.test_text_operators import (
    SMALL,
    awkward,
    copies_by_brute_force,
    packed_by_brute_force,
    prose,
    repeated_by_brute_force,
    COLUMNS,
)


def stages(spark, docs):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(saved(stage(spark, out[-1], SMALL), name))
    return out


def test_stages_take_effect(spark):
    docs = read_table(spark, SMALL, "documents")
    raw, good, single, stripped, clean, packed = stages(spark, docs)
    kept = {r["doc_id"] for r in quality.quality(raw).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept and good.columns == raw.columns
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    classes = copies_by_brute_force(texts.items())
    assert {r["doc_id"] for r in single.collect()} == set(classes.values())
    want = repeated_by_brute_force([(r["doc_id"], r["text"]) for r in single.collect()])
    left = {r["doc_id"]: r["text"].split() for r in stripped.collect()}
    assert {i: len(w) for i, w in left.items()} == {
        i: n - gone for i, (n, gone, _) in want.items() if n > gone
    }
    assert all(not pii.base_spans(r["text"]) for r in clean.collect())
    assert clean.columns == raw.columns and clean.count() == stripped.count()
    lengths = [r["length"] for r in packed.collect()]
    used = packed.select("sequence_id").distinct().count()
    assert used == len(packed_by_brute_force(lengths, 2048))


@pytest.mark.parametrize("rows", [[], awkward()])
def test_awkward_and_empty_tables(spark, rows):
    read_table(spark, SMALL, "documents")
    *before, packed = stages(spark, spark.createDataFrame(rows, COLUMNS))
    assert all(x.columns == before[0].columns for x in before)
    packed.count()


def test_one_of_each_goes_by_text(spark):
    read_table(spark, SMALL, "documents")
    rng = random.Random(8)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (-5, c), (3, c), (None, c), (None, d), (None, d), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(1, a), (1, b), (-5, c), (None, d), (None, "")], key=repr)
    assert sorted(map(tuple, near_copies.one_of_each(docs).collect()), key=repr) == want
    classes = {(r["doc_id"], r["class_id"]) for r in near_copies.near_classes(docs).collect()}
    assert {(1, 1), (-5, -5), (3, -5), (None, -5)} <= classes and len(classes) == 6


def test_text_without_words():
    assert substrings.without("a  b\nc d", [{"start": 1, "windows": 1 - substrings.WINDOW + 1}]) == "a\nc d"

"""Quality rules: counts of a text and its divergence from language references.

A document's histogram over character classes and its histogram over the common words of a
language are compared with references of that language by Jensen-Shannon distance (square root of
the divergence in bits, 0 to 1).  Everything is DataFrame expressions: a document is measured
within its own row, so the only exchanges are those of the references, one row per language, and of
word counts of languages that have no list in ``COMMON_WORDS``: their common words are the
commonest of their own documents.

Null text counts as empty: no words, ``base_failed``.  Rows are judged one by one, so repeated
rows and null ids keep one result each.  Extra input columns are ignored by ``quality``.  A document
whose label has no reference, as when no document of that label passes the base rules, is
judged by the base rules only; one without a label is compared with all references.

Texts are read whole, whatever their length.  An empty table gives no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigloom.llm.common import saved

# The commonest function words of four languages, as in public word lists.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "en": "the of and to in a is that for it as was with be by on this are from at or".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par pas au sur ne elle".split(),
}
CLASSES = ["n_white", "n_lower", "n_upper", "n_digit", "n_point", "n_other"]

#: Words in a repeated window, minimum words, and the method's own parameters.
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_CHARS_FOR_CLASSES = 200
MIN_WORDS_FOR_COMMON = 80
MAX_CLASS_DISTANCE = 0.22
MAX_WORD_DISTANCE = 0.33
#: Common words of a language without a list, as many as the lists have.
LEARNED_WORDS = 25

GAP = r"[\x20\x09-\x0D]+"


def _distinct_windows(words: Column) -> Column:
    """A 64-bit hash of every window of five words."""
    starts = F.when(
        F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(words[i + k] for k in range(WINDOW))))


def measures(docs: DataFrame, common: dict[str, list[str]] = COMMON_WORDS) -> DataFrame:
    """doc_id, lang, n_chars, the base counts, character classes, and counts of common words.

    ``common`` has the common words of each language.
    """
    counted = all_words(common)
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    no_words = F.array().cast("array<string>")
    step = docs.select(
        "doc_id",
        "lang",
        text.alias("text"),
        F.when(trimmed == "", no_words).otherwise(F.split(trimmed, GAP)).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "").alias("spelled"),
        F.regexp_replace(text, r"[\p{Ll}\x20\x09-\x0D]+", "").alias("rest"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).alias("n_symbols"),
    )
    step = step.select(
        "doc_id",
        "lang",
        "n_symbols",
        "words",
        F.length("text").alias("n_chars"),
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _distinct_windows(F.col("words")).alias("windows"),
        F.size("spelled").alias("n_spelled"),
        F.filter("spelled", lambda w: w.isin(counted)).alias("common"),
        "rest",
        F.regexp_replace("rest", r"\p{Lu}+", "").alias("no_upper"),
    )
    step = step.select(
        "*",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("sorted"),
        F.regexp_replace("no_upper", r"\p{Nd}+", "").alias("no_digit"),
    )
    ordered = F.col("sorted")
    repeated = F.filter(
        F.transform(
            ordered,
            lambda s, k: F.when(
                ((k > 0) & (F.get(ordered, k - 1)["h"] == s["h"]))
                | ((k < F.size(ordered) - 1) & (F.get(ordered, k + 1)["h"] == s["h"])),
                s["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    step = step.select(
        "*",
        F.sort_array(repeated).alias("at"),
        F.length(F.regexp_replace("no_digit", r"[.,;:!?'\"()\-]+", "")).alias("n_other"),
    )
    at = F.col("at")
    covered = F.aggregate(
        F.transform(
            at,
            lambda i, k: F.when(
                k < F.size(at) - 1, F.least(F.lit(WINDOW), F.get(at, k + 1) - i)
            ).otherwise(F.lit(WINDOW)),
        ),
        F.lit(0),
        lambda total, x: total + x,
    )
    return step.select(
        "doc_id",
        "lang",
        *(F.col(c).cast("long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.col("n_chars").cast("long"),
        (F.col("n_chars") - F.col("word_chars")).cast("long").alias("n_white"),
        (F.col("word_chars") - F.length("rest")).cast("long").alias("n_lower"),
        (F.length("rest") - F.length("no_upper")).cast("long").alias("n_upper"),
        (F.length("no_upper") - F.length("no_digit")).cast("long").alias("n_digit"),
        (F.length("no_digit") - F.col("n_other")).cast("long").alias("n_point"),
        F.col("n_other").cast("long"),
        F.col("n_spelled").cast("long"),
        F.array(
            *(
                (F.size("common") - F.size(F.array_remove("common", w))).cast("long")
                for w in counted
            )
        ).alias("common"),
    )


def all_words(common: dict[str, list[str]]) -> list[str]:
    return sorted({w for words in common.values() for w in words})


def common_words(docs: DataFrame) -> dict[str, list[str]]:
    """The lists, and for each other label the commonest words of its documents.

    Only documents that pass the base rules count.  The rows of one label that reach the driver are
    as many as its common words.
    """
    other = docs.where(F.col("lang").isNotNull() & ~F.col("lang").isin(list(COMMON_WORDS)))
    if other.isEmpty():
        return COMMON_WORDS
    measured = measures(other.select(F.col("text").alias("doc_id"), "text", "lang"))
    counts = (
        saved(measured.select("doc_id", "lang", "n_words", "n_repeat_words"), "labelled")
        .where(~base_failed())
        .select("lang", F.explode(F.split(F.lower("doc_id"), r"[^\p{L}]+")).alias("word"))
        .where(F.col("word") != "")
        .groupBy("lang", "word")
        .count()
    )
    commonest = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    found = (
        counts.withColumn("n", F.row_number().over(commonest))
        .where(F.col("n") <= LEARNED_WORDS)
        .collect()
    )
    out = dict(COMMON_WORDS)
    for row in sorted(found, key=lambda r: (r["lang"], r["n"])):
        out.setdefault(row["lang"], []).append(row["word"])
    return out


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def references(
    measured: DataFrame, common: dict[str, list[str]] = COMMON_WORDS
) -> dict[str, tuple[list[int], list[int]]]:
    """For each language of ``common`` its class counts and its common-word counts with the rest.

    Summed over all labelled documents that pass the base rules.  One row per language reaches the
    driver, whatever the size of the corpus.
    """
    counted = all_words(common)
    sums = (
        measured.where(F.col("lang").isin(list(common)) & ~base_failed())
        .groupBy("lang")
        .agg(
            *(F.sum(c).alias(c) for c in CLASSES),
            F.sum("n_spelled").alias("n_spelled"),
            *(F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(len(counted))),
        )
        .collect()
    )
    out = {}
    for row in sorted(sums, key=lambda r: r["lang"]):
        words = [row[f"w{counted.index(w)}"] for w in common[row["lang"]]]
        if row["n_spelled"]:
            out[row["lang"]] = [row[c] for c in CLASSES], [*words, row["n_spelled"] - sum(words)]
    return out


def js_distance(counts: Column, reference: list[int]) -> Column:
    """Jensen-Shannon distance of an array of counts from a reference histogram of its length."""
    whole = float(sum(reference))
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    parts = F.zip_with(
        F.transform(counts, lambda c: c / total),
        F.array(*(F.lit(x / whole) for x in reference)),
        lambda p, q: term(p, (p + q) / 2) + term(q, (p + q) / 2),
    )
    divergence = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2
    return F.sqrt(F.greatest(F.least(divergence, F.lit(1.0)), F.lit(0.0)))


def _nearest(distances: list[Column]) -> Column:
    return F.least(*distances) if len(distances) > 1 else distances[0]


def judged(
    measured: DataFrame,
    refs: dict[str, tuple[list[int], list[int]]],
    common: dict[str, list[str]] = COMMON_WORDS,
) -> DataFrame:
    """The measures with both distances and the verdict; a distance under its guard is null.

    A document is compared with all languages and belongs to the nearest, so a wrong or missing
    label does not reject it.  Under a label without reference both distances are null.
    """
    counted = all_words(common)
    classes = words = F.lit(None).cast("double")
    if refs:
        spelled = F.col("n_spelled")
        known = F.col("lang").isNull() | F.col("lang").isin(list(refs))
        long_enough = known & (F.col("n_chars") >= MIN_CHARS_FOR_CLASSES)
        classes = F.when(
            long_enough,
            _nearest([js_distance(F.array(*CLASSES), r[0]) for r in refs.values()]),
        )
        by_language = []
        for lang, (_, reference) in refs.items():
            counts = [F.col("common")[counted.index(w)] for w in common[lang]]
            rest = spelled - reduce(lambda a, b: a + b, counts)
            by_language.append(js_distance(F.array(*counts, rest), reference))
        words = F.when(known & (spelled >= MIN_WORDS_FOR_COMMON), _nearest(by_language))
    divergent = F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) | F.coalesce(
        F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False)
    )
    return (
        measured.withColumn("class_distance", F.round(classes, 6))
        .withColumn("word_distance", F.round(words, 6))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~divergent)
    )


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, ``base_failed``, ``kept`` and the two distances."""
    common = common_words(docs)
    measured = saved(measures(docs.select("doc_id", "text", "lang"), common), "quality")
    return judged(measured, references(measured, common), common).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "class_distance",
        "word_distance",
    )


def accepted(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, that the rules keep."""
    named = docs.select(
        F.struct("*").alias("row"),
        F.coalesce("doc_id", F.lit(-(2**63))).alias("key"),
        F.xxhash64("text", "lang").alias("version"),
    )
    judged_rows = judged_by_row(docs).where("kept")
    return named.join(judged_rows, ["key", "version"], "left_semi").select("row.*")


def judged_by_row(docs: DataFrame) -> DataFrame:
    """(key, version, kept): the verdict by id and a hash of text and label."""
    keyed = docs.select(
        F.struct(
            F.coalesce("doc_id", F.lit(-(2**63))).alias("key"),
            F.xxhash64("text", "lang").alias("version"),
        ).alias("doc_id"),
        "text",
        "lang",
    )
    common = common_words(docs)
    measured = saved(measures(keyed, common), "quality")
    verdicts = judged(measured, references(measured, common), common)
    return verdicts.select("doc_id.key", "doc_id.version", "kept")

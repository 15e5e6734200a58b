"""The text operators over their whole tables, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import (
    bpe,
    fingerprints,
    language,
    near_copies,
    packing,
    pages,
    pii,
    prefix_trie,
    quality,
    secrets,
    spellings,
    substrings,
    toxicity,
)
from sigloom.llm.common import read_table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"))


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_classes(read_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(read_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(read_table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.kept_words(read_table(spark, sf_dir, "documents"))


def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(read_table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(read_table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(read_table(spark, sf_dir, "conversations"))


def op13_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.variants(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_near_copies,
        op3_packing,
        op4_secrets,
        op5_language,
        op6_substrings,
        op7_pages,
        op8_bpe,
        op9_pii,
        op10_fingerprints,
        op11_toxicity,
        op12_prefix_trie,
        op13_spellings,
    )
}

_WORDS = r"""list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""


def _quality_sql() -> str:
    """The quality rules relationally: windows as groups, histograms as rows, distances as sums."""
    words = ", ".join(
        f"('{lang}', '{w}')" for lang, ws in quality.COMMON_WORDS.items() for w in ws
    )
    term = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((p + q) / 2)) ELSE 0 END"
    distance = f"round(sqrt(least(greatest(sum({term.format('p')} + {term.format('q')}) / 2, 0), 1)), 6)"
    return rf"""
WITH common_words(lang, word) AS (VALUES {words}),
split AS (
    SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
           list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}]+'),
                       lambda x: x <> '') AS spelled
    FROM documents),
starts AS (
    SELECT doc_id, p, words[p : p + {quality.WINDOW - 1}] AS w
    FROM split, unnest(range(1, len(words) - {quality.WINDOW - 2})) AS t(p)),
repeated AS (
    SELECT doc_id, count(DISTINCT p + k) AS n
    FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w) AS times FROM starts),
         unnest(range(0, {quality.WINDOW})) AS t(k)
    WHERE times > 1 GROUP BY doc_id),
counted AS (
    SELECT s.doc_id, s.lang, spelled, len(words) AS n_words, len(spelled) AS n_spelled,
           length(text) AS n_chars,
           coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           coalesce(r.n, 0) AS n_repeat_words,
           length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS n_white,
           length(regexp_replace(text, '[^\p{{Ll}}]', '', 'g')) AS n_lower,
           length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS n_upper,
           length(regexp_replace(text, '[^\p{{Nd}}]', '', 'g')) AS n_digit,
           length(regexp_replace(text, '[^.,;:!?''"()-]', '', 'g')) AS n_point,
           length(regexp_replace(text, '[\x20\x09-\x0D\p{{Ll}}\p{{Lu}}\p{{Nd}}.,;:!?''"()-]', '', 'g')) AS n_other
    FROM split AS s LEFT JOIN repeated AS r ON r.doc_id = s.doc_id),
judged AS (
    SELECT *, n_words < {quality.MIN_WORDS}
              OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed
    FROM counted),
class_counts AS (
    UNPIVOT (SELECT doc_id, lang, base_failed, n_chars, {', '.join(quality.CLASSES)} FROM judged)
    ON {', '.join(quality.CLASSES)} INTO NAME item VALUE n),
spoken AS (SELECT doc_id, lang, base_failed, n_spelled, unnest(spelled) AS word FROM judged),
doc_words AS (SELECT doc_id, word, count(*) AS n FROM spoken GROUP BY ALL),
doc_common AS (
    SELECT d.doc_id, c.lang, c.word AS item, coalesce(w.n, 0) AS n
    FROM judged AS d CROSS JOIN common_words AS c
    LEFT JOIN doc_words AS w ON w.doc_id = d.doc_id AND w.word = c.word),
word_counts AS (
    FROM doc_common
    UNION ALL
    SELECT c.doc_id, c.lang, NULL, d.n_spelled - sum(c.n)
    FROM doc_common AS c JOIN judged AS d ON d.doc_id = c.doc_id
    GROUP BY c.doc_id, c.lang, d.n_spelled),
class_refs AS (
    SELECT lang, item, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM class_counts
    WHERE NOT base_failed AND lang IN (SELECT lang FROM common_words) GROUP BY lang, item),
word_refs AS (
    SELECT w.lang, w.item, sum(w.n) / sum(sum(w.n)) OVER (PARTITION BY w.lang) AS q
    FROM word_counts AS w JOIN judged AS d ON d.doc_id = w.doc_id AND d.lang = w.lang
    WHERE NOT d.base_failed GROUP BY w.lang, w.item),
class_distances AS (
    SELECT doc_id, r.lang, {distance} AS js
    FROM (SELECT doc_id, item, n / n_chars AS p FROM class_counts
          WHERE n_chars >= {quality.MIN_CHARS_FOR_CLASSES}) AS c
    JOIN class_refs AS r ON r.item = c.item GROUP BY doc_id, r.lang),
word_distances AS (
    SELECT c.doc_id, r.lang, {distance} AS js
    FROM (SELECT w.*, w.n / d.n_spelled AS p
          FROM word_counts AS w JOIN judged AS d ON d.doc_id = w.doc_id
          WHERE d.n_spelled >= {quality.MIN_WORDS_FOR_COMMON}) AS c
    JOIN word_refs AS r ON r.lang = c.lang AND r.item IS NOT DISTINCT FROM c.item
    GROUP BY c.doc_id, r.lang),
nearest AS (
    SELECT d.doc_id,
           (SELECT min(js) FROM class_distances AS x WHERE x.doc_id = d.doc_id) AS class_distance,
           (SELECT min(js) FROM word_distances AS x WHERE x.doc_id = d.doc_id) AS word_distance
    FROM judged AS d)
SELECT d.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(class_distance <= {quality.MAX_CLASS_DISTANCE}, true)
                       AND coalesce(word_distance <= {quality.MAX_WORD_DISTANCE}, true) AS kept,
       class_distance, word_distance
FROM judged AS d JOIN nearest AS n ON n.doc_id = d.doc_id
"""


def _substrings_sql() -> str:
    w = substrings.WINDOW
    return rf"""
WITH split AS (SELECT doc_id, {_WORDS} AS words FROM documents),
starts AS (
    SELECT doc_id, p, words[p : p + {w - 1}] AS w
    FROM split, unnest(range(1, len(words) - {w - 2})) AS t(p)),
later AS (
    SELECT doc_id, p FROM starts
    QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1),
covered AS (SELECT DISTINCT doc_id, p + k AS p FROM later, unnest(range(0, {w})) AS t(k)),
kept AS (
    SELECT s.doc_id, string_agg(s.words[i.p], ' ' ORDER BY i.p) AS text, count(*) AS n
    FROM split AS s, unnest(range(1, len(s.words) + 1)) AS i(p)
    WHERE NOT EXISTS (FROM covered AS c WHERE c.doc_id = s.doc_id AND c.p = i.p)
    GROUP BY s.doc_id)
SELECT s.doc_id, len(s.words) AS n_words, len(s.words) - coalesce(k.n, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM split AS s LEFT JOIN kept AS k ON k.doc_id = s.doc_id
"""


ORACLES: dict[str, str] = {
    "op1_quality": _quality_sql(),
    "op6_substrings": _substrings_sql(),
}

"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of labelled text.  A text is lower-cased,
reduced to its letters, cut into blocks of one size and compressed with every dictionary; the
language with the fewest bytes over the whole text wins.  The margin over the runner-up gives the
score; a narrow one makes the answer unreliable (``accepted`` is false) without hiding it.

Dictionaries come from a bounded sample: per language the ``SAMPLE_DOCS`` labelled documents that are
first by a hash of their text, those of at least ``SAMPLE_MIN_CHARS`` characters before shorter ones,
``SAMPLE_CHARS`` characters from each, ``DICTIONARY_BYTES`` in all.  Every label is learned.

Null text, or one without a letter, is ``und`` with score 0.  Equal sizes go to the commoner
label.  Repeated rows and null ids keep one result each.  With no labelled text all is ``und``.

Texts are compressed whole, whatever their length.  An empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigloom.llm.common import by_batch, crc32_of_id, texts

UNKNOWN = "und"
SAMPLE_DOCS = 700
SAMPLE_MIN_CHARS = 200
SAMPLE_CHARS = 400
DICTIONARY_BYTES = 200_000
LEVEL = 6
BLOCK = 2048
NARROW = 0.02

_NO_LETTER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return _NO_LETTER.sub(" ", text.lower()).strip().encode()


def dictionaries(labelled: DataFrame) -> dict[str, bytes]:
    """For each label its dictionary, commonest label first.  ``labelled`` has text and lang."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = known.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    order = [r["lang"] for r in shares.collect()]
    first = Window.partitionBy("lang").orderBy("short", "at", "text")
    sample = (
        known.select(
            "lang",
            (F.length("text") < SAMPLE_MIN_CHARS).alias("short"),
            F.xxhash64("text").alias("at"),
            F.left("text", F.lit(SAMPLE_CHARS)).alias("text"),
        )
        .distinct()
        .withColumn("n", F.row_number().over(first))
        .where(F.col("n") <= SAMPLE_DOCS)
        .collect()
    )
    parts: dict[str, list[bytes]] = {lang: [] for lang in order}
    for row in sorted(sample, key=lambda r: r["n"]):
        parts[row["lang"]].append(letters(row["text"]))
    return {k: b" ".join(v)[:DICTIONARY_BYTES] for k, v in parts.items()}


class Compressors:
    def __init__(self, contents: dict[str, bytes]):
        import zstandard

        self.by_language = {}
        for lang, content in contents.items():
            options = {}
            if len(content) >= 8:  # the library takes no shorter dictionary
                own = zstandard.ZstdCompressionDict(
                    content, dict_type=zstandard.DICT_TYPE_RAWCONTENT
                )
                own.precompute_compress(level=LEVEL)
                options["dict_data"] = own
            self.by_language[lang] = zstandard.ZstdCompressor(
                level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False,
                **options,
            )

    def sizes(self, text: bytes) -> list[tuple[int, str]]:
        """Bytes and label, the fewest first; labels are in order of their share."""
        blocks = [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)]
        sizes = [
            (sum(len(c.compress(b)) for b in blocks), lang) for lang, c in self.by_language.items()
        ]
        return sorted(sizes, key=lambda x: x[0])


@functools.lru_cache(1)
def _compressors(contents: tuple[tuple[str, bytes], ...]) -> Compressors:
    return Compressors(dict(contents))


def _predicted(batch, contents) -> dict[str, list]:
    own = _compressors(contents.value)
    out = {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out")}
    labels, scores, accepted = [], [], []
    for text in texts(batch):
        spelled = letters(text)
        sizes = own.sizes(spelled) if spelled else []
        if not sizes:
            labels.append(UNKNOWN)
            scores.append(0.0)
            accepted.append(False)
            continue
        margin = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
        labels.append(sizes[0][1])
        scores.append(margin / (margin + NARROW))
        accepted.append(margin >= NARROW)
    return out | {"lang_pred": labels, "score": scores, "accepted": accepted}


def held_out() -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(crc32_of_id() % 3 == 1, F.lit(True))


def languages(docs: DataFrame) -> DataFrame:
    """Per document ``held_out``, ``lang_pred``, ``score`` and ``accepted``."""
    marked = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    contents = dictionaries(marked.where(~F.col("held_out")).select("text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(contents.items()))
    return by_batch(
        marked.select("doc_id", "text", "held_out"),
        "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean",
        _predicted,
        shared,
    )

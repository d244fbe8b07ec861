"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of sample texts.  A
text is compressed in blocks with every dictionary; the language whose bytes
are fewest is chosen, and the choice is rejected where the margin to the next
is narrow (``rejected``; the label stays, callers may drop it).

Only the dictionaries use a sample: of each language's texts with a letter the
``SAMPLE`` of the least hash of their id, joined and cut at ``DICTIONARY``
bytes.  What goes to the driver and to every task is ``DICTIONARY`` bytes for
each different value of ``lang``; a text is compressed once with each.

Defined results.  Null texts and texts without a letter get ``und`` and score
0.  Equal sizes choose the language of the least name.  Without training rows
every text gets ``und``; a language whose training texts have no letter is not
learned.  Rows are independent; null ids are not held out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, has_letter, plain, rows_of

SAMPLE, DICTIONARY = 120, 96 << 10
BLOCK, LEVEL = 512, 7
#: Margins below this share of the runner-up's size are rejected.
NARROW = 0.01


def letters(text: str, others=re.compile(r"[\W\d_]+")) -> bytes:
    """Lower-cased letters with a space for whatever lies between: case, figures and symbols tell no language."""
    return others.sub(" ", text.lower()).encode("utf-8", "replace")


class Classifier:
    """One compressor for each language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.compress = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False).compress)

    def sizes(self, text: str) -> list[int]:
        data = letters(text)
        blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        return [sum(len(c(b)) for b in blocks) for c in self.compress]

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (0 to 1: the margin's share of the runner-up), whether the margin is too narrow."""
        if not self.names or text is None or not has_letter(text):
            return "und", 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for i, s in enumerate(sizes) if i != best]
        margin = (min(rest) - sizes[best]) / min(rest) if rest else 1.0
        return self.names[best], margin, margin < NARROW


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, training: Column) -> Classifier:
    """Dictionaries from the rows that ``training``, a condition on doc_id, admits."""
    return Classifier(dictionaries(docs, training))


def dictionaries(docs: DataFrame, training: Column) -> dict[str, bytes]:
    """A dictionary for each language, from two passes over the documents, however many languages there are.

    The first ranks each language's texts that hold a letter by hash, on narrow
    rows and with the rank limited before they are moved; the second fetches the
    texts of those chosen.
    """
    known = plain(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & training & F.col("text").rlike(r"\p{L}"))
    known = known.withColumn("th", F.xxhash64("text"))
    least = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "th")
    chosen = known.select("lang", "doc_id", "th", F.row_number().over(least).alias("rank")).where(F.col("rank") <= SAMPLE)
    chosen = chosen.groupBy("lang", "doc_id", "th").agg(F.min("rank").alias("rank"))  # rows that repeat give one text
    fetched = known.join(chosen, ["lang", "doc_id", "th"]).dropDuplicates(["lang", "rank"])
    sample = fetched.select("lang", "rank", F.substring("text", 1, DICTIONARY).alias("text")).repartition("lang")
    schema = pa.schema([("lang", pa.string()), ("content", pa.binary())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for lang, group in groupby(rows_of(batches, "lang", "text"), key=lambda r: r[0]):
                held = bytearray()
                for _, text in group:
                    if len(held) < DICTIONARY:
                        held += letters(text) + b"\n"
                yield lang, bytes(held[:DICTIONARY])

        return batched(rows(), schema, 64)

    joined = sample.sortWithinPartitions("lang", "rank").select("lang", "text").mapInArrow(join, "lang string, content binary")
    return {r[0]: bytes(r[1]) for r in joined.toLocalIterator()}  # DICTIONARY bytes a language at most


def classify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)  # of bounded size
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(sent.value)
        return batched(((doc, *own.classify(text)) for doc, text in rows_of(batches, "doc_id", "text")), schema)

    out = plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def identify(docs: DataFrame) -> DataFrame:
    return classify(docs, dictionaries(docs, ~held_out(F.col("doc_id"))))

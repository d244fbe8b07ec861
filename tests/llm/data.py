"""Small tables for the operators: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone Light house under walking bright morning café über niño soleil".split()


def prose(seed: int, n: int = 60) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(9)) * draw.randrange(2) for _ in range(n))


def rows() -> list[tuple]:
    shared = prose(99, 40)
    texts = [prose(i) for i in range(12)]
    texts += [texts[0], texts[0].upper(), texts[1].replace("river", "lake"), "", None, " \n\t", "x", "a" * 300, "日本語😀" * 30]
    texts += [prose(50) + " " + shared + " " + prose(51), shared, prose(52) + shared, prose(53, 9000)]
    out = [(i, t, ("en", "fr", None)[i % 3], f"src{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, texts[2], "en", None, 1), (None, None, None, None, None)]


def table(spark, some: list[tuple] | None = None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)


def clashing(docs):
    """The same rows with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    for name in ("fp", "fp_len", "node", "h", "p", "part", "key", "bucket", "target", "length", "n", "pid", "seq", "items", "w", "x"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs

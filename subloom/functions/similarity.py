"""Sequence similarity (F15): the one scalar without a built-in form.

The ratio is that of Python's ``difflib``: it depends on the order of its
arguments and ignores popular characters from 200 characters on, so an edit
distance can't stand in for it.  Arrow batches carry the texts; equal texts skip
the comparison.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import merge_key


def plain_ratio(a: str, b: str) -> float:
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else plain_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts as they are; null with a null text."""
    return _ratio(a, b)


def similarity(a: Column, b: Column) -> Column:
    """Similarity of the merge keys, or of the texts where a key is empty."""
    x, y = merge_key(a), merge_key(b)
    keyed = (x != "") & (y != "")
    return _ratio(F.when(keyed, x).otherwise(a), F.when(keyed, y).otherwise(b))

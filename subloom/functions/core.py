"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_in(words: Column, vocabulary: Iterable[str]) -> Column:
    """How many items of an array are in a small fixed vocabulary."""
    known = sorted(vocabulary)
    return F.size(F.filter(words, lambda w: w.isin(known))) if known else F.lit(0)


def reasons(*pairs: tuple[str, Column]) -> Column:
    """The names whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]))


def ladder(*steps: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in steps:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))

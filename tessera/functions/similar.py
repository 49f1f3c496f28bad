"""Likeness of short texts: share of a longest common subsequence. Arrow batches, as no built-in function states it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common(a: str, b: str) -> int:
    """Length of a longest common subsequence: one integer holds a row of the table, a bit for each sign of a."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, sign in enumerate(a):
        places[sign] = places.get(sign, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for sign in b:
        met = row & places.get(sign, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def likeness(a: str, b: str) -> float:
    """0 to 100: twice the common signs of all signs; two empty texts are alike."""
    both = len(a) + len(b)
    return 100.0 * 2 * common(a, b) / both if both else 100.0


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """Likeness of two texts; null counts as empty."""
    return _ratio(a.cast("string"), b.cast("string"))


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Likeness whatever the order of the tokens."""
    return ratio(sorted_tokens(a), sorted_tokens(b))

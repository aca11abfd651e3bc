"""Similarity of two texts of one row: matching-blocks ratio, containment, version comparison."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _longest_match(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common run; of equals the first in a, then the first in b."""
    at, to, best = alo, blo, 0
    i = alo
    while i + best < ahi:
        # every run that is searched is one longer than the best, so native search passes over all that can't be better
        j = b.find(a[i : i + best + 1], blo, bhi)
        while j >= 0:
            n, most = best + 1, min(ahi - i, bhi - j)
            while n < most and a[i + n] == b[j + n]:
                n += 1
            at, to, best = i, j, n
            if i + best >= ahi:
                break
            j = b.find(a[i : i + best + 1], j + 1, bhi)
        i += 1
    return at, to, best


def matching_characters(a: str, b: str) -> int:
    """Characters in the matching blocks of two texts (Ratcliff-Obershelp): the longest common run, then left and right of it."""
    found, open_parts = 0, [(0, len(a), 0, len(b))]
    while open_parts:
        alo, ahi, blo, bhi = open_parts.pop()
        i, j, n = _longest_match(a, b, alo, ahi, blo, bhi)
        if n:
            found += n
            if alo < i and blo < j:
                open_parts.append((alo, i, blo, j))
            if i + n < ahi and j + n < bhi:
                open_parts.append((i + n, ahi, j + n, bhi))
    return found


def matching_ratio():
    """A pandas UDF: twice the matching characters over all (Ratcliff-Obershelp), 1.0 for two empty texts, null with a null.

    Characters are matched at every length, with the results of difflib's SequenceMatcher without autojunk.
    """

    def one(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        if a == b:
            return 1.0
        return round(2.0 * matching_characters(a, b) / (len(a) + len(b)), 6)

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    return ratio


def containment(old: Column, new: Column, shortest: int = 40, digits: int = 3) -> Column:
    """Share of old's lines of at least `shortest` characters that stand in new; 1.0 if there are none."""
    lines = F.filter(F.split(F.coalesce(old, F.lit("")), "\n"), lambda x: F.length(x) >= shortest)
    held = F.size(F.filter(lines, lambda x: F.contains(F.coalesce(new, F.lit("")), x)))
    return F.round(F.coalesce(F.try_divide(held.cast("double"), F.nullif(F.size(lines), F.lit(0)).cast("double")), F.lit(1.0)), digits)


def vocabulary_overlap(a: Column, b: Column, digits: int = 4) -> Column:
    """Shared over all distinct words of two word arrays; null if both are empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.round(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.nullif(F.size(F.array_union(x, y)), F.lit(0)).cast("double")), digits)

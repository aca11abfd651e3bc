"""Unicode compatibility forms: normalised in Arrow batches, and only where a text leaves ASCII."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _nfkc(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize("NFKC", t) for t in texts], dtype=object)


def nfkc(t: Column) -> Column:
    """t in the form NFKC. ASCII texts, which have no other form, never leave the JVM: only nulls of theirs reach Python."""
    return F.coalesce(F.pandas_udf(_nfkc, "string")(F.when(t.rlike(r"[^\x00-\x7f]"), t)), t)

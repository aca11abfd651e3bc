"""Accuracy audit: confusion, intervals, agreement, stratified samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatrix.functions.stats import wilson
from verbatrix.operators.relational import round_robin


def confusion(df: DataFrame, machine: str, human: str, labels: list[str]) -> DataFrame:
    """Counts of human labels (columns) by machine label; labels outside the list are left out, missing pairs are 0."""
    return df.filter(F.col(human).isin(*labels)).groupBy(machine).pivot(human, labels).agg(F.count(F.lit(1))).na.fill(0)


def accuracy(df: DataFrame, group: str, correct: str, digits: int = 6) -> DataFrame:
    """(group, n, hits, share, lower, upper) with Wilson intervals; null outcomes don't count."""
    counts = df.filter(F.col(correct).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("hits"))
    share, lower, upper = wilson(F.col("hits"), F.col("n"))
    return counts.select(group, "n", "hits", F.round(share, digits).alias("share"), F.round(lower, digits).alias("lower"), F.round(upper, digits).alias("upper"))


def stratified_sample(df: DataFrame, id_col: str, stratum: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in turn from all strata, in an order that hangs on the seed only: the same at every parallelism."""
    return round_robin(df, stratum, [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), F.col(id_col)], n)

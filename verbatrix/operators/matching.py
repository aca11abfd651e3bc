"""Matches by methods in order of trust, reviews of matches, exclusions that can be undone, resumed budgets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_priority(targets: DataFrame, methods: Sequence[tuple[str, float, DataFrame]], key: str = "target", id_col: str = "id") -> DataFrame:
    """(target, id, method, confidence) of every target by the first method that has a match for it.

    methods: (name, confidence, pairs of key and id), the most trusted first. A target with more than one match by that
    method is 'ambiguous', one without any 'unmatched'; both have no id and a confidence of 0. Repeated pairs count once.
    """
    kind = targets.schema[key].dataType.simpleString()
    marked = [pairs.select(key, F.col(id_col).alias("id"), F.lit(i).alias("p"), F.lit(name).alias("method"), F.lit(float(c)).alias("confidence")) for i, (name, c, pairs) in enumerate(methods)]
    every = reduce(DataFrame.unionByName, marked).filter(F.col("id").isNotNull())
    # one row a target and method, then one a target: no target's matches are gathered
    counted = every.groupBy(key, "p", "method", "confidence").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    best = counted.groupBy(key).agg(F.min(F.struct("p", "method", "confidence", "low", "high")).alias("b"))
    sure = F.col("b.low") == F.col("b.high")
    joined = targets.select(F.col(key).cast(kind)).distinct().join(best, key, "left")
    return joined.select(
        key, F.when(sure, F.col("b.low")).alias("id"), F.when(F.col("b").isNull(), "unmatched").when(sure, F.col("b.method")).otherwise("ambiguous").alias("method"), F.when(sure, F.col("b.confidence")).otherwise(F.lit(0.0)).alias("confidence")
    )


def reviewed(matches: DataFrame, review: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(applied, rejected, invalid) rows of a review sheet over matches (target, id).

    review: target, confirm, correct. A corrected id counts as it is, else the matched one if confirm opens with y; an id that
    known (id) lacks, or a target that matches lacks, is invalid; a row that opens with n is rejected; others are left out.
    """
    said = F.lower(F.trim(F.coalesce("confirm", F.lit(""))))
    rows = review.join(matches.select("target", F.col("id").alias("__matched"), F.lit(True).alias("__there")), "target", "left")
    rows = rows.withColumn("chosen", F.coalesce(F.nullif(F.trim("correct"), F.lit("")), F.when(F.startswith(said, F.lit("y")), F.col("__matched"))))
    rows = rows.join(known.select(F.col("id").alias("chosen"), F.lit(True).alias("__known")).distinct(), "chosen", "left")
    good = F.col("chosen").isNotNull() & F.coalesce("__known", F.lit(False)) & F.coalesce("__there", F.lit(False))
    return rows.filter(good).select("target", F.col("chosen").alias("id")), rows.filter(F.col("chosen").isNull() & F.startswith(said, F.lit("n"))).select("target"), rows.filter(F.col("chosen").isNotNull() & ~good).select("target", F.col("chosen").alias("id"))


def excluded_runs(log: DataFrame, run: str, action: str, order: Sequence[str]) -> DataFrame:
    """(run) of the runs whose last action is an exclusion: an undo takes it back, and a later exclusion counts again."""
    last = log.filter(F.col(run).isNotNull()).groupBy(run).agg(F.max_by(action, F.struct(*order)).alias("__last"))
    return last.filter(F.col("__last") == "exclude").select(run)

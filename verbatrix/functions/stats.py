"""Ratios, intervals and agreement as expressions and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b rounded; null where b is 0 or null."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """(share, lower, upper) of the Wilson score interval; nulls for n = 0."""
    k, m = successes.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p = k / m
    scale = 1 + z * z / m
    centre = (p + z * z / (2 * m)) / scale
    half = F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) * z / scale
    return p, F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def cohens_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, observed, expected, kappa) of two raters' labels; rows with a null label don't count; 1.0 if chance alone agrees."""
    counts = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    left = counts.groupBy(F.col("x").alias("label")).agg(F.sum("n").alias("na"))
    right = counts.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "label").agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("both"))
    po = F.try_divide(F.col("same").cast("double"), F.col("n").cast("double"))
    pe = F.try_divide(F.coalesce("both", F.lit(0.0)), F.col("n").cast("double") * F.col("n"))
    # two one-row tables: a broadcast of one row
    return total.join(F.broadcast(chance), F.lit(True)).select(
        F.coalesce("n", F.lit(0)).alias("n"), po.alias("observed"), pe.alias("expected"), F.when(pe == 1.0, F.lit(1.0)).otherwise(F.try_divide(po - pe, 1 - pe)).alias("kappa")
    )

"""Names matched approximately inside blocks, with a margin over the runner-up."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatrix.functions.text import organisation_name
from verbatrix.operators.sizing import join_measured, materialise


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _grams(name, size: int = 3):
    padded = F.concat(F.lit("^^"), name, F.lit("$$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - size + 1), lambda i: F.substring(padded, i, F.lit(size))))


def fuzzy_names(targets: DataFrame, known: DataFrame, block: str, least: float = 0.88, margin: float = 0.03) -> DataFrame:
    """(target, id, similarity) of the targets with one known name at least `least` alike and `margin` ahead of the next.

    targets: target, name, block; known: id, name, block. Similarity is the matching ratio of names in common form. Only
    names of a block that share one of their rarest three-letter runs are compared: names at least `least - margin` alike
    leave so few letters unmatched that of all runs but a fixed number one must be shared, so nothing is lost, and the
    runs that most names hold (university) bring no pairs together. Nulls and empty names match nothing.
    """
    floor = least - margin
    a = materialise(targets.select("target", organisation_name(F.col("name")).alias("a"), F.col(block).alias("block")).filter("a <> '' AND block IS NOT NULL"))
    b = materialise(known.select("id", organisation_name(F.col("name")).alias("b"), F.col(block).alias("block")).filter("b <> '' AND block IS NOT NULL"))
    grams = b.select("block", F.explode(_grams(F.col("b"))).alias("g")).groupBy("block", "g").agg(F.count(F.lit(1)).alias("n"))

    def rarest(df: DataFrame, key: str, name: str) -> DataFrame:
        each = df.select("block", key, F.length(name).alias("len"), F.explode(_grams(F.col(name))).alias("g"))
        ranked = join_measured(each, grams, ["block", "g"], "left").groupBy("block", key, "len").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g"))).alias("gs"))
        # letters unmatched on both sides, at most, and the blocks they leave: each costs two runs of its length
        unmatched = 2 * F.col("len") * (1 - floor) / floor
        shared = F.greatest(F.lit(1), F.floor(F.col("len") * floor / (2 - floor) - 2 * (unmatched + 1)).cast("int"))
        return ranked.select("block", key, F.explode(F.slice("gs", 1, F.greatest(F.lit(1), F.size("gs") - shared + 1))).alias("g")).select("block", key, "g.g")

    met = rarest(a, "target", "a").join(rarest(b, "id", "b"), ["block", "g"]).select("block", "target", "id").distinct()
    pairs = met.join(a, ["block", "target"]).join(b, ["block", "id"])
    close = pairs.filter(2 * F.least(F.length("a"), F.length("b")) >= floor * (F.length("a") + F.length("b")))
    scored = close.select("target", "id", F.pandas_udf(_ratio, "double")("a", "b").alias("r")).filter(F.col("r") >= floor)
    scored = materialise(scored)  # ratios are dear and read twice
    best = scored.groupBy("target").agg(F.max(F.struct("r", "id")).alias("best"))
    next_best = scored.join(best, "target").filter(F.col("id") != F.col("best.id")).groupBy("target").agg(F.max("r").alias("next"))
    sure = (F.col("best.r") >= least) & (F.col("next").isNull() | (F.col("best.r") - F.col("next") >= margin))
    return best.join(next_best, "target", "left").filter(sure).select("target", F.col("best.id").alias("id"), F.round("best.r", 4).alias("similarity"))

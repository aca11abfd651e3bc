"""Versions of a page, caches and resumable work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatrix.functions.text import compact_ws
from verbatrix.operators.similarity import matching_ratio, vocabulary_overlap

#: Two or three capitalised words, as a native pattern.
NAMES = r"\b([A-ZÀ-ÖØ-Þ][\p{L}’'-]+(?: [A-ZÀ-ÖØ-Þ]\.)? [A-ZÀ-ÖØ-Þ][\p{L}’'-]+)\b"


def person_names(text: Column, ordinary: Sequence[str] = ()) -> Column:
    """Distinct capitalised word pairs of a text, first seen first, without those that open with an ordinary word."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NAMES), 1))
    return F.filter(found, lambda n: ~F.lower(F.substring_index(n, " ", 1)).isin(*ordinary)) if ordinary else found


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def compare_versions(df: DataFrame, old: str, new: str, status: str | None = None, altered: float = 0.85, related: float = 0.6) -> DataFrame:
    """df with `observations`: unpublished, names_removed, content_altered, sorted.

    A text that is gone (null, blank or, with `status`, 404 or 410) is unpublished. Names count as removed if the texts
    still share their vocabulary; no name is put out, only how many. Altered is a matching ratio below the threshold.
    """
    gone = F.length(F.trim(F.coalesce(F.col(new), F.lit("")))) == 0
    if status:
        gone = gone | F.coalesce(F.col(status).isin(404, 410), F.lit(False))
    there = F.length(F.trim(F.coalesce(F.col(old), F.lit("")))) > 0
    lost = F.filter(person_names(F.col(old)), lambda n: ~F.contains(F.coalesce(F.col(new), F.lit("")), n))
    ratio = matching_ratio()(F.coalesce(F.col(old), F.lit("")), F.coalesce(F.col(new), F.lit("")))
    seen = df.withColumns({"names_lost": F.size(lost), "overlap": vocabulary_overlap(words(F.col(old)), words(F.col(new))), "ratio": ratio})
    kept = there & ~gone
    return seen.withColumn(
        "observations",
        F.array_compact(
            F.array(
                F.when(kept & (F.col("ratio") < altered), F.lit("content_altered")),
                F.when(kept & (F.col("names_lost") > 0) & (F.col("overlap") >= related), F.lit("names_removed")),
                F.when(there & gone, F.lit("unpublished")),
            )
        ),
    )


def cache_key(query: Column, n: Column) -> Column:
    """Hash of the query, lower case and with single blanks, and of how many results were asked."""
    return F.sha2(F.concat_ws("|", F.lower(compact_ws(query)), n.cast("string")), 256)


def fresh(stored: Column, now: Column, days: int) -> Column:
    """Is a stored time at most so many days old? Unreadable times are stale."""
    return F.coalesce(F.try_to_timestamp(stored.cast("string")) >= now - F.make_dt_interval(F.lit(days)), F.lit(False))


def cached(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(requests with their cached row, distinct requests that must be made): equal requests are made once."""
    return requests.join(cache, key), requests.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def remaining(items: DataFrame, log: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Items not done: what a resumed run works on. Running and failed ones are taken again."""
    return items.join(log.filter(F.col(status) == "done").select(key).distinct(), key, "left_anti")


def within_budget(items: DataFrame, cost: str, order: list[str], budget: float) -> DataFrame:
    """Items in order as long as the running cost stays within the budget."""
    from verbatrix.operators.relational import running_sum

    return running_sum(items, cost, order, "__spent").filter(F.col("__spent") <= budget).drop("__spent")


def best_excerpt(df: DataFrame, id_col: str, text: str, patterns: dict[str, float], shortest: int = 60, longest: int = 600) -> DataFrame:
    """(id, excerpt, score): the line with the highest weighted score among those of fitting length; the first of equals."""
    from verbatrix.functions.text import weighted_keywords

    lines = df.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line")).filter(F.length("line").between(shortest, longest))
    scored = lines.withColumn("score", weighted_keywords(F.col("line"), patterns)).filter("score > 0")
    return scored.groupBy(id_col).agg(F.max_by("line", F.struct("score", -F.col("pos"))).alias("excerpt"), F.max("score").alias("score"))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """old without the rows of every parent that new has rows for, and new: delete and insert again in one pass."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))

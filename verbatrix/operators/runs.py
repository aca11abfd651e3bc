"""Runs under way: heartbeats, progress, circuit breakers and pacing of hosts, as aggregates over their logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatrix.operators.relational import spread_rank


def active_runs(beats: DataFrame, run: str, ts: str, now: Column, seconds: int = 60) -> DataFrame:
    """(run, last, active): the last heartbeat of every run, active if it is younger than `seconds`; null runs and times don't count."""
    last = beats.filter(F.col(run).isNotNull() & F.col(ts).isNotNull()).groupBy(run).agg(F.max(ts).alias("last"))
    return last.withColumn("active", F.timestamp_diff("SECOND", F.col("last"), now) < seconds)


def progress(items: DataFrame, run: str, status: str, ts: str, total: int) -> DataFrame:
    """(run, done, failed, remaining, per_minute, minutes_left) of a log of items; rates are null before time has passed."""
    done, failed = F.count_if(F.col(status) == "done"), F.count_if(F.col(status) == "failed")
    rows = items.groupBy(run).agg(done.alias("done"), failed.alias("failed"), (F.timestamp_diff("SECOND", F.min(ts), F.max(ts)) / 60.0).alias("minutes"))
    rows = rows.withColumn("remaining", F.greatest(F.lit(0), F.lit(total) - F.col("done") - F.col("failed"))).withColumn("per_minute", F.try_divide(F.col("done").cast("double"), F.nullif("minutes", F.lit(0.0))))
    return rows.select(run, "done", "failed", "remaining", F.round("per_minute", 4).alias("per_minute"), F.round(F.try_divide(F.col("remaining").cast("double"), F.nullif("per_minute", F.lit(0.0))), 2).alias("minutes_left"))


def circuits(fetches: DataFrame, host: str, ts: str, ok: Column, now: Column, threshold: int = 5, cooldown: int = 300) -> DataFrame:
    """(host, failures, state) of every host: closed below `threshold` failures since its last success, else open until
    `cooldown` seconds after the last one, then half_open: one more fetch decides. Two aggregates, no host is gathered."""
    rows = fetches.filter(F.col(host).isNotNull() & F.col(ts).isNotNull()).select(host, F.col(ts).alias("__ts"), F.coalesce(ok, F.lit(False)).alias("__ok"))
    good = rows.filter("__ok").groupBy(host).agg(F.max("__ts").alias("__good"))
    bad = rows.filter("NOT __ok").join(good, host, "left").filter(F.col("__good").isNull() | (F.col("__ts") > F.col("__good"))).groupBy(host).agg(F.count(F.lit(1)).alias("failures"), F.max("__ts").alias("__last"))
    every = rows.select(host).distinct().join(bad, host, "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    waiting = F.timestamp_diff("SECOND", F.col("__last"), now) < cooldown
    return every.select(host, "failures", F.when(F.col("failures") < threshold, "closed").when(waiting, "open").otherwise("half_open").alias("state"))


def paced(items: DataFrame, host: str, order: list[Column], delay: float, at_once: int = 2) -> DataFrame:
    """items with `start`, the seconds from now at which each may begin: at most `at_once` of a host together, the next ones `delay` later."""
    rows = spread_rank(items, [host], order, "__place")
    return rows.withColumn("start", F.floor((F.col("__place") - 1) / at_once) * delay).drop("__place")


def first_and_last(versions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, first, last, versions): the earliest and latest version of every key as structs, for comparing; null keys are left out."""
    rest = F.struct(*(c for c in versions.columns if c != key))
    return versions.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(rest, F.struct(*order)).alias("first"), F.max_by(rest, F.struct(*order)).alias("last"), F.count(F.lit(1)).alias("versions"))


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key by `order`, with its place among the kept ones left to the caller's sort; one aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest)).select(*df.columns)

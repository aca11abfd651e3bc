"""Structured Streaming forms of the incremental operators: windows, sessions, late duplicates, change detection, upserts.

Event time needs a zoned timestamp, so TIMESTAMP_NTZ columns are cast first. All operators take and return streaming
DataFrames; `drain` runs one over what is there now and reads the result back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verbatrix.operators.relational import latest
from verbatrix.session import ensure_checkpoint_dir


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's part files as a stream, with the schema of the files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet*")


def tumbling(events: DataFrame, ts: str, keys: list[str], width: str, late: str) -> DataFrame:
    """(keys, window_start, n) of closed windows; rows later than `late` are dropped."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """(keys, session_start, session_end, n): runs of events with no gap of `gap` or more between them."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def late_dedupe(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """The first row of every key within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def changes(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, order, before, after) whenever a key's value differs from its last one; state holds the last value and its place.

    Within a micro-batch rows are taken in `order`; a row that comes in a later batch than one behind it is late and changes
    nothing. Null keys are one key, rows with a null order are left out.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place, last = state.get if state.exists else (None, None)
        out = []
        for at, now in sorted(((a, v) for f in frames for a, v in zip(f[order], f[value])), key=lambda x: x[0]):
            if place is not None and at < place:
                continue
            if last is not None and now != last:
                out.append((k[0], at, last, now))
            place, last = at, now
        if place is not None:
            state.update((place, last))
        yield pd.DataFrame(out, columns=[key, order, "before", "after"])

    schema = f"{key} {types[key]}, {order} {types[order]}, before {types[value]}, after {types[value]}"
    return rows.select(key, value, order).filter(F.col(order).isNotNull()).groupBy(key).applyInPandasWithState(step, schema, f"place {types[order]}, last {types[value]}", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now (availableNow) into the shared folder and read the result."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    out.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def drain_upserts(stream: DataFrame, keys: list[str], order: list[str], rules: dict[str, str] | None = None) -> DataFrame:
    """The table that results from writing every micro-batch over what came before by key, by the rules of `upsert`.

    A batch is appended to a log under its number, so nothing is rewritten, and a batch that is run again after a failure
    overwrites its own part only. The log is folded when it is read: the last row a key and batch, then the batches by rule.
    """
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/upsert-{uuid.uuid4().hex}"

    def log(batch: DataFrame, number: int) -> None:
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{base}/log/batch={number}")

    query = stream.writeStream.foreachBatch(log).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not query.recentProgress:
        return spark.createDataFrame([], stream.schema)
    return folded(spark.read.parquet(f"{base}/log"), stream.columns, keys, rules)


def folded(log: DataFrame, columns: list[str], keys: list[str], rules: dict[str, str] | None = None) -> DataFrame:
    """One row a key of a log with the column batch, each column by its rule; every rule is an aggregate, so batches combine map-side."""
    rule = {
        "new": lambda c: F.max_by(F.struct(c), "batch")[c],
        "keep": lambda c: F.min_by(F.struct(c), "batch")[c],
        "max": lambda c: F.max(c),
        "coalesce": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch"))),
    }
    rest = [c for c in columns if c not in keys]
    return log.groupBy(*keys).agg(*(rule[(rules or {}).get(c, "new")](c).alias(c) for c in rest)).select(*columns)


Operator = Callable[..., DataFrame]

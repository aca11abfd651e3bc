"""Joins whose strategy depends on a measured size, and lineage cuts that survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatrix.session import ensure_checkpoint_dir

#: A side is broadcast only if its measured bytes stay below this.
BROADCAST_BYTES = 32 << 20


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there: reliable, never local to one executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def measured_bytes(df: DataFrame) -> int:
    """Bytes that df needs in a broadcast table: fixed widths, and the real lengths of all texts and nested values, in one aggregate."""
    fixed = {"bigint": 8, "int": 4, "smallint": 2, "tinyint": 1, "double": 8, "float": 4, "boolean": 1, "timestamp": 8, "timestamp_ntz": 8, "date": 4}
    width = 24 + sum(fixed.get(kind, 8) for _, kind in df.dtypes)
    long = [F.octet_length(f"`{c}`") if kind in ("string", "binary") else F.octet_length(F.to_json(F.struct(f"`{c}`"))) for c, kind in df.dtypes if kind not in fixed]
    total = sum((F.coalesce(x, F.lit(0)) for x in long), F.lit(width)).cast("bigint")
    return df.agg(F.coalesce(F.sum(total), F.lit(0))).first()[0]


def join_measured(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """left joined with a right side whose size is measured first.

    right is materialised and its bytes are summed; it is broadcast if they stay below `limit`, otherwise the join shuffles
    both sides on the keys and AQE splits skewed partitions. The result is the same either way.
    """
    return join_written(left, materialise(right), on, how, limit)


def join_written(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """join_measured for a right side that is written already."""
    return left.join(F.broadcast(right) if measured_bytes(right) <= limit else right, on, how)


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt out to all cores if it has fewer partitions than there are cores; else as it is.

    For passes that spend far more time on a row than a shuffle would: one small file is one task otherwise. At size a scan
    has more partitions than cores and nothing is moved. Only for plain scans: what is known of their partitions is free.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan

"""Sinks: exports with a manifest, a content-addressed store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def safe_text(df: DataFrame) -> DataFrame:
    """df with control characters other than line break and tab removed from its text columns."""
    return df.withColumns({c: F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "") for c, kind in df.dtypes if kind == "string"})


def export(df: DataFrame, folder: str, name: str, formats: tuple[str, ...] = ("csv", "json", "parquet")) -> dict[str, object]:
    """df written as part files by many tasks under folder/name.format; gives a manifest of columns and rows.

    Nested columns become JSON text in CSV.
    """
    safe = safe_text(df)
    for kind in formats:
        out = safe
        if kind == "csv":
            out = safe.withColumns({c: F.to_json(c) for c, t in safe.dtypes if t.startswith(("array", "map", "struct"))})
        writer = out.write.mode("overwrite")
        (writer.option("header", True).option("escape", '"') if kind == "csv" else writer).format(kind).save(f"{folder}/{name}.{kind}")
    return {"name": name, "columns": df.columns, "rows": df.sparkSession.read.format(formats[-1]).option("header", True).load(f"{folder}/{name}.{formats[-1]}").count(), "formats": list(formats)}


def store_content(df: DataFrame, content: str, path: str) -> DataFrame:
    """Append the texts a store lacks, keyed by the SHA-256 of their bytes; what is there is never written again.

    Gives df with `sha256`. The store is a parquet folder of (sha256, content), created if missing.
    """
    spark = df.sparkSession
    keyed = df.withColumn("sha256", F.when(F.col(content).isNotNull(), F.sha2(F.col(content).cast("binary"), 256)))
    new = keyed.filter(F.col("sha256").isNotNull()).select("sha256", F.col(content).alias("content")).dropDuplicates(["sha256"])
    try:
        new = new.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    new.write.mode("append").parquet(path)
    return keyed


def stored_content(spark, path: str) -> DataFrame:
    """(sha256, content) of a store, each once: two writers that add the same text at the same time leave it there twice."""
    return spark.read.parquet(path).dropDuplicates(["sha256"])

"""Readers: delimited files with checked headers and aliases, zipped files, sitemaps, robots files, stored snapshots."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, required: Sequence[str], aliases: dict[str, Sequence[str]] | None = None, breaks: bool = True) -> DataFrame:
    """A CSV with a header, all columns text. A missing required column is an error before any row is read.

    aliases: name -> headers it may have; the first that is filled counts. A byte-order mark on the first header is ignored.
    breaks: cells may hold line breaks; a file is one task then. Large files without such cells are split among tasks with False.
    """
    df = spark.read.csv(path, header=True, multiLine=breaks, escape='"')
    df = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))
    for name, others in (aliases or {}).items():
        found = [c for c in (name, *others) if c in df.columns]
        if found:
            df = df.withColumn(name, F.coalesce(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in found)))
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}; it has {df.columns}")
    return df


def guarded(df: DataFrame, needed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with all needed columns filled, the others)."""
    good = F.lit(True)
    for c in needed:
        good = good & (F.length(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) > 0)
    return df.filter(good), df.filter(~good)


def read_zipped_csv(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """The rows of the CSV members (pattern `member`) of zip files, one zip a task, streamed in chunks, never whole."""
    names = [f.split(":")[0].split()[0] for f in schema.split(",")]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if re.search(member, name):
                            with z.open(name) as f:
                                for chunk in pd.read_csv(f, dtype=str, encoding="utf-8-sig", chunksize=20_000):
                                    yield chunk.reindex(columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)


def sitemap_urls(df: DataFrame, xml: str) -> DataFrame:
    """(kind, url) of a column of sitemap documents: kind is page, or sitemap for a nested index; by pattern, so broken XML still gives what it holds."""
    text = F.coalesce(F.col(xml), F.lit(""))
    nested = text.rlike(r"(?i)<sitemapindex[\s>]")
    urls = F.regexp_extract_all(text, F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), 1)
    return df.select(F.when(nested, "sitemap").otherwise("page").alias("kind"), F.explode(F.array_distinct(urls)).alias("url")).filter("url <> ''").withColumn("url", F.replace("url", F.lit("&amp;"), F.lit("&")))


def crawl_delay(robots: Column, agent: str) -> Column:
    """Seconds of Crawl-delay (fractions too) that a robots file states for an agent, or else for all; null for none."""

    def one(text: str | None) -> float | None:
        groups: dict[str, float] = {}
        names: list[str] = []
        rules = False
        for line in (text or "").splitlines():
            key, _, value = line.split("#")[0].partition(":")
            key, value = key.strip().lower(), value.strip()
            if key == "user-agent":
                names = [value.lower()] if rules or not names else [*names, value.lower()]
                rules = False
            elif key:
                rules = True
                if key == "crawl-delay" and re.fullmatch(r"\d+(\.\d+)?", value):
                    for n in names:
                        groups.setdefault(n, float(value))
        mine = [n for n in groups if n != "*" and n in agent.lower()]
        return groups[max(mine, key=len)] if mine else groups.get("*")

    return _series(one, robots)


def robots_allow(text: str | None, status: int | None, agent: str, path: str) -> bool:
    """May an agent fetch a path? A robots file that answered with a server's error forbids all, one that is missing nothing.

    The group that names most of the agent counts, or else that for all; of its rules the longest that fits the path, of
    equals the one that allows. * and a final $ in rules have their usual meaning.
    """
    if status is not None and status >= 500:
        return False
    if text is None or status is not None and status >= 400:
        return True
    groups: dict[str, list[tuple[bool, str]]] = {}
    names: list[str] = []
    rules = True
    for line in text.splitlines():
        key, _, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            names = [value.lower()] if rules else [*names, value.lower()]
            rules = False
            groups.setdefault(names[-1], [])
        elif key in ("allow", "disallow"):
            rules = True
            for n in names if value else ():
                groups[n].append((key == "allow", value))
    mine = [n for n in groups if n != "*" and n in agent.lower()]
    best = (-1, True)
    for allowed, rule in groups[max(mine, key=len)] if mine else groups.get("*", []):
        pattern = "".join(".*" if c == "*" else re.escape(c) for c in rule.removesuffix("$")) + ("$" if rule.endswith("$") else "")
        if re.match(pattern, path):
            best = max(best, (len(rule), allowed))
    return best[1]


def may_fetch(robots: Column, status: Column, path: Column, agent: str) -> Column:
    def run(texts: pd.Series, codes: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([robots_allow(t, None if pd.isna(c) else int(c), agent, p or "/") for t, c, p in zip(texts, codes, paths)], dtype=bool)

    run.__annotations__ = {"texts": pd.Series, "codes": pd.Series, "paths": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "boolean")(robots, status, path)


def _series(one, column: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in texts], dtype="float64")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(column)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, path, content) of stored files."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha256"), "path", "content")

"""Imports with contracts: a universe of schools, attributes, labels, archive indexes, packed sitemaps, stored mail, settings."""

from __future__ import annotations

import email
import email.policy
import gzip
import os
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatrix.functions.urls import host
from verbatrix.operators.relational import longest_suffix_join
from verbatrix.sources.readers import read_csv, sitemap_urls


def with_scheme(url: Column) -> Column:
    """A trimmed address with https:// in front unless it has a scheme of the web; null for none."""
    u = F.nullif(F.trim(url), F.lit(""))
    return F.when(u.rlike("(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def universe(spark: SparkSession, path: str, levels: Sequence[int] = (1,), controls: Sequence[int] = (1, 2), states: Sequence[str] = (), year: int | None = None) -> DataFrame:
    """Schools of a directory CSV: (unitid, name, city, state, website, control, level, source_year, included, raw_json).

    UNITID and INSTNM are needed. Numbers that aren't whole become null, websites get a scheme, the year comes from the
    file's name unless given, `included` says if level, control and state are wanted, the whole row is kept as JSON. Rows
    without a unitid are left out; of several with one, the last by their JSON counts.
    """
    df = read_csv(spark, path, ["UNITID", "INSTNM"])
    if year is None and (m := re.search(r"20\d{2}", os.path.basename(path))):
        year = int(m[0])
    held = lambda *names: F.coalesce(*(F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in df.columns), F.lit(None).cast("string"))
    whole = lambda c: F.trim(c).try_cast("int")
    level, control, state = whole(held("ICLEVEL", "LEVEL")), whole(held("CONTROL")), held("STABBR")
    wanted = level.isin(*levels) & control.isin(*controls) & (F.upper(state).isin(*(s.upper() for s in states)) if states else F.lit(True))
    rows = df.select(
        F.trim("UNITID").alias("unitid"), F.trim("INSTNM").alias("name"), held("CITY").alias("city"), state.alias("state"), with_scheme(held("WEBADDR")).alias("website"), control.alias("control"), level.alias("level"),
        F.lit(year).cast("int").alias("source_year"), F.coalesce(wanted, F.lit(False)).cast("int").alias("included"), F.to_json(F.struct(*sorted(df.columns))).alias("raw_json"),
    ).filter(F.length("unitid") > 0)
    last = rows.groupBy("unitid").agg(F.max_by(F.struct(*rows.columns), F.col("raw_json")).alias("r"))
    return last.select("r.*")


def attributes(spark: SparkSession, path: str, known: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """((unitid, key, value, source) of a CSV of attributes, its other rows): schools must be known, the value defaults to 1, one row a school and key."""
    df = read_csv(spark, path, ["unitid", "key"], {"unitid": ["UNITID"]})
    value = F.coalesce(F.nullif(F.trim("value"), F.lit("")), F.lit("1")) if "value" in df.columns else F.lit("1")
    rows = df.select(F.trim("unitid").alias("unitid"), F.nullif(F.trim("key"), F.lit("")).alias("key"), value.alias("value"), F.lit(source).alias("source"))
    there = known.select(F.col("unitid")).distinct().withColumn("__there", F.lit(True))
    marked = rows.join(there, "unitid", "left")
    good = F.coalesce("__there", F.lit(False)) & F.col("key").isNotNull()
    return marked.filter(good).groupBy("unitid", "key", "source").agg(F.max("value").alias("value")).select("unitid", "key", "value", "source"), marked.filter(~good).drop("__there")


def labels(spark: SparkSession, path: str, labeler: str, relevant: str = "relevant (y/n)", direction: str = "direction (supportive/adverse/neutral)", directions: Sequence[str] = ("supportive", "adverse", "neutral")) -> DataFrame:
    """(audit_item_id, labeler, relevant, direction, note) of a filled label sheet; rows without any label are left out.

    A direction counts by its first three letters.
    """
    df = read_csv(spark, path, ["audit_item_id", relevant, direction])
    rel, said = F.lower(F.trim(F.coalesce(F.col(f"`{relevant}`"), F.lit("")))), F.lower(F.trim(F.coalesce(F.col(f"`{direction}`"), F.lit(""))))
    side = F.lit(None).cast("string")
    for d in reversed(directions):
        side = F.when((said != "") & F.startswith(F.lit(d), F.substring(said, 1, 3)), F.lit(d)).otherwise(side)
    rows = df.select(F.trim("audit_item_id").try_cast("long").alias("audit_item_id"), F.lit(labeler).alias("labeler"), F.when(rel != "", F.startswith(rel, F.lit("y"))).alias("relevant"), side.alias("direction"), (F.nullif(F.trim("note"), F.lit("")) if "note" in df.columns else F.lit(None).cast("string")).alias("note"))
    return rows.filter(F.col("audit_item_id").isNotNull() & (F.col("relevant").isNotNull() | F.col("direction").isNotNull()))


def captures(df: DataFrame, index: str) -> DataFrame:
    """df with `capture`, one row a capture of an archive index: JSON lists of lists of which the first names the columns.

    Only those that answered 200 count; a malformed index has none.
    """
    lists = F.from_json(F.col(index), "array<array<string>>")
    head = F.element_at(lists, 1)
    each = F.transform(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0))), lambda row: F.map_from_arrays(head, row))
    rows = df.withColumn("__lists", lists).filter(F.size("__lists") > 1).withColumn("capture", F.explode(each)).drop("__lists")
    return rows.filter(F.coalesce(F.col("capture")["statuscode"], F.lit("200")) == "200")


def packed_sitemap_urls(df: DataFrame, content: str) -> DataFrame:
    """(kind, url) of a column of sitemaps as bytes, gzipped or plain; damaged ones give what they hold."""
    def run(packed: pd.Series) -> pd.Series:
        return pd.Series([_unpacked(x) for x in packed], dtype=object)

    run.__annotations__ = {"packed": pd.Series, "return": pd.Series}
    return sitemap_urls(df.select(F.pandas_udf(run, "string")(F.col(content)).alias("xml")), "xml")


def _unpacked(content: bytes | None) -> str | None:
    if content is None:
        return None
    if content[:2] == b"\x1f\x8b":
        import io

        out = bytearray()
        try:
            with gzip.open(io.BytesIO(content)) as f:
                while part := f.read(1 << 20):
                    out += part
        except (OSError, EOFError):
            pass  # cut short: what came before
        content = bytes(out)
    return content.decode("utf-8", "replace")


def read_mail(content: bytes | None) -> dict[str, str] | None:
    """Sender, subject and own text of a stored mail; what it quotes from the mail before is left out. Never raises."""
    if content is None:
        return None
    try:
        mail = email.message_from_bytes(content, policy=email.policy.default)
        body = mail.get_body(preferencelist=("plain", "html"))
        text = body.get_content() if body is not None else ""
    except Exception:  # a broken mail is read as it is
        return {"sender": "", "subject": "", "text": content.decode("utf-8", "replace")}
    own = []
    for line in re.sub(r"<[^>]*>", " ", text).splitlines() if body is not None and body.get_content_type() == "text/html" else text.splitlines():
        if re.match(r"\s*On .{4,200} wrote:\s*$|-{3,}\s*Original Message", line):
            break
        if not line.lstrip().startswith(">"):
            own.append(line)
    return {"sender": str(mail.get("From", "")), "subject": str(mail.get("Subject", "")), "text": "\n".join(own).strip()}


def mails(spark: SparkSession, path: str) -> DataFrame:
    """(path, sender, subject, text) of stored mails, one file a row."""
    def parse(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_mail(x) or {} for x in content], columns=["sender", "subject", "text"])

    parse.__annotations__ = {"content": pd.Series, "return": pd.DataFrame}
    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    return rows.select("path", F.pandas_udf(parse, "sender string, subject string, text string")("content").alias("m")).select("path", "m.*")


def settings(text: str, known: Mapping[str, object]) -> dict[str, object]:
    """Lines NAME=value of a settings file over known defaults; each takes the default's type, unknown names are an error."""
    out = dict(known)
    for line in text.splitlines():
        name, sep, value = line.partition("=")
        name, value = name.strip(), value.strip().strip("'\"")
        if not sep or name.startswith("#"):
            continue
        if name not in known:
            raise KeyError(f"unknown setting {name}")
        kind = type(known[name])
        out[name] = value.lower() in ("1", "true", "yes") if kind is bool else kind(value)
    return out


def entities(spark: SparkSession, path: str, known: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """((domain, id, name, url, source, added) of a CSV of organisations, its rows without a name or host).

    Headers may be name, organization or publication, and url, website or homepage. Rows merge by domain: one row a domain,
    under the id that known (id, domain) has for it, or none yet (added); of several rows the first name in order counts.
    """
    df = read_csv(spark, path, ["name", "url"], {"name": ["organization", "organisation", "publication"], "url": ["website", "homepage"]})
    rows = df.select(F.trim("name").alias("name"), with_scheme(F.col("url")).alias("url")).withColumn("domain", host(F.col("url")))
    good = (F.length("name") > 0) & (F.length("domain") > 0)
    one = rows.filter(good).groupBy("domain").agg(F.min(F.struct("name", "url")).alias("r"))
    held = known.select(host(F.col("domain")).alias("domain"), "id").groupBy("domain").agg(F.min("id").alias("id"))
    merged = one.join(held, "domain", "left").select("domain", "id", "r.name", "r.url", F.lit(source).alias("source"), F.col("id").isNull().alias("added"))
    return merged, rows.filter(~F.coalesce(good, F.lit(False)))


def evidence_index(spark: SparkSession, path: str, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((url, claim, site, id) of an index of evidence, its rows on no known site): the site is the paper's host that is the URL's or its nearest parent.

    Headers may be url, link or source, and claim, summary or note. Rows without a URL are left out; a URL listed twice with
    one claim counts once.
    """
    df = read_csv(spark, path, ["url", "claim"], {"url": ["link", "source"], "claim": ["summary", "note"]})
    rows = df.select(with_scheme(F.col("url")).alias("url"), F.trim("claim").alias("claim")).filter("url IS NOT NULL").distinct().withColumn("h", host(F.col("url")))
    sites = papers.select(host(F.col("domain")).alias("site"), "id").filter("site <> ''").groupBy("site").agg(F.min("id").alias("id"))
    found = longest_suffix_join(rows, "h", sites, "site")
    return found.select("url", "claim", "site", "id"), rows.join(found.select("url", "claim"), ["url", "claim"], "left_anti").select("url", "claim")

"""Redaction and publication filters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A person's name: two or three capitalised words, a middle initial allowed.
NAME = r"\b[A-ZÀ-ÖØ-Þ][\w’'-]+ (?:[A-ZÀ-ÖØ-Þ]\. )?[A-ZÀ-ÖØ-Þ][\w’'-]+\b"
TITLED = r"\b((?:Dr|Mr|Mrs|Ms|Prof|Judge|Officer|Sgt|Lt)\.? )([A-ZÀ-ÖØ-Þ][\w’'-]+)"


def redact(text: Column, keep: Column, placeholder: str = "[name]", common: set[str] | None = None) -> Column:
    """text with personal names replaced, and the bare surnames of the names replaced; names in the array `keep` stay.

    Words in `common` (lower case) are no part of a name: they are trimmed from its ends. Null stays null.
    """
    ordinary = frozenset(common or ())
    name, titled = re.compile(NAME), re.compile(TITLED)

    def one(t: str | None, kept: list[str] | None) -> str | None:
        if t is None:
            return None
        stay = {k.casefold() for k in (kept if kept is not None else []) if k}
        surnames: set[str] = set()

        def put(m: re.Match) -> str:
            words = m[0].split(" ")
            if m[0].casefold() in stay or len(words) < 2:
                return m[0]
            head, tail = [], []
            while words and words[0].casefold() in ordinary:
                head.append(words.pop(0))
            while words and words[-1].casefold() in ordinary:
                tail.insert(0, words.pop())
            if len(words) < 2:
                return m[0]
            surnames.add(words[-1])
            return " ".join([*head, placeholder, *tail])

        out = name.sub(put, t)
        out = titled.sub(lambda m: m[0] if m[2].casefold() in stay else m[1] + placeholder, out)
        for s in surnames:
            out = re.sub(rf"\b{re.escape(s)}\b", placeholder, out)
        return out

    @F.pandas_udf("string")
    def run(texts: pd.Series, kept: pd.Series) -> pd.Series:
        return pd.Series([one(t, k) for t, k in zip(texts, kept)], dtype=object)

    return run(text, keep)


def url_without_names(url: Column, names: Column, withheld: str = "[withheld: address carries a name]") -> Column:
    """The URL, or a mark where its path holds a word of one of the redacted names as a token of its own; null and other schemes stay."""
    path = F.lower(F.regexp_replace(url, r"^https?://[^/]+", ""))
    tokens = F.split(path, "[^a-z]+")
    parts = F.filter(F.flatten(F.transform(names, lambda n: F.split(F.lower(n), "[^a-z]+"))), lambda w: F.length(w) >= 2)
    held = F.coalesce(url.rlike("^https?://") & F.arrays_overlap(tokens, parts), F.lit(False))
    return F.when(held, F.lit(withheld)).otherwise(url)


def redact_rows(df: DataFrame, texts: list[str], urls: list[str], keep: Column, drop: list[str] = (), common: set[str] | None = None, placeholder: str = "[name]") -> DataFrame:
    """df with the names in its text columns replaced, then the URLs of a row that carry one of that row's redacted names, and the columns `drop` marked.

    Texts come first, so that a name redacted in any of a row's texts is known when its URLs are looked at. Kept names stay
    in both. Nulls stay null.
    """
    ordinary = F.array(*(F.lit(w) for w in sorted(common or ()))) if common else F.array().cast("array<string>")
    kept = F.transform(F.coalesce(keep, F.array().cast("array<string>")), F.lower)
    found = F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(f"({NAME})".replace(r"\w", r"\p{L}")), 1) for c in texts)))
    named = F.filter(F.array_distinct(found), lambda n: ~F.array_contains(kept, F.lower(n)))
    words = F.transform(named, lambda n: F.array_join(F.filter(F.split(n, " "), lambda w: ~F.array_contains(ordinary, F.lower(w))), " "))
    out = df.withColumn("__named", words).withColumn("__kept", keep)
    out = out.withColumns({c: redact(F.col(c), F.col("__kept"), placeholder, common) for c in texts})
    out = out.withColumns({c: url_without_names(F.col(c), F.col("__named")) for c in urls})
    out = out.withColumns({c: F.when(F.length(F.col(c)) > 0, F.lit("[withheld in shared copy]")).otherwise(F.col(c)) for c in drop})
    return out.drop("__named", "__kept")


def withhold(df: DataFrame, url: str, pattern: str, party: str) -> DataFrame:
    """df without the rows whose URL matches and without all rows of a party that only stands in such rows; nulls never match."""
    hit = F.coalesce(F.col(url).rlike(pattern), F.lit(False))
    only = df.groupBy(party).agg(F.bool_and(hit).alias("__only")).filter("__only").select(party)
    return df.filter(~hit).join(only, party, "left_anti")


def mask_urls(url: Column, story: Column, mask: str = "withheld") -> Column:
    """The host alone, with a mask for the path, where `story` holds; the URL elsewhere."""
    site = F.regexp_extract(F.coalesce(url, F.lit("")), r"^([a-zA-Z]+://[^/?#]*)", 1)
    return F.when(F.coalesce(story, F.lit(False)), F.concat(site, F.lit(f"/{mask}"))).otherwise(url)


def common_words(df: DataFrame, text: str, least: int = 2) -> DataFrame:
    """(word, n) of the ASCII words that stand in lower case at least `least` times; pre-aggregated before the shuffle."""
    words = F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?<![A-Za-z0-9])([a-z]{2,})(?![A-Za-z0-9])"), 1))
    return df.select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def make_public(df: DataFrame, private: list[str], urls: list[str], titles: list[str], story: Column, order: list[Column], rank: str = "rank", limit: int | None = None) -> DataFrame:
    """df for the public: private columns dropped, addresses and titles of stories masked, ranked anew; with a limit only the first rows, which is all that is ranked then."""
    out = df.drop(*private).withColumn("__story", F.coalesce(story, F.lit(False)))
    out = out.withColumns({c: mask_urls(F.col(c), F.col("__story")) for c in urls})
    out = out.withColumns({c: F.when(F.col("__story") & F.col(c).isNotNull(), F.lit("[story]")).otherwise(F.col(c)) for c in titles}).drop("__story")
    if limit is None:
        return out
    from verbatrix.operators.predicates import ordered

    return ordered(out, order, limit, rank)

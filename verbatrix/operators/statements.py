"""Statements out of text: light sentence split, tags, context, quotations with speakers, near-duplicate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatrix.functions.text import compact_ws, near_duplicate_key, tags_of
from verbatrix.operators.relational import with_edges
from verbatrix.operators.sizing import materialise

#: A gap behind a sentence mark and before a capital or figure: an expression-only split (the llm package has the full one).
GAP = r"(?<=[.!?][\"'”’)]{0,2})\s+(?=[\"'“‘(]?[A-Z0-9])"


def light_sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, sentence) split by a look-around gap, inside the JVM; null and blank texts have none."""
    parts = F.filter(F.split(F.col(text_col), GAP), lambda s: F.trim(s) != "")
    return df.select(F.col(id_col), F.posexplode(parts).alias("pos", "sentence"))


#: A gap behind a sentence mark, closers between, and before an opening; and abbreviations that a gap behind doesn't end.
BOUNDARY = r"(?<=[.!?][\"'”’)\]]{0,3})\s+(?=[\"'“‘(\[]?[A-Z0-9])"
ABBREVIATION = r"(?i)\b(?:Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|Inc|Co|Corp|Ltd|vs|No|Gov|Sen|Rep|Gen|Lt|Col|Sgt|Capt|U\.S|U\.K|a\.m|p\.m|e\.g|i\.e|etc|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\.$"


def bounded_sentences(df: DataFrame, id_col: str, text_col: str, longest: int = 700) -> DataFrame:
    """(id, pos, sentence): split at gaps, joined again behind abbreviations, those above `longest` cut at list marks and then at blanks.

    All of it is expression; white space is made single first; no sentence is above `longest` and no text is lost but blanks
    and list marks at cuts.
    """
    parts = F.split(compact_ws(F.col(text_col)), BOUNDARY)
    start = F.array().cast("array<string>")

    def join(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & last.rlike(ABBREVIATION), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", last, p)))).otherwise(F.concat(acc, F.array(p)))

    # an element before the first, so that the last one always has an index
    joined = F.filter(F.aggregate(parts, F.concat(start, F.array(F.lit(""))), join), lambda s: s != "")
    wrapped = lambda c: F.regexp_extract_all(c, F.lit(rf"(?s)(.{{1,{longest}}})(?:\s|$)|(.{{{longest}}})"), 0)
    cut = F.flatten(F.transform(joined, lambda s: F.when(F.length(s) <= longest, F.array(s)).otherwise(F.flatten(F.transform(F.split(s, r"\s*[;•·|]\s+"), lambda c: F.when(F.length(c) <= longest, F.array(c)).otherwise(wrapped(c)))))))
    clean = F.filter(F.transform(cut, F.trim), lambda s: s != "")
    return df.select(F.col(id_col), F.posexplode(clean).alias("pos", "sentence"))


def with_context(df: DataFrame, key: str, order: str, text: str, before: int = 1, after: int = 1) -> DataFrame:
    """df with the neighbouring texts of the same key joined before and behind; rows without a key are each other's neighbours.

    The rows lie in ranges of key and order, with copies of the rows at the edges of ranges, so neither a hot key nor the
    rows without one meet in one task.
    """
    rows = with_edges(df, [key], [F.asc(order)], before, after)
    w = W.partitionBy("__p", key).orderBy(order)
    parts = [*(F.lag(text, k).over(w) for k in range(before, 0, -1)), F.col(text), *(F.lead(text, k).over(w) for k in range(1, after + 1))]
    return rows.withColumn("context", F.concat_ws(" ", *parts)).filter("NOT __ghost").select(*df.columns, "context")


def neighbours(df: DataFrame, id_col: str, texts: Column, before: int = 2, after: int = 1) -> DataFrame:
    """(id, pos, text, context) of the elements of an array with those around them, cut out of the array itself: no shuffle, no window."""
    held = df.select(F.col(id_col), texts.alias("__all")).filter(F.size("__all") > 0)
    each = held.select(id_col, "__all", F.posexplode("__all").alias("pos", "text"))
    first = F.greatest(F.col("pos") - before, F.lit(0))
    return each.select(id_col, "pos", "text", F.array_join(F.slice("__all", first + 1, F.col("pos") + after - first + 1), " ").alias("context"))


def tag_bridge(df: DataFrame, id_col: str, text_col: str, patterns: dict[str, str]) -> DataFrame:
    """(id, tag) for every pattern found: the many-to-many bridge."""
    return df.select(id_col, F.explode(tags_of(F.col(text_col), patterns)).alias("tag"))


def near_dup_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, canonical, copies) of texts that share a near-duplicate key with another; the longest, then lowest id, is canonical.

    One shuffle on the key carries ids and lengths only. Null texts belong to no group.
    """
    keyed = df.filter(F.col(text_col).isNotNull()).select(id_col, near_duplicate_key(F.col(text_col)).alias("key"), F.length(text_col).alias("__n"))
    keyed = materialise(keyed)  # read twice; the keys are dear, the rows short
    best = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.max_by(id_col, F.struct("__n", -F.col(id_col))).alias("canonical")).filter("copies > 1")
    return keyed.join(best, "key").select(id_col, "key", "canonical", "copies")


#: A quotation and a speaker named behind it, with RE2-safe groups: quote, verb, speaker.
QUOTE_AFTER = r"[\"“]([^\"“”]{20,700})[\"”],? ?(said|asked|told|added|explained) ([A-ZÀ-Þ][^ ,.]+ (?:[A-Z]\. )?[A-ZÀ-Þ][^ ,.]+)"


def voices(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, quote, speaker) of quotations whose speaker follows; one row a distinct quotation and speaker of a text."""
    hit = lambda g: F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(QUOTE_AFTER), g)
    rows = df.select(id_col, F.explode(F.arrays_zip(hit(1).alias("quote"), hit(3).alias("speaker"))).alias("v"))
    return rows.select(id_col, "v.quote", "v.speaker").distinct()


_SAID = r"(?:said|asked|told|added|explained|says|wrote)"
_NAMED = r"([A-ZÀ-Þ][^ ,.\"“”]+ (?:[A-Z]\. )?[A-ZÀ-Þ][^ ,.\"“”]+)"
_QUOTED = r"[\"“]([^\"“”]{40,700})[\"”]"
#: Attributions in the order they count: (method, pattern, group of the quotation, of the speaker, of the role or 0).
ATTRIBUTIONS = [
    ("said_name", rf"{_QUOTED},? ?{_SAID} {_NAMED}(?:, ([^,.;\"“”]{{3,120}})[,.])?", 1, 2, 3),
    ("name_said", rf"{_QUOTED},? ?{_NAMED} {_SAID}", 1, 2, 0),
    ("name_role_said", rf"{_QUOTED},? ?{_NAMED}, ([^,.;\"“”]{{3,120}}), {_SAID}", 1, 2, 3),
    ("before", rf"{_NAMED}(?:, ([^,.;\"“”]{{3,120}}),)? {_SAID}(?: that)?[:,]? ?{_QUOTED}", 3, 1, 2),
]


def attributed_voices(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, quote, speaker, role, method, confidence) of quotations with a named speaker behind or before them.

    One row a quotation of a text, by the first attribution that names its speaker; 0.7 with a role, else 0.6.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = []
    for k, (method, pattern, quote, speaker, role) in enumerate(ATTRIBUTIONS):
        group = lambda g: F.regexp_extract_all(text, F.lit(pattern), g)  # noqa: B023, E731
        zipped = F.arrays_zip(group(quote).alias("quote"), group(speaker).alias("speaker"), (group(role) if role else F.transform(group(quote), lambda _: F.lit(""))).alias("role"))
        found.append(F.transform(zipped, lambda v: F.struct(v["quote"].alias("quote"), F.lit(k).alias("k"), v["speaker"].alias("speaker"), F.nullif(v["role"], F.lit("")).alias("role"), F.lit(method).alias("method"))))  # noqa: B023
    rows = df.select(id_col, F.explode(F.concat(*found)).alias("v")).select(id_col, "v.*")
    best = rows.groupBy(id_col, "quote").agg(F.min(F.struct("k", "speaker", "role", "method")).alias("b"))
    return best.select(id_col, "quote", "b.speaker", "b.role", "b.method", F.when(F.col("b.role").isNull(), F.lit(0.6)).otherwise(F.lit(0.7)).alias("confidence"))

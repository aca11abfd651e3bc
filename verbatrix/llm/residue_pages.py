"""Problem 6: pages that hold residue instead of a story: unfilled layouts, filler, error messages, demands for scripts.

Normalised lines are counted first, by host, and by template over all hosts; those that recur are boilerplate and are
subtracted. Of the residual, lines that for the most part are evidence of residue name the text unless running text
stands beside them. Evidence counts as boilerplate only where its template recurs beside stories, so an error message
that many pages of a host show is subtracted nowhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatrix.llm.page_lines import plain
from verbatrix.llm.recurrence import COMMON, GOOD, RESIDUE, RESIDUE_KINDS, first_pass, host_of, link_templates, page_lines, with_links
from verbatrix.operators.sizing import join_measured


def is_residue(lines: list[str]) -> bool:
    """Evidence of residue and no running text beside it, by the lines alone, before any are subtracted."""
    labels = {first_pass(x, "")[0] for x in map(plain, lines) if x}
    return RESIDUE in labels and GOOD not in labels


def extracted_texts(pages: DataFrame, *fields: str) -> DataFrame:
    """(page, field, host, title, text) of extracted texts of pages; no nulls, no blanks."""
    title = F.col("title") if "title" in pages.columns else F.lit(None).cast("string")
    each = [pages.select(F.col("page_id").alias("page"), F.lit(x).alias("field"), host_of(F.col("url")).alias("host"), title.alias("title"), F.col(x).alias("text")) for x in fields]
    return reduce(DataFrame.unionByName, each).filter(F.length(F.trim("text")) > 0)


def page_texts(fetched: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, field, host, title, text) of markup (fetched.content) and extracted text (pages.main_text); no nulls, no blanks."""
    markup = fetched.select(F.col("page_id").alias("page"), F.lit("content").alias("field"), host_of(F.coalesce("final_url", "requested_url")).alias("host"), F.lit(None).cast("string").alias("title"), F.col("content").alias("text"))
    return markup.filter(F.length(F.trim("text")) > 0).unionByName(extracted_texts(pages, "main_text"))


def host_lines(lines: DataFrame, min_pages: int = COMMON) -> DataFrame:
    """(host, field, line) of the lines of wording that stand on at least min_pages pages of their host."""
    good = F.filter(F.arrays_zip("line", "label"), lambda x: x["label"] == GOOD)["line"]
    each = lines.select("host", "field", "page", F.explode(F.array_distinct(good)).alias("line"))
    # distinct (line, page) first: a hot line is spread over its pages, and only one row a task is left for the count
    pages = each.groupBy("host", "field", "line", "page").agg(F.lit(1).alias("one")).groupBy("host", "field", "line").agg(F.count("one").alias("pages"))
    return pages.filter(F.col("pages") >= min_pages).select("host", "field", "line")


def residual_cases(lines: DataFrame, min_pages: int = COMMON) -> DataFrame:
    """(page, field, kinds) of the texts whose residual holds evidence and no running text; lines has the links."""
    residual = F.filter(F.arrays_zip("label", "kind", "line", "link"), lambda x: ~x["link"])
    held = lines.select("page", "field", "host", residual.alias("r")).filter(F.exists("r", lambda x: x["label"] == RESIDUE))
    names = F.array(*map(F.lit, RESIDUE_KINDS))
    kinds = F.array_sort(F.array_distinct(F.transform(F.filter("r", lambda x: x["label"] == RESIDUE), lambda x: F.element_at(names, x["kind"].cast("int") + 1))))
    beside = F.array_distinct(F.filter("r", lambda x: x["label"] == GOOD)["line"])
    each = held.select("page", "field", "host", kinds.alias("kinds"), F.explode_outer(beside).alias("line"))
    judged = join_measured(each, host_lines(lines, min_pages).withColumn("often", F.lit(True)), ["host", "field", "line"], "left")
    left = F.col("line").isNotNull() & F.col("often").isNull()
    return judged.groupBy("page", "field").agg(F.min("kinds").alias("kinds"), F.bool_or(left).alias("left")).filter(~F.col("left")).select("page", "field", "kinds")


def residue_texts(texts: DataFrame, min_pages: int = COMMON) -> DataFrame:
    """(page, field, kinds) of the texts that hold residue in place of a story.

    texts has page, field ('content' is markup, anything else plain lines), host, text and, if known, title. Blank and
    null texts are no case; a page is named once a field; texts are read once and whole.
    """
    if "title" not in texts.columns:
        texts = texts.withColumn("title", F.lit(None).cast("string"))
    lines = page_lines(texts)
    return residual_cases(with_links(lines, link_templates(lines, min_pages)), min_pages)

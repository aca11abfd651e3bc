"""Queries of the training-data operators, by problem number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatrix.llm.leakage import leaked_spans, without_leaks
from verbatrix.llm.main_content import main_lines
from verbatrix.llm.one_form import look_alikes, look_classes, with_forms
from verbatrix.llm.packing import checked, fill, packed, token_counts
from verbatrix.llm.repeated_lines import line_templates, repeated_lines, without_repeated_lines
from verbatrix.llm.residue_pages import page_texts, residue_texts
from verbatrix.llm.school_links import school_links
from verbatrix.llm.sentences import learn_words, sentences
from verbatrix.llm.text_quality import text_classes, text_statistics
from verbatrix.operators.sizing import materialise, spread
from verbatrix.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def texts(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The columns of a table that a dear pass over its texts needs, on all cores."""
    return spread(table(spark, folder, name).select(*columns))


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """publications.domain is unique by publication, so publication_id stands for the domain and no join is needed."""
    pages = texts(spark, folder, "main_texts", "page_id", "publication_id", "full_text")
    return repeated_lines(pages).select(F.col("page").alias("page_id"), "line_no")


@query
def p1_templates(spark: SparkSession, folder: str) -> DataFrame:
    pages = texts(spark, folder, "main_texts", "page_id", "publication_id", "full_text")
    return line_templates(pages).select(F.col("site").alias("publication_id"), "template", "pages")


@query
def p1_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    pages = texts(spark, folder, "main_texts", "page_id", "publication_id", "full_text")
    return without_repeated_lines(pages).select("page_id", "full_text", "lines_removed")


def _looks(spark: SparkSession, folder: str) -> DataFrame:
    parts = [with_forms(texts(spark, folder, name, "id", text), text).withColumn("field", F.lit(text)) for name, text in (("evidence_items", "excerpt"), ("voices", "quote"))]
    return parts[0].unionByName(parts[1])


@query
def p1_template_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """As p1_cleaned, and freed of the lines of templates with slots."""
    pages = texts(spark, folder, "main_texts", "page_id", "publication_id", "full_text")
    return without_repeated_lines(pages, slots=True).select("page_id", "full_text", "lines_removed")


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return look_alikes(materialise(_looks(spark, folder).select("field", "id", "raw", "look")), "field")


@query
def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    return look_classes(materialise(_looks(spark, folder).select("field", "id", "raw", "look")), "field")


@query
def p3_forms(spark: SparkSession, folder: str) -> DataFrame:
    return _looks(spark, folder).select("field", "id", "form")


@query
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    spans = leaked_spans(texts(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items"))
    return spans.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


@query
def p9_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder, "documents", "doc_id", "text")
    return without_leaks(docs, leaked_spans(docs, table(spark, folder, "eval_items")))


@query
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    classes = text_classes(texts(spark, folder, "documents", "doc_id", "text"))
    return classes.filter(F.col("text_class") != "prose").select(F.col("id").alias("doc_id"), "text_class")


@query
def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return text_statistics(texts(spark, folder, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")


@query
def p10_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The basic counts alone."""
    return text_statistics(texts(spark, folder, "documents", "doc_id", "text")).select(F.col("id").alias("doc_id"), "words", "mean_word_length", "symbol_ratio", "punctuated_lines")


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return main_lines(texts(spark, folder, "main_texts", "page_id", "url", "full_text", "title", "main_text")).withColumnRenamed("page", "page_id")


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = page_texts(texts(spark, folder, "fetch_results", "page_id", "final_url", "requested_url", "content"), texts(spark, folder, "main_texts", "page_id", "url", "title", "main_text"))
    return residue_texts(pages).select(F.col("page").alias("page_id")).distinct()


@query
def p6_kinds(spark: SparkSession, folder: str) -> DataFrame:
    pages = page_texts(texts(spark, folder, "fetch_results", "page_id", "final_url", "requested_url", "content"), texts(spark, folder, "main_texts", "page_id", "url", "title", "main_text"))
    return residue_texts(pages).withColumnRenamed("page", "page_id").withColumn("kinds", F.array_join("kinds", ","))


@query
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [("statement", "statements", "id", "sentence"), ("main_text", "main_texts", "page_id", "main_text")]
    read = [(field, texts(spark, folder, name, key, text), key, text) for field, name, key, text in parts]
    learnt = learn_words(read[0][1].select(F.col("sentence").alias("text")).unionByName(read[1][1].select(F.col("main_text").alias("text"))))
    found = [sentences(rows, key, text, learnt).select(F.lit(field).alias("field"), F.col("id").alias("rec_id"), "start_char", "end_char") for field, rows, key, text in read]
    return found[0].unionByName(found[1])


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    links = school_links(table(spark, folder, "institutions"), table(spark, folder, "publication_candidates"))
    return links.filter(F.col("confidence") >= 0.5).select("unitid", "candidate_id")


@query
def p2_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return school_links(table(spark, folder, "institutions"), table(spark, folder, "publication_candidates"))


@query
def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(texts(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "container_sizes")).withColumnRenamed("id", "doc_id")


@query
def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return fill(packed(texts(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "container_sizes")))


@query
def p8_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Every document once, no container over its capacity, next to none more than the tokens' volume needs."""
    docs = texts(spark, folder, "documents", "doc_id", "text")
    return checked(materialise(packed(docs, table(spark, folder, "container_sizes"))), token_counts(docs))

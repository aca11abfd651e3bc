"""Templates with learnt slots: lines that no count of whole lines finds."""

import random

from pyspark.sql import functions as F

from verbatrix.llm import repeated_lines as R

SCHEMA = "page_id long, publication_id long, full_text string"


def names(n):
    rng = random.Random(2)
    return ["".join(rng.choice("bdgklmprt") + rng.choice("aeiou") for _ in range(4)) for _ in range(n)]


def test_a_byline_with_a_varying_name_goes_by_its_template(spark):
    texts = [f"Story {a} of {b}\nReported by {a} {b} for the desk\nAll {a} things {b} other {i}" for i, (a, b) in enumerate(zip(names(40), names(80)[40:]))]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    assert R.repeated_lines(df).count() == 0  # no line stands twice
    assert {(r["page"], r["line_no"]) for r in R.repeated_lines(df, slots=True).collect()} >= {(i, 2) for i in range(40)}
    assert "7\treported by <*> <*> for the desk" in {r["template"] for r in R.line_templates(df).collect()}
    assert R.without_repeated_lines(df, slots=True).filter(F.contains("full_text", F.lit("Reported"))).count() == 0


def test_the_tree_decides_rows(spark, monkeypatch):
    # without the nodes of the tree nothing is whole, so nothing is found
    df = spark.createDataFrame([(i, 1, f"share this page\n{x}") for i, x in enumerate(names(12))], SCHEMA)
    assert R.repeated_lines(df).count() == 12
    monkeypatch.setattr(R, "covering", lambda lines, min_pages: lines.limit(0).selectExpr("site", "leaf", "slots", "0L AS pages", "page", "line_no"))
    assert R.repeated_lines(df).count() == 0


def test_large_trees_are_joined_with_the_same_result(spark, monkeypatch):
    rng = random.Random(3)
    words = names(30)
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(1, 11))) if rng.random() < 0.7 else "the same line of the site here" for _ in range(6)) for _ in range(60)]
    df = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], SCHEMA)
    small = {tuple(r) for r in R.template_lines(df, min_pages=3).collect()}
    monkeypatch.setattr(R, "BROADCAST_BYTES", 0)
    assert small and {tuple(r) for r in R.template_lines(df, min_pages=3).collect()} == small
    monkeypatch.setattr(R, "TREE_NODES", 10)
    assert {tuple(r) for r in R.template_lines(df.repartition(4), min_pages=3).collect()} == small

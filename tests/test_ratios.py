"""Matching ratios over the characters of whole texts, against difflib."""

import random
from difflib import SequenceMatcher

from tests.conftest import DATA
from verbatrix.operators.similarity import matching_characters, matching_ratio
from verbatrix.plans import catalog


def brute(a, b):
    return 1.0 if a == b else SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_matching_characters_of_short_texts():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choices(rng.choice(["ab", "abc ", "abcdefgh"]), k=rng.randint(0, 25))) for _ in "ab")
        assert matching_characters(a, b) == sum(x.size for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()), (a, b)


def test_ratio_matches_characters_at_every_length(spark):
    from pyspark.sql import functions as F

    pairs = [("abcd" * n + "x", "abcd" * n + "y") for n in (10, 200, 6000)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(matching_ratio()(F.col("a"), F.col("b"))).collect()]
    assert got == [round(2 * (len(a) - 1) / (len(a) + len(b)), 6) for a, b in pairs]


def test_version_queries_against_brute_force(spark, duck):
    pages = {r[0]: (r[1], r[2]) for r in duck.execute("SELECT page_id, main_text, full_text FROM main_texts").fetchall()}
    both = {k: v for k, v in pages.items() if None not in v}
    assert sum(max(map(len, v)) > 400 for v in both.values()) > 50
    ratios = {r["page_id"]: r["ratio"] for r in catalog.QUERIES["version_ratio"](spark, f"{DATA}/sf0.001").collect()}
    assert {k for k, v in ratios.items() if v is None} == set(pages) - set(both)
    assert all(abs(ratios[k] - brute(*v)) < 1e-6 for k, v in both.items())
    seen = {r["page_id"]: r["observations"].split(",") for r in catalog.QUERIES["version_observations"](spark, f"{DATA}/sf0.001").collect()}
    kept = {k: v for k, v in both.items() if v[0].strip() and v[1].strip()}
    assert {k for k, v in seen.items() if "content_altered" in v} == {k for k, (new, old) in kept.items() if round(brute(old, new), 6) < 0.85}

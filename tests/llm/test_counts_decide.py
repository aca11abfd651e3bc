"""Planted pages whose furniture no cue word gives away: the counts over sites decide rows of problems 5 and 6."""

import random

import pytest

from verbatrix.llm.main_content import main_lines
from verbatrix.llm.page_lines import EVIDENCE, FURNITURE_HEADS, FURNITURE_WORDS
from verbatrix.llm.residue_pages import residue_texts

SCHEMA = "page_id long, url string, title string, full_text string, main_text string"
WORDS = "archive board budget canal choir court ferry garden harbour ledger market museum orchard parish quarry school street theatre valley winter".split()


def planted():
    """Pages of 30 sites, the places of their own lines, and the pages of residue."""
    rng = random.Random(11)
    name = lambda: rng.choice("BDGKLMPRT") + "".join(rng.choice(("ar", "el", "in", "or", "ush")) for _ in range(3))
    pages, own, residue = [], set(), set()
    for site in range(30):
        title = name()
        above = [f"{title} Weekly goes out to every house along the river before noon."]
        below = [f"{title} Weekly belongs to the Guild of River Papers and keeps to its rules.", "The views on these pages are those of the people who hold them."]
        for k in range(12):
            teaser = f"{name()} on {name()}: seven things that the town should hear about"
            head = f"{name()} {rng.choice(WORDS)} plan goes to the {rng.choice(WORDS)}"
            story = [" ".join(f"The {rng.choice(WORDS)} of {name()} was shown to the {rng.choice(WORDS)} and {name()} said that it would stay." for _ in range(4)) for _ in range(3)]
            page = len(pages)
            if k == 0:
                residue.add(page)
                lines = [*above, teaser + ".", "Error 503: the server is unavailable", *below]
            else:
                lines = [*above, *([teaser] if k % 3 == 0 else []), head, *story[:2], *([teaser + "."] if k % 3 == 1 else []), f"What {name()} asks of the {rng.choice(WORDS)}", story[2], *below]
                own |= {(page, i) for i, x in enumerate(lines, 1) if x == head or x in story or x.startswith("What ")}
            pages.append((page, f"http://{title.lower()}weekly.example/{k}", head if k else None, "\n".join(lines), None))
    return pages, own, residue


def rates(found, true):
    return len(found & true) / len(true), len(found & true) / max(1, len(found))


@pytest.fixture(scope="module")
def frame(spark):
    pages, own, residue = planted()
    return spark.createDataFrame(pages, SCHEMA), own, residue


def test_own_lines_are_found_by_the_counts(frame):
    df, own, _ = frame
    got = {min_pages: rates({(r["page"], r["line_no"]) for r in main_lines(df, min_pages=min_pages).collect()}, own) for min_pages in (10, 10**9)}
    assert min(got[10]) >= 0.95
    assert got[10**9][1] < 0.9  # without the counts furniture that reads like prose stays


def test_residue_is_found_by_the_counts(frame):
    df, _, residue = frame
    texts = df.selectExpr("page_id AS page", "'full_text' AS field", "split_part(url, '/', 3) AS host", "title", "full_text AS text")
    found = {min_pages: {r["page"] for r in residue_texts(texts, min_pages).collect()} for min_pages in (10, 10**9)}
    assert found[10] == residue and not found[10**9]


def test_copies_of_a_story_are_no_furniture(frame, spark):
    df, own, _ = frame
    copied = spark.createDataFrame([(10_000 + i, *r[1:]) for r in df.filter("page_id = 1").collect() for i in range(300)], SCHEMA)
    found = {(r["page"], r["line_no"]) for r in main_lines(df.unionByName(copied)).collect()}
    assert {x for x in found if x[0] == 10_000} == {(10_000, n) for p, n in own if p == 1}


def test_the_cues_are_few_and_short():
    words = {w for rows in EVIDENCE.values() for w in " ".join(rows).split()}
    assert len(FURNITURE_WORDS | FURNITURE_HEADS) < 40 and all(" " not in w for w in words)

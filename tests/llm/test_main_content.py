"""Short blocks among good, bad and short neighbours, and pages that problem 6 names."""

from verbatrix.llm.main_content import own_lines
from verbatrix.llm.queries import QUERIES

STORY = ["Orm council keeps its archive", "The council voted on Monday to keep the archive as it is, because the record matters."]
FOOTER = ["Share this story", "Most read", "Privacy policy"]
LIST = ["Police log of Orm", "What changed in Orm since May"]


def own(lines):
    return own_lines("\n".join(lines), STORY[0])


def test_short_blocks_amid_footers_are_not_the_pages_own():
    assert own(STORY + LIST + FOOTER + ["Town of Orm and its people"] + FOOTER) == [1, 2, 3, 4]


def test_short_blocks_between_menus_within_a_story_are_not_the_pages_own():
    page = STORY + FOOTER + ["Town of Orm and its people"] + FOOTER + STORY[1:]
    assert own(page) == [1, 2, 10]


def test_notes_in_scripts_without_spaces_go_on_with_the_story():
    assert own(STORY + ["編集部の注記", "裁判所の記録"] + FOOTER) == [1, 2, 3, 4]


def test_menu_sized_entries_of_a_list():
    assert own(STORY + ["Police log of Orm", "Court briefs", "What changed in Orm since May"] + FOOTER) == [1, 2, 3, 4, 5]
    assert own(STORY + ["Court briefs"] + FOOTER) == [1, 2]


def test_pages_of_residue_have_no_lines_though_boilerplate_stands_beside_it(spark, tmp_path):
    notice = "All letters to this paper are read by the desk before noon."
    pages = [(i, "http://orm.example/x", "\n".join([*STORY, notice]), None, None) for i in range(10)] + [(10, "http://orm.example/y", f"{notice}\n[object Object]", None, None)]
    spark.createDataFrame(pages, "page_id long, url string, full_text string, title string, main_text string").write.parquet(str(tmp_path / "main_texts.parquet"))
    assert {r["page_id"] for r in QUERIES["p5_found"](spark, str(tmp_path)).collect()} == set(range(10))

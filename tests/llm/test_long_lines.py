"""Residue and furniture in lines above and below the length of one cue."""

import pytest

from verbatrix.llm.page_lines import cues

LAYOUT = "{{ headline }} by {{ author }} for {{ site }} "
ERROR = "Access denied. You asked for a page that is not open to you. "
STORY = "The council voted on Monday to keep the archive as it is, because the record matters to the people of the town. "


@pytest.mark.parametrize(
    "part,kind",
    [
        (LAYOUT, "layout"),
        ("Access denied for this address. ", "error"),
        ("Traceback (most recent call last) in the page builder. ", "error"),
        ("Please enable JavaScript to view this site. ", "script"),
        ("Sample text for this page. ", "filler"),
    ],
)
def test_residue_at_every_length(part, kind):
    for n in (1, 2, 5, 20, 500):
        if n * len(part) <= 180 and n > 1:
            continue
        assert cues((part * n).strip())[1] == kind, n


def test_notices_of_every_length_are_furniture():
    notice = "We use cookies to run this site. Accept cookies or manage choices. "
    assert all(cues((notice * n).strip())[0] for n in (1, 4, 50))


def test_talk_about_residue_in_a_long_story_is_none():
    assert cues(STORY * 2 + "Access denied. " + STORY) == (False, None)
    assert cues(STORY * 3 + "The page showed {{ name }} in its headline.") == (False, "mark")


def test_long_runs_take_no_time():
    assert cues("1" * 100_000 + "a")[1] is None and cues("x" * 100_000 + "a")[1] is None


@pytest.mark.parametrize("unit", ["{{ ", "<% ", "[[ ", "“error ", "«access denied ", "<!-- ", "[x ", "a@b ", "< ", "| ", "lorem "])
def test_openings_without_ends_take_linear_time(unit):
    import time

    took = []
    for n in (40_000, 320_000):
        text = (unit * (n // len(unit))).strip()
        t = time.process_time()
        cues(text)
        took.append(time.process_time() - t)
    assert took[1] < 20 * took[0] + 0.5, took


@pytest.mark.parametrize("unit", ["<script>", "<p>x", "<head><style>a</style>", "<", "<title>"])
def test_markup_takes_linear_time(unit):
    import time

    from verbatrix.llm.page_lines import markup_lines, markup_title

    took = []
    for n in (40_000, 320_000):
        text = unit * (n // len(unit))
        t = time.process_time()
        markup_lines(text), markup_title(text)
        took.append(time.process_time() - t)
    assert took[1] < 20 * took[0] + 0.5, took

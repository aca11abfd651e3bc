"""Problem 5: the page's own text among menus, notices, teasers and footers, by two-pass block rules.

Blocks are the lines of the text. The first pass looks at a block: stop-word density and length by itself, and its link
density, the share of it in wording that recurs as furniture of sites (`recurrence`). It calls blocks good, bad or short.
In the second pass the short ones inherit from their nearest decided neighbours, within the span that the headline opens.
Pages that problem 6 names by the same text or main_text have no lines of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatrix.llm.arrow import map_batches
from verbatrix.llm.recurrence import BAD, COMMON, GOOD, HEAD, MENU, MENU_WORDS, RESIDUE, SHORT, host_of, link_templates, page_lines, read_lines, with_links
from verbatrix.llm.residue_pages import is_residue, residual_cases
from verbatrix.operators.sizing import join_measured

#: Menus and footers are sections of more bad blocks than so many in a row.
INSERT = 2
#: Words of a short block that may open a story without a headline.
OPENING_WORDS = 4


def _list_entries(at: list[int], size: dict[int, int], label: dict[int, int]) -> list[int]:
    """Menu-sized lines that stand between longer short ones: entries of one list."""
    longer = {i for i in at if label[i] == SHORT and size[i] > MENU_WORDS}
    return [i for h, i, j in zip(at, at[1:], at[2:]) if label[i] == MENU and h in longer and j in longer]


def second_pass(at: list[int], label: dict[int, int]) -> dict[int, int]:
    """Labels of blocks with each run of short ones decided by its nearest decided neighbours.

    Up to INSERT bad blocks among others are inserts (share links, adverts) and decide nothing. Of differing neighbours
    the nearer one counts, by blank lines between; of equally near ones the good one, as subheads open and lists and
    notes go on with a story.
    """
    kept, k = [], 0
    while k < len(at):
        end = k
        while end < len(at) and label[at[end]] == BAD:
            end += 1
        if end - k > INSERT or end == len(at):
            kept += at[k:end]
        kept += at[end : end + 1]
        k = end + 1
    place = {i: n for n, i in enumerate(at)}
    blanks = lambda i, j: j - i - (place[j] - place[i])
    out, k = dict(label), 0
    while k < len(kept):
        end = k
        while end < len(kept) and label[kept[end]] == SHORT:
            end += 1
        if end > k:
            before, behind = kept[k - 1] if k else None, kept[end] if end < len(kept) else None
            near = {x: blanks(*sorted((x, y))) for x, y in ((before, kept[k]), (behind, kept[end - 1])) if x is not None}
            own = any(label[x] in (GOOD, HEAD) for x in near if near[x] == min(near.values()))
            for i in kept[k:end]:
                out[i] = GOOD if own else BAD
        k = end + 1
    return out


def own_blocks(no: list[int], labels: list[int], sizes: list[int], link: list[bool]) -> list[int]:
    """Numbers of the blocks that are the page's own, by what each is, its words and whether it is link wording."""
    at, size = no, dict(zip(no, sizes))
    label = {i: BAD if x == RESIDUE or linked and x != HEAD else x for i, x, linked in zip(no, labels, link)}
    entries = _list_entries(at, size, label)
    label |= {i: BAD for i in at if label[i] == MENU} | {i: SHORT for i in entries}
    good = [i for i in at if label[i] == GOOD]
    heads = [i for i in at if label[i] == HEAD and (not good or i < good[-1])] or [i for i in at if label[i] == HEAD]
    if heads:
        start = heads[0]
    elif good:
        before = [i for i in at if i < good[0] and label[i] == SHORT and size[i] >= OPENING_WORDS]
        start = before[-1] if before else good[0]
        label[start] = HEAD if label[start] == SHORT else label[start]
    else:
        return []
    final = second_pass([i for i in at if i >= start], label)
    return [i for i in at if i >= start and final[i] in (GOOD, HEAD)]


def own_lines(text: str, title: str | None = None, main_text: str | None = None) -> list[int]:
    """Numbers, from 1, of the lines of one text that are the page's own, without counts over other pages."""
    if is_residue(text.split("\n")) or main_text and is_residue(main_text.split("\n")):
        return []
    got = read_lines(text, False, title or "", "")
    return own_blocks(got["no"], got["label"], got["size"], [False] * len(got["no"]))


def _own(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    for b in batches:
        out: dict[str, list] = {"page": [], "line_no": []}
        for page, *rest in zip(b["page"], b["no"], b["label"], b["size"], b["link"]):
            found = own_blocks(*rest)
            out["page"].extend([page] * len(found))
            out["line_no"].extend(found)
        yield out


def main_lines(pages: DataFrame, page_col: str = "page_id", text_col: str = "full_text", title_col: str = "title", main_col: str = "main_text", url_col: str = "url", min_pages: int = COMMON) -> DataFrame:
    """(page, line_no) of the lines that are each page's own text; line_no counts from 1 at `\\n`, blank lines included.

    Texts are read once and whole; what is shuffled are hashes of lines. Null and blank texts give nothing, a null title
    only loses the help of the headline, a null main text its veto, a missing or null url the words of the site's name;
    repeated rows give their lines each, and count once as furniture.
    """
    host = host_of(F.col(url_col)) if url_col in pages.columns else F.lit("")
    rows = pages.select(F.col(page_col).alias("page"), host.alias("host"), F.col(title_col).alias("title"), F.explode(F.create_map(F.lit("full"), F.col(text_col), F.lit("main"), F.col(main_col))).alias("field", "text"))
    lines = page_lines(rows)
    linked = with_links(lines, link_templates(lines.filter("field = 'full'"), min_pages))
    own = map_batches(linked.filter("field = 'full'").select("page", "no", "label", "size", "link"), _own, f"page {rows.schema['page'].dataType.simpleString()}, line_no int")
    return join_measured(own, residual_cases(linked, min_pages).select("page").distinct(), ["page"], "left_anti")


def with_main_content(pages: DataFrame, text_col: str = "full_text", title_col: str = "title", main_col: str = "main_text", out_col: str = "own_text") -> DataFrame:
    """pages with a column of the page's own text, each page by itself (null for a null text, empty if nothing is the page's own)."""
    def cut(texts: pd.Series, titles: pd.Series, mains: pd.Series) -> pd.Series:
        def one(text: str | None, title: str | None, main: str | None) -> str | None:
            if text is None:
                return None
            lines = text.split("\n")
            return "\n".join(lines[i - 1].strip() for i in own_lines(text, title, main))

        return pd.Series([one(*x) for x in zip(texts, titles, mains)], dtype=object)

    return pages.withColumn(out_col, F.pandas_udf(cut, "string")(text_col, title_col, main_col))

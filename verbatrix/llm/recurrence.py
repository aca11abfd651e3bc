"""Lines of pages read once: what each is by itself, and which of their templates recur as furniture of sites.

A template is a line without its closing marks, its digits masked and its capitalised words, and the words of its site's own name, as slots. A
template is link wording if it is common and its lines either come back word by word within their sites, as no story's
do, or stand above the headline of pages, where no story's do. Counts run over the texts that hold a story, each
different text of a site once, so that copies of a page don't make its story look like furniture and residue, which
replaces stories, never does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatrix.llm.arrow import map_batches, pa, pc
from verbatrix.llm.page_lines import dense_letters, facts, markup_lines, markup_title, plain
from verbatrix.operators.sizing import BROADCAST_BYTES, join_measured, materialise

#: Labels of a line by itself.
BAD, MENU, SHORT, GOOD, HEAD, RESIDUE = 0, 1, 2, 3, 4, 5
RESIDUE_KINDS = ("layout", "filler", "error", "script")
#: Short lines of at most so many words are menu entries.
MENU_WORDS = 2
#: A text holds a story if a line of wording has so many characters, or so many letters of a script without spaces.
STORY_CHARS, STORY_LETTERS = 160, 60
#: A template is common from so many texts. It is link wording if at most CONSTANT of its (text, line) pairs differ within
#: sites, or if ABOVE of its lines, and ABOVE_LEAST at least, stand above a headline.
COMMON, CONSTANT, ABOVE, ABOVE_LEAST = 10, 0.75, 0.05, 3

_DIGITS = re.compile(r"\d+")
_SLOTS = re.compile(r"\*(?: \*)+")
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?([^/:?#]+)")


def site_label(host: str) -> str:
    """The letters of a host, in which words of its site's own name are looked for."""
    return re.sub(r"[^a-z0-9]", "", host)


def template(line: str, label: str) -> str:
    """The template of a line with single blanks, on a site whose host has the letters of label."""
    said = _DIGITS.sub("0", line)
    return _template(said, said.casefold(), label)


def _template(said: str, low: str, label: str) -> str:
    said = said.rstrip(".,:;!?… ") or said
    low = low.rstrip(".,:;!?… ") or low
    words = low.split(" ")
    if said == low or said.isupper():
        return _SLOTS.sub("*", " ".join(["*" if len(w) >= 4 and len(x := w.strip(".,:;!?'’")) >= 4 and x in label else w for w in words]))
    kept = [w if w == s else "*" for w, s in zip(words, said.split(" "))]
    if len(kept) - kept.count("*") < 6 and sum(w != "*" and w[0].isalpha() for w in kept) < 2:
        kept[0] = words[0]
        if len(kept) < 3:
            kept = words
    return _SLOTS.sub("*", " ".join(kept))


def _is_headline(line: str, title: str) -> bool:
    if len(line) < 8 or line not in title:
        return False
    rest = title[len(line) :].lstrip() if title.startswith(line) else "x"
    return not rest or rest[0] in "|·-–—:•" or len(line) >= 0.5 * len(title)


def first_pass(line: str, title: str) -> tuple[int, int, int]:
    """(label, residue kind, words) of a line by itself; title is case-folded, the kind an index of RESIDUE_KINDS or -1."""
    furniture, kind, wording, size = facts(line)
    if kind is not None and kind != "mark":
        return RESIDUE, RESIDUE_KINDS.index(kind), size
    if title and len(line) <= len(title) + 8 and _is_headline(line.casefold(), title):
        return HEAD, -1, size
    if furniture:
        return BAD, -1, size
    if wording:
        return GOOD, -1, size
    return MENU if size <= MENU_WORDS and not dense_letters(line) else SHORT, -1, size


def _h(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def read_lines(text: str, markup: bool, title: str, host: str, known: dict[str, tuple] | None = None) -> dict[str, list]:
    """Numbers, labels, residue kinds, sizes, line and template hashes of the lines that aren't blank, where the headline is, and whether a story is there.

    known may hold what the lines of another text of the same page gave.
    """
    lines = [(i, x) for i, x in enumerate(markup_lines(text), 1)] if markup else [(i, p) for i, x in enumerate(text.split("\n"), 1) if (p := plain(x))]
    wanted = plain(title or (markup_title(text) if markup else "")).casefold()
    label = site_label(host)
    known = {} if known is None else known
    got = []
    for _, x in lines:
        if (at := known.get(x)) is None:
            said = _DIGITS.sub("0", x)
            low = said.casefold()
            at = known[x] = (*first_pass(x, wanted), _h(low), _h(_template(said, low, label)))
        got.append(at)
    out = dict(zip(("label", "kind", "size", "line", "template"), map(list, zip(*got)))) if got else {k: [] for k in ("label", "kind", "size", "line", "template")}
    labels = out["label"]
    head = labels.index(HEAD) if HEAD in labels else -1
    story = any(what == GOOD and (len(x) >= STORY_CHARS or dense_letters(x) >= STORY_LETTERS) for what, (_, x) in zip(labels, lines))
    return {"no": [i for i, _ in lines], **out, "head": head, "story": story}


def _read(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    names = ("page", "field", "host", "copy", "head", "story", "no", "label", "kind", "size", "line", "template")
    for b in batches:
        out: dict[str, list] = {k: [] for k in names}
        last, known = None, {}
        for page, field, host, title, text in zip(b["page"], b["field"], b["host"], b["title"], b["text"]):
            if (page, host, title) != last:
                last, known = (page, host, title), {}
            got = read_lines(text, field == "content", title or "", host or "", known if title else {})
            for name, value in {"page": page, "field": field, "host": host or "", "copy": _h(text), **got}.items():
                out[name].append(value)
        yield out


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), _HOST.pattern, 1), F.lit(""))


def page_lines(texts: DataFrame) -> DataFrame:
    """Every text (page, field, host, title, text; field 'content' is markup) as arrays over its lines, written once; no nulls, no blanks."""
    rows = texts.select("page", "field", "host", "title", "text").filter(F.length(F.trim("text")) > 0)
    arrays = "no array<int>, label array<tinyint>, kind array<tinyint>, size array<int>, line array<bigint>, template array<bigint>"
    return materialise(map_batches(rows, _read, f"page {rows.schema['page'].dataType.simpleString()}, field string, host string, copy bigint, head int, story boolean, {arrays}"))


def link_templates(lines: DataFrame, common: int = COMMON) -> DataFrame:
    """(template) that recur as furniture, of the arrays that page_lines gives."""
    once = lines.filter("story").dropDuplicates(["host", "field", "copy"])
    each = once.select("host", "head", F.posexplode(F.arrays_zip("line", "template")).alias("at", "x"))
    each = each.select("host", F.col("x.line").alias("line"), F.col("x.template").alias("template"), (F.col("head") >= 0).cast("int").alias("headed"), (F.col("at") < F.col("head")).cast("int").alias("above"))
    by_line = each.groupBy("template", "host", "line").agg(F.count(F.lit(1)).alias("n"), F.sum("headed").alias("headed"), F.sum("above").alias("above"))
    by_template = by_line.groupBy("template").agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("n"), F.sum("headed").alias("headed"), F.sum("above").alias("above"))
    constant = F.col("different") <= CONSTANT * F.col("n")
    above = (F.col("above") >= ABOVE_LEAST) & (F.col("above") >= ABOVE * F.col("headed"))
    return by_template.filter((F.col("n") >= common) & (constant | above)).select("template")


#: What is kept of a text's lines once their links are known.
LINKED = ("page", "field", "host", "no", "label", "kind", "size", "line")


def with_links(lines: DataFrame, links: DataFrame) -> DataFrame:
    """lines with `link`, an array of booleans over the lines: is the line's template link wording?

    The templates travel as one sorted array while their measured size allows; beyond, lines and templates are joined
    and each text's few lines are put together again. The result is the same.
    """
    links = materialise(links)
    if links.count() * 8 <= BROADCAST_BYTES // 4:
        known = lines.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in links.collect()] or [0], dtype="int64")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                column = b.column("template")
                flat = column.flatten().to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(known.value, flat), len(known.value) - 1)
                offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))])
                link = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(known.value[at] == flat))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in LINKED), link], names=[*LINKED, "link"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.select(*LINKED).schema)
        return lines.select(*LINKED, "template").mapInArrow(run, f"{kinds}, link array<boolean>")
    keyed = materialise(lines.select(F.monotonically_increasing_id().alias("text"), *LINKED, "template"))
    each = keyed.select("text", F.posexplode("template").alias("at", "template"))
    marked = join_measured(each, links.withColumn("hit", F.lit(True)), ["template"], "left")
    flags = marked.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("hit", F.lit(False)).alias("hit")))).alias("x"))
    return keyed.join(flags.select("text", F.col("x.hit").alias("link")), "text").select(*LINKED, "link")

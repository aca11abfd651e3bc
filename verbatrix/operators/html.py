"""Markup: title, links, robots directives and text of pages, with the standard library's parser in Arrow batches."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements whose text is no reading matter, and elements that break a line.
SKIPPED = frozenset("script style noscript template svg nav header footer aside form button select iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BREAKS = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 br tr td section article main body table blockquote pre span".split())
SCHEMA = "struct<title:string,canonical:string,robots:string,links:array<string>,text:string>"


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.canonical, self.robots = "", None, None
        self.links: list[str] = []
        self.parts: list[str] = []
        self.skipping: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "title":
            self.in_title = True
        elif tag == "meta" and (a.get("name") or "").lower() == "robots":
            self.robots = a.get("content")
        elif tag == "link" and "canonical" in (a.get("rel") or "").lower().split():
            self.canonical = a.get("href")
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag in SKIPPED and tag not in VOID:
            self.skipping.append(tag)
        elif tag in BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if self.skipping and tag == self.skipping[-1]:
            self.skipping.pop()
        elif tag in BREAKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skipping:
            self.parts.append(data)


def read_markup(markup: str | None) -> dict | None:
    """The parts of a page; never raises, a piece cut short gives what it holds, null gives null."""
    if markup is None:
        return None
    reader = _Reader()
    try:
        reader.feed(markup)
        reader.close()
    except Exception:  # broken markup: keep what was read
        pass
    lines = (" ".join(x.split()) for x in "".join(reader.parts).split("\n"))
    return {"title": " ".join(reader.title.split()), "canonical": reader.canonical, "robots": reader.robots, "links": reader.links, "text": "\n".join(x for x in lines if x)}


# Elements and attributes of page furniture, and elements that hold blocks of text.
FURNITURE = frozenset("nav header footer aside form button select iframe svg template noscript style".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog".split())
FURNITURE_NAMES = re.compile(r"\b(?:nav|menu|sidebar|footer|header|cookie|share|social|newsletter|subscribe|promo|advert|ads?|related|comments?|breadcrumbs?|widget)\b", re.I)
BLOCKS = frozenset("div section article main td".split())
#: Shorter texts are no main text: the densest block is looked for instead.
SHORTEST_MAIN = 200
_STRING = re.compile(r'"((?:[^"\\]|\\.){200,})"')


class _MainReader(HTMLParser):
    """Text by where it stands: in furniture, in main or article, in paragraphs by the block that holds them, in scripts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # tag, furniture?, number of its block
        self.blocks, self.inside = 0, 0
        self.body: list[str] = []
        self.main: list[str] = []
        self.dense: dict[int, list[str]] = {}
        self.scripts: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            return
        a = dict(attrs)
        named = f"{a.get('id') or ''} {a.get('class') or ''}"
        bad = tag in FURNITURE or (a.get("role") or "").lower() in FURNITURE_ROLES or tag not in ("body", "html", "main", "article") and bool(FURNITURE_NAMES.search(named))
        bad = bad or bool(self.stack and self.stack[-1][1]) and tag not in ("main", "article")
        if tag in BLOCKS:
            self.blocks += 1
        self.stack.append((tag, bad, self.blocks if tag in BLOCKS else self.stack[-1][2] if self.stack else 0))
        self.inside += tag in ("main", "article") or a.get("role") == "main"
        self._put("\n" if tag in BREAKS else "")

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.inside -= sum(t in ("main", "article") for t, _, _ in self.stack[k:])
                del self.stack[k:]
                break
        self._put("\n" if tag in BREAKS else "")

    def _put(self, data: str) -> None:
        if data and not (self.stack and self.stack[-1][1]):
            self.body.append(data)
            if self.inside > 0:
                self.main.append(data)

    def handle_data(self, data: str) -> None:
        tag = self.stack[-1][0] if self.stack else ""
        if tag == "script":
            self.scripts.append(data)
        elif tag not in ("style", "title"):
            self._put(data)
            if any(t == "p" for t, _, _ in self.stack):
                block = next((b for t, _, b in reversed(self.stack) if t in BLOCKS), 0)
                self.dense.setdefault(block, []).append(data)


def _prose(value: str) -> bool:
    words = value.split()
    return len(words) >= 30 and sum(len(w) > 25 for w in words) <= 0.05 * len(words) and ". " in value and value.count("/") <= 0.3 * len(words)


def embedded_text(scripts: list[str]) -> str:
    """Prose that a page ships inside its data: long JSON strings that read like it, without tags, each once, in page order."""
    out: list[str] = []
    for script in scripts:
        for m in _STRING.finditer(script):
            try:
                value = json.loads(f'"{m[1]}"')
            except ValueError:
                continue
            value = " ".join(re.sub(r"<[^>]*>", " ", value).split())
            if value not in out and _prose(value):
                out.append(value)
    return " ".join(out)


def main_text(markup: str | None) -> str | None:
    """The reading matter of a page: what main or article hold, else the body without furniture, else the densest block of
    paragraphs; prose that scripts embed goes with it. Never raises; null gives null."""
    if markup is None:
        return None
    reader = _MainReader()
    try:
        reader.feed(markup)
        reader.close()
    except Exception:  # broken markup: keep what was read
        pass
    flat = lambda parts: " ".join("".join(parts).split())
    text = flat(reader.main)
    if len(text) < SHORTEST_MAIN:
        text = max(text, flat(reader.body), key=len)
    if len(text) < SHORTEST_MAIN and reader.dense:
        text = max(text, max((" ".join(" ".join(x).split()) for x in reader.dense.values()), key=len), key=len)
    inside = embedded_text(reader.scripts)
    return f"{text} {inside}".strip() if inside and inside[:200] not in text else text


# Where markup states its encoding.
CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)


def decoded(content: bytes | None, header: str | None = None) -> str | None:
    """Text of markup bytes: by byte-order mark, header, declaration in the first 2,048 bytes, UTF-8 or else Windows-1252; never raises."""
    if content is None:
        return None
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace")
    said = CHARSET.search((header or "").encode("latin-1", "ignore")) or CHARSET.search(content[:2048])
    for name in (said[1].decode("ascii", "ignore") if said else None, "utf-8", "windows-1252"):
        try:
            return content.decode(name) if name else None or content.decode("utf-8")
        except (LookupError, UnicodeDecodeError):
            continue
    return content.decode("utf-8", "replace")


def with_main_text(df: DataFrame, markup: str, out: str = "reading") -> DataFrame:
    """df with the reading matter of its markup."""
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in pages], dtype=object)

    run.__annotations__ = {"pages": pd.Series, "return": pd.Series}
    return df.withColumn(out, F.pandas_udf(run, "string")(F.col(markup)))


def with_decoded(df: DataFrame, content: str, header: str | None = None, out: str = "markup") -> DataFrame:
    """df with the text of a column of markup bytes, by the column of content-type headers if named."""
    def run(contents: pd.Series, headers: pd.Series) -> pd.Series:
        return pd.Series([decoded(bytes(c) if c is not None else None, h) for c, h in zip(contents, headers)], dtype=object)

    run.__annotations__ = {"contents": pd.Series, "headers": pd.Series, "return": pd.Series}
    return df.withColumn(out, F.pandas_udf(run, "string")(F.col(content), F.col(header) if header else F.lit(None).cast("string")))


def _parse(markup: pd.Series) -> pd.DataFrame:
    names = ["title", "canonical", "robots", "links", "text"]
    return pd.DataFrame([read_markup(x) or dict.fromkeys(names) for x in markup], columns=names)


def with_page_parts(df: DataFrame, markup: str, out: str = "page") -> DataFrame:
    """df with a struct of the page's title, canonical URL, robots directives, links and text; null markup gives nulls."""
    return df.withColumn(out, F.pandas_udf(_parse, SCHEMA)(F.col(markup)))


def native_title(markup: Column) -> Column:
    """The title by expression alone, for scans that need nothing else of the page."""
    return F.trim(F.regexp_extract(F.coalesce(markup, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))

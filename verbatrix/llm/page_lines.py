"""What a single line of a web page looks like by itself: furniture, residue of a layout or an error page, wording, or open.

The cues are short lists of generic words and the syntax of template languages, no wording of any site. What recurs is
counted in `recurrence`; a cue only helps where a line is too rare to be counted.
"""

from __future__ import annotations

import html
import re

from verbatrix.llm.lexicon import CLOSERS, ENDERS, FUNCTION_SETS, HAN_KANA, SPACED_FUNCTION_WORDS, THAI

WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
FUNCTION = SPACED_FUNCTION_WORDS | FUNCTION_SETS["fr"]

# Words of page furniture, in English.
FURNITURE_WORDS = frozenset("advertisement cookie cookies privacy copyright © reserved subscribe newsletter login register share follow comments menu related also sponsored trending terms posted updated tags filed".split())
#: Furniture words that count only at the head of a line, and the words a line they head may have.
FURNITURE_HEADS = frozenset("by photo source more most home search sign read".split())
HEADED_WORDS = 6
#: Share of furniture words from which a line is furniture.
FURNITURE_SHARE = 0.15
SEPARATED = re.compile(r"\s[|·•]\s")
DENSE = re.compile(f"{HAN_KANA.pattern}|{THAI.pattern}")
ADDRESS = re.compile(r"\b[\w.+-]+@[\w-]+\.\w+")

# Syntax of unfilled layouts.
# No mark and no quotation is longer than their quantifiers say, so that an opening without an end costs no more than that.
MARKS = re.compile(
    r"\{\{.{0,200}?\}\}+|\$\{+.{0,200}?\}+|%%\w{1,80}%%|<%.{0,200}?%>|\{%.{0,200}?%\}|#\{.{0,200}?\}|\[\[.{0,200}?\]\]|__[A-Z_]{3,80}__|@@\w{1,80}@@|\{\$[^}]{0,200}\}|\[object Object\]|\bundefined\b|\bNaN\b|<!--.{0,400}?-->"
    r"|<(?:your|insert|enter)\b[^>]{0,200}>|\[[^\]]{0,200}\b(?:goes here|to come|here)\]|\[(?:headline|insert|your)\b[^\]]{0,200}\]|\{\d\}|%[sd]\b",
    re.I,
)
# Words of pages in place of a story, by kind; words of other languages stand behind the English ones. The
# first row of a kind counts double.
EVIDENCE = {
    "error": (
        "error denied forbidden traceback exception unavailable maintenance failed oops introuvable denegado verweigert refusé fehler erreur ошибка",
        "page found gone broken moved missing access blocked requests later try internal warning status down connection server link followed resource upstream response bad recent call line http"
        " página existe seite gefunden pas страница найдена الصفحة موجودة पृष्ठ मिला",
    ),
    "script": (
        "javascript noscript captcha scripts browser робот",
        "enable turn allow reload loading app verify person human continue checking displayed support features requires activar aktivieren activer включите تفعيل सक्षम",
    ),
    "filler": (
        "lorem ipsum placeholder dummy sample beispieltext platzhaltertext blindtext relleno remplissage заполнитель",
        "text texto texte copy test layout paragraph goes here replace your own post ignore asdf qwerty blah bitte ersetzen",
    ),
}
# The same for scripts without spaces, matched as strings.
DENSE_EVIDENCE = {"error": ("見つかりません", "找不到", "不存在", "拒绝", "エラー", "错误", "ไม่พบ"), "script": ("有効にして", "启用", "เปิดใช้งาน"), "filler": ("ダミー", "サンプル", "示例", "占位", "ตัวอย่าง")}
_WEIGHT = {w: (kind, 2 - i) for kind, rows in EVIDENCE.items() for i, row in enumerate(rows) for w in row.split()}
#: Weight of evidence a line needs at least, and for each of its words.
EVIDENCE_LEAST, EVIDENCE_SHARE = 2, 0.28
STATUS = re.compile(r"(?<![\w.,])[45]\d\d(?![\w.,]\d|\w)")
QUOTED = re.compile(r"“[^”]{0,1000}”|\"[^\"]{0,1000}\"|«[^»]{0,1000}»|「[^」]{0,1000}」|„[^“”]{0,1000}[“”]")
TAG = re.compile(r"<[^<>]*>?")
UNREAD = re.compile(r"<(head|script|style)\b", re.I)
UNREAD_ENDS = {tag: re.compile(f"</{tag}>", re.I) for tag in ("head", "script", "style")}
BLOCK = re.compile(r"</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|section|article|header|footer|nav|span|body|html|title|head)\b[^<>]*>", re.I)
TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)


def plain(line: str) -> str:
    return " ".join(line.split())


def without_heads(markup: str) -> str:
    """Markup without its head, scripts and styles; one that isn't closed stays, and is looked for once."""
    out, at, open_ended = [], 0, set()
    for m in UNREAD.finditer(markup):
        tag = m[1].lower()
        if m.start() < at or tag in open_ended:
            continue
        if (end := UNREAD_ENDS[tag].search(markup, m.end())) is None:
            open_ended.add(tag)
            continue
        out.append(markup[at : m.start()])
        at = end.end()
    return "\n".join([*out, markup[at:]])


def markup_lines(markup: str) -> list[str]:
    """The text lines of a piece of markup, its head left out; the last may be cut short."""
    text = BLOCK.sub("\n", without_heads(markup))
    return [x for line in text.split("\n") if (x := plain(html.unescape(TAG.sub("", line))))]


def markup_title(markup: str) -> str:
    return plain(html.unescape(m[1])) if (m := TITLE.search(markup)) else ""


# Words of Latin filler text.
LATIN_FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
    " augue massa quam ligula felis odio mattis semper vitae dapibus porta sapien turpis cursus donec vel ac at nec mauris vestibulum pellentesque morbi tristique senectus netus malesuada fames egestas integer tellus viverra accumsan faucibus ornare suspendisse interdum consequat neque gravida risus".split()
)
#: Lines up to this length are kept in the cache of answers.
CACHED_LENGTH = 180
_MAY_MARK = re.compile(r"[{\[<%]|@@|__|undefined|nan", re.I)
_MAY_SEPARATE = re.compile("[|·•]")
_END, _CLOSE = frozenset(ENDERS), CLOSERS
_FACTS: dict[str, tuple[bool, str | None, bool, int]] = {}


def ends_like_prose(line: str) -> bool:
    """Does the line, free of white space at its end, end in a sentence mark, or one in front of closers?"""
    return line.rstrip(_CLOSE)[-1:] in _END if line else False


def _furniture(line: str, low: list[str]) -> bool:
    if not low:
        return "©" in line
    if low[0] in FURNITURE_HEADS and len(low) <= HEADED_WORDS:
        return True
    if not FURNITURE_WORDS.isdisjoint(low) or "©" in line:
        if sum(w in FURNITURE_WORDS for w in low) + ("©" in line) >= FURNITURE_SHARE * len(low):
            return True
    if _MAY_SEPARATE.search(line) and (m := SEPARATED.search(line)) and (SEPARATED.search(line, m.end() - 1) or not ends_like_prose(line)):
        return True
    return "@" in line and len(low) < 15 and bool(ADDRESS.search(line))


def _filler(words: list[str]) -> bool:
    """Latin filler, or the same few words over and over."""
    n = len(words)
    if n >= 4 and not LATIN_FILLER.isdisjoint(words) and sum(w in LATIN_FILLER for w in words) >= 0.7 * n:
        return True
    return n >= 3 and len(set(words)) <= 0.6 * n and all(len(set(w)) <= 4 and len(w) <= 4 or w.isdigit() for w in words)


def _weights(words: list[str]) -> dict[str, float]:
    out: dict[str, float] = {}
    for w in words:
        if (at := _WEIGHT.get(w)) is not None:
            out[at[0]] = out.get(at[0], 0) + at[1]
    return out


def _evidence(line: str, words: list[str], dense: int) -> str | None:
    weights = _weights(words) if not _WEIGHT.keys().isdisjoint(words) else {}
    if dense:
        for kind, marks in DENSE_EVIDENCE.items():
            if n := sum(line.count(m) * len(m) for m in marks):
                weights[kind] = weights.get(kind, 0) + n
    if not weights and len(words) > 1:
        return None
    if any(c in line for c in '“"«「„'):  # what stands in quotation marks is talked about
        line = QUOTED.sub(" ", line)
        words = WORD.findall(line.casefold())
        weights = _weights(words)
    if STATUS.search(line):
        weights["error"] = weights.get("error", 0) + 1 + (len(words) == 1)
    total = sum(weights.values())
    if total < EVIDENCE_LEAST or total < EVIDENCE_SHARE * max(len(words), dense):
        return None
    return max(weights, key=weights.get)


def _facts(line: str) -> tuple[bool, str | None, bool, int]:
    text = html.unescape(line) if "&" in line else line
    marks = len(MARKS.findall(text)) if _MAY_MARK.search(text) else 0
    words = WORD.findall((MARKS.sub(" ", text) if marks else text).casefold())
    dense = dense_letters(text)
    size = max(len(words), dense // 2)
    wording = _wording(line, words, dense)
    if marks and (not words or marks >= 2 and len(words) <= 2 * marks):
        return False, "layout", wording, size
    if _filler(words):
        return False, "filler", wording, size
    if kind := _evidence(text, words, dense):
        return False, kind, wording, size
    return _furniture(text, words), "mark" if marks else None, wording, size


def facts(line: str) -> tuple[bool, str | None, bool, int]:
    """(furniture?, residue kind, wording?, words) of a line with single blanks.

    The kind is 'layout', 'filler', 'error' or 'script' if the line for the most part is such residue, 'mark' if it only
    holds an unfilled mark. Shares of words decide, so the length of a line makes no difference. Two letters of a script
    without spaces count as a word. Short lines come again and again, so their answers are kept for a while.
    """
    if len(line) > CACHED_LENGTH:
        return _facts(line)
    if (known := _FACTS.get(line)) is None:
        known = _facts(line)
        if len(_FACTS) > 100_000:
            _FACTS.clear()
        _FACTS[line] = known
    return known


def cues(line: str) -> tuple[bool, str | None]:
    """(furniture?, residue kind) of a line with single blanks."""
    return facts(line)[:2]


def stop_density(words: list[str]) -> float:
    """Share of function words among case-folded words."""
    return sum(w in FUNCTION or w.split("'")[0].split("’")[0] in FUNCTION for w in words) / max(1, len(words))


def dense_letters(line: str) -> int:
    """Letters of scripts without spaces."""
    return 0 if line.isascii() or not DENSE.search(line) else len(HAN_KANA.findall(line)) + len(THAI.findall(line))


def _wording(line: str, words: list[str], dense: int) -> bool:
    """A sentence of running text, by length, stop-word density and its end."""
    if dense >= 8:
        return ends_like_prose(line) or dense >= 30 or len(THAI.findall(line)) >= 15
    if len(words) < 6:
        return False
    if len(line) <= 160 and not ends_like_prose(line):
        return False
    return len(line) >= 80 or stop_density(words) >= 0.15 or any(c > "ʯ" and c.isalpha() for c in line)

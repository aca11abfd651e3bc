"""Names of schools and hosts taken apart: core words, kind of school, labels a school's site may carry."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Words around names in titles; names of papers are no list but learnt from the tables (`school_links`).
AROUND = frozenset(
    "the at of for and by in on a an to is our your with from student students newspaper paper news newsroom campus press releases release media home page homepage about us independent voice serving online official site website welcome magazine weekly daily publication publications edition archive main branch est since updated run based coverage sign see more local".split()
)
# Wording of pages that are no site of a school: town papers, rankings, comparisons, platforms' own pages.
NOT_A_SCHOOL = re.compile(
    r"\b(?:town|county|city news|area|farms|obituaries|classifieds|legal notices|local news|high school sports)\b|\bbest (?:colleges|universities|schools)\b|\btop \d+\b|\branked\b|\brankings?\b|\bcompare\b|\bvs\.? |\breviews?, costs?\b|\badmissions? (?:odds|calculator|chances)\b|\bjobs?\b|\bscholarships?\b|[-–|] ?page\b|\best\. ?\d{4}\b|\bhighlights?\b|\bvideos?\b|\bclips?\b",
    re.I,
)
KINDS = ("tech", "poly", "cc", "am", "uof", "state", "saint", "college", "univ")
#: How a kind is written in host labels, before or behind the core.
LABEL_WORDS = {"tech": ("tech", "it"), "poly": ("poly", "polytechnic"), "cc": ("cc", "communitycollege"), "am": ("am", "aandm"), "uof": ("u", "univ", "university"), "state": ("state", "stateuniversity"), "saint": ("st", "saint"), "college": ("college",), "univ": ("u", "univ", "university")}
SCHOOL_WORDS = frozenset("university univ u univer uni college coll state institute inst tech technology polytechnic poly community comm cc aandm saint st school".split())
CLOSING_WORDS = frozenset("university univ univer uni college coll tech technology polytechnic poly cc".split())
_UNIVERSITY = frozenset(("university", "univ", "u", "univer", "uni"))


def tokens_of(text: str) -> list[str]:
    text = unicodedata.normalize("NFKD", text.casefold())
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = re.sub(r"\ba ?& ?m\b|\ba and m\b", " aandm ", text).replace("&", " and ")
    return re.findall(r"[^\W_]+", text)


@lru_cache(maxsize=65536)
def parse_name(text: str, around: frozenset[str] = frozenset()) -> tuple[str, str]:
    """(core, kind) of a school's name inside a text; the core is its own words joined, '' if there are none.

    around: words that stand around schools' names, besides AROUND. Words in front of an of or at that no word of a kind
    opens (Torch of ..), and words behind a word of a kind that ends a name (.. College Torch), are no part of it either.
    """
    t = tokens_of(text)
    kind, drop = "", set()
    n = len(t)
    outer = AROUND | around

    def at(i: int) -> str:
        return t[i] if 0 <= i < n else ""

    for i, w in enumerate(t):
        if w in ("of", "at", "from"):
            if i and not any(x in SCHOOL_WORDS for x in t[:i]) and any(x in SCHOOL_WORDS for x in t[i:]):
                drop |= set(range(i))
            break
    for i, w in enumerate(t):
        if w in ("institute", "inst") and at(i + 1) == "of" and at(i + 2) in ("technology", "tech"):
            kind, drop = kind or "tech", drop | {i, i + 1, i + 2}
        elif w in ("polytechnic", "poly"):
            kind, drop = kind or "poly", drop | {i}
        elif w in ("community", "comm") and at(i + 1) in ("college", "coll"):
            kind, drop = kind or "cc", drop | {i, i + 1}
        elif w == "cc":
            kind, drop = kind or "cc", drop | {i}
        elif w == "aandm":
            kind, drop = kind or "am", drop | {i}
        elif w in _UNIVERSITY and at(i + 1) == "of":
            kind, drop = kind or "uof", drop | {i, i + 1}
    for i, w in enumerate(t):
        if i in drop:
            continue
        if w == "state" or w == "st" and i and (at(i + 1) in _UNIVERSITY or at(i + 1) == "" or at(i + 1) in outer) and at(i - 1) not in outer:
            kind, drop = kind or "state", drop | {i}
        elif w in ("saint", "st") and at(i + 1):
            kind, drop = kind or "saint", drop | {i}
        elif w == "tech":
            kind, drop = kind or "tech", drop | {i}
    for i, w in enumerate(t):
        if i in drop:
            continue
        if w in ("college", "coll"):
            kind, drop = kind or "college", drop | {i}
        elif w in _UNIVERSITY:
            kind, drop = kind or "univ", drop | {i}
    closing = [i for i, w in enumerate(t) if i in drop and w in CLOSING_WORDS]
    # behind a word that closes a name, if words of the name stand in front of it
    if closing and kind != "uof" and any(i not in drop and w not in outer for i, w in enumerate(t[: closing[-1]])):
        drop |= set(range(closing[-1] + 1, n))
    core = [w for i, w in enumerate(t) if i not in drop and w not in outer and not w.isdigit()]
    return "".join(core), kind


def host_of(url: str | None) -> str:
    """Lower-case host of a URL or host name, without www and port; '' for none."""
    m = re.match(r"\s*(?:[a-z][a-z0-9+.-]*://)?(?:[^/@\s]*@)?([^/:?#\s]+)", url.casefold()) if url else None
    host = m[1].strip(".") if m else ""
    return host[4:] if host.startswith("www.") else host


def squeezed(label: str) -> str:
    return re.sub(r"[^a-z0-9]", "", label)


def school_labels(core: str, kind: str) -> list[str]:
    """Squeezed labels that a site of the school may carry as its host."""
    if not core:
        return []
    return [x for w in LABEL_WORDS.get(kind, ()) for x in (w + core, core + w)]


@lru_cache(maxsize=65536)
def label_stems(label: str, around: frozenset[str] = frozenset()) -> list[str]:
    """A squeezed host label and what is left of it without the words papers add to a school's label."""
    whole = squeezed(label)
    out = [whole]
    for w in {"news", "online", "media", "press", "paper", "student", "studentmedia", "studentnews", "edu", "campus", "daily", *around}:
        if whole.endswith(w) and len(whole) > len(w) + 3:
            out.append(whole[: -len(w)])
        if whole.startswith(w) and len(whole) > len(w) + 3:
            out.append(whole[len(w) :])
    return out


def edit_distance(a: str, b: str, limit: int = 3) -> int:
    """Edits (insertions, deletions, substitutions, swaps of neighbours) between a and b, limit + 1 if there are more."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        if min(now) > limit:
            return limit + 1
        before, row = row, now
    return row[-1]


def deletions(word: str) -> set[str]:
    """The word and every form of it with one character deleted: two words one edit apart share at least one."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}

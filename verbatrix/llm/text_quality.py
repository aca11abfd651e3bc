"""Problem 10: per-document text statistics and the structural class.

A document is reduced to four distributions: over character classes, over kinds of word, over shapes of line, and over the
function words of its language (the words listed for it, and one bin for all others). Each structural profile, of prose by
kind of script, of lists, tables and junk, states the same distributions; a language's function words are spread over a
profile's share of them by rank. The class is that of the profile with the least sum of Jensen-Shannon divergences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatrix.llm.arrow import map_batches
from verbatrix.llm.lexicon import ENDS_LIKE_PROSE, FUNCTION_SETS, FUNCTION_WORDS, HAN_KANA, SPACED_FUNCTION_WORDS, THAI, script_language

CHARS = ("lower", "upper", "caseless", "digit", "space", "newline", "mark", "rule", "symbol")
WORDS = ("function", "plain", "capital", "number", "odd", "symbols", "repeated")
LINES = ("closed", "entry", "record")
# The structural profiles, rounded means over 10,000 documents. Of each: class, shares in % of CHARS, WORDS, LINES
# (None: closed lines or entries alike).
PROFILES = (
    ("prose", (76, 4, 0, 1, 16, 0, 3, 0, 0), (33, 43, 20, 3, 0, 1, 0), (97, 3, 0)),
    ("prose", (73, 5, 0, 1, 16, 1, 4, 0, 0), (31, 28, 27, 4, 0, 2, 8), (80, 20, 0)),
    ("prose", (70, 8, 0, 2, 16, 0, 4, 0, 0), (18, 22, 52, 8, 0, 0, 0), (97, 3, 0)),
    ("prose", (8, 60, 0, 1, 15, 1, 4, 0, 0), (31, 0, 65, 3, 0, 1, 0), (95, 5, 0)),
    ("prose", (40, 4, 39, 2, 11, 1, 3, 0, 0), (24, 41, 29, 3, 3, 0, 0), (97, 3, 0)),
    ("prose", (1, 1, 80, 1, 14, 1, 2, 0, 0), (33, 62, 0, 3, 1, 1, 0), (97, 3, 0)),
    ("prose", (45, 6, 38, 3, 3, 0, 5, 0, 0), (12, 42, 24, 3, 19, 0, 0), (97, 3, 0)),
    ("prose", (1, 1, 87, 2, 1, 1, 7, 0, 0), (22, 75, 0, 2, 1, 0, 0), (97, 3, 0)),
    ("list", (74, 7, 0, 1, 11, 3, 4, 0, 0), (3, 27, 52, 3, 0, 0, 15), (3, 97, 0)),
    ("list", (73, 6, 0, 3, 12, 2, 4, 0, 0), (12, 22, 36, 10, 0, 7, 13), (4, 96, 0)),
    ("list", (73, 7, 0, 1, 11, 1, 7, 0, 0), (2, 6, 90, 1, 0, 0, 1), (97, 3, 0)),
    ("list", (1, 1, 78, 2, 8, 5, 5, 0, 0), (8, 76, 0, 6, 0, 4, 6), (4, 96, 0)),
    ("table", (62, 6, 0, 11, 4, 2, 3, 10, 2), (6, 26, 28, 25, 8, 0, 7), (1, 2, 97)),
    ("table", (53, 4, 0, 8, 3, 2, 22, 7, 1), (5, 13, 12, 4, 62, 0, 4), (2, 44, 54)),
    ("table", (54, 4, 0, 6, 2, 2, 2, 24, 6), (4, 8, 5, 1, 79, 0, 3), (1, 2, 97)),
    ("table", (47, 5, 0, 9, 21, 2, 4, 11, 1), (3, 13, 18, 14, 0, 4, 48), (1, 2, 97)),
    ("table", (57, 14, 0, 7, 9, 6, 7, 0, 0), (4, 15, 25, 19, 0, 0, 37), (1, 2, 97)),
    ("table", (36, 3, 0, 7, 50, 2, 1, 1, 0), (5, 26, 35, 32, 0, 0, 2), (1, 4, 95)),
    ("junk", (39, 39, 0, 16, 2, 1, 0, 0, 3), (0, 0, 0, 0, 100, 0, 0), None),
    ("junk", (0, 0, 0, 0, 4, 0, 28, 17, 51), (0, 0, 0, 0, 0, 100, 0), None),
    ("junk", (43, 8, 0, 12, 5, 0, 8, 4, 20), (0, 1, 5, 3, 88, 3, 0), None),
    ("junk", (76, 0, 0, 4, 16, 0, 0, 4, 0), (0, 19, 2, 0, 79, 0, 0), None),
    ("junk", (46, 0, 0, 14, 10, 0, 8, 9, 13), (0, 0, 0, 0, 76, 5, 19), None),
    ("junk", (17, 35, 0, 1, 9, 0, 4, 0, 34), (0, 5, 25, 3, 67, 0, 0), None),
    ("junk", (45, 8, 10, 2, 12, 0, 4, 0, 19), (5, 10, 20, 2, 63, 0, 0), None),
    ("junk", (83, 0, 0, 1, 16, 0, 0, 0, 0), (0, 10, 1, 1, 0, 0, 88), None),
    ("junk", (84, 2, 0, 0, 14, 0, 0, 0, 0), (0, 42, 13, 0, 0, 0, 45), None),
)
#: Documents compared with all profiles in one numpy step.
STEP_DOCUMENTS = 512
#: Weights of the divergences of characters, words, lines and function words.
WEIGHTS = (1.0, 1.0, 1.0, 0.5)
#: Languages whose function words are told apart by counting them, where the script doesn't settle the language.
LATIN = ("en", "es", "de", "fr")
#: Occurrences of a word, function words left out, from which it counts as repeated.
REPEATED = 3
#: A longer word without a mark is no word, a longer line without an end is running text all the same.
LONGEST_WORD, OPEN_LINE = 24, 140
#: Weight of a line's characters, against 1 - CHAR_WEIGHT for the line itself.
CHAR_WEIGHT = 0.65

WORD = re.compile(r"[^\W_]+")
MARKS = ".,:;!?'\"-–—’‘“”„()«»。、，！？「」：；…¿¡।؟،"
RULES = "\t|<>;="
EDGES = MARKS + "*•·"
VOWELS = re.compile(r"[aeiouyà-öø-ýāēīōūœæаеёиоуыэюя]", re.I)
LABEL = re.compile(r"([^\W\d_][^:：\d.!?]{0,30})\s*[:：=]\s*\S")
COLUMNS = re.compile(r"\S\s{2,}\S")


class _Classes(dict):
    """Code point to the letter of its character class, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c == "\n":
            k = "n"
        elif c in RULES:
            k = "t"
        elif c.isspace() and not 0x80 <= code < 0xA0:
            k = "s"
        elif c in MARKS:
            k = "m"
        elif 0x80 <= code <= 0xBF:
            k = "x"  # controls and signs that bytes of another encoding turn into
        elif c.islower():
            k = "l"
        elif c.isupper():
            k = "u"
        elif c.isalpha() or 0x900 <= code <= 0xE7F or 0x300 <= code <= 0x36F or 0x610 <= code <= 0x65F:
            k = "c"
        else:
            k = "d" if c.isdigit() else "x"
        self[code] = k
        return k


_LETTERS = "lucdsnmtx"
_CLASSES = _Classes()


def divergence(p: tuple[float, ...] | list[float], q: tuple[float, ...] | list[float]) -> float:
    """Jensen-Shannon divergence of two distributions, in bits (0 equal, 1 disjoint)."""
    return float(divergences(np.array([p]), np.array([q]))[0, 0])


def char_shares(text: str) -> list[float]:
    classes = text.translate(_CLASSES)
    return [classes.count(c) / max(1, len(text)) for c in _LETTERS]


def tokens_of(text: str) -> dict[str, list]:
    """Case-folded words between blanks, without marks at their ends, with [how often, as first written]; marks alone count as ''."""
    out: dict[str, list] = {}
    for token, n in Counter(text.split()).items():
        word = token.strip(EDGES)
        if not word and len(token) <= 2:
            continue
        if (at := out.get(low := word.casefold())) is None:
            out[low] = [n, word]
        else:
            at[0] += n
    return out


def language_of(text: str, tokens: dict[str, list]) -> str:
    """The language by script, else that of whose function words the text holds most."""
    if not text.isascii() and (found := script_language(text)) and (found not in ("ja", "zh", "th") or len(HAN_KANA.findall(text)) + len(THAI.findall(text)) >= 8):
        return found
    held = {x: sum(tokens[w][0] for w in FUNCTION_SETS[x] & tokens.keys()) for x in LATIN}
    return max(held, key=held.get)


_KINDS: dict[str, str] = {}


def _word_kind(word: str) -> str:
    """The kind of a word that is no function word; words come again and again, so the answers are kept for a while."""
    if (known := _KINDS.get(word)) is not None:
        return known
    bare = word if word.isalpha() else re.sub("[-'’.&]", "", word)
    if bare.isalpha() or not bare.isascii() and not {"x", "d"} & set(bare.translate(_CLASSES)):
        odd = word.isascii() and (len(word) > 2 and not word.isupper() and not VOWELS.search(word) or len(word) > LONGEST_WORD)
        known = "odd" if odd else "capital" if word[0].isupper() else "plain"
    elif not any(c.isalnum() for c in word):
        known = "symbols"
    else:
        known = "number" if sum(c.isdigit() for c in word) >= 0.5 * len(word) else "odd"
    if len(_KINDS) > 200_000:
        _KINDS.clear()
    if len(word) <= 2 * LONGEST_WORD:
        _KINDS[word] = known
    return known


def word_shares(text: str, language: str, tokens: dict[str, list]) -> tuple[list[float], Counter, int]:
    """Shares of the kinds of word, the counts of the language's function words, and all words counted."""
    kinds, held = dict.fromkeys(WORDS, 0), Counter()
    common = FUNCTION_SETS[language]
    dense = language in ("ja", "zh", "th")
    if dense:
        if language == "th":
            letters = len(THAI.findall(text))
            held.update({w: n for w in common if (n := text.count(w))})
            function = sum(n * len(w) for w, n in held.items())
        else:
            found = Counter(HAN_KANA.findall(text))
            letters = sum(found.values())
            held.update({c: n for c, n in found.items() if c in common})
            function = sum(held.values())
        kinds["function"], kinds["plain"] = min(letters, function), max(0, letters - function)
        tokens = tokens_of(HAN_KANA.sub(" ", THAI.sub(" ", text)))
    for low, (n, word) in tokens.items():
        if low in common:
            held[low] += n
            kinds["function"] += n
        elif low in SPACED_FUNCTION_WORDS:
            kinds["function"] += n
        elif word:
            if n > REPEATED:
                kinds["repeated"] += n - REPEATED
                n = REPEATED
            kinds[_word_kind(word)] += n
        elif not dense:
            kinds["symbols"] += n
    total = sum(kinds.values())
    return [x / max(1, total) for x in kinds.values()], held, total


def line_shares(text: str) -> list[float]:
    """Shares of the shapes of line, by characters and in part by lines; a lone entry beside a closed line is its heading and counts as one."""
    lines = [y for x in text.split("\n") if (y := x.lstrip("> \r").rstrip(" \r"))]
    labels = Counter(m[1].strip().casefold() for x in lines if (m := LABEL.match(x)))
    counts = {c: Counter(x.count(c) for x in lines) for c in "\t|;,<" if c in text and len(lines) > 1}
    gaps = "  " in text or "\t" in text
    each: list[str] = []
    for i, x in enumerate(lines):
        ends = bool(ENDS_LIKE_PROSE.search(x))
        words = x.count(" ") + 1
        ruled = not ends and any((n := x.count(c)) >= 2 and at[n] >= max(3, 0.5 * len(lines)) and words <= 4 * (n + 1) for c, at in counts.items())
        if ruled or not ends and "\t" in counts and (n := x.count("\t")) and counts["\t"][n] >= 2:
            each.append("record")
        elif not ends and ((m := LABEL.match(x)) and labels[m[1].strip().casefold()] >= 2 or gaps and len(COLUMNS.findall(x)) >= 2):
            each.append("record")
        elif ends and words >= 4 or len(x) > OPEN_LINE or not x.isascii() and (ends and HAN_KANA.search(x) or len(THAI.findall(x)) >= 12):
            each.append("closed")
        elif i + 1 < len(lines) and lines[i + 1][:1].islower() or each and each[-1] == "closed" and x[:1].islower():
            each.append("closed")  # wrapped prose
        else:
            each.append("entry")
    shares, total = dict.fromkeys(LINES, 0.0), sum(map(len, lines)) or 1
    for i, kind in enumerate(each):
        if kind == "entry":
            around = each[max(0, i - 1) : i] + each[i + 1 : i + 2]
            kind = "closed" if "closed" in around and "entry" not in around else kind
        shares[kind] += CHAR_WEIGHT * len(lines[i]) / total + (1 - CHAR_WEIGHT) / len(lines)
    return list(shares.values())


def _ranked(language: str) -> tuple[tuple[str, ...], tuple[float, ...]]:
    """A language's function words, most frequent first, and their shares of all function words by rank."""
    words = tuple(dict.fromkeys(FUNCTION_WORDS[language].split()))
    weights = [1 / (i + 2) for i in range(len(words))]
    return words, tuple(x / sum(weights) for x in weights)


RANKED = {language: _ranked(language) for language in FUNCTION_WORDS}


def function_shares(language: str, share: float) -> tuple[float, ...]:
    """The distribution over a language's function words, and all others last, of a text with that share of them."""
    return (*(share * x for x in RANKED[language][1]), 1 - share)


def _scaled(rows: list[tuple[float, ...]]) -> np.ndarray:
    table = np.array(rows, dtype="float64")
    return table / table.sum(axis=1, keepdims=True)


_ALL = [(*p[:3], shape) for p in PROFILES for shape in ([p[3]] if p[3] else [(97, 3, 0), (3, 97, 0)])]
_CLASSES_OF = [p[0] for p in _ALL]
_BY_KIND = tuple(_scaled([p[k] for p in _ALL]) for k in (1, 2, 3))
#: The profiles' different shares of function words, and which of them each has; per language the distributions over its
#: function words, and all others last, that those shares give.
_SHARES, _SHARE_OF = np.unique(_BY_KIND[1][:, 0], return_inverse=True)
_BY_FUNCTION = {x: np.array([function_shares(x, w) for w in _SHARES]) for x in RANKED}
_PROSE = np.array([x == "prose" for x in _CLASSES_OF])


def _information(rows: np.ndarray) -> np.ndarray:
    """Sum of x*log2(x) over the last axis; 0 for x = 0."""
    return (rows * np.log2(np.maximum(rows, 1e-300))).sum(axis=-1)


def divergences(shares: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergences, in bits, of every row of shares from every row of profiles: the mean information less that of the mean."""
    mean = (shares[:, None, :] + profiles[None, :, :]) / 2
    return (_information(shares)[:, None] + _information(profiles)[None, :]) / 2 - _information(mean)


class Shape:
    """The distributions of one text that isn't blank."""

    def __init__(self, text: str) -> None:
        tokens = tokens_of(text)
        self.language = language_of(text, tokens)
        self.chars, self.lines = char_shares(text), line_shares(text)
        self.words, held, total = word_shares(text, self.language, tokens)
        inside = [held[w] / max(1, total) for w in RANKED[self.language][0]]
        inside.append(max(0.0, 1 - sum(inside)))
        whole = sum(inside)
        self.function = [x / whole for x in inside]


def counts_of(text: str) -> tuple[int, float, float, float]:
    """(words, mean word length, symbol ratio, share of lines ending in punctuation) of a text that isn't blank."""
    words = WORD.findall(text)
    ends = [bool(ENDS_LIKE_PROSE.search(y)) for x in text.split("\n") if (y := x.strip())]
    return len(words), sum(map(len, words)) / len(words) if words else 0.0, text.translate(_CLASSES).count("x") / len(text), sum(ends) / len(ends)


def nearest(shapes: list[Shape]) -> list[tuple[str, float, float, float]]:
    """Of each, (class, its profile's weighted divergence, the characters' and the function words' divergence from the nearest prose)."""
    out: list[tuple[str, float, float, float]] = []
    for k in range(0, len(shapes), STEP_DOCUMENTS):
        part = shapes[k : k + STEP_DOCUMENTS]
        by_char, by_word, by_line = (divergences(np.array([getattr(x, name) for x in part]), table) for name, table in zip(("chars", "words", "lines"), _BY_KIND))
        by_function = np.empty_like(by_char)
        for language in {x.language for x in part}:
            at = [i for i, x in enumerate(part) if x.language == language]
            by_function[at] = divergences(np.array([part[i].function for i in at]), _BY_FUNCTION[language])[:, _SHARE_OF]
        total = sum(w * d for w, d in zip(WEIGHTS, (by_char, by_word, by_line, by_function)))
        best = total.argmin(axis=1)
        prose = np.where(_PROSE, by_char, 9.0).argmin(axis=1)
        out.extend((_CLASSES_OF[b], float(total[i, b]), float(by_char[i, p]), float(by_function[i, p])) for i, (b, p) in enumerate(zip(best, prose)))
    return out


def text_class(text: str) -> tuple[str, float, float, float]:
    return nearest([Shape(text)])[0]


_NAMES = ("id", "words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "char_divergence", "word_divergence", "class_divergence", "text_class")


def _statistics(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    for b in batches:
        shapes = [Shape(text) if text and text.strip() else None for text in b["text"]]
        found = iter(nearest([x for x in shapes if x]))
        out: dict[str, list] = {k: [] for k in _NAMES}
        for key, text, shape in zip(b["id"], b["text"], shapes):
            row = (key, 0, *[None] * 8)
            if shape:
                name, near, chars, wording = next(found)
                row = (key, *counts_of(text), shape.words[0], chars, wording, near, name)
            for column, value in zip(out, row):
                out[column].append(value)
        yield out


def _classes_alone(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    for b in batches:
        held = [(key, Shape(text)) for key, text in zip(b["id"], b["text"]) if text and text.strip()]
        yield {"id": [key for key, _ in held], "text_class": [x[0] for x in nearest([shape for _, shape in held])]}


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_class) of every row whose text isn't null or blank, as text_statistics gives it, without the counts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, _classes_alone, f"id {rows.schema['id'].dataType.simpleString()}, text_class string")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words, mean_word_length, symbol_ratio, punctuated_lines, common_words, three divergences, text_class) of every row.

    text_class is prose, list, table or junk. Null and blank texts have 0 words and nulls otherwise; whole texts are read;
    repeated rows stay; one narrow pass without a shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, _statistics, f"id {kind}, words bigint, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, char_divergence double, word_divergence double, class_divergence double, text_class string")


__all__ = ["divergence", "line_shares", "text_class", "text_classes", "text_statistics"]

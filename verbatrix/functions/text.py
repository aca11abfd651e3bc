"""Text expressions: white space, hashing forms, near-duplicate keys, names, weighted keyword scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbatrix.functions.unicode_forms import nfkc

def compact_ws(t: Column) -> Column:
    """Runs of white space of any kind to one blank, ends trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)\s+", " "))


def comparable(t: Column) -> Column:
    """The rest of hash_form for a text already in the form NFKC."""
    return F.trim(F.regexp_replace(F.translate(F.lower(t), "’‘", "''"), r"[^a-z0-9']+", " "))


def hash_form(t: Column) -> Column:
    """The comparable form: NFKC, lower case, curled apostrophes straightened, all but a-z 0-9 and ' to blanks, collapsed; null gives ''."""
    return comparable(nfkc(F.coalesce(t, F.lit(""))))


def text_sha(t: Column) -> Column:
    return F.sha2(F.coalesce(t, F.lit("")), 256)


def shingles(words: Column, n: int) -> Column:
    """Runs of n consecutive words of an array, each joined by a blank; none if it is shorter."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with value worked out once a row: inside a lambda a plain expression would be worked out for every element."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def near_duplicate_key(t: Column, n: int = 5, keep: int = 6) -> Column:
    """A key that texts with mostly the same n-word runs share: the `keep` smallest distinct run hashes, hashed again.

    Texts of up to n words are keyed by all of their words. Computed in the JVM, no shuffle.
    """

    def key(words: Column) -> Column:
        runs = F.slice(F.array_sort(F.array_distinct(F.transform(shingles(words, n), lambda s: F.substring(F.sha2(s, 256), 1, 16)))), 1, keep)
        short = F.sha2(F.array_join(words, " "), 256)
        return F.substring(F.when(F.size(words) <= n, short).otherwise(F.sha2(F.array_join(runs, "|"), 256)), 1, 24)

    return bound(F.split(hash_form(t), " "), key)


def slug(t: Column, longest: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, longest)


def person_key(name: Column) -> Column:
    """Lower case without dots, everything but letters to one hyphen."""
    bare = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\.", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[^a-z]+", "-"), r"^-+|-+$", "")


def organisation_name(name: Column) -> Column:
    """& to and, saint to st, a leading or trailing 'the' dropped, punctuation to blanks, lower case, collapsed."""
    t = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "&", " and ")
    t = F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " "))
    t = F.regexp_replace(t, r"(^| )saint( |$)", "$1st$2")
    return F.trim(F.regexp_replace(t, r"^the | the$", ""))


def acronym(name: Column) -> Column:
    """Initials of the words of the organisation's name, small words left out."""
    words = F.filter(F.split(organisation_name(name), " "), lambda w: ~w.isin("of", "and", "the", "at", "in", "for", ""))
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def leading_int(t: Column) -> Column:
    """The whole number a text opens with; null if it opens with none."""
    return F.regexp_extract(F.coalesce(t, F.lit("")), r"^ *([0-9]+)", 1).try_cast("int")


def headline(title: Column) -> Column:
    """A page title without the site's name behind the last separator."""
    return F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+[|·–—-]\s+[^|·–—]*$", ""))


def weighted_keywords(t: Column, weights: dict[str, float], cap: float = 100.0) -> Column:
    """Sum of the weights of the patterns found in a text (ASCII case ignored), capped; null counts as ''."""
    text = F.coalesce(t, F.lit(""))
    total = reduce(lambda a, b: a + b, (F.when(text.rlike(f"(?i){p}"), F.lit(float(w))).otherwise(F.lit(0.0)) for p, w in weights.items()), F.lit(0.0))
    return F.least(total, F.lit(float(cap)))


def tags_of(t: Column, patterns: dict[str, str]) -> Column:
    """Sorted names of the patterns found in a text."""
    text = F.coalesce(t, F.lit(""))
    return F.array_sort(F.array_compact(F.array(*(F.when(text.rlike(f"(?i){p}"), F.lit(name)) for name, p in patterns.items()))))


def function_word_share(t: Column, words: list[str]) -> Column:
    """Share of a text's ASCII words that are in a list; null without words."""
    tokens = F.filter(F.split(hash_form(t), " "), lambda w: w != "")
    return F.try_divide(F.size(F.filter(tokens, lambda w: w.isin(*words))).cast("double"), F.nullif(F.size(tokens), F.lit(0)).cast("double"))


def emails(t: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"([a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+)"), 1))


def windows_around(t: Column, pattern: str, width: int = 360, most: int = 4) -> Column:
    """Up to `most` excerpts of `width` characters on either side of a pattern's hits, for each text."""
    return F.slice(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(rf"(?si)(.{{0,{width}}}(?:{pattern}).{{0,{width}}})"), 1), 1, most)


def factor_match(t: Column, factors: dict[str, tuple[float, list[str]]], active: list[str] | None = None, digits: int = 2) -> tuple[Column, Column]:
    """(score, names) of the factors that a text matches: the share of their weights, out of 100, in all or in the active ones.

    A factor is matched if all of its patterns are found, ASCII case ignored: with more than one it is conjunctive.
    """
    text = F.coalesce(t, F.lit(""))
    used = {n: f for n, f in factors.items() if active is None or n in active}
    hit = {n: reduce(lambda a, b: a & b, (text.rlike(f"(?i){p}") for p in patterns)) for n, (_, patterns) in used.items()}
    total = sum(w for w, _ in used.values())
    score = reduce(lambda a, b: a + b, (F.when(hit[n], F.lit(float(w))).otherwise(F.lit(0.0)) for n, (w, _) in used.items()), F.lit(0.0))
    return F.round(100 * score / total, digits), F.array_sort(F.array_compact(F.array(*(F.when(h, F.lit(n)) for n, h in hit.items()))))


# Local parts of addresses that no person reads.
UNREAD = r"^(?:no-?reply|donotreply|privacy|abuse|postmaster|webmaster|ads?|advertis\w*|sales|billing|subscriptions?|circulation|careers|jobs|hr|classifieds?|marketing)$"


def own_emails(t: Column, domain: Column) -> Column:
    """The addresses of a text on the domain or below it, without those that no person reads."""
    site = F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), r"^www\.", "")
    at = lambda e: F.substring_index(e, "@", -1)
    return F.filter(emails(t), lambda e: (site != "") & ((at(e) == site) | F.endswith(e, F.concat(F.lit("."), site))) & ~F.substring_index(e, "@", 1).rlike(UNREAD))

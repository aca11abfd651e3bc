"""What pages and their addresses tell: title keys, kinds of page, kept sentences, names, request addresses, public hosts."""

from __future__ import annotations

import ipaddress
from functools import reduce
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from verbatrix.functions.text import bound, comparable, hash_form
from verbatrix.functions.unicode_forms import nfkc
from verbatrix.functions.urls import host

#: The rest of a title from its first separator on: one that always separates, or a hyphen that no other follows.
SITE_NAME = r"(?s)(?:\s+[–—|·]\s+|\s+-\s+(?=[^-]+$)).*$"


def title_key(title: Column) -> Column:
    """The comparable form of a title without its site's name, cut at the first separator."""
    return hash_form(F.regexp_replace(F.coalesce(title, F.lit("")), SITE_NAME, ""))


# Patterns of kinds of page, matched without case.
LEGAL = r"(?:privacy|cookie|terms[-_ ]of[-_ ](?:use|service)|terms[-_ ]and[-_ ]conditions|\bterms\b|gdpr|ccpa|do[-_ ]not[-_ ]sell|accessibility|disclaimer|copyright[-_ ]policy|dmca|user[-_ ]agreement|advertis)"
STORY = r"/(?:19|20)\d{2}/\d{1,2}/|/\d{4}-\d{2}-\d{2}|/article[s]?/|/story/"
POLICY = r"(?:polic(?:y|ies)|ethic|standards|guidelines|code[-_ ]of|corrections?|unpublish|takedown|take-down|removal|remove|de-?index|anonymi|archive[-_ ]polic|editorial[-_ ]polic|handbook|bylaws|faq|principles|right[-_ ]to[-_ ]be[-_ ]forgotten|fresh[-_ ]start)"
ABOUT = r"(?:^|/)(?:about|about-us|who-we-are|masthead|staff|contact|mission|our-team)(?:/|$|\.)"
ARTICLE = r"/(?:19|20)\d{2}/\d{1,2}/|/\d{4}-\d{2}-\d{2}|/article_|/story/|/news/[^/]{25,}"


def kind_of_page(url: Column, title: Column, is_pdf: Column, is_listing: Column) -> Column:
    """homepage, legal_boilerplate, listing, article, policy, about, pdf or other, by the first rule that holds."""
    path = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))
    name = F.coalesce(title, F.lit(""))
    has = lambda text, pattern: text.rlike(f"(?i){pattern}")
    both = F.concat_ws(" ", path, name)
    return (
        F.when(path == "/", "homepage")
        .when(has(F.concat_ws(" ", path, F.substring(name, 1, 120)), LEGAL), "legal_boilerplate")
        .when(F.coalesce(is_listing, F.lit(False)), "listing")
        .when(has(path, STORY), "article")
        .when(has(both, POLICY), "policy")
        .when(has(path, ABOUT), "about")
        .when(F.coalesce(is_pdf, F.lit(False)), "pdf")
        .when(has(path, ARTICLE), "article")
        .otherwise("other")
    )


def kept_sentences(old: Column, new: Column, shortest: int = 40, digits: int = 3) -> Column:
    """Share of old's sentences, of at least `shortest` characters in comparable form, that new still holds; 1.0 without any."""
    cut = nfkc(F.regexp_replace(F.coalesce(old, F.lit("")), r"([.!?])\s+", "$1\u0001"))

    def share(both: Column) -> Column:
        sentences = F.filter(F.transform(F.split(both["cut"], "\u0001"), comparable), lambda s: F.length(s) >= shortest)
        return bound(sentences, lambda s: F.coalesce(F.try_divide(F.size(F.filter(s, lambda x: F.contains(both["held"], x))).cast("double"), F.nullif(F.size(s), F.lit(0)).cast("double")), F.lit(1.0)))

    return F.round(bound(F.struct(cut.alias("cut"), hash_form(new).alias("held")), share), digits)


#: Two capitalised words, a middle initial allowed, as a pattern without look-around.
PERSON = r"\b([A-Z][a-z]{1,20}(?:\s+[A-Z]\.)?\s+(?:Mc|Mac|O')?[A-Z][a-z]{1,25}(?:-[A-Z][a-z]{1,20})?)\b"
# Capitalised words that are no part of a person's name.
NO_NAME = (
    "The This That University College Police Department County City State Court District Street Avenue Hall Center Campus Student Students News Daily Times"
    " Office Public Safety North South East West New Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July"
    " August September October November December Editor Editors Staff Sheriff Superior Associated Press By On In At For And But After When Before During According"
    " Sports Opinion Photo Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec United States Read More Related Share Comments Contact Advertise"
    " Prosecuting Attorney Judge Officer Sergeant Detective Chief President Dean Professor"
).split()


def people(text: Column) -> Column:
    """Distinct names of persons in a text: capitalised words of three letters or more at both ends, none of them ordinary."""
    ordinary = F.array(*map(F.lit, NO_NAME))

    def named(n: Column) -> Column:
        words = F.split(n, r"\s+")
        ends = (F.length(words[0]) >= 3) & (F.length(F.element_at(words, -1)) >= 3)
        return ends & ~F.arrays_overlap(F.transform(words, lambda w: F.regexp_replace(w, r"\.+$", "")), ordinary)

    return F.filter(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PERSON), 1)), named)


def names_gone(old: Column, new: Column) -> Column:
    """Names of persons in old of which no word of three letters or more stands in new."""
    def gone(words: Column) -> Column:
        return F.filter(people(old), lambda n: F.size(F.filter(F.transform(F.split(n, r"\s+"), lambda w: F.regexp_replace(w, r"\.+$", "")), lambda w: (F.length(w) >= 3) & F.array_contains(words, w))) == 0)

    return bound(F.array_distinct(F.regexp_extract_all(F.coalesce(new, F.lit("")), F.lit(r"([A-Za-z][A-Za-z'-]+)"), 1)), gone)


def shared_vocabulary(old: Column, new: Column) -> Column:
    """Share of old's distinct words of four letters or more that new holds; 1.0 without any."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit("([a-z]{4,})"), 1))
    both = F.struct(hash_form(old).alias("old"), hash_form(new).alias("new"))
    pairs = F.transform(F.array(both), lambda x: F.struct(words(x["old"]).alias("a"), words(x["new"]).alias("b")))
    return F.element_at(F.transform(pairs, lambda x: F.coalesce(F.try_divide(F.size(F.array_intersect(x["a"], x["b"])).cast("double"), F.nullif(F.size(x["a"]), F.lit(0)).cast("double")), F.lit(1.0))), 1)


# What may stand unquoted in a path and in a query of a request, and the ports that may be asked.
PATH_SAFE, QUERY_SAFE = "/%:@!$&'()*+,;=-._~", "=&%:@!$'()*+,;/?-._~"
PORTS = (80, 443, 8080, 8443)
LABEL = r"(?!-)[a-z0-9-]{1,63}(?<!-)"


def request_address(url: str | None, base: str | None = None, ports: tuple[int, ...] | None = PORTS) -> str | None:
    """An http(s) address to ask for: scheme and host lower, default port and fragment dropped, path and query kept but for
    unsafe characters; null for anything malformed, with credentials, or on another port."""
    try:
        parts = urlsplit(urljoin(base, url.strip()) if base else url.strip())
        name, port, scheme = (parts.hostname or "").lower().rstrip("."), parts.port, parts.scheme.lower()
        if scheme not in ("http", "https") or not name or parts.username or parts.password or port is not None and ports is not None and port not in ports:
            return None
        name = name if name.isascii() else name.encode("idna").decode()
        if not pd.Series([name]).str.fullmatch(rf"{LABEL}(?:\.{LABEL})*")[0] and not _is_address(name):
            return None
        place = (f"[{name}]" if ":" in name else name) + (f":{port}" if port and port != {"http": 80, "https": 443}[scheme] else "")
        return urlunsplit((scheme, place, quote(parts.path or "/", safe=PATH_SAFE), quote(parts.query, safe=QUERY_SAFE), ""))
    except (ValueError, UnicodeError, AttributeError):
        return None


def _is_address(name: str) -> bool:
    try:
        ipaddress.ip_address(name)
        return True
    except ValueError:
        return False


def request_url(url: Column) -> Column:
    def run(urls: pd.Series) -> pd.Series:
        return pd.Series([None if u is None else request_address(u) for u in urls], dtype=object)

    run.__annotations__ = {"urls": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(url)


def on_hosts(url: Column, suffixes: list[str]) -> Column:
    """Is the URL's host one of the suffixes, or below one?"""
    h = host(url)
    return reduce(lambda a, b: a | b, ((h == s) | F.endswith(h, F.lit(f".{s}")) for s in suffixes))


# Names that stay inside a network.
INNER = (".local", ".localhost", ".internal", ".lan", ".home.arpa")


def public_address(name: str | None) -> bool:
    """Is a host a public name or address? Embedded IPv4 addresses are unwrapped, numeric encodings of addresses are not public."""
    name = (name or "").lower().strip().strip("[]").rstrip(".")
    if not name or name in ("localhost", "localhost.localdomain") or name.endswith(INNER):
        return False
    try:
        return _public(ipaddress.ip_address(name))
    except ValueError:
        pass
    number = r"(?:0x[0-9a-f]+|\d+)"
    return not pd.Series([name]).str.fullmatch(rf"{number}(?:\.{number}){{0,3}}")[0] and request_address(f"https://{name}/") is not None


def _public(ip: ipaddress.IPv4Address | ipaddress.IPv6Address) -> bool:
    if isinstance(ip, ipaddress.IPv6Address):
        inner = [x for x in (ip.ipv4_mapped, ip.sixtofour, *(ip.teredo or ())) if x is not None]
        if inner:
            return all(map(_public, inner))
    return ip.is_global and not (ip.is_multicast or ip.is_unspecified or ip.is_reserved or ip.is_loopback or ip.is_private or ip.is_link_local)


def is_public(name: Column) -> Column:
    def run(names: pd.Series) -> pd.Series:
        return names.map({n: public_address(n) for n in names.unique()}).fillna(False).astype(bool)

    run.__annotations__ = {"names": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "boolean")(name)


# What the local part of an address tells of its owner, first match first.
ROLES = [("standards", "standards editor"), ("editor-in-chief", "editor-in-chief"), ("eic", "editor-in-chief"), ("editor", "editor"), ("managing", "managing editor"), ("adviser", "adviser"), ("advisor", "adviser"), ("publisher", "publisher"), ("news", "newsroom"), ("letters", "letters"), ("tips", "tips"), ("contact", "general contact"), ("info", "general contact")]


def role_of(local: Column) -> tuple[Column, Column]:
    """(role, rank) by the first of ROLES that an address's local part holds; contact, last, without any."""
    low = F.lower(F.coalesce(local, F.lit("")))
    role, rank = F.lit("contact"), F.lit(len(ROLES))
    for i, (needle, name) in reversed(list(enumerate(ROLES))):
        role, rank = F.when(F.contains(low, F.lit(needle)), F.lit(name)).otherwise(role), F.when(F.contains(low, F.lit(needle)), F.lit(i)).otherwise(rank)
    return role, rank


def relationship(site: Column, url: Column) -> Column:
    """How a paper's address stands to its school's: unknown, independent_domain, institution_subdomain or institution_path."""
    a, b = host(site), host(url)
    same = (a != "") & (b != "") & ((a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a)))
    return F.when(F.length(F.coalesce(site, F.lit(""))) == 0, "unknown").when(~same, "independent_domain").when(a != b, "institution_subdomain").otherwise("institution_path")


# Terms of policies with their weights, matched without case.
POLICY_TERMS = {
    r"\bde[- ]?index(?:ing|ed)?\b": 8.0,
    r"\bnoindex\b": 8.0,
    r"\banonym(?:ize|ise|ized|ised|ization|isation|ity)\b": 7.0,
    r"\bunpublish(?:ed|ing)?\b": 8.0,
    r"\btake[- ]?down\b": 7.0,
    r"\bremov(?:e|al|ed|ing)\b": 3.0,
    r"\b(chang(?:e|ed|ing) circumstances|circumstances have changed)\b": 8.0,
    r"\b(charges? (?:were |was )?(?:dismissed|dropped)|case (?:was )?dismissed)\b": 9.0,
    r"\bexpung(?:e|ed|ement)\b": 9.0,
    r"\b(record|records|case).{0,30}\bseal(?:ed|ing)?\b": 8.0,
    r"\bacquitt(?:ed|al)\b": 9.0,
    r"\brehabilitat(?:e|ed|ion)\b": 6.0,
    r"\bprivacy\b": 3.0,
    r"\b(safety|physical harm|credible threat)\b": 4.0,
    r"\b(reputational? harm|damage to (?:a |their |his |her )?reputation)\b": 7.0,
    r"\bminimi[sz](?:e|ing) harm\b": 5.0,
    r"\bpublic interest\b": 3.0,
    r"\bcase[- ]by[- ]case\b": 7.0,
    r"\b(update|updated|updating|editor'?s note|addendum|follow[- ]up)\b": 2.0,
    r"\b(correction|corrected|corrections policy)\b": 2.0,
    r"\b(archive|historical record|record of publication|integrity of (?:the )?archive)\b": 2.0,
    r"\b(search engine|google|bing|search results?)\b": 2.0,
    r"\brobots\.txt\b": 4.0,
}
# What raises a page's score besides: its address, the wording of its rules, of its refusals.
POLICY_PATH = (r"(?:about|policy|policies|ethics|standards|correction|archive|privacy|remov|unpublish|takedown|deindex|editorial)", 6.0)
POLICY_RULES = (r"\b(editorial|newsroom|publication) (?:policy|policies|standards|guidelines)\b", 6.0)
POLICY_REFUSAL = (r"(?:do not (?:remove|delete|unpublish)|will not (?:remove|delete|unpublish)|never (?:remove|delete|unpublish)|archive.{0,50}(?:permanent|historical record)|content.{0,30}(?:will|shall) remain)", 7.0)


def policy_score(url: Column, title: Column, text: Column) -> Column:
    """The weights of the policy terms and wordings that a page's title and text hold, and of its address; 100 at most."""
    hay = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    found = [F.when(hay.rlike(f"(?i){p}"), F.lit(w)).otherwise(F.lit(0.0)) for p, w in {**POLICY_TERMS, POLICY_RULES[0]: POLICY_RULES[1], POLICY_REFUSAL[0]: POLICY_REFUSAL[1]}.items()]
    by_path = F.when(F.coalesce(url, F.lit("")).rlike(f"(?i){POLICY_PATH[0]}"), F.lit(POLICY_PATH[1])).otherwise(F.lit(0.0))
    return F.least(reduce(lambda a, b: a + b, found, by_path), F.lit(100.0))


# Function words, and the wording of page furniture, by which a sentence is told from a menu.
SENTENCE_WORDS = "the a an of to and or is are we be in for that if will may not with our on by from should would can could it its this their them they as at any all when who which has have was were must do does than but such because about after before no never only us you".split()
CHROME = r"\b(?:this page|this site uses cookies|cookie|subscribe|newsletter|sign up|log ?in|password|read more|click here|share this|follow us|all rights reserved|copyright ©|powered by|skip to (?:main )?content|privacy policy|terms of (?:use|service)|javascript)\b"


def is_chrome(sentence: Column) -> Column:
    """Is a sentence page furniture: short, almost without function words, or worded like it?"""
    s = F.trim(F.coalesce(sentence, F.lit("")))
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    few = bound(words, lambda ws: (F.size(ws) < 7) | ((F.size(ws) >= 12) & (F.size(F.filter(ws, lambda w: F.regexp_replace(F.lower(w), r"^[,.;:]+|[,.;:]+$", "").isin(*SENTENCE_WORDS))) < 0.06 * F.size(ws))))
    return (F.length(s) < 40) | few | s.rlike(f"(?i){CHROME}")


def percent(n: Column, d: Column) -> Column:
    """'12.5%', or 'n/a' without a denominator."""
    return F.when(F.coalesce(d, F.lit(0)) == 0, F.lit("n/a")).otherwise(F.format_string("%.1f%%", F.lit(100.0) * n / d))


def number_text(v: Column) -> Column:
    """A number as text: – for null, three digits below 1, else two and thousands apart."""
    return F.when(v.isNull(), F.lit("–")).when(v < 1.0, F.format_string("%.3f", v.cast("double"))).otherwise(F.format_string("%,.2f", v.cast("double")))


def rounded(v: Column, digits: int) -> Column:
    """v rounded as the binary number it is, halves to even."""
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: round(x, digits), na_action="ignore").astype("float64")

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(v.cast("double"))


#: The name of a campus behind a school's name.
CAMPUS = r"(?i)\s*[-–,]\s*(?:main campus|[A-Z][\w .'&]*campus)\s*$"


def base_name(name: Column) -> Column:
    """A school's name without that of its campus."""
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), CAMPUS, ""))


#: What parts a title.
PARTS = r"\s+[|–—:-]\s+"


def title_part(title: Column, generic: str, wanted: str, other: Column, longest: int = 120, plain: int = 80) -> Column:
    """The part of a title that names its paper: the first that isn't generic and looks wanted or opens with 'the', else the
    first that isn't generic, up to `plain` characters and not `other`; null for none. generic and wanted are patterns."""
    parts = F.filter(F.transform(F.split(F.coalesce(title, F.lit("")), PARTS), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    named = F.filter(parts, lambda p: ~p.rlike(f"(?i)^(?:{generic})$"))
    best = F.filter(named, lambda p: p.rlike(f"(?i){wanted}") | F.startswith(F.lower(p), F.lit("the ")))
    rest = F.filter(named, lambda p: (F.length(p) <= plain) & (F.lower(p) != F.lower(F.coalesce(other, F.lit("")))))
    return F.substring(F.coalesce(F.try_element_at(best, F.lit(1)), F.try_element_at(rest, F.lit(1))), 1, longest)

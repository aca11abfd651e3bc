"""URL expressions: hosts, sites, identity keys, what a path tells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track the visitor.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source"]


def host(url: Column) -> Column:
    """Lower-case host without user, port and www; '' for none."""
    raw = F.regexp_extract(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#\s]+)", 1)
    return F.regexp_replace(raw, r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    """Hosts that are equal or one below the other; empty hosts are no site."""
    return (a != "") & (b != "") & ((a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a)))


def host_suffixes(h: Column) -> Column:
    """The host and all of its parents down to two labels: the keys of an equi-join on 'is or is below'."""
    labels = F.split(h, r"\.")
    return F.when(F.size(labels) >= 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array(h))


def url_identity(url: Column) -> Column:
    """The lossy key by which two URLs are the same page: scheme and host lower, default port, credentials, fragment and
    tracking parameters dropped, double and trailing slashes removed; null unless it is http(s) with a host."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z]+)://", 1))
    authority = F.lower(F.regexp_extract(u, r"^[A-Za-z]+://([^/?#]*)", 1))
    authority = F.regexp_replace(authority, r"^.*@", "")
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).otherwise(F.regexp_replace(authority, ":443$", ""))
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/{2,}", "/")
    path = F.regexp_replace(path, "/$", "")
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING)), "&")
    key = F.concat(scheme, F.lit("://"), authority, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(scheme.isin("http", "https") & (authority != ""), key)


def path_year(url: Column, missing: int = 9999) -> Column:
    year = F.regexp_extract(F.coalesce(url, F.lit("")), r"/((?:19|20)[0-9]{2})(?:/|-|$)", 1)
    return F.when(year != "", year.cast("int")).otherwise(F.lit(missing))


def robots_flags(*directives: Column) -> tuple[Column, Column]:
    """(noindex, nofollow) stated by robots directives; 'none' states both."""
    tokens = F.flatten(F.array(*(F.split(F.lower(F.coalesce(d, F.lit(""))), r"[,;\s]+") for d in directives)))
    none = F.array_contains(tokens, "none")
    return F.array_contains(tokens, "noindex") | none, F.array_contains(tokens, "nofollow") | none


# Classes of HTTP status codes.
STATUS_CLASSES = [("ok", range(200, 300)), ("not_found", (404,)), ("gone", (410,)), ("rate_limited", (429,)), ("blocked", (401, 403, 407, 451)), ("server_error", range(500, 600)), ("client_error", range(400, 500))]


def status_class(code: Column) -> Column:
    """The class of an HTTP status by the first that holds it; null for no status, else unexpected_status."""
    out = F.when(code.isNull(), F.lit(None).cast("string"))
    for name, codes in STATUS_CLASSES:
        out = out.when(code.between(codes[0], codes[-1]) if isinstance(codes, range) else code.isin(*codes), F.lit(name))
    return out.otherwise(F.lit("unexpected_status"))


def page_kind(url: Column, title: Column, is_pdf: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The kind of a page by the first rule (kind, path pattern, title pattern) that fits; pdf first, other last."""
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z]+://[^/]*([^?#]*)", 1))
    name = F.lower(F.coalesce(title, F.lit("")))
    out = F.when(F.coalesce(is_pdf, F.lit(False)), F.lit("pdf")).when(path.isin("", "/"), F.lit("homepage"))
    for kind, in_path, in_title in rules:
        hit = path.rlike(in_path) if in_path else F.lit(False)
        out = out.when(hit | (name.rlike(in_title) if in_title else F.lit(False)), F.lit(kind))
    return out.otherwise(F.lit("other"))

"""Text queries: hashing, near duplicates, URLs, tags, scores, markup, audit, redaction."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from verbatrix.functions import text as X
from verbatrix.functions import urls as U
from verbatrix.functions.stats import cohens_kappa, ratio
from verbatrix.operators import audit, html, redaction, similarity
from verbatrix.operators import relational as R
from verbatrix.operators import statements as S
from verbatrix.operators.sizing import spread
from verbatrix.plans.registry import query
from verbatrix.sources.tables import table

_WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _known_forms() -> str:
    """A DuckDB map from characters to their compatibility form, where that holds letters, figures or an apostrophe of ASCII."""
    rows = {}
    for code in range(0x80, 0x110000):
        c, t = chr(code), unicodedata.normalize("NFKC", chr(code))
        if t != c and unicodedata.normalize("NFC", c) == c and any(x.isascii() and (x.isalnum() or x in "' ") for x in t):
            rows[c] = t.replace("'", "''")
    return "MAP {" + ", ".join(f"'{c}': '{t}'" for c, t in rows.items()) + "}"


_FORMS = _known_forms()


def _nfkc(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '[^\\x00-\\x7f]') THEN nfc_normalize(array_to_string(list_transform(string_split(nfc_normalize({c}), ''), lambda x: CASE WHEN x < chr(128) THEN x ELSE coalesce({_FORMS}[x], x) END), '')) ELSE {c} END"


def _comparable(c: str) -> str:
    return f"trim(regexp_replace(translate(lower({c}), '’‘', ''''''), '[^a-z0-9'']+', ' ', 'g'))"


def _hash_form(c: str) -> str:
    return _comparable(f"({_nfkc(f'coalesce({c}, {chr(39) * 2})')})")


def _near_keys(columns: str, table_name: str, text: str) -> str:
    """SQL of (columns, key): words first, so that no run is cut out of a text more than once."""
    runs = "list_transform(range(1, len(w) - 3), lambda i: substr(sha256(array_to_string(w[i : i + 4], ' ')), 1, 16))"
    key = f"substr(CASE WHEN len(w) <= 5 THEN sha256(array_to_string(w, ' ')) ELSE sha256(array_to_string(list_sort(list_distinct({runs}))[1:6], '|')) END, 1, 24)"
    return f"SELECT {columns}, {key} AS key FROM (SELECT *, string_split({_hash_form(text)}, ' ') AS w FROM {table_name} WHERE {text} IS NOT NULL)"


@query(f"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g')) = '' AS blank, sha256({_hash_form('text')}) AS form_sha, sha256(coalesce(text, '')) AS text_sha FROM documents")
def normalized_text_hash(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", (X.compact_ws(t) == "").alias("blank"), F.sha2(X.hash_form(t), 256).alias("form_sha"), X.text_sha(t).alias("text_sha"))


@query(f"""WITH k AS ({_near_keys('doc_id, length(text) AS n', 'documents', 'text')}), b AS (SELECT key, count(*) AS copies, arg_max(doc_id, (n, -doc_id)) AS canonical FROM k GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id, key, canonical, copies FROM k JOIN b USING (key)""")
def near_dup_groups(spark, d):
    return S.near_dup_groups(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


@query(f"SELECT source, count(*) AS docs, count(DISTINCT key) AS distinct_keys, round(1 - CAST(count(DISTINCT key) AS DOUBLE) / count(*), 4) AS duplicate_rate FROM ({_near_keys('source', 'documents', 'text')}) GROUP BY 1")
def near_dup_rate_by_source(spark, d):
    rows = spread(table(spark, d, "documents").filter("text IS NOT NULL").select("source", "text")).select("source", X.near_duplicate_key(F.col("text")).alias("key"))
    n, k = F.count(F.lit(1)), F.count_distinct("key")
    return rows.groupBy("source").agg(n.alias("docs"), k.alias("distinct_keys"), F.round(1 - k / n, 4).alias("duplicate_rate"))


@query(f"SELECT sha256({_hash_form('excerpt')}) AS form_sha, min(id) AS canonical, count(*) AS copies FROM evidence_items GROUP BY 1")
def exact_dup_canonical(spark, d):
    return table(spark, d, "evidence_items").groupBy(F.sha2(X.hash_form(F.col("excerpt")), 256).alias("form_sha")).agg(F.min("id").alias("canonical"), F.count(F.lit(1)).alias("copies"))


@query("SELECT id, concat_ws(' ', lag(sentence) OVER w, sentence, lead(sentence) OVER w) AS context FROM statements WINDOW w AS (PARTITION BY page_id ORDER BY id)")
def sentence_context_prev_next(spark, d):
    return S.with_context(table(spark, d, "statements").select("id", "page_id", "sentence"), "page_id", "id", "sentence").select("id", "context")


TAGS = {"remove": "take down|delete|remov", "deindex": "de-index|hide from search", "anonymize": "anonymi[sz]e|initials", "update": "update|correct|annotate", "outcome": "acquitt|dismissed|expunged|sealed", "archive": "archive|record"}
_TAG_LIST = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(excerpt, '(?i){p}') THEN '{n}' END" for n, p in sorted(TAGS.items())) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT tag, count(*) AS items, count(DISTINCT id) AS ids FROM (SELECT id, unnest({_TAG_LIST}) AS tag FROM evidence_items) GROUP BY 1")
def tag_bridge_counts(spark, d):
    return S.tag_bridge(table(spark, d, "evidence_items"), "id", "excerpt", TAGS).groupBy("tag").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("id").alias("ids"))


@query(f"SELECT id, array_to_string({_TAG_LIST}, ';') AS tags FROM evidence_items")
def tag_list_concat(spark, d):
    return table(spark, d, "evidence_items").select("id", F.array_join(X.tags_of(F.col("excerpt"), TAGS), ";").alias("tags"))


@query("SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(tags) AS tag FROM statements) GROUP BY 1")
def statement_tags(spark, d):
    return table(spark, d, "statements").select("page_id", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


KEYWORDS = {"policy|guideline": 20.0, "remov|delete|take down": 25.0, "correct": 10.0, "archive": 8.0, "editor": 5.0, "request": 15.0, "privacy": 6.0, "court|charge": 12.0, "search": 9.0}
_SCORE = " + ".join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN {w} ELSE 0 END" for p, w in KEYWORDS.items())


@query(f"SELECT page_id, CAST(least({_SCORE}, 100) AS DOUBLE) AS score FROM (SELECT page_id, coalesce(full_text, '') AS t FROM main_texts)")
def policy_keyword_score(spark, d):
    return table(spark, d, "main_texts").select("page_id", X.weighted_keywords(F.col("full_text"), KEYWORDS).alias("score"))


FACTORS = {"student|campus": 8.0, "arrest|charge|police": 10.0, "dismissed": 15.0, "acquitt": 12.0, "expunged|sealed": 12.0, "de-index|hide from search": 20.0, "anonymi": 12.0, "update": 6.0}
ACTIVE = ["dismissed", "acquitt", "expunged|sealed"]
_PART = lambda ps: " + ".join(f"CASE WHEN regexp_matches(excerpt, '(?i){p}') THEN {FACTORS[p]} ELSE 0 END" for p in ps)


@query(f"SELECT id, round(CAST(100 * ({_PART(FACTORS)}) / {sum(FACTORS.values())} AS DOUBLE), 2) AS similarity, round(CAST(100 * ({_PART(ACTIVE)}) / {sum(FACTORS[p] for p in ACTIVE)} AS DOUBLE), 2) AS case_match FROM evidence_items")
def similarity_weighted(spark, d):
    """Share of the matched factors' weights, over all factors and over the active ones."""
    total, active = sum(FACTORS.values()), {p: FACTORS[p] for p in ACTIVE}
    t = F.col("excerpt")
    return table(spark, d, "evidence_items").select("id", F.round(100 * X.weighted_keywords(t, FACTORS, 1e9) / total, 2).alias("similarity"), F.round(100 * X.weighted_keywords(t, active, 1e9) / sum(active.values()), 2).alias("case_match"))


@query("""WITH u AS (SELECT page_id, trim(requested_url) AS u FROM fetch_results), p AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1)), '^.*@', '') AS a,
regexp_replace(regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), '/$', '') AS path, array_to_string(list_filter(string_split(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'source'], lower(split_part(x, '=', 1)))), '&') AS q FROM u)
SELECT key, min(page_id) AS first_page, count(*) AS fetches FROM (SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND a <> '' THEN scheme || '://' || CASE WHEN scheme = 'http' THEN regexp_replace(a, ':80$', '') ELSE regexp_replace(a, ':443$', '') END || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS key FROM p) GROUP BY 1""")
def url_identity_dedupe(spark, d):
    return table(spark, d, "fetch_results").groupBy(U.url_identity(F.col("requested_url")).alias("key")).agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("fetches"))


KIND_RULES = [("policy", "/polic(?:y|ies)|/standards|/ethics", "policy|standards"), ("corrections", "/corrections?", "^correction"), ("about", "/about", "^about"), ("opinion", "/opinion", "column"), ("article", "/article|/news/|/(?:19|20)[0-9]{2}/", "")]
_KIND = " ".join(["WHEN is_pdf THEN 'pdf'", "WHEN path IN ('', '/') THEN 'homepage'", *(f"WHEN regexp_matches(path, '{a}')" + (f" OR regexp_matches(name, '{b}')" if b else "") + f" THEN '{k}'" for k, a, b in KIND_RULES)])


@query(f"SELECT CASE {_KIND} ELSE 'other' END AS kind, page_kind, count(*) AS n FROM (SELECT *, lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z]+://[^/]*([^?#]*)', 1)) AS path, lower(coalesce(title, '')) AS name FROM main_texts) GROUP BY 1, 2")
def page_kind_counts(spark, d):
    kind = U.page_kind(F.col("url"), F.col("title"), F.col("is_pdf"), KIND_RULES)
    return table(spark, d, "main_texts").groupBy(kind.alias("kind"), "page_kind").agg(F.count(F.lit(1)).alias("n"))


_TOK = "list_concat(regexp_split_to_array(lower(coalesce(meta_robots, '')), '[,;\\s]+'), regexp_split_to_array(lower(coalesce(x_robots_tag, '')), '[,;\\s]+'))"


@query(f"SELECT page_id, list_contains({_TOK}, 'noindex') OR list_contains({_TOK}, 'none') AS says_noindex, list_contains({_TOK}, 'nofollow') OR list_contains({_TOK}, 'none') AS says_nofollow FROM main_texts")
def robots_directive_flags(spark, d):
    noindex, nofollow = U.robots_flags(F.col("meta_robots"), F.col("x_robots_tag"))
    return table(spark, d, "main_texts").select("page_id", noindex.alias("says_noindex"), nofollow.alias("says_nofollow"))


@query("""SELECT unitid, n AS norm_name, regexp_extract(coalesce(name, ''), '^ *([0-9]+)', 1) AS lead FROM (SELECT unitid, name, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(coalesce(name, '')), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g')), '(^| )saint( |$)', '\\1st\\2', 'g'), '^the | the$', '', 'g')) AS n FROM institutions)""")
def organisation_names(spark, d):
    return table(spark, d, "institutions").select("unitid", X.organisation_name(F.col("name")).alias("norm_name"), F.regexp_extract(F.coalesce("name", F.lit("")), r"^ *([0-9]+)", 1).alias("lead"))


@query("SELECT page_id, trim(regexp_replace(coalesce(title, ''), '\\s+[|·–—-]\\s+[^|·–—]*$', '')) AS headline FROM main_texts")
def headline_without_site(spark, d):
    return table(spark, d, "main_texts").select("page_id", X.headline(F.col("title")).alias("headline"))


@query("SELECT page_id, trim(regexp_extract(coalesce(content, ''), '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM fetch_results")
def html_title_native(spark, d):
    return table(spark, d, "fetch_results").select("page_id", html.native_title(F.col("content")).alias("title"))


@query()
def html_parts(spark, d):
    rows = html.with_page_parts(spread(table(spark, d, "fetch_results").select("page_id", "content")), "content")
    return rows.select("page_id", "page.title", "page.robots", F.size("page.links").alias("links"), F.length("page.text").alias("text_length"))


@query("SELECT page_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(full_text, '')), '([a-z0-9._%+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)+)', 1))) AS email FROM main_texts")
def emails_found(spark, d):
    return table(spark, d, "main_texts").select("page_id", F.explode(X.emails(F.col("full_text"))).alias("email"))


@query("SELECT page_id, len(regexp_extract_all(coalesce(full_text, ''), '(?si)(.{0,60}(?:delete|take down).{0,60})', 1)[1:4]) AS n, array_to_string(regexp_extract_all(coalesce(full_text, ''), '(?si)(.{0,60}(?:delete|take down).{0,60})', 1)[1:4], '¦') AS excerpts FROM main_texts")
def excerpt_windows(spark, d):
    found = X.windows_around(F.col("full_text"), "delete|take down", 60)
    return table(spark, d, "main_texts").select("page_id", F.size(found).cast("bigint").alias("n"), F.array_join(found, "¦").alias("excerpts"))


@query("WITH o AS (SELECT page_id, list_filter(string_split(coalesce(full_text, ''), chr(10)), lambda x: length(x) >= 40) AS ls, coalesce(main_text, '') AS m FROM main_texts) SELECT page_id, round(coalesce(CAST(len(list_filter(ls, lambda x: contains(m, x))) AS DOUBLE) / nullif(len(ls), 0), 1.0), 3) AS held FROM o")
def line_containment(spark, d):
    return table(spark, d, "main_texts").select("page_id", similarity.containment(F.col("full_text"), F.col("main_text")).alias("held"))


@query("""WITH p AS (SELECT page_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce(main_text, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce(full_text, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS b FROM main_texts)
SELECT page_id, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / nullif(len(list_distinct(list_concat(a, b))), 0), 4) AS overlap FROM p WHERE len(a) > 0 OR len(b) > 0""")
def vocab_overlap(spark, d):
    words = lambda c: F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), " "), lambda x: x != "")
    rows = table(spark, d, "main_texts").select("page_id", words("main_text").alias("a"), words("full_text").alias("b"))
    return rows.filter((F.size("a") > 0) | (F.size("b") > 0)).select("page_id", similarity.vocabulary_overlap(F.col("a"), F.col("b")).alias("overlap"))


@query()
def version_ratio(spark, d):
    """Matching ratio of a page's extracted and full text: how much of it the extraction kept."""
    rows = spread(table(spark, d, "main_texts").select("page_id", "main_text", "full_text"))
    return rows.withColumn("ratio", similarity.matching_ratio()(F.col("main_text"), F.col("full_text"))).select("page_id", "ratio")


@query("SELECT DISTINCT doc_id, q[1] AS quote, q[2] AS speaker FROM (SELECT doc_id, unnest(list_zip(regexp_extract_all(coalesce(text, ''), '[\"“]([^\"“”]{20,700})[\"”],? ?(said|asked|told|added|explained) ([A-ZÀ-Þ][^ ,.]+ (?:[A-Z]\\. )?[A-ZÀ-Þ][^ ,.]+)', 1), regexp_extract_all(coalesce(text, ''), '[\"“]([^\"“”]{20,700})[\"”],? ?(said|asked|told|added|explained) ([A-ZÀ-Þ][^ ,.]+ (?:[A-Z]\\. )?[A-ZÀ-Þ][^ ,.]+)', 3))) AS q FROM documents)")
def attributed_quotes(spark, d):
    return S.voices(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT doc_id, len(list_filter(string_split(x, ' '), lambda w: w <> '')) AS words, round(CAST(len(list_filter(string_split(x, ' '), lambda w: list_contains(['the', 'of', 'and', 'to', 'in', 'a', 'for', 'on', 'that', 'was'], w))) AS DOUBLE) / nullif(len(list_filter(string_split(x, ' '), lambda w: w <> '')), 0), 6) AS share FROM (SELECT doc_id, " + _hash_form("text") + " AS x FROM documents) WHERE x <> ''")
def function_word_share(spark, d):
    listed = ["the", "of", "and", "to", "in", "a", "for", "on", "that", "was"]
    rows = table(spark, d, "documents").select("doc_id", "text", F.size(F.filter(F.split(X.hash_form(F.col("text")), " "), lambda w: w != "")).cast("bigint").alias("words"))
    return rows.filter("words > 0").select("doc_id", "words", F.round(X.function_word_share(F.col("text"), listed), 6).alias("share"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(' ' || regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]', '  ', 'g') || ' ', ' ([a-z]{2,}) ', 1)) AS word FROM documents) GROUP BY 1 HAVING count(*) >= 2")
def common_words(spark, d):
    return redaction.common_words(table(spark, d, "documents"), "text")


@query()
def redacted_quotes(spark, d):
    """Quotes with names removed, except the speaker's own."""
    rows = table(spark, d, "voices").select("id", "quote", F.array("person_name").alias("keep"))
    return rows.select("id", redaction.redact(F.col("quote"), F.col("keep"), common={"the", "a", "after", "if", "for", "nobody", "deleting"}).alias("quote"))


@query("WITH h AS (SELECT page_id, url, publication_id, regexp_matches(coalesce(url, ''), '/opinion/') AS hit FROM main_texts), o AS (SELECT publication_id FROM h GROUP BY 1 HAVING bool_and(hit)) SELECT page_id, publication_id FROM h WHERE NOT hit AND publication_id NOT IN (SELECT publication_id FROM o)")
def withhold_by_url(spark, d):
    return redaction.withhold(table(spark, d, "main_texts").select("page_id", "url", "publication_id"), "url", "/opinion/", "publication_id").select("page_id", "publication_id")


@query("SELECT page_id, CASE WHEN page_kind = 'crime_article' THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || '/withheld' ELSE url END AS url FROM main_texts")
def mask_story_urls(spark, d):
    return table(spark, d, "main_texts").select("page_id", redaction.mask_urls(F.col("url"), F.col("page_kind") == "crime_article").alias("url"))


# two raters: the stored direction and the one that the statement's type stands for
_HUMAN = "CASE WHEN statement_type LIKE 'relief_permitted%' OR statement_type = 'case_by_case' THEN 'supportive' WHEN statement_type IN ('relief_rejected', 'archive_principle') THEN 'adverse' ELSE 'neutral' END"


def _rated(spark, d):
    kind = F.col("statement_type")
    human = F.when(kind.startswith("relief_permitted") | (kind == "case_by_case"), "supportive").when(kind.isin("relief_rejected", "archive_principle"), "adverse").otherwise("neutral")
    return table(spark, d, "evidence_items").select("id", "cohort", F.col("direction").alias("machine"), human.alias("human"))


@query(f"SELECT direction AS machine, CAST(count(*) FILTER (WHERE h = 'supportive') AS BIGINT) AS supportive, CAST(count(*) FILTER (WHERE h = 'adverse') AS BIGINT) AS adverse, CAST(count(*) FILTER (WHERE h = 'neutral') AS BIGINT) AS neutral FROM (SELECT direction, {_HUMAN} AS h FROM evidence_items) GROUP BY 1")
def confusion_matrix(spark, d):
    return audit.confusion(_rated(spark, d), "machine", "human", ["supportive", "adverse", "neutral"])


@query(f"""WITH c AS (SELECT cohort, count(*) AS n, CAST(count(*) FILTER (WHERE direction = h) AS BIGINT) AS hits FROM (SELECT cohort, direction, {_HUMAN} AS h FROM evidence_items WHERE direction IS NOT NULL) GROUP BY 1), p AS (SELECT *, CAST(hits AS DOUBLE) / n AS p FROM c)
SELECT cohort, n, hits, round(p, 6) AS share, round(greatest((p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) * 1.96 / (1 + 1.96 * 1.96 / n), 0), 6) AS lower, round(least((p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) * 1.96 / (1 + 1.96 * 1.96 / n), 1), 6) AS upper FROM p""")
def wilson_accuracy(spark, d):
    return audit.accuracy(_rated(spark, d).withColumn("correct", F.col("machine") == F.col("human")), "cohort", "correct")


@query(f"""WITH r AS (SELECT direction AS a, {_HUMAN} AS b FROM evidence_items WHERE direction IS NOT NULL), t AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END) AS po FROM r), e AS (SELECT sum(CAST(x.n AS DOUBLE) * y.n) AS s FROM (SELECT a, count(*) AS n FROM r GROUP BY 1) x JOIN (SELECT b, count(*) AS n FROM r GROUP BY 1) y ON a = b)
SELECT n, round(po, 6) AS observed, round(coalesce(s, 0) / (CAST(n AS DOUBLE) * n), 6) AS expected, round((po - s / (CAST(n AS DOUBLE) * n)) / (1 - s / (CAST(n AS DOUBLE) * n)), 6) AS kappa FROM t, e""")
def cohens_kappa_score(spark, d):
    k = cohens_kappa(_rated(spark, d), "machine", "human")
    return k.select("n", *(F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")))


@query("SELECT id, statement_type, turn FROM (SELECT id, statement_type, CAST(row_number() OVER (PARTITION BY statement_type ORDER BY md5('7:' || id), id) AS INTEGER) AS turn FROM evidence_items) ORDER BY turn, statement_type LIMIT 60")
def stratified_round_robin(spark, d):
    return audit.stratified_sample(table(spark, d, "evidence_items").select("id", "statement_type"), "id", "statement_type", 60, 7)


@query("""WITH r AS (SELECT publication_id, page_id, row_number() OVER (PARTITION BY publication_id ORDER BY url, page_id) - 1 AS i, count(*) OVER (PARTITION BY publication_id) AS n FROM main_texts)
SELECT publication_id, page_id FROM r WHERE n <= 5 OR list_contains(list_transform(range(0, 5), lambda j: CAST(round_even(CAST(j AS DOUBLE) * (n - 1) / 4, 0) AS INTEGER)), CAST(i AS INTEGER))""")
def even_sample(spark, d):
    rows = table(spark, d, "main_texts").select("publication_id", "page_id", "url")
    return R.evenly(rows, ["publication_id"], [F.asc("url"), F.asc("page_id")], 5).select("publication_id", "page_id")


@query("SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 4) AS mean_chars, round(CAST(count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS DOUBLE) / count(*), 4) AS blank_share FROM documents GROUP BY 1")
def language_profile(spark, d):
    blank = F.count_if(F.col("text").isNull() | (F.trim("text") == ""))
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), ratio(blank, F.count(F.lit(1))).alias("blank_share"))

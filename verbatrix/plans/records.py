"""Record queries: page kinds and versions, predicates and orders from parameters, graphs, metrics, JSON, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatrix.functions import pages as P
from verbatrix.functions import text as X
from verbatrix.functions import urls as U
from verbatrix.functions.concepts import CONCEPTS
from verbatrix.functions.stats import ratio
from verbatrix.operators import frontier, html, matching, names, redaction, runs
from verbatrix.operators import predicates as Q
from verbatrix.operators.relational import overlapping_groups
from verbatrix.operators.sizing import spread
from verbatrix.operators.statements import ATTRIBUTIONS, attributed_voices, bounded_sentences, neighbours, tag_bridge
from verbatrix.operators.versions import remaining, within_budget
from verbatrix.plans.registry import query
from verbatrix.plans.texts import _comparable, _hash_form, _nfkc
from verbatrix.sources.sinks import safe_text
from verbatrix.sources.tables import table

# titles: the shorter of what the two kinds of separator leave
_CUT = "CASE WHEN length(a) <= length(b) THEN a ELSE b END"
_TITLES = r"(SELECT page_id, regexp_replace(coalesce(title, ''), '(?s)\s+[–—|·]\s+.*$', '') AS a, regexp_replace(coalesce(title, ''), '\s+-\s+[^-]+$', '') AS b FROM main_texts)"


@query(f"SELECT page_id, {_hash_form('t')} AS title_key FROM (SELECT page_id, {_CUT} AS t FROM {_TITLES})")
def title_keys(spark, d):
    return table(spark, d, "main_texts").select("page_id", P.title_key(F.col("title")).alias("title_key"))


_PATH = "coalesce(nullif(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '(?i){pattern}')"


@query(f"""SELECT page_id, CASE WHEN path = '/' THEN 'homepage' WHEN {_has("path || ' ' || left(name, 120)", P.LEGAL)} THEN 'legal_boilerplate' WHEN is_listing THEN 'listing' WHEN {_has('path', P.STORY)} THEN 'article'
WHEN {_has("path || ' ' || name", P.POLICY)} THEN 'policy' WHEN {_has('path', P.ABOUT)} THEN 'about' WHEN is_pdf THEN 'pdf' WHEN {_has('path', P.ARTICLE)} THEN 'article' ELSE 'other' END AS kind
FROM (SELECT page_id, {_PATH} AS path, coalesce(title, '') AS name, coalesce(is_listing, false) AS is_listing, coalesce(is_pdf, false) AS is_pdf FROM main_texts)""")
def page_kinds(spark, d):
    return table(spark, d, "main_texts").select("page_id", P.kind_of_page(F.col("url"), F.col("title"), F.col("is_pdf"), F.col("is_listing")).alias("kind"))


_KEPT = f"""SELECT page_id, list_filter(list_transform(string_split(cut, chr(1)), lambda s: {_comparable('s')}), lambda s: length(s) >= 40) AS ss, held
FROM (SELECT page_id, {_nfkc("regexp_replace(coalesce(full_text, ''), '([.!?])' || chr(92) || 's+', chr(92) || '1' || chr(1), 'g')")} AS cut, {_hash_form('main_text')} AS held FROM main_texts)"""


@query(f"SELECT page_id, round(coalesce(CAST(len(list_filter(ss, lambda s: contains(held, s))) AS DOUBLE) / nullif(len(ss), 0), 1.0), 3) AS kept FROM ({_KEPT})")
def sentences_kept(spark, d):
    return table(spark, d, "main_texts").select("page_id", P.kept_sentences(F.col("full_text"), F.col("main_text")).alias("kept"))


_ORDINARY = "[" + ", ".join(f"'{w}'" for w in P.NO_NAME) + "]"


def _people(text: str) -> str:
    words = "regexp_split_to_array(n, '\\s+')"
    # a word goes on in letters beyond ASCII, which this dialect's boundaries don't know
    text = f"regexp_replace(regexp_replace(coalesce({text}, ''), '[^\\x00-\\x7f\\p{{L}}\\p{{N}}\\p{{M}}]', '#', 'g'), '[^\\x00-\\x7f]', '_', 'g')"
    return f"""list_filter(list_distinct(regexp_extract_all({text}, '{P.PERSON.replace("'", "''")}', 1)), lambda n: length({words}[1]) >= 3 AND length({words}[-1]) >= 3 AND NOT list_has_any(list_transform({words}, lambda w: rtrim(w, '.')), {_ORDINARY}))"""


@query(f"SELECT page_id, unnest({_people('full_text')}) AS name FROM main_texts")
def person_names_found(spark, d):
    return table(spark, d, "main_texts").select("page_id", F.explode(P.people(F.col("full_text"))).alias("name"))


def _vocabulary(c: str) -> str:
    return f"list_distinct(regexp_extract_all({_hash_form(c)}, '([a-z]{{4,}})', 1))"


@query(f"""WITH p AS (SELECT page_id, full_text, main_text, {_people('full_text')} AS people, list_distinct(regexp_extract_all(coalesce(main_text, ''), '([A-Za-z][A-Za-z''-]+)', 1)) AS words, {_vocabulary('full_text')} AS a, {_vocabulary('main_text')} AS b, length({_hash_form('full_text')}) AS la, length({_hash_form('main_text')}) AS lb FROM main_texts),
k AS (SELECT page_id, coalesce(CAST(len(list_filter(ss, lambda s: contains(held, s))) AS DOUBLE) / nullif(len(ss), 0), 1.0) AS kept FROM ({_KEPT})),
g AS (SELECT *, len(list_filter(people, lambda n: len(list_filter(list_transform(regexp_split_to_array(n, '\\s+'), lambda w: rtrim(w, '.')), lambda w: length(w) >= 3 AND list_contains(words, w))) = 0)) AS gone, coalesce(CAST(len(list_intersect(a, b)) AS DOUBLE) / nullif(len(a), 0), 1.0) AS shared FROM p)
SELECT page_id, CAST(gone AS INTEGER) AS names_gone, CASE WHEN full_text IS NOT NULL AND main_text IS NULL THEN 'unpublished' WHEN la < 60 OR lb < 60 THEN '' ELSE array_to_string(list_filter([CASE WHEN kept < 0.85 THEN 'content_altered' END, CASE WHEN gone > 0 AND shared >= 0.6 THEN 'names_removed' END], lambda x: x IS NOT NULL), ',') END AS observations FROM g JOIN k USING (page_id)""")
def version_changes(spark, d):
    """What changed between the whole and the extracted text of a page; too short texts are not compared."""
    old, new = F.col("full_text"), F.col("main_text")
    rows = table(spark, d, "main_texts").select("page_id", old, new, F.size(P.names_gone(old, new)).alias("names_gone"), P.shared_vocabulary(old, new).alias("shared"), P.kept_sentences(old, new, digits=12).alias("kept"), (F.least(F.length(X.hash_form(old)), F.length(X.hash_form(new))) < 60).alias("short"))
    found = F.array_join(F.array_compact(F.array(F.when(F.col("kept") < 0.85, F.lit("content_altered")), F.when((F.col("names_gone") > 0) & (F.col("shared") >= 0.6), F.lit("names_removed")))), ",")
    return rows.select("page_id", "names_gone", F.when(old.isNotNull() & new.isNull(), "unpublished").when(F.col("short"), "").otherwise(found).alias("observations"))


def _score_sql() -> str:
    hay = "coalesce(title, '') || chr(10) || coalesce(full_text, '')"
    quoted = lambda p: p.replace("'", "''")
    parts = [f"CASE WHEN {_has('hay', quoted(p))} THEN {w} ELSE 0 END" for p, w in {**P.POLICY_TERMS, P.POLICY_RULES[0]: P.POLICY_RULES[1], P.POLICY_REFUSAL[0]: P.POLICY_REFUSAL[1]}.items()]
    parts.append(f"CASE WHEN {_has('url', P.POLICY_PATH[0])} THEN {P.POLICY_PATH[1]} ELSE 0 END")
    return f"SELECT page_id, CAST(least({' + '.join(parts)}, 100) AS DOUBLE) AS score FROM (SELECT page_id, coalesce(url, '') AS url, {hay} AS hay FROM main_texts)"


@query(_score_sql())
def policy_scores(spark, d):
    return table(spark, d, "main_texts").select("page_id", P.policy_score(F.col("url"), F.col("title"), F.col("full_text")).alias("score"))


_LISTED = "[" + ", ".join(f"'{w}'" for w in P.SENTENCE_WORDS) + "]"


@query(f"""WITH s AS (SELECT id, trim(coalesce(sentence, '')) AS s, list_filter(regexp_split_to_array(trim(coalesce(sentence, '')), '\\s+'), lambda w: w <> '') AS ws FROM statements)
SELECT id, length(s) < 40 OR len(ws) < 7 OR (len(ws) >= 12 AND len(list_filter(ws, lambda w: list_contains({_LISTED}, trim(lower(w), ',.;:')))) < 0.06 * len(ws)) OR {_has('s', P.CHROME)} AS chrome FROM s""")
def chrome_flags(spark, d):
    return table(spark, d, "statements").select("id", P.is_chrome(F.col("sentence")).alias("chrome"))


@query(r"""WITH u AS (SELECT page_id, trim(requested_url) AS u FROM fetch_results), p AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1)) AS place, regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS q FROM u)
SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND regexp_full_match(place, '[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)*(:(80|443|8080|8443))?')
THEN scheme || '://' || CASE WHEN scheme = 'http' THEN regexp_replace(place, ':80$', '') ELSE regexp_replace(place, ':443$', '') END || replace(CASE WHEN path = '' THEN '/' ELSE path END, ' ', '%20') || CASE WHEN q <> '' THEN '?' || replace(q, ' ', '%20') ELSE '' END END AS url FROM p""")
def request_urls(spark, d):
    """Addresses to ask for, of the fetched ones; a fixture tests what these tables don't hold: other characters, credentials, literal addresses."""
    return table(spark, d, "fetch_results").select("page_id", P.request_url(F.col("requested_url")).alias("url"))


@query(r"""SELECT page_id, h = 'falsethkraypury-gazette.example' OR h LIKE '%.falsethkraypury-gazette.example' OR h = 'video.example' OR h LIKE '%.video.example' AS blocked FROM (SELECT page_id, regexp_replace(regexp_extract(lower(trim(coalesce(requested_url, ''))), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#\s]+)', 1), '^www\.', '') AS h FROM fetch_results)""")
def blocked_hosts(spark, d):
    return table(spark, d, "fetch_results").select("page_id", P.on_hosts(F.col("requested_url"), ["falsethkraypury-gazette.example", "video.example"]).alias("blocked"))


_ROLE = "CASE " + " ".join(f"WHEN contains(l, '{n}') THEN '{r}'" for n, r in P.ROLES) + " ELSE 'contact' END"
_ROLE_RANK = "CASE " + " ".join(f"WHEN contains(l, '{n}') THEN {i}" for i, (n, _) in enumerate(P.ROLES)) + f" ELSE {len(P.ROLES)} END"


@query(f"SELECT role, rank, count(*) AS n FROM (SELECT {_ROLE} AS role, {_ROLE_RANK} AS rank FROM (SELECT split_part(unnest(list_distinct(regexp_extract_all(lower(coalesce(full_text, '')), '([a-z0-9._%+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)+)', 1))), '@', 1) AS l FROM main_texts)) GROUP BY 1, 2")
def contact_roles(spark, d):
    found = table(spark, d, "main_texts").select(F.explode(X.emails(F.col("full_text"))).alias("email"))
    role, rank = P.role_of(F.substring_index("email", "@", 1))
    return found.groupBy(role.alias("role"), rank.alias("rank")).agg(F.count(F.lit(1)).alias("n"))


_HOST = r"regexp_replace(regexp_extract(lower(trim(coalesce({}, ''))), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#\s]+)', 1), '^www\.', '')"


@query(f"""WITH p AS (SELECT p.id, i.website, {_HOST.format('i.website')} AS a, {_HOST.format('p.homepage_url')} AS b FROM publications p LEFT JOIN institutions i USING (unitid))
SELECT id, CASE WHEN coalesce(website, '') = '' THEN 'unknown' WHEN NOT (a <> '' AND b <> '' AND (a = b OR ends_with(a, '.' || b) OR ends_with(b, '.' || a))) THEN 'independent_domain' WHEN a <> b THEN 'institution_subdomain' ELSE 'institution_path' END AS relation FROM p""")
def site_relations(spark, d):
    schools = table(spark, d, "institutions").select("unitid", "website")
    rows = table(spark, d, "publications").select("id", "unitid", "homepage_url").join(schools, "unitid", "left")
    return rows.select("id", P.relationship(F.col("website"), F.col("homepage_url")).alias("relation"))


@query("SELECT cohort, CASE WHEN count(*) = 0 THEN 'n/a' ELSE format('{:.1f}%', 100.0 * count(*) FILTER (WHERE first_party) / count(*)) END AS share, format('{:,.2f}', CAST(sum(authority_score) AS DOUBLE)) AS authority FROM evidence_items GROUP BY 1")
def formatted_shares(spark, d):
    rows = table(spark, d, "evidence_items").groupBy("cohort").agg(F.count_if("first_party").alias("k"), F.count(F.lit(1)).alias("n"), F.sum("authority_score").alias("s"))
    return rows.select("cohort", P.percent(F.col("k"), F.col("n")).alias("share"), P.number_text(F.col("s")).alias("authority"))


@query("SELECT c_mktsegment, count(*) AS events, round(sum(value), 2) AS value FROM events JOIN customer ON c_custkey = CAST(json_extract_string(props, '$.k') AS BIGINT) GROUP BY 1")
def json_key_join(spark, d):
    """Events joined with customers on a key inside a JSON text: the key is taken out once, then it is an equi-join."""
    events = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("c_custkey"), "value")
    return events.join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("value"))


@query("SELECT unitid, json_extract_string(raw_json, '$.INSTSIZE') AS size, 'yes' AS seen, 2 + CAST(len(json_keys(raw_json)) AS INTEGER) - CAST(list_contains(json_keys(raw_json), 'seen') AS INTEGER) - 1 AS keys FROM institutions")
def json_value_set(spark, d):
    rows = table(spark, d, "institutions").select("unitid", Q.with_json_value(F.col("raw_json"), "seen", F.lit("yes")).alias("j"))
    return rows.select("unitid", F.get_json_object("j", "$.INSTSIZE").alias("size"), F.get_json_object("j", "$.seen").alias("seen"), F.size(F.json_object_keys("j")).alias("keys"))


@query("SELECT event_type, count(*) AS n FROM events WHERE coalesce(json_extract_string(props, '$.k'), '0') IN ('0', 'false') GROUP BY 1")
def unflagged_events(spark, d):
    return table(spark, d, "events").filter(Q.unflagged(F.col("props"), "$.k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT cohort, count(*) AS n FROM evidence_items WHERE first_party AND page_id IS NOT NULL AND ai_gate = 'accepted' GROUP BY 1")
def named_predicates(spark, d):
    p = Q.Predicates(own=F.col("first_party"), held=F.col("page_id").isNotNull(), accepted=F.col("ai_gate") == "accepted")
    return table(spark, d, "evidence_items").filter(p.all_of("own", "held", "accepted")).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id FROM evidence_items WHERE cohort = 'student' AND contains(lower(excerpt), 'note') AND authority_score >= 0.5")
def optional_filter_search(spark, d):
    builders = {"cohort": lambda v: F.col("cohort") == v, "direction": lambda v: F.col("direction") == v, "text": lambda v: F.contains(F.lower("excerpt"), F.lit(v.lower())), "authority": lambda v: F.col("authority_score") >= v}
    wanted = {"cohort": "student", "direction": None, "text": "Note", "authority": 0.5}
    return table(spark, d, "evidence_items").filter(Q.optional_filters(wanted, builders)).select("id")


@query("SELECT unitid, name FROM institutions WHERE coalesce(state = 'OH' AND control = 1, false) OR unitid IN ('100024', '100001', '100500')")
def peer_group_by_ids(spark, d):
    group = Q.peer_group([F.col("state") == "OH", F.col("control") == 1], F.col("unitid"), ["100024", "100001", "100500"])
    return table(spark, d, "institutions").filter(group).select("unitid", "name")


_STATUS = ["manual", "verified", "auto", "candidate"]


@query("SELECT CAST(CASE verification_status WHEN 'manual' THEN 0 WHEN 'verified' THEN 1 WHEN 'auto' THEN 2 WHEN 'candidate' THEN 3 ELSE 4 END AS INTEGER) AS rank, count(*) AS n FROM publications GROUP BY 1")
def status_ranks(spark, d):
    return table(spark, d, "publications").groupBy(Q.rank_in(F.col("verification_status"), _STATUS).alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(row_number() OVER (ORDER BY coalesce(is_primary, 9), confidence, id) AS INTEGER) AS place, id FROM publications QUALIFY place <= 40")
def priority_first(spark, d):
    rows = table(spark, d, "publications").select("id", "is_primary", "confidence")
    return Q.ordered(rows, [F.coalesce("is_primary", F.lit(9)), F.col("confidence"), F.col("id")], 40).select("place", "id")


@query("SELECT CAST(row_number() OVER (ORDER BY NOT coalesce(ai_gate = 'accepted', false), page_id IS NULL, id) AS INTEGER) AS place, id FROM evidence_items QUALIFY place <= 50")
def boolean_order(spark, d):
    rows = table(spark, d, "evidence_items").select("id", "ai_gate", "page_id")
    return Q.ordered(rows, [~F.coalesce(F.col("ai_gate") == "accepted", F.lit(False)), F.col("page_id").isNull(), F.col("id")], 50).select("place", "id")


_GATES = {"first_party": 0.5, "authority": 0.4, "confidence": 0.5}


@query("SELECT cohort, coalesce(avg(CASE WHEN first_party THEN 1.0 ELSE 0.0 END) >= 0.5, false) AND coalesce(avg(authority_score) >= 0.4, false) AND coalesce(avg(extraction_confidence) >= 0.5, false) AS publishable FROM evidence_items GROUP BY 1")
def gates_all(spark, d):
    """Publishable only if every gate holds; a gate without a value fails."""
    rows = table(spark, d, "evidence_items").groupBy("cohort").agg(F.avg(F.col("first_party").cast("double")).alias("first_party"), F.avg("authority_score").alias("authority"), F.avg("extraction_confidence").alias("confidence"))
    gates = F.array(*(F.coalesce(F.col(k) >= v, F.lit(False)) for k, v in _GATES.items()))
    return rows.select("cohort", F.forall(gates, lambda g: g).alias("publishable"))


@query("""WITH e AS (SELECT cohort, count(*) AS items, count(DISTINCT entity_id) AS entities, count(DISTINCT entity_id) FILTER (WHERE direction IN ('supportive', 'adverse')) AS determinate, count(*) FILTER (WHERE statement_type <> 'mention') AS substantive,
count(*) FILTER (WHERE statement_type <> 'mention' AND ai_gate = 'accepted') AS verified, count(*) - count(DISTINCT coalesce(near_dup_key, CAST(id AS VARCHAR))) AS repeated, avg(extraction_confidence) FILTER (WHERE direction IN ('supportive', 'adverse')) AS confidence,
count(*) FILTER (WHERE first_party) AS own, count(*) FILTER (WHERE page_id IS NOT NULL) AS held FROM evidence_items GROUP BY 1)
SELECT cohort, items AS evidence_items, substantive AS substantive_items, entities AS entities_researched, determinate, (SELECT count(*) FROM publications) AS universe,
round(CAST(entities AS DOUBLE) / nullif((SELECT count(*) FROM publications), 0), 4) AS research_coverage, round(CAST(determinate AS DOUBLE) / nullif(entities, 0), 4) AS discovery_rate, round(CAST(entities - determinate AS DOUBLE) / nullif(entities, 0), 4) AS undetermined_rate,
round(CAST(repeated AS DOUBLE) / nullif(items, 0), 4) AS duplicate_rate, round(CAST(verified AS DOUBLE) / nullif(substantive, 0), 4) AS verification_rate, round(confidence, 3) AS mean_confidence, round(CAST(own AS DOUBLE) / nullif(items, 0), 4) AS first_party_rate, round(CAST(held AS DOUBLE) / nullif(items, 0), 4) AS page_rate FROM e""")
def cohort_measures(spark, d):
    """Thirteen measures a cohort, each with its own denominator; null without one."""
    sided, real = F.col("direction").isin("supportive", "adverse"), F.col("statement_type") != "mention"
    e = table(spark, d, "evidence_items").groupBy("cohort").agg(
        F.count(F.lit(1)).alias("evidence_items"),
        F.count_if(real).alias("substantive_items"),
        F.count_distinct("entity_id").alias("entities_researched"),
        F.count_distinct(F.when(sided, F.col("entity_id"))).alias("determinate"),
        F.count_if(real & (F.col("ai_gate") == "accepted")).alias("verified"),
        (F.count(F.lit(1)) - F.count_distinct(F.coalesce("near_dup_key", F.col("id").cast("string")))).alias("repeated"),
        F.avg(F.when(sided, F.col("extraction_confidence"))).alias("confidence"),
        F.count_if("first_party").alias("own"),
        F.count("page_id").alias("held"),
    )
    universe = table(spark, d, "publications").agg(F.count(F.lit(1)).alias("universe"))
    c = F.col
    return e.join(F.broadcast(universe), F.lit(True)).select(  # a table of one row
        "cohort", "evidence_items", "substantive_items", "entities_researched", "determinate", "universe",
        ratio(c("entities_researched"), c("universe")).alias("research_coverage"),
        ratio(c("determinate"), c("entities_researched")).alias("discovery_rate"),
        ratio(c("entities_researched") - c("determinate"), c("entities_researched")).alias("undetermined_rate"),
        ratio(c("repeated"), c("evidence_items")).alias("duplicate_rate"),
        ratio(c("verified"), c("substantive_items")).alias("verification_rate"),
        F.round("confidence", 3).alias("mean_confidence"),
        ratio(c("own"), c("evidence_items")).alias("first_party_rate"),
        ratio(c("held"), c("evidence_items")).alias("page_rate"),
    )


@query("""WITH i AS (SELECT count(*) FILTER (WHERE included = 1) AS total, count(*) FILTER (WHERE included = 1 AND control = 1) AS core, count(*) FILTER (WHERE included = 1 AND coalesce(website, '') = '') AS no_site FROM institutions),
p AS (SELECT count(DISTINCT p.unitid) AS identified, count(DISTINCT p.unitid) FILTER (WHERE verification_status IN ('verified', 'manual')) AS verified, count(DISTINCT p.unitid) FILTER (WHERE control = 1) AS core_identified FROM publications p JOIN institutions i ON i.unitid = p.unitid WHERE included = 1 AND is_primary = 1),
q AS (SELECT count(*) FILTER (WHERE confidence < 0.6) AS ambiguous FROM publications WHERE is_primary = 1), c AS (SELECT count(DISTINCT domain) AS attempted FROM publication_candidates)
SELECT total, core, attempted, identified, verified, ambiguous, no_site, round(CAST(identified AS DOUBLE) / nullif(total, 0), 4) AS success_rate, round(CAST(core_identified AS DOUBLE) / nullif(core, 0), 4) AS core_success_rate, round(CAST(greatest(0, attempted - identified) AS DOUBLE) / nullif(attempted, 0), 4) AS unresolved_rate, round(CAST(verified AS DOUBLE) / nullif(identified, 0), 4) AS verification_rate FROM i, p, q, c""")
def discovery_measures(spark, d):
    """Eleven measures of discovery over the included schools, in one row."""
    schools = table(spark, d, "institutions").filter("included = 1").select("unitid", "control", "website")
    papers = table(spark, d, "publications").filter("is_primary = 1")
    i = schools.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("control") == 1).alias("core"), F.count_if(F.coalesce("website", F.lit("")) == "").alias("no_site"))
    p = papers.join(schools, "unitid").agg(
        F.count_distinct("unitid").alias("identified"),
        F.count_distinct(F.when(F.col("verification_status").isin("verified", "manual"), F.col("unitid"))).alias("verified"),
        F.count_distinct(F.when(F.col("control") == 1, F.col("unitid"))).alias("core_identified"),
    )
    q = papers.agg(F.count_if(F.col("confidence") < 0.6).alias("ambiguous"))
    c = table(spark, d, "publication_candidates").agg(F.count_distinct("domain").alias("attempted"))
    one = i
    for other in (p, q, c):  # tables of one row
        one = one.join(F.broadcast(other), F.lit(True))
    col = F.col
    return one.select(
        "total", "core", "attempted", "identified", "verified", "ambiguous", "no_site",
        ratio(col("identified"), col("total")).alias("success_rate"),
        ratio(col("core_identified"), col("core")).alias("core_success_rate"),
        ratio(F.greatest(F.lit(0), col("attempted") - col("identified")), col("attempted")).alias("unresolved_rate"),
        ratio(col("verified"), col("identified")).alias("verification_rate"),
    )


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
r AS (SELECT 's1' AS node, 0 AS depth UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 2) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1""")
def reach_within(spark, d):
    """Suppliers and parts within two steps of supplier 1."""
    pairs = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    edges = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return frontier.bounded_bfs(edges, spark.sql("SELECT 's1' AS node"), 2)


@query("""WITH b AS (SELECT domain AS site, url, max(score) AS score, min(length(url)) AS depth FROM publication_candidates WHERE url IS NOT NULL AND length(url) <= 200 GROUP BY 1, 2), f AS (SELECT * FROM b WHERE url NOT IN (SELECT homepage_url FROM publications WHERE homepage_url IS NOT NULL))
SELECT site, url, CAST(row_number() OVER (PARTITION BY site ORDER BY score DESC, depth, url) AS INTEGER) AS place FROM f QUALIFY place <= 3""")
def crawl_frontier(spark, d):
    links = table(spark, d, "publication_candidates").select(F.col("domain").alias("site"), "url", "score", F.length("url").alias("depth"))
    done = table(spark, d, "publications").select(F.col("homepage_url").alias("url")).filter("url IS NOT NULL")
    return frontier.frontier(links, done, "site", "url", "score", "depth", 3, 200).select("site", "url", "place")


@query()
def fuzzy_school_names(spark, d):
    """Titles of candidates that are almost the name of a school of the state that their snippet names; brute force tests it on a fixture."""
    schools = table(spark, d, "institutions").select(F.col("unitid").alias("id"), "name", "state")
    state = F.nullif(F.regexp_extract(F.coalesce("snippet", F.lit("")), r"\b([A-Z]{2})\b", 1), F.lit(""))
    # the school stands behind an of or at, in brackets or alone
    name = F.regexp_replace(F.regexp_replace("title", r"^.*?(?:\bof |\bat |\()(?!of)", ""), r"[).]+\s*$", "")
    titles = table(spark, d, "publication_candidates").select(F.col("id").alias("target"), F.explode(F.array(F.col("title"), name)).alias("name"), state.alias("state"))
    numbered = titles.filter("name IS NOT NULL AND state IS NOT NULL").distinct().withColumn("target", F.struct("target", "name"))
    found = names.fuzzy_names(numbered.select(F.to_json("target").alias("target"), "name", "state"), schools, "state")
    return found.select(F.get_json_object("target", "$.target").cast("bigint").alias("candidate_id"), F.col("id").alias("unitid"), "similarity").groupBy("candidate_id").agg(F.max_by("unitid", "similarity").alias("unitid"), F.max("similarity").alias("similarity"))


@query("SELECT id, 'kept' AS origin FROM publications WHERE is_primary = 1 UNION ALL SELECT c.id, 'added' FROM publication_candidates c WHERE c.status = 'candidate' AND c.score >= 0.8 AND c.domain NOT IN (SELECT domain FROM publications WHERE domain IS NOT NULL)")
def insert_from_select(spark, d):
    papers, found = table(spark, d, "publications"), table(spark, d, "publication_candidates")
    added = found.filter("status = 'candidate' AND score >= 0.8 AND domain IS NOT NULL").join(papers.select("domain").distinct(), "domain", "left_anti").select("id", F.lit("added").alias("origin"))
    return papers.filter("is_primary = 1").select("id", F.lit("kept").alias("origin")).unionByName(added)


@query("SELECT (SELECT coalesce(max(o_totalprice), -1) FROM orders WHERE o_orderkey < 0) AS none, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS urgent")
def scalars_with_default(spark, d):
    orders = table(spark, d, "orders")
    none = Q.scalar(orders.filter("o_orderkey < 0").agg(F.max("o_totalprice").alias("x")), "x", -1.0)
    urgent = Q.scalar(orders.filter("o_orderpriority = '1-URGENT'").agg(F.count(F.lit(1)).alias("x")), "x", 0)
    return spark.range(1).select(F.lit(float(none)).alias("none"), F.lit(urgent).cast("bigint").alias("urgent"))


@query("SELECT domain, min(id) AS survivor, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(*) AS merged FROM publication_candidates WHERE domain IS NOT NULL GROUP BY 1")
def merged_with_provenance(spark, d):
    """One survivor a domain that keeps where its rows came from; the sources are few, so their set stays small."""
    rows = table(spark, d, "publication_candidates").filter("domain IS NOT NULL")
    return rows.groupBy("domain").agg(F.min("id").alias("survivor"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count(F.lit(1)).alias("merged"))


@query("SELECT id, sha256('vendor|model-1|v2|' || coalesce(excerpt_sha256, '')) AS key FROM evidence_items")
def verdict_cache_keys(spark, d):
    return table(spark, d, "evidence_items").select("id", F.sha2(F.concat_ws("|", F.lit("vendor"), F.lit("model-1"), F.lit("v2"), F.coalesce("excerpt_sha256", F.lit(""))), 256).alias("key"))



@query()
def sentences_bounded(spark, d):
    """Sentences of at most 700 characters, a row each; small fixtures test the split."""
    return bounded_sentences(table(spark, d, "main_texts"), "page_id", "main_text")


@query()
def markup_reading(spark, d):
    """How much reading matter the markup holds, and whether its title is in it."""
    rows = html.with_main_text(spread(table(spark, d, "fetch_results").select("page_id", "content")), "content")
    return rows.select("page_id", F.length("reading").alias("characters"), F.contains("reading", html.native_title(F.col("content"))).alias("titled"))


@query()
def redacted_rows(spark, d):
    """Quotations with names out of the text and out of the addresses of their pages, the speaker's own kept."""
    pages = table(spark, d, "main_texts").select("page_id", "url", "title")
    rows = table(spark, d, "voices").select("id", "page_id", "quote", "person_name").join(pages, "page_id", "left").withColumn("keep", F.array("person_name"))
    return redaction.redact_rows(rows, ["quote", "title"], ["url"], F.col("keep")).select("id", "quote", "title", "url")


@query("SELECT user_id, last AS last_seen, date_diff('second', last, TIMESTAMP '2024-01-31 00:00:00') < 86400 AS active FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY 1)")
def active_users(spark, d):
    beats = table(spark, d, "events").select("user_id", "ts")
    return runs.active_runs(beats, "user_id", "ts", F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00")), 86_400).withColumnRenamed("last", "last_seen")


@query("""WITH f AS (SELECT split_part(requested_url, '/', 3) AS host, fetched_at AS ts, coalesce(status_code BETWEEN 200 AND 299, false) AS ok FROM fetch_results WHERE fetched_at IS NOT NULL), g AS (SELECT host, max(ts) AS good FROM f WHERE ok GROUP BY 1),
b AS (SELECT f.host, count(*) AS failures, max(ts) AS last FROM f LEFT JOIN g USING (host) WHERE NOT ok AND (good IS NULL OR ts > good) GROUP BY 1)
SELECT host, coalesce(failures, 0) AS failures, CASE WHEN coalesce(failures, 0) < 2 THEN 'closed' WHEN date_diff('second', last, TIMESTAMP '2025-01-02 09:00:00') < 2400 THEN 'open' ELSE 'half_open' END AS state FROM (SELECT DISTINCT host FROM f WHERE host IS NOT NULL) LEFT JOIN b USING (host)""")
def host_circuits(spark, d):
    rows = table(spark, d, "fetch_results").select(F.split_part("requested_url", F.lit("/"), F.lit(3)).alias("host"), "fetched_at", "status_code")
    return runs.circuits(rows, "host", "fetched_at", F.col("status_code").between(200, 299), F.to_timestamp_ntz(F.lit("2025-01-02 09:00:00")), 2, 2400)


@query("SELECT page_id, floor((row_number() OVER (PARTITION BY split_part(requested_url, '/', 3) ORDER BY page_id) - 1) / 2.0) * 1.5 AS start FROM fetch_results")
def paced_requests(spark, d):
    rows = table(spark, d, "fetch_results").select("page_id", F.split_part("requested_url", F.lit("/"), F.lit(3)).alias("host"))
    return runs.paced(rows, "host", [F.asc("page_id")], 1.5).select("page_id", F.col("start").cast("double").alias("start"))


@query("""WITH v AS (SELECT requested_url, page_id, status_code, count(*) OVER w AS versions, row_number() OVER (w ORDER BY fetched_at, page_id) AS a, row_number() OVER (w ORDER BY fetched_at DESC, page_id DESC) AS z FROM fetch_results WHERE requested_url IS NOT NULL WINDOW w AS (PARTITION BY requested_url))
SELECT requested_url, versions, max(page_id) FILTER (WHERE a = 1) AS first_page, max(page_id) FILTER (WHERE z = 1) AS last_page, max(status_code) FILTER (WHERE a = 1) IS DISTINCT FROM max(status_code) FILTER (WHERE z = 1) AS changed FROM v WHERE versions > 1 GROUP BY 1, 2""")
def version_pairs(spark, d):
    """The earliest and the latest fetch of every address that was fetched again."""
    rows = table(spark, d, "fetch_results").select("requested_url", "page_id", "status_code", "fetched_at")
    pairs = runs.first_and_last(rows, "requested_url", ["fetched_at", "page_id"]).filter("versions > 1")
    return pairs.select("requested_url", "versions", F.col("first.page_id").alias("first_page"), F.col("last.page_id").alias("last_page"), (~F.col("first.status_code").eqNullSafe(F.col("last.status_code"))).alias("changed"))


@query("SELECT excerpt_sha256, id, created_at FROM evidence_items WHERE excerpt_sha256 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY excerpt_sha256 ORDER BY created_at, id) = 1")
def first_seen_excerpts(spark, d):
    rows = table(spark, d, "evidence_items").filter("excerpt_sha256 IS NOT NULL").select("excerpt_sha256", "id", "created_at")
    return runs.first_seen(rows, ["excerpt_sha256"], ["created_at", "id"])


@query("SELECT run_id, CAST(count(*) FILTER (WHERE ai_gate = 'accepted') AS BIGINT) AS done, CAST(count(*) FILTER (WHERE ai_gate = 'rejected') AS BIGINT) AS failed, CAST(greatest(0, 10000 - count(*) FILTER (WHERE ai_gate = 'accepted') - count(*) FILTER (WHERE ai_gate = 'rejected')) AS BIGINT) AS remaining FROM evidence_items GROUP BY 1")
def run_progress(spark, d):
    status = F.when(F.col("ai_gate") == "accepted", "done").when(F.col("ai_gate") == "rejected", "failed")
    rows = table(spark, d, "evidence_items").select("run_id", status.alias("status"), "created_at")
    return runs.progress(rows, "run_id", "status", "created_at", 10_000).select("run_id", "done", "failed", F.col("remaining").cast("bigint").alias("remaining"))


@query("""WITH l AS (SELECT page_id, string_split(full_text, chr(10)) AS ls FROM main_texts WHERE full_text IS NOT NULL), e AS (SELECT page_id, ls, unnest(range(len(ls))) AS pos FROM l)
SELECT page_id, CAST(pos AS INTEGER) AS pos, array_to_string(ls[greatest(pos - 2, 0) + 1 : least(pos + 1, len(ls) - 1) + 1], ' ') AS context FROM e""")
def lines_in_context(spark, d):
    """Every line with the two before and the one behind it."""
    return neighbours(table(spark, d, "main_texts"), "page_id", F.split("full_text", "\n", -1)).select("page_id", "pos", "context")


@query("SELECT unitid, trim(regexp_replace(coalesce(name, ''), '(?i)\\s*[-–,]\\s*(?:main campus|[A-Z][\\w .''&]*campus)\\s*$', '')) AS base FROM institutions")
def school_base_names(spark, d):
    return table(spark, d, "institutions").select("unitid", P.base_name(F.col("name")).alias("base"))


_GENERIC, _WANTED = "home|homepage|news|about us|welcome|index", "gazette|herald|torch|observer|chronicle|collegian|signal|beacon"


@query(f"""WITH p AS (SELECT id, domain, list_filter(list_filter(list_transform(regexp_split_to_array(coalesce(title, ''), '\\s+[|–—:-]\\s+'), lambda x: trim(x)), lambda x: x <> ''), lambda x: NOT regexp_matches(x, '(?i)^(?:{_GENERIC})$')) AS ps FROM publication_candidates)
SELECT id, left(coalesce(list_filter(ps, lambda x: regexp_matches(x, '(?i){_WANTED}') OR starts_with(lower(x), 'the '))[1], list_filter(ps, lambda x: length(x) <= 80 AND lower(x) <> lower(coalesce(domain, '')))[1]), 120) AS name FROM p""")
def paper_names(spark, d):
    return table(spark, d, "publication_candidates").select("id", P.title_part(F.col("title"), _GENERIC, _WANTED, F.col("domain")).alias("name"))


_ORG = r"trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g')), '(^| )saint( |$)', '\1st\2', 'g'), '^the | the$', '', 'g'))"


@query(f"""WITH t AS (SELECT id AS target, {_ORG.format('title')} AS n, {_HOST.format('domain')} AS h FROM publication_candidates), i AS (SELECT unitid AS id, {_ORG.format('name')} AS n, {_HOST.format('website')} AS h FROM institutions),
m AS (SELECT target, i.id, 0 AS p, 'name' AS method, 0.85 AS c FROM t JOIN i ON t.n = i.n AND t.n <> '' UNION ALL SELECT target, i.id, 1, 'domain', 0.8 FROM t JOIN i ON t.h <> '' AND i.h <> '' AND (t.h = i.h OR ends_with(t.h, '.' || i.h))),
g AS (SELECT target, p, method, c, min(id) AS low, max(id) AS high FROM m GROUP BY ALL), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY target ORDER BY p) = 1)
SELECT t.target, CASE WHEN low = high THEN low END AS id, CASE WHEN b.target IS NULL THEN 'unmatched' WHEN low = high THEN method ELSE 'ambiguous' END AS method, CAST(CASE WHEN low = high THEN c ELSE 0 END AS DOUBLE) AS confidence FROM (SELECT DISTINCT target FROM t) t LEFT JOIN b USING (target)""")
def school_match_cascade(spark, d):
    """Candidates to schools by name, else by host; the host test is an equi-join on the host's suffixes."""
    sites = table(spark, d, "publication_candidates").select(F.col("id").alias("target"), X.organisation_name(F.col("title")).alias("n"), U.host(F.col("domain")).alias("h"))
    schools = table(spark, d, "institutions").select(F.col("unitid").alias("id"), X.organisation_name(F.col("name")).alias("n"), U.host(F.col("website")).alias("h"))
    by_name = sites.filter("n <> ''").join(schools.select("id", "n"), "n").select("target", "id")
    below = sites.filter("h <> ''").select("target", F.explode(U.host_suffixes(F.col("h"))).alias("h"))
    by_host = below.join(schools.filter("h <> ''").select("id", "h"), "h").select("target", "id")
    return matching.by_priority(sites, [("name", 0.85, by_name), ("domain", 0.8, by_host)])


@query("SELECT run_id, count(*) AS n FROM evidence_items WHERE run_id NOT IN (SELECT run_id FROM evidence_items WHERE run_id IS NOT NULL GROUP BY 1 HAVING arg_max(CASE WHEN id % 7 < 3 THEN 'exclude' ELSE 'undo' END, id) = 'exclude') GROUP BY 1")
def runs_after_undo(spark, d):
    """Rows of the runs that no standing exclusion covers; here every row also stands for an action on its run."""
    rows = table(spark, d, "evidence_items").select("run_id", "id")
    log = rows.withColumn("action", F.when(F.col("id") % 7 < 3, "exclude").otherwise("undo"))
    out = matching.excluded_runs(log, "run_id", "action", ["id"])
    return rows.filter("run_id IS NOT NULL").join(out, "run_id", "left_anti").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id FROM (SELECT page_id, sum(elapsed_ms) OVER (ORDER BY page_id) AS spent FROM fetch_results WHERE access_class IS DISTINCT FROM 'ok') WHERE spent <= 200000")
def resumed_within_budget(spark, d):
    """A stopped run goes on: what isn't done, in order, as far as the budget goes."""
    items = table(spark, d, "fetch_results").select("page_id", "elapsed_ms")
    log = table(spark, d, "fetch_results").select("page_id", F.when(F.col("access_class") == "ok", "done").otherwise("failed").alias("status"))
    return within_budget(remaining(items, log, "page_id"), "elapsed_ms", ["page_id"], 200_000).select("page_id")


@query("""SELECT CAST(row_number() OVER (ORDER BY page_id) AS INTEGER) AS rank, page_id, CASE WHEN s THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || '/withheld' ELSE url END AS url, CASE WHEN s AND title IS NOT NULL THEN '[story]' ELSE title END AS title FROM (SELECT *, coalesce(page_kind = 'crime_article', false) AS s FROM main_texts) QUALIFY rank <= 100""")
def public_pages(spark, d):
    """The first hundred pages as a public list."""
    rows = table(spark, d, "main_texts").select("page_id", "url", "title", "page_kind", "author")
    return redaction.make_public(rows.withColumn("story", F.col("page_kind") == "crime_article"), ["author", "page_kind"], ["url"], ["title"], F.col("story"), [F.col("page_id")], limit=100).drop("story")


#: Fourteen weighted factors; the last is conjunctive.
_FACTORS = {
    "setting": (8.0, ["student|campus|school|college"]), "police": (12.0, ["police log|mug ?shot|arrest"]), "dismissed": (14.0, ["dismissed|dropped"]), "acquitted": (14.0, ["acquittal|acquitted"]), "sealed": (12.0, ["sealed|expunged"]),
    "time": (10.0, ["years? ago|change of heart|[0-9]+ months"]), "private": (8.0, ["private|minors?"]), "search": (12.0, ["search|de-index"]), "harm": (10.0, ["harm|threat|job search"]), "delete": (8.0, ["delete|take down|remove"]),
    "anonymize": (12.0, ["anonymize|names? of"]), "update": (8.0, ["update|note|annotate"]), "court": (10.0, ["court|charge"]), "kept_without_name": (14.0, ["keep|kept|remain", "search|name"]),
}
_ACTIVE_FACTORS = ["dismissed", "search", "anonymize", "kept_without_name"]


def _factor_sql(names: list[str]) -> str:
    hit = {n: " AND ".join(_has("coalesce(excerpt, '')", p) for p in _FACTORS[n][1]) for n in names}
    total = sum(_FACTORS[n][0] for n in names)
    return f"round(100 * ({' + '.join(f'CASE WHEN {h} THEN {_FACTORS[n][0]}::DOUBLE ELSE 0 END' for n, h in hit.items())}) / {total}, 2)", f"array_to_string(list_sort(list_filter([{', '.join(f'CASE WHEN {h} THEN {chr(39)}{n}{chr(39)} END' for n, h in hit.items())}], lambda x: x IS NOT NULL)), ',')"


@query(f"SELECT id, {_factor_sql(list(_FACTORS))[0]} AS similarity, {_factor_sql(list(_FACTORS))[1]} AS factors, {_factor_sql(_ACTIVE_FACTORS)[0]} AS case_match FROM evidence_items")
def factor_similarity(spark, d):
    score, found = X.factor_match(F.col("excerpt"), _FACTORS)
    active, _ = X.factor_match(F.col("excerpt"), _FACTORS, _ACTIVE_FACTORS)
    return table(spark, d, "evidence_items").select("id", score.alias("similarity"), F.array_join(found, ",").alias("factors"), active.alias("case_match"))


def _voices_sql() -> str:
    parts = []
    for k, (method, pattern, q, s, r) in enumerate(ATTRIBUTIONS):
        group = lambda g: f"regexp_extract_all(coalesce(full_text, ''), '{pattern}', {g})"  # noqa: B023, E731
        roles = group(r) if r else f"list_transform({group(q)}, lambda x: '')"
        parts.append(f"SELECT page_id, {k} AS k, '{method}' AS method, unnest({group(q)}) AS quote, unnest({group(s)}) AS speaker, nullif(unnest({roles}), '') AS role FROM main_texts")
    return f"SELECT page_id, quote, speaker, role, method, CASE WHEN role IS NULL THEN 0.6 ELSE 0.7 END::DOUBLE AS confidence FROM ({' UNION ALL '.join(parts)}) QUALIFY row_number() OVER (PARTITION BY page_id, quote ORDER BY k, speaker, role NULLS FIRST, method) = 1"


@query(_voices_sql())
def voices_by_attribution(spark, d):
    return attributed_voices(table(spark, d, "main_texts"), "page_id", "full_text")


@query(r"""WITH m AS (SELECT m.page_id, regexp_replace(lower(coalesce(p.domain, '')), '^www\.', '') AS site, list_distinct(regexp_extract_all(lower(coalesce(full_text, '')), '([a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+)', 1)) AS es FROM main_texts m LEFT JOIN publications p ON p.id = m.publication_id)
SELECT page_id, unnest(list_filter(es, lambda e: site <> '' AND (split_part(e, '@', 2) = site OR ends_with(e, '.' || site)) AND NOT regexp_matches(split_part(e, '@', 1), '^(?:no-?reply|donotreply|privacy|abuse|postmaster|webmaster|ads?|advertis\w*|sales|billing|subscriptions?|circulation|careers|jobs|hr|classifieds?|marketing)$'))) AS email FROM m""")
def own_site_emails(spark, d):
    papers = table(spark, d, "publications").select(F.col("id").alias("publication_id"), "domain")
    rows = table(spark, d, "main_texts").select("page_id", "publication_id", "full_text").join(papers, "publication_id", "left")
    return rows.select("page_id", F.explode(X.own_emails(F.col("full_text"), F.col("domain"))).alias("email"))


@query("""WITH g AS (SELECT unitid, control, level, state, included FROM institutions), m AS (SELECT unitid, unnest(list_filter(['all', CASE WHEN control = 1 THEN 'public' END, CASE WHEN level = 1 THEN 'four_year' END, CASE WHEN state IN ('OH', 'TX', 'CA') THEN 'large_states' END], lambda x: x IS NOT NULL)) AS peer_group FROM g WHERE included = 1),
p AS (SELECT unitid, count(*) AS papers, count(*) FILTER (WHERE verification_status = 'verified') AS verified, count(*) FILTER (WHERE is_primary = 1) AS primaries FROM publications WHERE unitid IS NOT NULL GROUP BY 1)
SELECT peer_group, count(*) AS institutions, CAST(coalesce(sum(papers), 0) AS BIGINT) AS publications, CAST(coalesce(sum(verified), 0) AS BIGINT) AS verified, CAST(coalesce(sum(primaries), 0) AS BIGINT) AS primaries, count(papers) AS with_publication FROM m LEFT JOIN p USING (unitid) GROUP BY 1""")
def peer_group_crosstab(spark, d):
    """Measures over groups that overlap: a school counts in each of its groups, its papers are summed before it is repeated."""
    schools = table(spark, d, "institutions").filter("included = 1")
    papers = table(spark, d, "publications").filter("unitid IS NOT NULL").groupBy("unitid").agg(F.count(F.lit(1)).alias("papers"), F.count_if(F.col("verification_status") == "verified").alias("v"), F.count_if(F.col("is_primary") == 1).alias("p"))
    groups = {"all": F.lit(True), "public": F.col("control") == 1, "four_year": F.col("level") == 1, "large_states": F.col("state").isin("OH", "TX", "CA")}
    member = overlapping_groups(schools.join(papers, "unitid", "left"), groups)
    return member.groupBy("peer_group").agg(
        F.count(F.lit(1)).alias("institutions"), F.coalesce(F.sum("papers"), F.lit(0)).alias("publications"), F.coalesce(F.sum("v"), F.lit(0)).alias("verified"), F.coalesce(F.sum("p"), F.lit(0)).alias("primaries"), F.count("papers").alias("with_publication")
    )


@query("""WITH g AS (SELECT entity_id, statement_type, coalesce(near_dup_key, CAST(id AS VARCHAR)) AS k, max(authority_score) AS score, min(id) AS id FROM evidence_items WHERE entity_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT entity_id, statement_type, count(*) AS groups, arg_min(id, (-score, id)) AS best FROM g WHERE score IS NOT NULL GROUP BY 1, 2""")
def distinct_groups_best_first(spark, d):
    """How many different statements of a kind stand for an entity, and the first of the best."""
    rows = table(spark, d, "evidence_items").filter("entity_id IS NOT NULL")
    groups = rows.groupBy("entity_id", "statement_type", F.coalesce("near_dup_key", F.col("id").cast("string")).alias("k")).agg(F.max("authority_score").alias("score"), F.min("id").alias("id")).filter("score IS NOT NULL")
    return groups.groupBy("entity_id", "statement_type").agg(F.count(F.lit(1)).alias("groups"), F.min_by("id", F.struct(-F.col("score"), "id")).alias("best"))


@query("SELECT doc_id, regexp_replace(title, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS title FROM documents")
def safe_titles(spark, d):
    return safe_text(table(spark, d, "documents").select("doc_id", "title"))


#: What other engines' patterns can say; the one left out looks ahead and is tested on a fixture.
_TAGGED = {n: p for n, p in CONCEPTS.items() if n != "dismissed_charges"}


@query("WITH t AS (SELECT id, coalesce(excerpt, '') AS x FROM evidence_items) " + " UNION ALL ".join(f"""SELECT id, '{n}' AS tag FROM t WHERE {_has('x', p.replace("'", "''"))}""" for n, p in _TAGGED.items()))
def concept_tags(spark, d):
    return tag_bridge(table(spark, d, "evidence_items"), "id", "excerpt", CONCEPTS).filter(F.col("tag") != "dismissed_charges")


@query("WITH t AS (SELECT id, entity_id, coalesce(quote, '') AS x FROM voices) SELECT tag, count(*) AS n, count(DISTINCT entity_id) AS entities FROM (" + " UNION ALL ".join(f"""SELECT entity_id, '{n}' AS tag FROM t WHERE {_has('x', p.replace("'", "''"))}""" for n, p in _TAGGED.items()) + ") GROUP BY 1")
def concept_tallies(spark, d):
    rows = table(spark, d, "voices").select("id", "entity_id", "quote")
    tags = tag_bridge(rows, "id", "quote", _TAGGED)
    return tags.join(rows.select("id", "entity_id"), "id").groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("entities"))

"""Relational queries: joins, aggregates, current versions, ranks, upserts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatrix.functions.stats import ratio
from verbatrix.functions.text import person_key, slug
from verbatrix.functions.urls import host, same_site, status_class
from verbatrix.operators import relational as R
from verbatrix.operators.sizing import join_measured
from verbatrix.plans.registry import query
from verbatrix.sources.tables import table


@query("SELECT o_custkey, o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_order_per_customer(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    return R.latest(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT entity_id, max(id) AS id, arg_max(direction, id) AS direction, arg_max(run_id, id) AS run_id FROM evidence_items GROUP BY entity_id")
def latest_evidence_per_entity(spark, d):
    return table(spark, d, "evidence_items").groupBy("entity_id").agg(F.max("id").alias("id"), F.max_by("direction", "id").alias("direction"), F.max_by("run_id", "id").alias("run_id"))


@query("SELECT entity_id, id, round(relevance_score * authority_score, 6) AS score FROM evidence_items WHERE relevance_score IS NOT NULL AND authority_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY round(relevance_score * authority_score, 6) DESC, extraction_confidence DESC NULLS LAST, id) = 1")
def best_item_per_entity(spark, d):
    rows = table(spark, d, "evidence_items").select("entity_id", "id", F.round(F.col("relevance_score") * F.col("authority_score"), 6).alias("score"), "extraction_confidence").filter("score IS NOT NULL")
    return R.top_k(rows, ["entity_id"], [F.desc("score"), F.desc_nulls_last("extraction_confidence"), F.asc("id")], 1).select("entity_id", "id", "score")


@query("SELECT l_suppkey, l_partkey, qty, CAST(rnk AS INTEGER) AS rnk, rnk > 3 AS overflow FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS qty, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS rnk FROM lineitem GROUP BY 1, 2)")
def top_k_parts_with_overflow(spark, d):
    parts = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("qty"))
    rows = R.spread_rank(parts, ["l_suppkey"], [F.desc("qty"), F.asc("l_partkey")], "rnk")
    return rows.withColumn("rnk", F.col("rnk").cast("int")).withColumn("overflow", F.col("rnk") > 3)


@query("SELECT id, round(relevance_score * authority_score, 6) AS score, extraction_confidence FROM evidence_items ORDER BY round(relevance_score * authority_score, 6) DESC NULLS LAST, extraction_confidence DESC NULLS LAST, id LIMIT 50")
def top50_scored(spark, d):
    rows = table(spark, d, "evidence_items").select("id", F.round(F.col("relevance_score") * F.col("authority_score"), 6).alias("score"), "extraction_confidence")
    return rows.orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("extraction_confidence"), "id").limit(50)


@query("SELECT event_id, round(s, 4) AS running, round(s, 4) <= 50000 AS within FROM (SELECT event_id, sum(round(value, 2)) OVER (ORDER BY ts, event_id) AS s FROM events)")
def budget_running_sum(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", F.round("value", 2).alias("value"))
    return R.running_sum(rows, "value", ["ts", "event_id"]).select("event_id", F.round("running", 4).alias("running"), (F.round("running", 4) <= 50000).alias("within"))


@query("""WITH s AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY qty DESC, l_partkey) AS k FROM s)
SELECT l_suppkey, max(CASE WHEN k = 1 THEN l_partkey END) AS l_partkey, max(CASE WHEN k = 1 THEN qty END) AS qty, max(CASE WHEN k = 2 THEN qty END) AS runner_up, coalesce(max(CASE WHEN k = 1 THEN qty END) - max(CASE WHEN k = 2 THEN qty END) < 5, false) AS ambiguous FROM r WHERE k <= 2 GROUP BY 1""")
def ambiguity_margin(spark, d):
    parts = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("qty"))
    return R.best_with_margin(parts, "l_suppkey", "l_partkey", "qty", 5)


@query("SELECT n_name, r_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def star_join_revenue(spark, d):
    t = {n: table(spark, d, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    orders = t["orders"].filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    # the dimensions go to the orders first; lineitem then meets them once and leaves a row a nation and task
    place = t["customer"].select("c_custkey", "c_nationkey").join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    placed = orders.join(place, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name", "r_name")
    lines = t["lineitem"].select("l_orderkey", "l_extendedprice", "l_discount").join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_mktsegment, count(o_orderkey) AS urgent, count(DISTINCT c_custkey) AS customers FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1")
def left_optional_dims(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey")
    rows = table(spark, d, "customer").join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("urgent"), F.count_distinct("c_custkey").alias("customers"))


@query("""WITH b AS (SELECT entity_id, direction, id FROM evidence_items WHERE direction IN ('supportive', 'adverse') QUALIFY row_number() OVER (PARTITION BY entity_id, direction ORDER BY relevance_score DESC NULLS LAST, id) = 1)
SELECT p.id AS entity_id, s.id AS supportive_id, a.id AS adverse_id FROM publications p LEFT JOIN b s ON s.entity_id = p.id AND s.direction = 'supportive' LEFT JOIN b a ON a.entity_id = p.id AND a.direction = 'adverse'""")
def double_role_join(spark, d):
    rows = table(spark, d, "evidence_items").filter(F.col("direction").isin("supportive", "adverse")).select("entity_id", "direction", "id", "relevance_score")
    best = R.top_k(rows, ["entity_id", "direction"], [F.desc_nulls_last("relevance_score"), F.asc("id")], 1)
    # both roles in one row a side by a conditional aggregate instead of two joins to the same relation
    roles = best.groupBy("entity_id").agg(F.max(F.when(F.col("direction") == "supportive", F.col("id"))).alias("supportive_id"), F.max(F.when(F.col("direction") == "adverse", F.col("id"))).alias("adverse_id"))
    return table(spark, d, "publications").select(F.col("id").alias("entity_id")).join(roles, "entity_id", "left")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join_active(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(big, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join_excluded(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT p.id, p.domain, EXISTS (SELECT 1 FROM voices v WHERE v.entity_id = p.id) AS has_voice FROM publications p")
def exists_flag_projection(spark, d):
    spoke = table(spark, d, "voices").select(F.col("entity_id").alias("id")).distinct().withColumn("has_voice", F.lit(True))
    return table(spark, d, "publications").select("id", "domain").join(spoke, "id", "left").withColumn("has_voice", F.coalesce("has_voice", F.lit(False)))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS dearest FROM customer")
def correlated_scalar_topone(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("dearest"))
    return table(spark, d, "customer").select("c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "dearest")


@query("SELECT e.near_dup_key AS near_dup_key, count(*) AS pairs FROM (SELECT DISTINCT near_dup_key, ai_gate FROM evidence_items) e JOIN (SELECT DISTINCT near_dup_key, ai_gate FROM evidence_items WHERE direction = 'adverse') f ON e.near_dup_key = f.near_dup_key AND e.ai_gate IS NOT DISTINCT FROM f.ai_gate GROUP BY 1")
def null_safe_match(spark, d):
    rows = table(spark, d, "evidence_items")
    a = rows.select("near_dup_key", "ai_gate").distinct()
    b = rows.filter("direction = 'adverse'").select(F.col("near_dup_key").alias("k"), F.col("ai_gate").alias("g")).distinct()
    return a.join(b, (F.col("near_dup_key") == F.col("k")) & F.col("ai_gate").eqNullSafe(F.col("g"))).groupBy("near_dup_key").agg(F.count(F.lit(1)).alias("pairs"))


@query("SELECT id, domain, title, total FROM (SELECT id, domain, title, count(*) OVER () AS total FROM publication_candidates WHERE title ILIKE '%college%' AND status <> 'rejected' AND score BETWEEN 0.3 AND 0.9) ORDER BY id LIMIT 25 OFFSET 10")
def ilike_search_page(spark, d):
    hits = table(spark, d, "publication_candidates").filter(F.col("title").ilike("%college%") & (F.col("status") != "rejected") & F.col("score").between(0.3, 0.9)).select("id", "domain", "title")
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    return hits.orderBy("id").offset(10).limit(25).join(F.broadcast(total), F.lit(True))


@query("SELECT CASE control WHEN 1 THEN 'public' WHEN 2 THEN 'private nonprofit' WHEN 3 THEN 'for profit' ELSE 'unknown' END AS control_name, state, count(*) AS n, CAST(count(*) FILTER (WHERE website IS NULL) AS BIGINT) AS without_site, CAST(sum(included) AS BIGINT) AS included FROM institutions GROUP BY 1, 2")
def case_decode_counts(spark, d):
    name = F.when(F.col("control") == 1, "public").when(F.col("control") == 2, "private nonprofit").when(F.col("control") == 3, "for profit").otherwise("unknown")
    return table(spark, d, "institutions").groupBy(name.alias("control_name"), "state").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("website").isNull()).alias("without_site"), F.sum("included").cast("bigint").alias("included"))


@query("SELECT domain, min(id) AS first_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM publication_candidates GROUP BY domain HAVING count(*) > 1")
def having_duplicates(spark, d):
    rows = table(spark, d, "publication_candidates").select("domain", "id")
    return rows.groupBy("domain").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("ids")).filter("n > 1")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS high FROM events GROUP BY 1")
def distinct_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("high"))


_SPLIT = "(SELECT user_id, max(round(value, 3)) AS v, arg_max(event_type, event_id) AS t FROM events WHERE event_id % 2 = {0} GROUP BY user_id)"


@query(f"SELECT coalesce(n.user_id, o.user_id) AS user_id, greatest(o.v, n.v) AS v, CASE WHEN n.user_id IS NOT NULL THEN n.t ELSE o.t END AS t FROM {_SPLIT.format(0)} o FULL JOIN {_SPLIT.format(1)} n USING (user_id)")
def upsert_keep_max(spark, d):
    rows = table(spark, d, "events").withColumn("value", F.round("value", 3))
    half = lambda k: rows.filter(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.max("value").alias("v"), F.max_by("event_type", "event_id").alias("t"))
    return R.upsert(half(0), half(1), ["user_id"], {"v": "max"})


@query(f"SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.v, o.v) AS v, coalesce(o.t, n.t) AS t FROM {_SPLIT.format(0)} o FULL JOIN {_SPLIT.format(1)} n USING (user_id)")
def upsert_last_wins_keep_decision(spark, d):
    rows = table(spark, d, "events").withColumn("value", F.round("value", 3))
    half = lambda k: rows.filter(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.max("value").alias("v"), F.max_by("event_type", "event_id").alias("t"))
    return R.upsert(half(0), half(1), ["user_id"], {"t": "keep", "v": "coalesce"})


@query("SELECT quote_sha256, min(id) AS id FROM voices WHERE direction = 'adverse' GROUP BY 1 UNION ALL SELECT quote_sha256, min(id) AS id FROM voices WHERE direction <> 'adverse' AND quote_sha256 NOT IN (SELECT quote_sha256 FROM voices WHERE direction = 'adverse') GROUP BY 1")
def insert_ignore_anti(spark, d):
    rows = table(spark, d, "voices")
    first = lambda x: x.groupBy("quote_sha256").agg(F.min("id").alias("id"))
    return R.insert_ignore(first(rows.filter("direction = 'adverse'")), first(rows.filter("direction <> 'adverse'")), ["quote_sha256"])


@query("SELECT id, domain, min(id) OVER (PARTITION BY lower(domain)) AS survivor, min(id) OVER (PARTITION BY lower(domain)) = id AS active FROM publication_candidates")
def merge_by_domain(spark, d):
    rows = table(spark, d, "publication_candidates").select("id", "domain", F.lower("domain").alias("k"))
    return R.merge_survivors(rows, "k", "id").drop("k", "merged_into")


@query("SELECT source_domain, CASE WHEN n = 1 THEN 'added' ELSE 'removed' END AS change FROM (SELECT source_domain, max(o) AS o, max(n) AS n FROM (SELECT source_domain, 1 AS o, 0 AS n FROM evidence_items UNION ALL SELECT source_domain, 0, 1 FROM voices) GROUP BY 1) WHERE o <> n")
def set_diff_added_removed(spark, d):
    return R.set_changes(table(spark, d, "evidence_items"), table(spark, d, "voices"), ["source_domain"])


@query("""WITH g AS (SELECT 'public' AS peer_group, i.* FROM institutions i WHERE control = 1 UNION ALL SELECT 'large', i.* FROM institutions i WHERE CAST(json_extract_string(raw_json, '$.INSTSIZE') AS INTEGER) >= 4 UNION ALL SELECT 'coast', i.* FROM institutions i WHERE state IN ('CA', 'OR', 'WA', 'NY', 'MA') UNION ALL SELECT 'all', i.* FROM institutions i)
SELECT peer_group, count(DISTINCT g.unitid) AS institutions, count(p.id) AS publications FROM g LEFT JOIN publications p ON p.unitid = g.unitid GROUP BY 1""")
def peer_group_overlap(spark, d):
    size = F.get_json_object("raw_json", "$.INSTSIZE").try_cast("int")
    rows = table(spark, d, "institutions").select("unitid", "control", "state", size.alias("size"))
    papers = table(spark, d, "publications").filter("unitid IS NOT NULL").groupBy("unitid").agg(F.count(F.lit(1)).alias("papers"))
    members = R.overlapping_groups(rows.join(papers, "unitid", "left"), {"public": F.col("control") == 1, "large": F.col("size") >= 4, "coast": F.col("state").isin("CA", "OR", "WA", "NY", "MA"), "all": F.lit(True)})
    return members.groupBy("peer_group").agg(F.count_distinct("unitid").alias("institutions"), F.coalesce(F.sum("papers"), F.lit(0)).alias("publications"))


@query("SELECT cohort, CAST(count(*) FILTER (WHERE direction = 'supportive') AS BIGINT) AS supportive, CAST(count(*) FILTER (WHERE direction = 'adverse') AS BIGINT) AS adverse, CAST(count(*) FILTER (WHERE direction = 'neutral') AS BIGINT) AS neutral FROM evidence_items GROUP BY 1")
def direction_pivot(spark, d):
    return table(spark, d, "evidence_items").groupBy("cohort").pivot("direction", ["supportive", "adverse", "neutral"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def json_prop_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


@query("SELECT json_extract_string(raw_json, '$.IALIAS') AS alias, count(*) AS n FROM institutions WHERE json_extract_string(raw_json, '$.IALIAS') <> '' GROUP BY 1")
def json_key_group(spark, d):
    return table(spark, d, "institutions").groupBy(F.get_json_object("raw_json", "$.IALIAS").alias("alias")).agg(F.count(F.lit(1)).alias("n")).filter("alias <> ''")


_STATUS = "CASE WHEN status_code IS NULL THEN NULL WHEN status_code BETWEEN 200 AND 299 THEN 'ok' WHEN status_code = 404 THEN 'not_found' WHEN status_code = 410 THEN 'gone' WHEN status_code = 429 THEN 'rate_limited' WHEN status_code IN (401, 403, 407, 451) THEN 'blocked' WHEN status_code BETWEEN 500 AND 599 THEN 'server_error' WHEN status_code BETWEEN 400 AND 499 THEN 'client_error' ELSE 'unexpected_status' END"


@query(f"SELECT {_STATUS} AS status_class, access_class, count(*) AS n FROM fetch_results GROUP BY 1, 2")
def status_to_access(spark, d):
    return table(spark, d, "fetch_results").groupBy(status_class(F.col("status_code")).alias("status_class"), "access_class").agg(F.count(F.lit(1)).alias("n"))


_HOST = r"regexp_replace(regexp_extract(lower(trim(coalesce({0}, ''))), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#\s]+)', 1), '^www\.', '')"


@query(f"""SELECT {_HOST.format('requested_url')} AS site, count(*) AS pages, CAST(count(*) FILTER (WHERE access_class = 'ok') AS BIGINT) AS ok, CAST(count(*) FILTER (WHERE robots_allowed IS FALSE) AS BIGINT) AS disallowed, round(CAST(count(*) FILTER (WHERE access_class <> 'ok') AS DOUBLE) / count(*), 4) AS inaccessible, CAST(count(*) FILTER (WHERE coalesce(content, '') = '') AS BIGINT) AS empty, coalesce(CAST(sum(len(redirect_chain)) AS BIGINT), 0) AS redirects FROM fetch_results GROUP BY 1""")
def coverage_counters(spark, d):
    ok = F.col("access_class") == "ok"
    return (
        table(spark, d, "fetch_results")
        .groupBy(host(F.col("requested_url")).alias("site"))
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.count_if(ok).alias("ok"),
            F.count_if(~F.col("robots_allowed")).alias("disallowed"),
            ratio(F.count_if(~ok), F.count(F.lit(1))).alias("inaccessible"),
            F.count_if(F.coalesce("content", F.lit("")) == "").alias("empty"),
            F.coalesce(F.sum(F.when(F.col("redirect_chain").isNotNull(), F.size("redirect_chain"))), F.lit(0)).cast("bigint").alias("redirects"),
        )
    )


_COHORT = """SELECT cohort, count(*) AS items, count(DISTINCT entity_id) AS entities, count(DISTINCT near_dup_key) AS distinct_texts, round(1 - CAST(count(DISTINCT near_dup_key) AS DOUBLE) / count(*), 4) AS duplicate_share,
round(CAST(count(*) FILTER (WHERE first_party) AS DOUBLE) / count(*), 4) AS first_party_share, round(CAST(count(*) FILTER (WHERE about_entity AND direction <> 'neutral') AS DOUBLE) / nullif(count(*) FILTER (WHERE about_entity), 0), 4) AS decided_share,
round(avg(extraction_confidence) FILTER (WHERE direction <> 'neutral'), 6) AS mean_confidence FROM evidence_items GROUP BY cohort"""


@query(_COHORT)
def cohort_metrics(spark, d):
    """All measures of all cohorts in one wide conditional aggregate."""
    decided = F.col("direction") != "neutral"
    n = F.count(F.lit(1))
    return (
        table(spark, d, "evidence_items")
        .groupBy("cohort")
        .agg(
            n.alias("items"),
            F.count_distinct("entity_id").alias("entities"),
            F.count_distinct("near_dup_key").alias("distinct_texts"),
            F.round(1 - F.count_distinct("near_dup_key") / n, 4).alias("duplicate_share"),
            ratio(F.count_if("first_party"), n).alias("first_party_share"),
            ratio(F.count_if(F.col("about_entity") & decided), F.count_if("about_entity")).alias("decided_share"),
            F.round(F.avg(F.when(decided, F.col("extraction_confidence"))), 6).alias("mean_confidence"),
        )
    )


@query(f"WITH m AS ({_COHORT}) SELECT cohort, g.gate AS gate, g.value AS value, g.threshold AS threshold, coalesce(CASE WHEN g.op = '>=' THEN g.value >= g.threshold ELSE g.value <= g.threshold END, false) AS passed FROM (SELECT cohort, unnest([{{'gate': 'entities', 'value': CAST(entities AS DOUBLE), 'threshold': 30.0::DOUBLE, 'op': '>='}}, {{'gate': 'duplicate_share', 'value': duplicate_share, 'threshold': 0.35::DOUBLE, 'op': '<='}}, {{'gate': 'mean_confidence', 'value': mean_confidence, 'threshold': 0.5::DOUBLE, 'op': '>='}}]) AS g FROM m)")
def gates_unpivot(spark, d):
    return R.unpivot_gates(cohort_metrics(spark, d), "cohort", {"entities": (">=", 30.0), "duplicate_share": ("<=", 0.35), "mean_confidence": (">=", 0.5)})


@query("SELECT source, count(*) AS shown, CAST(count(*) FILTER (WHERE status <> 'rejected') AS BIGINT) AS useful, round(CAST(count(*) FILTER (WHERE status <> 'rejected') AS DOUBLE) / count(*), 3) AS rate FROM publication_candidates GROUP BY 1")
def usefulness_by_source(spark, d):
    useful = F.count_if(F.col("status") != "rejected")
    return table(spark, d, "publication_candidates").groupBy("source").agg(F.count(F.lit(1)).alias("shown"), useful.alias("useful"), ratio(useful, F.count(F.lit(1)), 3).alias("rate"))


@query("SELECT entity_id, statement_type, CASE WHEN len(p) = 1 THEN p[1] WHEN list_contains(p, 'supportive') AND list_contains(p, 'adverse') THEN 'mixed' WHEN list_contains(p, 'supportive') THEN 'supportive' ELSE 'adverse' END AS position FROM (SELECT entity_id, statement_type, list(DISTINCT direction) AS p FROM evidence_items WHERE direction IS NOT NULL GROUP BY 1, 2)")
def position_lattice(spark, d):
    """Join of the positions seen: one alone stands, opposed ones are mixed, neutral gives way."""
    rows = table(spark, d, "evidence_items").filter("direction IS NOT NULL").groupBy("entity_id", "statement_type").agg(F.collect_set("direction").alias("p"))
    has = lambda x: F.array_contains("p", x)
    return rows.select("entity_id", "statement_type", F.when(F.size("p") == 1, F.col("p")[0]).when(has("supportive") & has("adverse"), "mixed").when(has("supportive"), "supportive").otherwise("adverse").alias("position"))


@query("SELECT v.id AS id, p.domain AS domain FROM voices v JOIN publications p ON 'pub:' || v.entity_id = 'pub:' || p.id")
def expression_key_join(spark, d):
    a = table(spark, d, "voices").select("id", F.concat(F.lit("pub:"), F.col("entity_id")).alias("k"))
    return a.join(table(spark, d, "publications").select(F.concat(F.lit("pub:"), F.col("id")).alias("k"), "domain"), "k").select("id", "domain")


@query(f"""WITH h AS (SELECT page_id, {_HOST.format('url')} AS host FROM main_texts)
SELECT page_id, host, domain AS site, id AS publication FROM (SELECT page_id, host, domain, p.id, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC) AS k FROM h JOIN publications p ON host = domain OR ends_with(host, '.' || domain)) WHERE k = 1""")
def host_suffix_join(spark, d):
    pages = table(spark, d, "main_texts").select("page_id", host(F.col("url")).alias("host"))
    sites = table(spark, d, "publications").select(F.col("domain").alias("site"), F.col("id").alias("publication"))
    return R.longest_suffix_join(pages, "host", sites, "site")


@query(f"SELECT e.id AS id, ({_HOST.format('e.source_domain')} = p.domain OR ends_with({_HOST.format('e.source_domain')}, '.' || p.domain) OR ends_with(p.domain, '.' || {_HOST.format('e.source_domain')})) AND {_HOST.format('e.source_domain')} <> '' AS first_party FROM evidence_items e JOIN publications p ON p.id = e.entity_id")
def same_site_flag(spark, d):
    sites = table(spark, d, "publications").select(F.col("id").alias("entity_id"), "domain")
    rows = join_measured(table(spark, d, "evidence_items").select("id", "entity_id", "source_domain"), sites, ["entity_id"])
    return rows.select("id", same_site(host(F.col("source_domain")), F.col("domain")).alias("first_party"))


@query("SELECT e.id AS id, contains(m.full_text, e.excerpt) AS held FROM evidence_items e JOIN main_texts m USING (page_id) WHERE m.full_text IS NOT NULL")
def quote_containment(spark, d):
    """Excerpts against the text of their own page: the containment test is blocked by the page's key."""
    texts = table(spark, d, "main_texts").select("page_id", "full_text").filter("full_text IS NOT NULL")
    return table(spark, d, "evidence_items").select("id", F.col("page_id").cast("bigint").alias("page_id"), "excerpt").join(texts, "page_id").select("id", F.contains("full_text", "excerpt").alias("held"))


@query("SELECT id, rnk <= 2 AS kept FROM (SELECT id, row_number() OVER (PARTITION BY source_domain ORDER BY authority_score DESC NULLS LAST, id) AS rnk FROM evidence_items)")
def trim_keep_flag(spark, d):
    rows = table(spark, d, "evidence_items").select("id", "source_domain", "authority_score")
    return R.flag_top_k(rows, "id", ["source_domain"], [F.desc_nulls_last("authority_score"), F.asc("id")], 2).select("id", "kept")


@query("SELECT id, first_value(id) OVER (PARTITION BY run_id, entity_id, near_dup_key ORDER BY id) AS canonical, count(*) OVER (PARTITION BY run_id, entity_id, near_dup_key) AS copies FROM evidence_items")
def near_dup_canonical(spark, d):
    rows = table(spark, d, "evidence_items").select("id", "run_id", "entity_id", "near_dup_key")
    return R.with_group_stats(rows, ["run_id", "entity_id", "near_dup_key"], canonical=F.min("id"), copies=F.count(F.lit(1))).select("id", "canonical", "copies")


@query("SELECT id, person_name, trim(regexp_replace(regexp_replace(lower(coalesce(person_name, '')), '\\.', '', 'g'), '[^a-z]+', '-', 'g'), '-') AS key, substr(trim(regexp_replace(lower(coalesce(person_name, '')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80) AS slug FROM voices")
def person_keys(spark, d):
    name = F.col("person_name")
    return table(spark, d, "voices").select("id", "person_name", person_key(name).alias("key"), slug(name).alias("slug"))

"""Queries on versions, caches, resumable work and seed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatrix.functions.urls import path_year
from verbatrix.operators import versions as V
from verbatrix.operators.relational import latest
from verbatrix.operators.sizing import spread
from verbatrix.plans.registry import query
from verbatrix.sources.tables import table


@query("SELECT id, sha256(lower(trim(regexp_replace(coalesce(query, ''), '\\s+', ' ', 'g'))) || '|10') AS key FROM publication_candidates")
def cache_keys(spark, d):
    return table(spark, d, "publication_candidates").select("id", V.cache_key(F.col("query"), F.lit(10)).alias("key"))


@query("SELECT source, CAST(count(*) FILTER (WHERE updated_at >= TIMESTAMP '2024-03-20' - INTERVAL 10 DAY) AS BIGINT) AS fresh, CAST(count(*) FILTER (WHERE NOT coalesce(updated_at >= TIMESTAMP '2024-03-20' - INTERVAL 10 DAY, false)) AS BIGINT) AS stale FROM publication_candidates GROUP BY 1")
def cache_freshness(spark, d):
    is_fresh = V.fresh(F.col("updated_at"), F.to_timestamp(F.lit("2024-03-20 00:00:00")), 10)
    return table(spark, d, "publication_candidates").groupBy("source").agg(F.count_if(is_fresh).alias("fresh"), F.count_if(~is_fresh).alias("stale"))


@query("SELECT page_id, requested_url FROM fetch_results WHERE page_id NOT IN (SELECT page_id FROM fetch_results WHERE access_class = 'ok')")
def resume_remaining(spark, d):
    rows = table(spark, d, "fetch_results")
    log = rows.select("page_id", F.when(F.col("access_class") == "ok", "done").otherwise("failed").alias("status"))
    return V.remaining(rows.select("page_id", "requested_url"), log, "page_id")


@query("SELECT page_id FROM (SELECT page_id, sum(elapsed_ms) OVER (ORDER BY fetched_at, page_id) AS spent FROM fetch_results) WHERE spent <= 500000")
def fetch_within_budget(spark, d):
    return V.within_budget(table(spark, d, "fetch_results").select("page_id", "elapsed_ms", "fetched_at"), "elapsed_ms", ["fetched_at", "page_id"], 500_000).select("page_id")


@query("""WITH l AS (SELECT page_id, unnest(string_split(coalesce(full_text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(full_text, ''), chr(10))))) AS pos FROM main_texts), s AS (SELECT page_id, line, pos, CASE WHEN regexp_matches(line, '(?i)court') THEN 5.0 ELSE 0 END + CASE WHEN regexp_matches(line, '(?i)policy|code') THEN 3.0 ELSE 0 END + CASE WHEN regexp_matches(line, '(?i)archive') THEN 2.0 ELSE 0 END AS score FROM l WHERE length(line) BETWEEN 60 AND 600)
SELECT page_id, line AS excerpt, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) = 1""")
def best_excerpts(spark, d):
    return V.best_excerpt(table(spark, d, "main_texts"), "page_id", "full_text", {"court": 5.0, "policy|code": 3.0, "archive": 2.0})


@query()
def version_observations(spark, d):
    rows = V.compare_versions(spread(table(spark, d, "main_texts").select("page_id", "full_text", "main_text")), "full_text", "main_text")
    return rows.select("page_id", "names_lost", "overlap", F.array_join("observations", ",").alias("observations"))


@query("SELECT page_id, status_code, redirects FROM (SELECT page_id, coalesce(status_code, 0) AS status_code, CAST(len(redirect_chain) AS BIGINT) AS redirects, row_number() OVER (PARTITION BY requested_url ORDER BY fetched_at DESC, page_id DESC) AS k FROM fetch_results) WHERE k = 1")
def latest_fetch_per_url(spark, d):
    rows = table(spark, d, "fetch_results").select("requested_url", "fetched_at", "page_id", F.coalesce("status_code", F.lit(0)).alias("status_code"), F.when(F.col("redirect_chain").isNotNull(), F.size("redirect_chain")).cast("bigint").alias("redirects"))
    return latest(rows, ["requested_url"], ["fetched_at", "page_id"]).select("page_id", "status_code", "redirects")


@query("SELECT id, entity_id, direction FROM voices WHERE entity_id NOT IN (SELECT entity_id FROM voices WHERE id % 5 = 0) UNION ALL SELECT id, entity_id, 'reviewed' FROM voices WHERE id % 5 = 0")
def replace_children(spark, d):
    rows = table(spark, d, "voices").select("id", "entity_id", "direction")
    return V.replace_children(rows, rows.filter("id % 5 = 0").withColumn("direction", F.lit("reviewed")), "entity_id")


@query("SELECT year, count(*) AS n FROM (SELECT CASE WHEN regexp_extract(coalesce(url, ''), '/((?:19|20)[0-9]{2})(?:/|-|$)', 1) <> '' THEN CAST(regexp_extract(url, '/((?:19|20)[0-9]{2})(?:/|-|$)', 1) AS INTEGER) ELSE 9999 END AS year FROM main_texts) GROUP BY 1")
def url_years(spark, d):
    return table(spark, d, "main_texts").groupBy(path_year(F.col("url")).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c.id AS id, coalesce(p.confidence, c.score) AS score, p.id IS NOT NULL AS promoted FROM publication_candidates c LEFT JOIN publications p ON p.domain = regexp_replace(lower(c.domain), '^www\\.', '')")
def conditional_update(spark, d):
    """Candidates take the confidence of the publication on their domain where there is one."""
    papers = table(spark, d, "publications").select("domain", "confidence").withColumn("promoted", F.lit(True))
    rows = table(spark, d, "publication_candidates").select("id", "score", F.regexp_replace(F.lower("domain"), r"^www\.", "").alias("domain"))
    return rows.join(papers, "domain", "left").select("id", F.coalesce("confidence", "score").alias("score"), F.coalesce("promoted", F.lit(False)).alias("promoted"))


@query("SELECT direction, count(*) AS n FROM evidence_items WHERE run_id NOT IN (SELECT run_id FROM evidence_items GROUP BY run_id HAVING avg(extraction_confidence) < 0.2) GROUP BY 1")
def without_excluded_runs(spark, d):
    rows = table(spark, d, "evidence_items")
    excluded = rows.groupBy("run_id").agg(F.avg("extraction_confidence").alias("c")).filter("c < 0.2").select("run_id")
    return rows.select("run_id", "direction").join(excluded, "run_id", "left_anti").groupBy("direction").agg(F.count(F.lit(1)).alias("n"))

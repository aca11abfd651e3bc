"""Named exports, blind audit sheets, logs of changed classes, backups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatrix.operators.redaction import make_public, redact_rows, withhold
from verbatrix.sources.sinks import export


def export_all(named: Mapping[str, DataFrame], folder: str, formats: tuple[str, ...] = ("csv", "json")) -> list[dict[str, object]]:
    """Every named frame exported under folder, with one manifest a frame; each is written by many tasks."""
    return [export(df, folder, name, formats) for name, df in sorted(named.items())]


def research_exports(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The seven research exports out of the tables publications, publication_candidates, main_texts, evidence_items, voices, statements, fetch_results."""
    papers = tables["publications"].select(F.col("id").alias("entity_id"), F.col("name").alias("entity"), "domain")
    pages = tables["main_texts"].select("page_id", "publication_id", "url", "title", "page_kind", "noindex", "published")
    return {
        "entities": tables["publications"],
        "queries": tables["publication_candidates"].filter("query IS NOT NULL").groupBy("query").agg(F.count(F.lit(1)).alias("results"), F.max("score").alias("best_score")),
        "targets": tables["publication_candidates"].select("id", "url", "domain", "score", "status"),
        "pages": pages.join(papers, F.col("publication_id") == F.col("entity_id"), "left").drop("publication_id"),
        "evidence": tables["evidence_items"].join(papers, "entity_id", "left"),
        "voices": tables["voices"].join(papers, "entity_id", "left"),
        "fetches": tables["fetch_results"].select("page_id", "requested_url", "final_url", "status_code", "access_class", "fetched_at"),
    }


def record_exports(tables: Mapping[str, DataFrame], unsure: float = 0.6) -> dict[str, DataFrame]:
    """The six exports of a crawl's records: schools, papers, how the evidence of each paper leans, the evidence, pages that ask not to be indexed, and papers and candidates below a confidence that want review."""
    evidence, pages = tables["evidence_items"], tables["main_texts"]
    leaning = evidence.groupBy("entity_id").agg(*(F.count_if(F.col("direction") == side).alias(side) for side in ("supportive", "adverse", "neutral")), F.round(F.avg("extraction_confidence"), 4).alias("confidence"))
    papers = tables["publications"].filter(F.coalesce("confidence", F.lit(0.0)) < unsure).select(F.lit("publication").alias("kind"), "id", F.col("name").alias("what"), F.col("confidence").alias("score"))
    found = tables["publication_candidates"].filter((F.col("status") == "candidate") & (F.coalesce("score", F.lit(0.0)) < unsure)).select(F.lit("candidate").alias("kind"), "id", F.col("url").alias("what"), "score")
    return {
        "institutions": tables["institutions"].drop("raw_json"),
        "publications": tables["publications"],
        "classifications": leaning,
        "evidence": evidence.select("id", "entity_id", "page_id", "excerpt", "statement_type", "direction", "authority_score"),
        "noindex": pages.filter(F.coalesce("noindex", F.lit(False)) | F.coalesce("nofollow", F.lit(False))).select("page_id", "url", "meta_robots", "x_robots_tag", "noindex", "nofollow"),
        "review": papers.unionByName(found),
    }


def public_packet(rows: DataFrame, folder: str, name: str, url: str, withheld: str, party: str, texts: Sequence[str], keep: Column, story: Column, order: Sequence[Column], private: Sequence[str] = (), limit: int | None = None) -> dict[str, object]:
    """Rows made fit for the public and exported: parties that only stand on withheld addresses go with them, names go out of
    texts and addresses, private columns are dropped, stories masked, and what is left is ranked and written with a manifest."""
    seen = redact_rows(withhold(rows, url, withheld, party), list(texts), [url], keep)
    return export(make_public(seen, list(private), [url], [], story, list(order), limit=limit), folder, name, ("csv", "json"))


def audit_sheet(items: DataFrame, shown: Sequence[str], machine: Sequence[str], blind: bool = True) -> DataFrame:
    """A sheet for labelling: the shown columns and three empty ones; the machine's answer only if it isn't blind."""
    empty = {c: F.lit("") for c in ("relevant (y/n)", "direction (supportive/adverse/neutral)", "note")}
    return items.select(*shown, *([] if blind else machine)).withColumns(empty)


def class_changes(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, old, new) of every field of a row that changed; nulls compare as values, rows on one side only don't count."""
    a, b = before.select(key, *(F.col(c).alias(f"__a_{c}") for c in fields)), after.select(key, *(F.col(c).alias(f"__b_{c}") for c in fields))
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"__a_{c}").cast("string").alias("old"), F.col(f"__b_{c}").cast("string").alias("new")) for c in fields))
    changed: Column = F.filter(pairs, lambda x: ~x["old"].eqNullSafe(x["new"]))
    return a.join(b, key).select(key, F.explode(changed).alias("c")).select(key, "c.*")


def filled_in(template: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """template with its empty cells filled from values by key; filled cells, rows and the order of columns stay."""
    there = [c for c in values.columns if c != key and c in template.columns]
    held = values.select(key, *(F.col(c).alias(f"__v_{c}") for c in there)).dropDuplicates([key])
    joined = template.join(held, key, "left")
    return joined.select(*(F.coalesce(F.when(F.length(F.trim(F.col(c).cast("string"))) > 0, F.col(c)), F.col(f"__v_{c}")).alias(c) if c in there else F.col(c) for c in template.columns))


def backup(tables: Mapping[str, DataFrame], folder: str, stamp: str) -> dict[str, int]:
    """Every table written to folder/stamp, which must not exist yet, and its rows as read back."""
    out = {}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{stamp}/{name}")
        out[name] = df.sparkSession.read.parquet(f"{folder}/{stamp}/{name}").count()
    return out

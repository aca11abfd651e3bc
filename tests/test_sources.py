import zipfile

import pytest
from pyspark.sql import functions as F

from verbatrix.operators import versions as V
from verbatrix.sources import readers, sinks


def test_csv_headers_and_guard(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("﻿Name,Site URL,State\nOrm,https://orm.example,OH\n,https://vale.example,KY\nTor,,\n", encoding="utf-8")
    df = readers.read_csv(spark, str(path), ["Name", "url"], {"url": ["Website", "Site URL"]})
    good, bad = readers.guarded(df, ["Name", "url"])
    assert [r["Name"] for r in good.collect()] == ["Orm"] and bad.count() == 2
    with pytest.raises(ValueError, match="lacks"):
        readers.read_csv(spark, str(path), ["Missing"])


def test_zipped_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "hd.zip", "w") as z:
        z.writestr("hd2023.csv", "﻿unitid,name\n1,Orm\n2,Vale\n")
        z.writestr("readme.txt", "x")
    got = readers.read_zipped_csv(spark, str(tmp_path / "hd.zip"), r"hd\d{4}\.csv$", "unitid string, name string").collect()
    assert sorted(map(tuple, got)) == [("1", "Orm"), ("2", "Vale")]


def test_sitemaps_and_robots(spark):
    df = spark.createDataFrame([("<urlset><url><loc> https://orm.example/a?x=1&amp;y=2 </loc></url><url><loc>https://orm.example/b</loc>",), ("<sitemapindex><sitemap><loc><![CDATA[https://orm.example/s.xml]]></loc></sitemap></sitemapindex>",), (None,)], "x string")
    assert sorted(map(tuple, readers.sitemap_urls(df, "x").collect())) == [("page", "https://orm.example/a?x=1&y=2"), ("page", "https://orm.example/b"), ("sitemap", "https://orm.example/s.xml")]
    robots = spark.createDataFrame([("User-agent: *\nCrawl-delay: 2\n\nUser-agent: vbot\nUser-agent: other\nDisallow: /\nCrawl-delay: 0.5",), ("User-agent: x\nCrawl-delay: 9",), (None,)], "r string")
    assert [r[0] for r in robots.select(readers.crawl_delay(F.col("r"), "VBot/1.0")).collect()] == [0.5, None, None]


def test_export_and_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\x01b\nc", ["x"])], "id long, t string, l array<string>")
    manifest = sinks.export(df, str(tmp_path), "out")
    assert manifest["rows"] == 1 and spark.read.parquet(f"{tmp_path}/out.parquet").first()["t"] == "ab\nc"
    store = str(tmp_path / "store")
    texts = spark.createDataFrame([("one",), ("two",), ("one",), (None,)], "t string")
    assert sinks.store_content(texts, "t", store).filter("sha256 IS NULL").count() == 1
    sinks.store_content(texts, "t", store)
    assert spark.read.parquet(store).count() == 2
    assert readers.snapshots(spark, str(tmp_path / "store" / "*.parquet")).count() >= 1


def test_versions_and_caches(spark):
    long = "The council of the town met Ada Vale on Monday and kept the archive as it was."
    df = spark.createDataFrame([(1, long, long.replace("Ada Vale", "a woman"), 200), (2, long, None, 200), (3, long, long, 410), (4, long, "Other words entirely here.", 200), (5, None, None, 200)], "id int, a string, b string, s int")
    got = {r["id"]: r["observations"] for r in V.compare_versions(df, "a", "b", "s").collect()}
    assert got == {1: ["names_removed"], 2: ["unpublished"], 3: ["unpublished"], 4: ["content_altered"], 5: []}
    requests = spark.createDataFrame([("k1",), ("k2",), ("k2",)], "k string")
    hit, miss = V.cached(requests, spark.createDataFrame([("k1", 5)], "k string, v int"), "k")
    assert hit.count() == 1 and [r["k"] for r in miss.collect()] == ["k2"]
    log = spark.createDataFrame([(1, "done"), (2, "running"), (3, "failed")], "i int, status string")
    assert sorted(r["i"] for r in V.remaining(spark.createDataFrame([(1,), (2,), (3,), (4,)], "i int"), log, "i").collect()) == [2, 3, 4]
    assert [r["i"] for r in V.within_budget(spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "i int, c int"), "c", ["i"], 10).orderBy("i").collect()] == [1, 2]
    stale = spark.createDataFrame([("2024-01-01 00:00:00",), ("nonsense",), (None,)], "t string")
    assert [r[0] for r in stale.select(V.fresh(F.col("t"), F.to_timestamp(F.lit("2024-01-05 00:00:00")), 10)).collect()] == [True, False, False]

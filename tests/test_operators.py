import math

import pytest
from pyspark.sql import functions as F

from verbatrix.functions import text as X
from verbatrix.functions import urls as U
from verbatrix.functions.stats import cohens_kappa, wilson
from verbatrix.operators import audit, html, redaction, similarity
from verbatrix.operators import relational as R
from verbatrix.operators import statements as S
from verbatrix.operators.sizing import join_measured


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, expression, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return df.select(expression.alias("v")).first()[0]


def test_latest_breaks_ties_and_keeps_columns(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "c"), (2, None, None)], "k int, t int, v string")
    assert rows(R.latest(df, ["k"], ["t", "v"])) == [(1, 5, "b"), (2, None, None)]
    assert R.latest(df.limit(0), ["k"], ["t"]).count() == 0


def test_best_with_margin(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.85), ("b", 1, 0.5), ("c", 1, 0.9), ("c", 2, 0.1)], "k string, i int, s double")
    assert {r["k"]: (r["i"], r["ambiguous"]) for r in R.best_with_margin(df, "k", "i", "s", 0.1).collect()} == {"a": (1, True), "b": (1, False), "c": (1, False)}


def test_running_sum_over_partitions(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("v"))
    expected, total = {}, 0
    for i in range(1000):
        total += 0 if i % 7 == 0 else i
        expected[i] = total
    assert {r["id"]: r["running"] for r in R.running_sum(df, "v", ["id"], partitions=5).collect()} == expected


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, 10, "x", 1), (2, 20, "y", 2)], "k int, m int, d string, c int")
    new = spark.createDataFrame([(2, 5, "z", None), (2, 4, "w", None), (3, 7, "n", 3)], "k int, m int, d string, c int")
    got = rows(R.upsert(old, new, ["k"], {"m": "max", "d": "keep", "c": "coalesce"}, ["m"]))
    assert got == [(1, 10, "x", 1), (2, 20, "y", 2), (3, 7, "n", 3)]
    assert rows(R.upsert(old, new, ["k"], {}, ["m"]))[1] == (2, 5, "z", None)


def test_insert_ignore_and_changes(spark):
    old, new = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k int, v string")
    assert rows(R.insert_ignore(old, new, ["k"])) == [(1, "a"), (2, "c")]
    assert rows(R.set_changes(old, new, ["k"])) == [(2, "added")]


def test_survivors_keep_rows_without_group(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id int, g string")
    assert {r["id"]: (r["active"], r["merged_into"]) for r in R.merge_survivors(df, "g", "id").collect()} == {1: (True, None), 2: (False, 1), 3: (True, None), 4: (True, None)}


def test_longest_suffix_join(spark):
    left = spark.createDataFrame([(1, "a.b.c.example"), (2, "c.example"), (3, "other.example"), (4, "")], "id int, host string")
    right = spark.createDataFrame([("c.example", 1), ("b.c.example", 2)], "site string, n int")
    assert rows(R.longest_suffix_join(left, "host", right, "site").select("id", "n")) == [(1, 2), (2, 1)]


def test_join_measured_is_the_same_either_way(spark):
    a, b = spark.range(100), spark.range(50).withColumnRenamed("id", "id")
    assert join_measured(a, b, ["id"], "left_semi").count() == join_measured(a, b, ["id"], "left_semi", limit=0).count() == 50


def test_groups_gates_and_samples(spark):
    df = spark.createDataFrame([(1, 5), (2, 50)], "id int, v int")
    got = R.overlapping_groups(df, {"low": F.col("v") < 10, "all": F.lit(True)})
    assert rows(got.select("id", "peer_group")) == [(1, "all"), (1, "low"), (2, "all")]
    gates = R.unpivot_gates(spark.createDataFrame([("a", 0.9, None)], "k string, x double, y double"), "k", {"x": (">=", 0.8), "y": ("<=", 0.5)})
    assert rows(gates.select("gate", "passed")) == [("x", True), ("y", False)]
    many = spark.range(11).select(F.lit("s").alias("k"), "id")
    assert [r["id"] for r in R.evenly(many, ["k"], [F.asc("id")], 3).orderBy("id").collect()] == [0, 5, 10]
    strata = spark.createDataFrame([(i, "ab"[i > 0]) for i in range(9)], "id int, s string")
    assert [r["s"] for r in audit.stratified_sample(strata, "id", "s", 4).collect()].count("a") == 1


def test_wilson_and_kappa(spark):
    p, low, high = spark.range(1).select(*wilson(F.lit(45), F.lit(50))).first()
    assert p == 0.9 and 0.75 < low < 0.9 < high < 1
    assert spark.range(1).select(*wilson(F.lit(0), F.lit(0))).first()[0] is None
    pairs = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "b"), ("b", "a")], "x string, y string")
    assert math.isclose(cohens_kappa(pairs, "x", "y").first()["kappa"], 0.5)
    same = spark.createDataFrame([("a", "a"), ("a", "a")], "x string, y string")
    assert cohens_kappa(same, "x", "y").first()["kappa"] == 1.0
    assert cohens_kappa(pairs.limit(0), "x", "y").first()["n"] == 0


@pytest.mark.parametrize("value,expected", [("  a  　b\n", "a b"), (None, ""), ("", "")])
def test_compact_ws(spark, value, expected):
    assert one(spark, X.compact_ws(F.col("t")), t=value) == expected


def test_hash_form_and_near_key(spark):
    assert one(spark, X.hash_form(F.col("t")), t="Ｗｉｄｅ “quoted” — it’s É") == "wide quoted it's"
    long = " ".join(f"w{i}" for i in range(40))
    assert one(spark, X.near_duplicate_key(F.col("t")), t=long) == one(spark, X.near_duplicate_key(F.col("t")), t=long.upper() + "!")
    assert one(spark, X.near_duplicate_key(F.col("t")), t="a b") != one(spark, X.near_duplicate_key(F.col("t")), t="a c")
    assert len(one(spark, X.near_duplicate_key(F.col("t")), t="")) == 24


def test_names(spark):
    assert one(spark, X.organisation_name(F.col("t")), t="The Saint Orm & Vale College") == "st orm and vale college"
    assert one(spark, X.acronym(F.col("t")), t="University of North Orm") == "uno"
    assert one(spark, X.leading_int(F.col("t")), t="12 - high") == 12 and one(spark, X.leading_int(F.col("t")), t="high") is None
    assert one(spark, X.person_key(F.col("t")), t="J. R. Ormsby-Vale") == "j-r-ormsby-vale"
    assert one(spark, X.headline(F.col("t")), t="Big news - small town | The Orm") == "Big news - small town"


def test_urls(spark):
    key = lambda u: one(spark, U.url_identity(F.col("u")), u=u)
    assert key("HTTPS://User:p@WWW.Orm.example:443//a//b/?utm_source=x&id=3#frag") == "https://www.orm.example/a/b?id=3"
    assert key("http://orm.example:80/") == "http://orm.example" and key("ftp://orm.example/") is None and key(None) is None
    assert one(spark, U.host(F.col("u")), u="https://www.Orm.example:8080/x") == "orm.example"
    assert one(spark, U.same_site(F.lit("a.orm.example"), F.lit("orm.example"))) and not one(spark, U.same_site(F.lit(""), F.lit("")))
    assert not one(spark, U.same_site(F.lit("form.example"), F.lit("orm.example")))
    assert one(spark, U.path_year(F.col("u")), u="/2019/05/x") == 2019 and one(spark, U.path_year(F.col("u")), u="/x") == 9999
    assert [one(spark, U.status_class(F.col("c")), c=c) for c in (200, 404, 451, 503, 418, 302)] == ["ok", "not_found", "blocked", "server_error", "client_error", "unexpected_status"]


def test_html_never_raises(spark):
    page = html.read_markup("<html><head><title> A  b </title><meta name='Robots' content='noindex'></head><body><nav>menu</nav><p>One &amp; two</p><p>cut <a href='/x'>li")
    assert page["title"] == "A b" and page["robots"] == "noindex" and page["links"] == ["/x"] and page["text"] == "One & two\ncut li"
    assert html.read_markup(None) is None and html.read_markup("")["text"] == "" and html.read_markup("<<<>>&#xffffff;")
    df = spark.createDataFrame([("<p>x</p>",), (None,)], "m string")
    assert [r[0] for r in html.with_page_parts(df, "m").select("page.text").collect()] == ["x", None]


def test_similarity_redaction_statements(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("abcd", "bcde"), (None, "x"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(similarity.matching_ratio()(F.col("a"), F.col("b"))).collect()] == [1.0, 0.75, None, 1.0]
    text = "Orla Vance said Dr. Quill met Tam R. Doe. Later Vance left."
    keep = spark.createDataFrame([(text, ["Tam R. Doe"]), (None, None)], "t string, keep array<string>")
    assert [r[0] for r in keep.select(redaction.redact(F.col("t"), F.col("keep"), common={"later"})).collect()] == ["[name] said Dr. [name] met Tam R. Doe. Later [name] left.", None]
    pages = spark.createDataFrame([(1, "/opinion/a", "p"), (2, "/news/b", "p"), (3, "/opinion/c", "q"), (4, None, "r")], "id int, url string, party string")
    assert rows(redaction.withhold(pages, "url", "/opinion/", "party").select("id")) == [(2,), (4,)]
    docs = spark.createDataFrame([(1, "One thing. Another thing! And 3 more?"), (2, None), (3, " ")], "id int, text string")
    assert [r["sentence"] for r in S.light_sentences(docs, "id", "text").orderBy("pos").collect()] == ["One thing.", "Another thing!", "And 3 more?"]
    near = spark.createDataFrame([(1, "a b c d e f g"), (2, "A b c d e f g."), (3, "other words here"), (4, None)], "id int, text string")
    assert rows(S.near_dup_groups(near, "id", "text").select("id", "canonical", "copies")) == [(1, 2, 2), (2, 2, 2)]

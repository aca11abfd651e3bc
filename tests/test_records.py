"""Page functions, predicates, graphs, names, imports and exports on small fixtures."""

import difflib
import gzip
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbatrix.functions import pages as P
from verbatrix.functions.text import hash_form
from verbatrix.operators import html, redaction
from verbatrix.operators import predicates as Q
from verbatrix.operators.frontier import bounded_bfs, frontier
from verbatrix.operators.names import fuzzy_names
from verbatrix.operators.statements import bounded_sentences
from verbatrix.sources import exports, imports


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("text,form", [("ﬁrst x² ｶﾞ", "first x2"), ("Ⅷ ½ ㎏ 𝐀", "viii 1 2 kg a"), ("café it’s", "caf it's"), ("ÉTÉ №5", "t no5")])
def test_hash_form_is_nfkc(spark, text, form):
    assert one(spark, hash_form(F.col("t")), t=text) == form


def test_titles_and_kinds(spark):
    key = lambda t: one(spark, P.title_key(F.col("t")), t=t)
    assert key("Headline – The Spectator") == key("Headline | Site") == key("Headline - Site") == "headline"
    assert key("A well-known case - part 2 - Site") == "a well known case part 2"
    kind = lambda u, t="", pdf=False, listing=False: one(spark, P.kind_of_page(F.col("u"), F.col("t"), F.col("p"), F.col("l")), u=u, t=t, p=pdf, l=listing)
    assert [kind("https://o.example/"), kind("https://o.example/privacy"), kind("https://o.example/news/", listing=True), kind("https://o.example/2024/05/ethics")] == ["homepage", "legal_boilerplate", "listing", "article"]
    assert [kind("https://o.example/code-of-ethics"), kind("https://o.example/staff/"), kind("https://o.example/a.pdf", pdf=True), kind("https://o.example/x", "y")] == ["policy", "about", "pdf", "other"]


def test_versions(spark):
    old = "The council of Orm met on Monday and kept the archive. Nora Vance said that nothing of it will ever be removed! Short one."
    assert one(spark, P.kept_sentences(F.col("a"), F.col("b")), a=old, b=old.split("!")[0].split(". ")[0]) == 0.5
    assert one(spark, P.kept_sentences(F.col("a"), F.col("b")), a="", b="x") == 1.0
    assert one(spark, P.people(F.col("a")), a="Nora Vance and J. Doe on Monday Night; Tam R. O'Dell spoke") == ["Nora Vance", "Tam R. O'Dell"]
    assert one(spark, P.names_gone(F.col("a"), F.col("b")), a=old, b="A Vance is here") == [] and one(spark, P.names_gone(F.col("a"), F.col("b")), a=old, b="x") == ["Nora Vance"]


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTPS://Orm.Example:443/a b/?q=1 2#x", "https://orm.example/a%20b/?q=1%202"), ("http://orm.example:8080", "http://orm.example:8080/"), ("ftp://orm.example/", None),
        ("https://u:p@orm.example/", None), ("https://orm.example:22/", None), ("https://-bad.example/", None), ("https://[::1]/x", "https://[::1]/x"), ("", None), ("https://orm.example:x/", None), (None, None),
    ],
)
def test_request_addresses(url, want):
    assert P.request_address(url) == want


def test_public_hosts(spark):
    hosts = ["orm.example", "localhost", "a.internal", "127.0.0.1", "10.0.0.1", "8.8.8.8", "2130706433", "0x7f000001", "::ffff:127.0.0.1", "[2001:4860:4860::8888]", "-x.example", "", None]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert [r[0] for r in df.select(P.is_public(F.col("h"))).collect()] == [True, False, False, False, False, True, False, False, False, True, False, False, False]


def test_small_scalars(spark):
    assert [one(spark, P.percent(F.col("n"), F.col("d")), n=n, d=d) for n, d in ((1, 8), (0, 0))] == ["12.5%", "n/a"]
    assert [one(spark, P.number_text(F.col("v")), v=v) for v in (0.5, 1234.5)] == ["0.500", "1,234.50"]
    values = [2.675, 0.03125, 1.005, -0.5, 0.125]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    for digits in (0, 2, 4):
        assert [r[0] for r in df.select(P.rounded(F.col("v"), digits)).collect()] == [*(round(v, digits) for v in values), None]
    role, rank = P.role_of(F.col("l"))
    assert [(one(spark, role, l=x), one(spark, rank, l=x)) for x in ("Standards-Editor", "newstips", "zed")] == [("standards editor", 0), ("newsroom", 8), ("contact", 13)]
    relation = lambda a, b: one(spark, P.relationship(F.col("a"), F.col("b")), a=a, b=b)
    assert [relation("https://orm.example", u) for u in ("https://paper.example", "https://news.orm.example", "https://orm.example/news")] == ["independent_domain", "institution_subdomain", "institution_path"]
    assert [one(spark, P.is_chrome(F.col("s")), s=s) for s in ("Menu", "The council said that it would keep the archive of the town as it is.", "Sign up for the newsletter that we send to all of the readers of the town.")] == [True, False, True]


def test_predicates(spark):
    df = spark.createDataFrame([(1, '{"x": 0}'), (2, '{"x": "false"}'), (3, '{"x": 1}'), (4, "broken"), (5, None)], "id int, j string")
    assert rows(df.filter(Q.unflagged(F.col("j"), "$.x")).select("id")) == [(1,), (2,), (4,), (5,)]
    assert rows(df.filter(Q.optional_filters({"a": None, "b": ""}, {})).select("id")) == [(i,) for i in range(1, 6)]
    assert rows(df.filter(Q.peer_group([F.col("id") > 4], F.col("id"), [1])).select("id")) == [(1,), (5,)] and df.filter(Q.peer_group([], F.col("id"))).count() == 0
    with pytest.raises(KeyError):
        Q.Predicates(a=F.lit(True)).all_of("b")
    assert rows(Q.ordered(df, [F.col("id") != 3, F.desc("id").asc() if False else -F.col("id")], 2).select("place", "id")) == [(1, 3), (2, 5)]
    assert Q.ordered(df.limit(0), [F.col("id")], 2).count() == 0
    assert Q.scalar(df.filter("id > 9"), "id", 7) == 7 and Q.scalar(df.orderBy("id"), "id") == 1
    assert [one(spark, Q.with_json_value(F.col("j"), "k", F.lit(1)), j=j) for j in ('{"a":"b","k":"z"}', "broken")] == ['{"a":"b","k":"1"}', '{"k":"1"}']
    assert [one(spark, Q.rank_in(F.col("v"), ["a", "b"]), v=v) for v in ("b", "z")] == [1, 2]


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 1), (9, 9), (None, 1), (1, None)], "src int, dst int")
    seeds = spark.createDataFrame([(1,), (1,), (None,)], "node int")
    assert rows(bounded_bfs(edges, seeds, 2)) == [(1, 0), (2, 1), (3, 2)] and rows(bounded_bfs(edges, seeds, 9)) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert rows(bounded_bfs(edges.limit(0), seeds, 3)) == [(1, 0)] and bounded_bfs(edges, seeds.limit(0), 3).count() == 0
    links = spark.createDataFrame([("s", "a", 1.0, 1), ("s", "a", 5.0, 2), ("s", "b", 5.0, 1), ("s", "c", 9.0, 1), ("s", "d", 9.0, 7), ("t", "a", 0.0, 0), ("t", None, 9.0, 0)], "site string, url string, score double, depth int")
    got = frontier(links, spark.createDataFrame([("c",)], "url string"), "site", "url", "score", "depth", 2, 3)
    assert rows(got.select("site", "url", "place")) == [("s", "a", 1), ("s", "b", 2), ("t", "a", 1)]


def test_fuzzy_names_against_brute_force(spark):
    rng = random.Random(4)
    words = "university college state north orm vale quist tarn institute technology saint harbor lake".split()
    known = [(i, " ".join(rng.choices(words, k=rng.randint(1, 5))), rng.choice("ab")) for i in range(60)]
    targets = []
    for i in range(120):
        _, name, block = rng.choice(known)
        letters = list(name)
        for _ in range(rng.randint(0, 4)):
            letters[rng.randrange(len(letters))] = rng.choice("abcdefgh ")
        targets.append((i, "".join(letters), block))
    targets += [(500, None, "a"), (501, "", "a"), (502, "orm", None)]
    a, b = spark.createDataFrame(targets, "target int, name string, block string"), spark.createDataFrame(known, "id int, name string, block string")
    from verbatrix.functions.text import organisation_name

    plain = lambda df, key: {r[0]: (r[1], r[2]) for r in df.select(key, organisation_name(F.col("name")), "block").collect()}
    left, right, want = plain(a, "target"), plain(b, "id"), {}
    for t, (name, block) in left.items():
        scores = sorted(((difflib.SequenceMatcher(None, name, n).ratio(), i) for i, (n, k) in right.items() if k == block and n), reverse=True) if name and block else []
        if scores and scores[0][0] >= 0.88 and (len(scores) < 2 or scores[0][0] - scores[1][0] >= 0.03):
            want[t] = scores[0][1]
    got = {r["target"]: r["id"] for r in fuzzy_names(a, b, "block").collect()}
    assert len(want) > 30 and got == want
    assert fuzzy_names(a.limit(0), b, "block").count() == fuzzy_names(a, b.limit(0), "block").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab<>/pdiv\"'=& \n{}[]:."), max_size=200))
def test_main_text_never_raises(markup):
    assert isinstance(html.main_text(markup), str) and isinstance(html.decoded(markup.encode()), str)


def test_main_text():
    story = "The council of the town met on Monday and said that the archive would stay. " * 4
    page = f"<html><body><nav>Menu Home</nav><div class='sidebar'>Ads here</div><main><p>{story}</p><aside>Related</aside></main><footer>All rights</footer></body></html>"
    assert html.main_text(page) == story.strip()
    assert html.main_text(f"<body><div id='menu'>x</div><div><p>{story}</p></div></body>") == story.strip()
    assert html.main_text(f"<body class='x'><div class='widget'><p>{story}</p></div></body>") == story.strip()  # the densest block of a page that is all furniture
    data = '{"content": "' + "<p>" + story + "</p>" + '", "key": "' + "A" * 300 + '"}'
    assert html.main_text(f"<body><script>{data}</script><p>Short.</p></body>") == f"Short. {story.strip()}"
    assert html.main_text(None) is None and html.main_text("") == ""
    assert html.decoded("é".encode("latin-1"), "text/html; charset=latin-1") == html.decoded("é".encode()) == html.decoded("é".encode("utf-16")) == html.decoded(b"\xe9", "charset=nonsense") == "é"
    assert html.decoded(b"<meta charset='iso-8859-2'>\xb1") == "<meta charset='iso-8859-2'>ą" and html.decoded(None) is None


def test_bounded_sentences(spark):
    text = "Dr. Orm spoke at 5 p.m. on Monday. He left!  \"Why?\" she asked. " + "word " * 300 + "; " + "x" * 1500
    got = [r["sentence"] for r in bounded_sentences(spark.createDataFrame([(1, text), (2, None), (3, " ")], "id int, t string"), "id", "t").orderBy("id", "pos").collect()]
    assert got[:2] == ["Dr. Orm spoke at 5 p.m. on Monday.", "He left!"] and max(map(len, got)) <= 700
    assert "".join("".join(got).split()) == "".join(text.replace(";", "").split())


def test_redacted_rows(spark):
    df = spark.createDataFrame([("Nora Vance said so.", "https://o.example/2024/nora-vance-case", "x"), ("Nobody here.", "https://o.example/vance", ""), (None, None, None)], "t string, u string, p string")
    got = redaction.redact_rows(df.withColumn("keep", F.array().cast("array<string>")), ["t"], ["u"], F.col("keep"), ["p"])
    assert [tuple(r)[:3] for r in got.collect()] == [("[name] said so.", "[withheld: address carries a name]", "[withheld in shared copy]"), ("Nobody here.", "https://o.example/vance", ""), (None, None, None)]


def test_imports(spark, tmp_path):
    path = tmp_path / "HD2023.csv"
    path.write_text("﻿UNITID,INSTNM,CITY,STABBR,CONTROL,ICLEVEL,WEBADDR\n1,Orm College,Orm,OH,1,1,orm.example\n2,Vale,,KY,x,1,https://v.example\n,No id,,,1,1,\n", encoding="utf-8")
    got = {r["unitid"]: r for r in imports.universe(spark, str(path)).collect()}
    assert set(got) == {"1", "2"} and got["1"]["included"] == 1 and got["1"]["website"] == "https://orm.example" and got["1"]["source_year"] == 2023
    assert got["2"]["included"] == 0 and got["2"]["control"] is None and got["2"]["city"] is None
    with pytest.raises(ValueError):
        (tmp_path / "bad.csv").write_text("A,B\n1,2\n")
        imports.universe(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "attr.csv").write_text("unitid,key,value\n1,journalism,\n1,journalism,\n9,x,1\n2,,1\n")
    good, other = imports.attributes(spark, str(tmp_path / "attr.csv"), spark.createDataFrame([("1",), ("2",)], "unitid string"), "list")
    assert rows(good) == [("1", "journalism", "1", "list")] and other.count() == 2
    (tmp_path / "labels.csv").write_text("audit_item_id,relevant (y/n),direction (supportive/adverse/neutral),note\n1,Yes,sup,ok\n2,,,\n3,n,ADVERSE,\n")
    assert rows(imports.labels(spark, str(tmp_path / "labels.csv"), "ada").drop("note")) == [(1, "ada", True, "supportive"), (3, "ada", False, "adverse")]
    index = '[["timestamp","statuscode"],["20200101","200"],["20210101","404"]]'
    assert [r["capture"]["timestamp"] for r in imports.captures(spark.createDataFrame([(index,), ("broken",), (None,)], "i string"), "i").collect()] == ["20200101"]
    xml = b"<urlset><url><loc>https://o.example/a</loc></url></urlset>"
    packed = spark.createDataFrame([(gzip.compress(xml),), (xml,), (gzip.compress(xml)[:20],), (None,)], "c binary")
    assert rows(imports.packed_sitemap_urls(packed, "c")) == [("page", "https://o.example/a")] * 2
    (tmp_path / "m.eml").write_bytes(b"From: ada@o.example\nSubject: Hi\n\nMy answer.\n\nOn Monday, Bo wrote:\n> old\n")
    assert [tuple(r)[1:] for r in imports.mails(spark, str(tmp_path / "m.eml")).collect()] == [("ada@o.example", "Hi", "My answer.")]
    assert imports.settings("# x\nLIMIT=5\nFAST = yes\n", {"LIMIT": 1, "FAST": False, "NAME": "a"}) == {"LIMIT": 5, "FAST": True, "NAME": "a"}
    with pytest.raises(KeyError):
        imports.settings("NO=1", {})


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, kind string, side string")
    assert rows(exports.class_changes(df, df.withColumn("kind", F.lit("b")).withColumn("side", F.lit(None).cast("string")), "id", ["kind", "side"])) == [(1, "kind", "a", "b"), (2, "side", "x", None)]
    assert exports.audit_sheet(df, ["id"], ["kind"]).columns == ["id", "relevant (y/n)", "direction (supportive/adverse/neutral)", "note"] and "kind" in exports.audit_sheet(df, ["id"], ["kind"], blind=False).columns
    filled = exports.filled_in(spark.createDataFrame([(1, "", "k"), (3, None, None)], "id int, kind string, side string"), df, "id")
    assert rows(filled) == [(1, "a", "k"), (3, None, None)]
    assert exports.backup({"t": df}, str(tmp_path), "s") == {"t": 2}
    with pytest.raises(Exception):
        exports.backup({"t": df}, str(tmp_path), "s")
    assert [m["rows"] for m in exports.export_all({"b": df, "a": df.limit(1)}, str(tmp_path / "out"))] == [1, 2]


def test_research_exports(spark, duck, tmp_path):
    from tests.conftest import DATA
    from verbatrix.sources.tables import table

    names = "publications publication_candidates main_texts evidence_items voices statements fetch_results".split()
    found = exports.research_exports({n: table(spark, f"{DATA}/sf0.001", n) for n in names})
    assert len(found) == 7 and found["evidence"].count() == table(spark, f"{DATA}/sf0.001", "evidence_items").count()


def test_matches_and_reviews(spark):
    from verbatrix.operators import matching

    targets = spark.createDataFrame([(1,), (2,), (3,), (3,), (4,)], "target int")
    pairs = lambda *x: spark.createDataFrame(list(x), "target int, id string")
    got = matching.by_priority(targets, [("name", 0.85, pairs((1, "a"), (1, "a"), (2, "a"), (2, "b"))), ("domain", 0.8, pairs((1, "z"), (2, "a"), (3, "c"), (4, None)))])
    assert rows(got) == [(1, "a", "name", 0.85), (2, None, "ambiguous", 0.0), (3, "c", "domain", 0.8), (4, None, "unmatched", 0.0)]
    review = spark.createDataFrame([(1, "Yes", ""), (2, "", "b"), (3, "no", None), (9, "y", "b"), (1, "y", "zz"), (4, None, None)], "target int, confirm string, correct string")
    applied, rejected, invalid = matching.reviewed(got, review, spark.createDataFrame([("a",), ("b",)], "id string"))
    assert rows(applied) == [(1, "a"), (2, "b")] and rows(rejected) == [(3,)] and rows(invalid) == [(1, "zz"), (9, "b")]
    log = spark.createDataFrame([("r", "exclude", 1), ("r", "undo", 2), ("s", "undo", 1), ("s", "exclude", 3), (None, "exclude", 1)], "run string, action string, n int")
    assert rows(matching.excluded_runs(log, "run", "action", ["n"])) == [("s",)]


def test_names_and_context(spark):
    base = lambda n: one(spark, P.base_name(F.col("n")), n=n)
    assert [base(x) for x in ("University of Orm-Tarn Campus", "Orm College, Main Campus", "Orm-Vale College")] == ["University of Orm", "Orm College", "Orm-Vale College"]
    part = lambda t: one(spark, P.title_part(F.col("t"), "home|news", "gazette", F.lit("Orm College")), t=t)
    assert [part(t) for t in ("Home | The Torch - Orm", "News - Orm College | Campus Paper", "Home", "Orm Gazette")] == ["The Torch", "Campus Paper", None, "Orm Gazette"]
    from verbatrix.operators.statements import neighbours

    df = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, []), (3, None)], "id int, t array<string>")
    assert rows(neighbours(df, "id", F.col("t")).select("pos", "context")) == [(0, "a b"), (1, "a b c"), (2, "a b c d"), (3, "b c d")]


def test_robots():
    from verbatrix.sources.readers import robots_allow

    text = "User-agent: a\nUser-agent: orm\nDisallow: /x\nAllow: /x/y\nDisallow: /*.pdf$\n\nUser-agent: *\nDisallow: /\n"
    got = [robots_allow(text, 200, agent, path) for agent, path in (("OrmBot", "/x/1"), ("OrmBot", "/x/y/1"), ("OrmBot", "/z.pdf"), ("OrmBot", "/z.pdf?1"), ("other", "/"))]
    assert got == [False, True, False, True, False]
    assert not robots_allow(None, 503, "x", "/") and robots_allow(None, 404, "x", "/") and robots_allow("Disallow: /", 200, "x", "/") and robots_allow("User-agent: *\nDisallow:", None, "x", "/a")


def test_attributed_voices(spark):
    from verbatrix.operators.statements import attributed_voices

    quote = lambda x: f"“{x} and the paper keeps every story that it has ever run,”"
    texts = [f"{quote('We do not')} said Ada Orm, editor of the paper. {quote('You may')} Bo Vale told us.", f"{quote('They will')} Cy Tarn, the adviser, said. Di Quist said: {quote('She would')} and left.", None, "“Too short,” said Ada Orm."]
    got = {(r["quote"].split()[0], r["speaker"], r["role"], r["method"], r["confidence"]) for r in attributed_voices(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").collect()}
    assert got == {("We", "Ada Orm", "editor of the paper", "said_name", 0.7), ("You", "Bo Vale", None, "name_said", 0.6), ("They", "Cy Tarn", "the adviser", "name_role_said", 0.7), ("She", "Di Quist", None, "before", 0.6)}


def test_a_store_written_by_two_at_once_reads_each_text_once(spark, tmp_path):
    from verbatrix.sources.sinks import store_content, stored_content

    df, path = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string"), str(tmp_path / "store")
    store_content(df, "t", path)
    spark.read.parquet(path).limit(1).write.mode("append").parquet(str(tmp_path / "other"))
    spark.read.parquet(str(tmp_path / "other")).write.mode("append").parquet(path)  # a second writer's copy
    store_content(df, "t", path)
    assert spark.read.parquet(path).count() == 3 and stored_content(spark, path).count() == 2


def test_record_exports_and_packets(spark, duck, tmp_path):
    from tests.conftest import DATA
    from verbatrix.sources.tables import table

    d = f"{DATA}/sf0.001"
    found = exports.record_exports({n: table(spark, d, n) for n in ("institutions", "publications", "publication_candidates", "main_texts", "evidence_items")})
    assert sorted(found) == ["classifications", "evidence", "institutions", "noindex", "publications", "review"]
    want = duck.execute("SELECT (SELECT count(*) FROM main_texts WHERE coalesce(noindex, false) OR coalesce(nofollow, false)), (SELECT count(DISTINCT entity_id) + count(DISTINCT CASE WHEN entity_id IS NULL THEN 1 END) FROM evidence_items)").fetchall()[0]
    assert (found["noindex"].count(), found["classifications"].count()) == want
    rows_in = [(1, "Nora Vance spoke.", "https://o.example/a/nora-vance", "p", True, "secret"), (2, "Bo Tarn came.", "https://o.example/b", "p", False, "x"), (3, "x", "https://o.example/hidden/c", "q", False, "x"), (4, None, None, "r", None, None)]
    df = spark.createDataFrame(rows_in, "id int, t string, url string, party string, story boolean, note string").withColumn("keep", F.array(F.lit("Bo Tarn")))
    done = exports.public_packet(df, str(tmp_path), "packet", "url", "/hidden/", "party", ["t"], F.col("keep"), F.col("story"), [F.col("id")], ["note", "keep"], limit=10)
    got = spark.read.json(str(tmp_path / "packet.json"))
    assert done["rows"] == 3 and "note" not in got.columns
    assert rows(got.select("rank", "t")) == [(1, "[name] spoke."), (2, "Bo Tarn came."), (3, None)]
    assert [r["url"] for r in got.orderBy("rank").collect()] == ["/withheld", "https://o.example/b", None]


def test_concepts(spark):
    from verbatrix.functions.concepts import CONCEPTS
    from verbatrix.functions.text import tags_of

    tags = lambda t: one(spark, tags_of(F.col("t"), CONCEPTS), t=t)
    assert len(CONCEPTS) == 34
    assert tags("The charges against the student were later dismissed, and we removed the name from the story.") == ["anonymize", "dismissed_charges", "remove"]
    assert tags("The charges were not dismissed.") == [] and tags("Nothing here") == []
    assert tags("We consider each request individually; de-indexing is at the discretion of the editor.") == ["case_by_case", "deindex", "discretion"]


def test_entities_and_evidence_indexes(spark, tmp_path):
    (tmp_path / "e.csv").write_text("Organization ,website\n".replace("Organization ", "organization") + "The Torch,www.torch.example/x\nTorch B,https://torch.example\nNew One,new.example\n,none.example\nNo Site,\n")
    known = spark.createDataFrame([(7, "torch.example"), (8, "other.example")], "id int, domain string")
    merged, other = imports.entities(spark, str(tmp_path / "e.csv"), known, "list")
    assert rows(merged.select("domain", "id", "name", "added")) == [("new.example", None, "New One", True), ("torch.example", 7, "The Torch", False)] and other.count() == 2
    (tmp_path / "i.csv").write_text("link,claim\nhttps://news.torch.example/a,keeps\nhttps://news.torch.example/a,keeps\nelse.example/b,x\n,y\n")
    found, rest = imports.evidence_index(spark, str(tmp_path / "i.csv"), known)
    assert rows(found) == [("https://news.torch.example/a", "keeps", "torch.example", 7)] and rows(rest) == [("https://else.example/b", "x")]

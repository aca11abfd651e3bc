"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, by problem."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbatrix.llm.leakage import leaked_spans, without_leaks
from verbatrix.llm.main_content import main_lines, own_lines, with_main_content
from verbatrix.llm.one_form import look_alikes, look_classes, readable_form, with_forms
from verbatrix.llm.packing import fill, pack, packed
from verbatrix.llm.page_lines import cues, markup_lines
from verbatrix.llm.repeated_lines import line_templates, repeated_lines, template_path, without_repeated_lines
from verbatrix.llm.residue_pages import residue_texts
from verbatrix.llm.school_links import _solve, school_links
from verbatrix.llm.school_names import edit_distance, parse_name
from verbatrix.llm.sentences import sentence_spans, sentences, thai_words
from verbatrix.llm.text_quality import divergence, text_class, text_statistics


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# problem 1
def pages(spark, texts, site=1):
    schema = "page_id long, publication_id long, full_text string, page string, __gone int, lines_removed int"
    return spark.createDataFrame([(i, site, t, "x", 1, 9) for i, t in enumerate(texts)], schema)


def test_lines_repeat_in_other_spacing_case_and_digits(spark):
    df = pages(spark, [f"Story {chr(97 + i) * 3}\r\n SHARE  this　story {i * 7}\n\nend {chr(97 + i)}" for i in range(10)])
    assert rows(repeated_lines(df)) == [(i, 2) for i in range(10)]
    assert rows(repeated_lines(df.filter("page_id < 9"))) == []
    cleaned = without_repeated_lines(df).filter("page_id = 3").first()
    assert cleaned["full_text"] == "Story ddd\r\n\nend d" and cleaned["lines_removed"] == 1 and cleaned["page"] == "x"


def test_lines_edges(spark):
    same = pages(spark, ["a b"] * 9)
    assert rows(repeated_lines(same.unionByName(same))) == []  # repeated rows are the same nine pages
    mixed = pages(spark, ["notice\n" + "w " * 200_000, None, "", " \n\t"] + ["notice"] * 9)
    assert set(rows(repeated_lines(mixed))) == {(0, 1), *((i, 1) for i in range(4, 13))}
    assert repeated_lines(mixed.limit(0)).count() == 0
    assert [r["full_text"] for r in without_repeated_lines(mixed).orderBy("page_id").limit(4).collect()][1:] == [None, "", " \n\t"]
    assert rows(repeated_lines(pages(spark, ["n"] * 20).withColumn("publication_id", F.lit(None).cast("long")))) == []


def test_templates_merge_over_partitions(spark):
    df = pages(spark, [f"Read {i} comments" for i in range(12)]).repartition(6)
    assert rows(line_templates(df).select("template", "pages")) == [("3\tread 0 comments", 12)]
    assert template_path("a b c d e f g h i j", 0b10) == "10\ta <*> c d … g h i j" and template_path("a b") == "2\ta b"


# problem 2
INSTITUTIONS = "unitid string, name string, city string, state string, website string, host string"
CANDIDATES = "id long, domain string, title string, snippet string, mention string"


def link(spark, institutions, candidates):
    a = spark.createDataFrame([(*x, None) for x in institutions], INSTITUTIONS)
    b = spark.createDataFrame([(*x, "clash") for x in candidates], CANDIDATES)
    return {(r["unitid"], r["candidate_id"]) for r in school_links(a, b).filter("confidence >= 0.5").collect()}


def test_links(spark):
    schools = [("1", "Ormvale Quist State University", "Tarn", "OH", None), ("2", "Saint Ormvale-Quist University", "Gard", "KY", "http://ormvalequist-st.example/x"), ("3", None, None, None, None)]
    sites = [
        (1, "thetorch-3.example", "Torch of Ormvale Quist St. University", None),
        (2, "news.ormvalequist-st.example", None, None),
        (3, "quill.example", "Quill at St. Ormvlae Quist University", "Based in Gard (KY), updated weekly."),
        (4, "rankly.example", "Compare Ormvale Quist State University and St. Ormvale Quist University", None),
        (5, "ormvalequisttorch.example", "Ormvale Quist Town Torch - county news", None),
        (6, "thetorch-3.example", None, None),
        (7, "thetorch-4.example", "Torch of Zzyx Brann College", None),
        (8, None, None, None),
        (1, "thetorch-3.example", "Torch of Ormvale Quist St. University", None),
    ]
    assert link(spark, schools, sites) == {("1", 1), ("2", 2), ("2", 3), ("1", 6)}
    assert link(spark, [], sites) == link(spark, schools, []) == set()


def test_names_and_solver():
    assert parse_name("St. Orm Vale University") == ("ormvale", "saint") and parse_name("Orm Vale St. University") == ("ormvale", "state")
    assert parse_name("The Orm A & M Univ. Quill") == ("orm", "am") and parse_name("") == ("", "")
    assert edit_distance("hanleck", "hanelck") == 1 and edit_distance("abc", "xyz", 1) == 2
    import numpy as np

    m, _ = _solve(np.array([6.0, 6.0]), np.array([1.0, 1.0]), np.array([False, False]), np.zeros(2))
    assert m.sum() == pytest.approx(1.0, abs=1e-6) and m[0] == pytest.approx(m[1])


# problem 3
def test_forms(spark):
    texts = ["café ﬁle", "café file", "саfé​ file", " ｃａｆé ﬁle", "Café file", "cafe file", "café file", None, "", "x" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("look", F.lit("clash"))
    forms = with_forms(df, "t")
    assert {r["form"] for r in forms.filter("id < 4").collect()} == {"café file"}
    pairs = rows(look_alikes(forms))
    assert pairs == sorted(((a, b) for a in (0, 1, 2, 3, 6) for b in (0, 1, 2, 3, 6) if a < b), key=repr)
    assert rows(look_alikes(forms.unionByName(forms))) == pairs
    assert with_forms(df.limit(0), "t").count() == 0
    assert readable_form(df, "t").filter("id = 2").first()["text"] == "саfé file"


def test_compatibility_forms(spark):
    texts = ["x² ½ ① ℃ ㎏ 𝐀 Ⅷ … ｶﾞ ﷺ a−b", "x2 1⁄2 1 °C kg A VIII ... ガ صلى الله عليه وسلم a-b", "x² ½ ① °C kg A VIII ... ガ صلى الله عليه وسلم a-b"]
    got = {r["id"]: r for r in with_forms(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "t").collect()}
    assert {r["form"] for r in got.values()} == {texts[1]}
    assert got[0]["look"] == got[2]["look"] != got[1]["look"]  # a superscript doesn't read like a figure


def test_look_classes(spark):
    texts = [(5, "ﬁle"), (3, "file"), (4, "file"), (9, "other"), (9, "other"), (7, None)]
    forms = with_forms(spark.createDataFrame(texts, "id long, t string"), "t")
    assert rows(look_classes(forms)) == [(3, 3, 1), (4, 3, 1), (5, 3, 2), (9, 9, 0)]
    assert look_classes(forms.limit(0)).count() == 0


# problem 5 and 6
PAGE = "Menu\nHome | News | About\nBy Orm Staff\nOrm council keeps its archive\nThe council voted on Monday to keep the archive as it is, because the record matters.\nShare this story\nPolice log of Orm\nWhat changed in Orm since May\nEditors said that they would add a note to the story when the court has ruled.\nYou might also like: Orm\n© 2024 Orm. All rights reserved."


def test_own_lines():
    assert own_lines(PAGE, "Orm council keeps its archive | The Orm") == [4, 5, 7, 8, 9]
    assert own_lines(PAGE) == [4, 5, 7, 8, 9]
    assert own_lines("Page not found\nMenu", "x") == [] and own_lines("\n \n") == []


def test_main_lines_edges(spark):
    schema = "page_id long, full_text string, title string, main_text string, page int, text string"
    df = spark.createDataFrame([(1, PAGE, None, None, 1, "x"), (1, PAGE, None, None, 1, "x"), (2, None, "t", None, 1, "x"), (3, "", None, "", 1, "x"), (4, "A line of a very long story about the town and its people. " * 20_000, None, None, 1, "x")], schema)
    assert main_lines(df).filter("page = 1").count() == 10 and rows(main_lines(df).filter("page > 1")) == [(4, 1)]
    assert main_lines(df.limit(0)).count() == 0
    assert [r["own_text"] for r in with_main_content(df.filter("page_id in (2, 3)")).orderBy("page_id").collect()] == [None, ""]


def test_residue(spark):
    assert cues("{{ article.headline }}")[1] == "layout" and cues("Posted ${date}") == (True, "mark") and cues("The site showed “404 Page not found” for 4 hours, she said.")[1] is None
    assert markup_lines("<head><title>x</title></head><p>One &amp; two</p><div>Thr<b>ee</b>") == ["One & two", "Three"]
    notice = "All letters to this paper are read by the desk before noon."
    texts = [
        (1, "main_text", "h", "Menu\nPage not found"),
        (2, "main_text", "h", "Headline\nBy {{author}}\nThe council voted on Monday to keep the archive as it is."),
        (3, "content", "h", "<p>Please enable JavaScript to view this site.</p>"),
        (4, "main_text", "h", "Lorem ipsum dolor sit amet, tempor nulla."),
        (5, "main_text", "h", None),
        (6, "main_text", "h", "  "),
        (7, "main_text", "h", f"{notice}\n[object Object]"),
        *((10 + i, "main_text", "h", f"{notice}\nA story of the town number {i} and of the people who live in it.") for i in range(9)),
    ]
    df = spark.createDataFrame(texts, "page long, field string, host string, text string")
    assert {r["page"] for r in residue_texts(df).collect()} == {1, 3, 4, 7}
    assert {r["page"] for r in residue_texts(df.filter("page < 18")).collect()} == {1, 3, 4}  # the notice stands on nine pages only
    assert residue_texts(df.limit(0)).count() == 0
    assert residue_texts(df.unionByName(df)).count() == 4


# problem 7
@pytest.mark.parametrize(
    "text,count",
    [
        ("Dr. Orm met Sen. Vale at 9:05 a.m. on Feb. 3, 2019. They left at 5 p.m. Nobody spoke.", 3),
        ('"We never do. That is our rule," said T. R. Orm of Vale & Co. yesterday. It holds.', 2),
        ("“It hurt me. It still does!” Ada Orm told the desk. See orm.example/v2.1.html for more.", 2),
        ("The rate was 4.5 percent, i.e. low.The next was lower.  End", 3),
        ("«Nunca lo hacemos. Es la norma», dijo Orm. ¡No!, respondió la Sra. Vale. ¿Por qué?", 3),
        ("„Wir tun es nicht. Nie“, sagte Orm am 5. März 2019. Soll es, z. B. jetzt, so bleiben?", 2),
        ("« Faut-il tout dire ? » demande Orm. M. Vale, p. 12, répond.", 2),
        ("「残します。」とOrm編集長は述べた。なぜですか？", 2),
        ("“不删。是规定。”编辑K. A. Orm说。约有7.9%被拒。", 2),
        ("По словам Орма, т. е. без слов. Да?", 2),
        ("डॉ. Orm ने कहा। क्या यह रहेगा?", 2),
        ("هل يبقى؟ قال Orm إنه لا يتغير.", 2),
        ("คำขอจำนวน5รายการจากOrmถูกปฏิเสธ Ada Q. Valeขอให้ลบชื่อออกจากข่าวของBrann Tor บรรณาธิการของOrmเพิ่มหมายเหตุไว้ท้ายข่าว", 3),
        ("Headline without a mark\n\r\n Menu | Home \n1. Orm keeps it", 3),
        ("said no... and later said yes. iPress of Orm counted 3.", 2),
    ],
)
def test_sentence_counts(text, count):
    spans = sentence_spans(text)
    assert len(spans) == count, [text[a:b] for a, b in spans]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB c.!?\n\"“”。」「ก ข'1"), max_size=60))
def test_spans_cover_all_but_white_space(text):
    spans = sentence_spans(text)
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert "".join(text[a:b] for a, b in spans).replace(" ", "").replace("\n", "") == "".join(text.split())


def test_sentences_edges(spark):
    df = spark.createDataFrame([(1, "One. Two."), (1, "One. Two."), (2, None), (3, " \n"), (4, "Long one here. " * 50_000)], "id long, text string").withColumn("start_char", F.lit(1))
    assert {r["id"]: r["count"] for r in sentences(df, "id", "text").groupBy("id").count().collect()} == {1: 4, 4: 50_000}
    assert sentences(df.limit(0), "id", "text").count() == 0
    assert thai_words("ลบข่าวเก่า") == ["ลบ", "ข่าว", "เก่า"]


# problem 8
@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 250), max_size=60), st.integers(1, 100))
def test_pack_is_whole_and_fits(sizes, capacity):
    bins = pack(sizes, capacity)
    assert all(sum(n for _, _, n in b) <= capacity for b in bins)
    pieces = {}
    for b in bins:
        for item, first, n in b:
            pieces.setdefault(item, []).append((first, n))
    assert set(pieces) == set(range(len(sizes)))
    for item, parts in pieces.items():
        parts.sort()
        assert len(parts) == max(1, -(-sizes[item] // capacity)) and sum(n for _, n in parts) == sizes[item]
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))


def test_pack_is_near_the_bound():
    rng = random.Random(3)
    sizes = [rng.randint(1, 400) for _ in range(4000)]
    assert len(pack(sizes, 512)) <= 1.01 * sum(sizes) / 512 + 1
    assert len(pack([200] * 10, 512)) == 5 and len(pack([171] * 9, 512)) == 5


def test_packed_edges(spark):
    docs = spark.createDataFrame([(1, "word " * 3000), (2, None), (3, ""), (4, "some words"), (4, "some words")], "doc_id long, text string").withColumn("bin", F.lit("clash"))
    sizes = spark.createDataFrame([("a", 100), ("b", 2048), ("none", None)], "container string, capacity_tokens long")
    got = packed(docs, sizes)
    assert {r["container"]: r["documents"] for r in fill(got).collect()} == {"a": 5, "b": 5}
    assert got.filter("tokens > capacity").count() == 0
    assert packed(docs.limit(0), sizes).count() == 0


# problem 9
def test_leaks_against_brute_force(spark):
    import re

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(20)] + [(20, None), (21, "too short")]
    docs = []
    for i in range(200):
        words = rng.choices(vocabulary, k=60)
        if i % 3 == 0:
            source = items[i % 20][1].split()
            n = rng.choice((11, 12, 20))
            at = rng.randrange(0, 30 - n + 1)
            words[5 : 5 + n] = [w.upper() + "," for w in source[at : at + n]]
        docs.append((i, " ".join(words)))
    docs += [(200, None), (201, ""), (202, "w1 " * 100_000)]
    grams = {}
    split = lambda t: [w.casefold() for w in re.findall(r"[^\W_]+", t or "")]
    for i, t in items:
        w = split(t)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    expected = {(d, i) for d, t in docs for w in [split(t)] for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(0))
    right = spark.createDataFrame(items, "item_id long, text string")
    assert expected and {(r["doc"], r["item"]) for r in leaked_spans(left, right).collect()} == expected
    assert {(r["doc"], r["item"]) for r in leaked_spans(left, right, block_chars=500).collect()} == expected  # by bitmap and join
    assert leaked_spans(left, right.limit(0)).count() == leaked_spans(left.limit(0), right).count() == 0


def test_items_that_share_an_id_keep_their_own_texts(spark):
    first, second = (" ".join(f"{x}{i}" for i in range(12)) for x in "ab")
    docs = spark.createDataFrame([(1, first), (2, second), (3, f"{first} {second}")], "doc_id long, text string")
    items = spark.createDataFrame([(7, first), (7, second), (8, second)], "item_id long, text string")
    for chars in (10**6, 10):
        assert {(r["doc"], r["item"], r["start_char"]) for r in leaked_spans(docs, items, block_chars=chars).collect()} == {(1, 7, 0), (2, 7, 0), (2, 8, 0), (3, 7, 0), (3, 7, len(first) + 1), (3, 8, len(first) + 1)}


def test_leaks_are_cut_out(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, f"Before. {passage.title()}! After {passage} end", "c"), (2, "clean", "c"), (3, None, "c")], "doc_id long, text string, leaked_items string")
    items = spark.createDataFrame([(7, passage), (8, "zero " + passage)], "item_id long, text string")
    got = {r["doc_id"]: (r["text"], r["leaked_items"]) for r in without_leaks(docs, leaked_spans(docs, items)).collect()}
    assert got == {1: ("Before. ! After  end", 2), 2: ("clean", 0), 3: (None, 0)}


# problem 10
@pytest.mark.parametrize(
    "text,expected",
    [
        ("The council met on Monday and it was decided that the archive should stay.\nNobody spoke against it in the hall.", "prose"),
        ("A short heading\nThe council met on Monday and decided that the archive of the town should stay as it is.", "prose"),
        ("• Orm police log\n• Letters of May\n• Court briefs from Vale, 2019\n• Names of minors", "list"),
        ("Schools (5)\nHome > Orm > courts\nBudgets\nTransit (9)\nHousing", "list"),
        ("Year\tTown\tShare\n2019\tOrm\t4.5\n2020\tVale\t3.1\n2021\tTor\t9.9", "table"),
        ("Town: Orm\nYear: 2019\nTown: Vale\nYear: 2020\nTown: Tor\nYear: 2021", "table"),
        ("| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |", "table"),
        ("<?@[{,*#:/%-^@ ^~(/!%-?^)&-\\?  {&}+,,]<+%[\\[)}#!*=^>%@~", "junk"),
        ("update update update update update update update update update update update update update", "junk"),
        ("vldbt nrpxw ldqbvrt pfbhl wglqtz lltfxhrh scxfzm kdt jpmxcql rdfmfpqd mgjlxx pllj", "junk"),
        ("var a=function(e,t){return e[5]||t};var b=function(e,t){return e[3]||t};", "junk"),
        ("裁判の結果が変われば、注記を加える。\n編集部は古い記事を削除しません。", "prose"),
        ("กองบรรณาธิการไม่ลบข่าวเก่าออกจากคลังข้อมูล บรรณาธิการเพิ่มหมายเหตุไว้ท้ายข่าว", "prose"),
    ],
)
def test_text_class(text, expected):
    assert text_class(text)[0] == expected


def test_statistics_edges(spark):
    df = spark.createDataFrame([(1, "Two words. And\nmore: 5%"), (2, None), (3, " \n "), (4, "a long line of prose, and more of it. " * 20_000), (1, "Two words. And\nmore: 5%")], "doc_id long, text string").withColumn("words", F.lit("clash"))
    got = {r["id"]: r for r in text_statistics(df).collect()}
    assert got[1]["words"] == 5 and got[1]["punctuated_lines"] == 0.0 and got[1]["mean_word_length"] == pytest.approx(3.2)
    assert got[2]["words"] == got[3]["words"] == 0 and got[2]["text_class"] is None and got[4]["text_class"] == "prose"
    assert text_statistics(df.limit(0)).count() == 0 and text_statistics(df).count() == 5
    assert divergence((0.5, 0.5), (0.5, 0.5)) == 0 and divergence((1.0, 0.0), (0.0, 1.0)) == 1

"""Word lattices of spaceless scripts: what they decide, what is learnt, and that lines take linear time."""

import time

import pytest

from verbatrix.llm.sentences import BASE, Lexicon, learn_words, sentence_spans, thai_words

EMPTY = Lexicon(frozenset({"\x00"}), frozenset(), frozenset(), frozenset())


def parts(text, lexicon=BASE):
    return [text[a:b] for a, b in sentence_spans(text, lexicon)]


@pytest.mark.parametrize(
    "text,count",
    [
        ("記事は削除しません 名前は残ります", 2),  # a final word, then a new clause
        ("記事の件は 名前の件と同じです", 1),  # a particle goes on
        ("他已经走了 我们没有新闻", 2),
        ("我们要求 从新闻中去掉姓名", 1),
        ("เราไม่ลบข่าวเก่าออกแล้ว นายกล่าว", 2),
        ("เราขอให้ลบข่าวของ คนบ้านนี้", 1),
    ],
)
def test_words_at_gaps_decide(text, count):
    assert len(parts(text)) == count, parts(text)


@pytest.mark.parametrize("text", ["記事は削除しません 名前は残ります", "他已经走了 我们没有新闻", "เราไม่ลบข่าวเก่าออกแล้ว คนบ้านนี้"])
def test_without_words_the_gaps_are_read_otherwise(text):
    assert len(parts(text)) != len(parts(text, EMPTY))


def test_path_is_the_cheapest():
    assert thai_words("記事は残ります") == ["記事", "は", "残り", "ます"] and thai_words("我们认为") == ["我们", "认为"]
    assert thai_words("กขค") == ["กขค"] and thai_words("") == []


def test_words_and_openings_are_learnt(spark):
    texts = [f"編集部は記事を削除しません\n編集部が{x}を残します" for x in ("名前", "件", "私")] * 4 + ["คณะบุคคลไม่ลบข่าว\nคณะบุคคลเพิ่มข่าว"] * 6
    learnt = learn_words(spark.createDataFrame([(t,) for t in texts] + [(None,), ("plain",)], "text string"))
    assert "編集部" in learnt.words and "編集部" in learnt.opening and BASE.words <= learnt.words
    text = "記事を見た人 編集部が名前を残します"
    assert len(parts(text)) == 1 and len(parts(text, learnt)) == 2
    assert learn_words(spark.createDataFrame([], "text string")).words == BASE.words


@pytest.mark.parametrize("unit", ["a.b ", "“open ", "記事は残りません ", "新闻在 ", "ข่าวของเรา ", "1.5 no. 3 ", '"x. ', "Dr. ", "記", "ก"])
def test_long_lines_take_linear_time(unit):
    took = []
    for n in (50_000, 400_000):
        text = unit * (n // len(unit))
        t = time.process_time()
        sentence_spans(text)
        took.append(time.process_time() - t)
    assert took[1] < 20 * took[0] + 0.5, took

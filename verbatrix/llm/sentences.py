"""Problem 7: sentence units with their places, in ten languages.

A line break always ends a sentence. Within a line, quotations are paired first. In spaced scripts every terminator is a
node of a lattice whose edges (what stands before, what comes next, which quotation holds it) decide if a sentence ends
there. Runs of Thai, Chinese and Japanese letters are cut into words by the cheapest path of a word lattice; a gap is then
classified by the final word before it and the opening word behind it. The dictionary starts from short lists of frequent
words; what stands between them again and again over all texts joins it, and words that open lines, where a sentence surely
begins, are learnt as opening words.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatrix.llm.arrow import map_batches
from verbatrix.llm.lexicon import CLOSERS
from verbatrix.operators.sizing import materialise

# Abbreviations that never end a sentence before a name, figure or further word.
NEVER = frozenset(
    "dr prof mr mrs ms mx gov sen rep lt col gen sgt capt maj cmdr rev hon pres supt st sra sr srta lic ing dra dña arq mme mlle mm hr fr frau herr no nos nr núm num art sec secs fig figs vol vols ch chap p pp pg par ed eds vs v approx ca cf viz esp incl jan feb mar apr jun jul aug sep sept oct nov dec mon tue tues wed thu thur thurs fri sat sun ave blvd rd mt ft bzw vgl ggf evtl z.b u.a d.h т.е т.д т.п т.к г им ул стр см напр डॉ श्री श्रीमती कु पं प्रो د أ م".split()
)
# Abbreviations that may end one, if a new sentence follows.
MAYBE = frozenset("inc co corp ltd bros jr sr al etc esq llc plc gmbh ag u.s u.k u.n e.u p.m a.m ph.d m.d b.a m.a d.c usw etc cía ltda s.a и.т.д".split())
# Verbs of speech that tie a quotation to its speaker.
SPEECH = re.compile(
    r"\b(?:said|says|say|told|tells|asked|asks|added|adds|explained|wrote|writes|replied|noted|argued|warned|insisted|answered|recalled|stated|declared|dijo|dice|respondió|explicó|añadió|preguntó|afirmó|señaló|sagte|sagt|erklärte|fragte|meinte|antwortete|betonte|schrieb|dit|demande|demanda|précise|ajoute|explique|répond|affirme|déclare|сказал|сказала|заявил|заявила|ответил|ответила|пояснил|пояснила|спросил|спросила)\b"
    r"|说|表示|认为|写道|问道|指出|称|述べ|話し|語っ|答え|尋ね|書い|قال|قالت|أضاف|أوضح|سأل|कहा|बताया|पूछा|กล่าว|บอก|ถาม"
)
# What goes on with a sentence of Chinese or Japanese behind a quotation.
CJK_ON = re.compile(r"[とはがをにのもでへやか、，・：；]")
PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "„": "“”", "‹": "›"}
TERMINATOR = re.compile(r"[.!?…。！？｡।॥؟۔]+")
WIDE_MARKS = frozenset("。！？｡।॥؟۔")
OPENERS = frozenset("\"'“„«‹「『([¿¡‘《〈【")
CAMEL = re.compile(r"[a-z][A-Z]")
BEFORE = re.compile(r"[^\s\"'“”„«»‹›「」『』(\[¿¡‘’|、，。：；・぀-ヿ㐀-䶿一-鿿々฀-๿]+$")
THAI = re.compile(r"[฀-๿]")
CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿々]")
GAP = re.compile(r"\s+")
AFTER_STATE = re.compile(r"(?:The|In|On|A|An|By|At|For|It|He|She|They|We|But|And)\b")
GERMAN_MONTH = re.compile(r"(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b")
INITIALS = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
#: No abbreviation is longer: what stands before a mark is read back so far.
LONGEST_WORD = 80

# Frequent words by script and by their part at a gap: opening, never final, final, any.
THAI_OPENING = "แต่ และ อย่างไรก็ตาม นอกจากนี้ เมื่อ หาก ถ้า เนื่องจาก ดังนั้น ทั้งนี้ เพราะ ขณะที่ นาย นาง นางสาว ดร. เรา เขา เธอ พวกเขา ฉัน ผม".split()
THAI_OPEN_ENDED = "ของ จาก ใน ที่ และ หรือ กับ โดย ว่า ให้ เพื่อ แก่ ต่อ ถึง ด้วย เป็น คือ ไม่ จะ ได้ ซึ่ง แต่".split()
THAI_FINAL = "ครับ ค่ะ คะ นะ แล้ว ด้วย เลย เท่านั้น".split()
THAI_WORDS = "มี ไป มา ได้ ต้อง การ ความ คน ปี เดือน วัน ครั้ง นี้ นั้น ทำ ใช้ อยู่ มาก กว่า ทุก บาง หลาย ออก เข้า ขึ้น ลง ก่อน หลัง ถูก ขอ ลบ เพิ่ม เก่า ใหม่ ข่าว ชื่อ ข้อมูล จำนวน เรื่อง บ้าน เมือง ประเทศ เวลา งาน เด็ก น้ำ กล่าว บอก ถาม ตอบ พูด รู้ เห็น คิด".split()
JA_FINAL = "ます ません ました ませんでした でしょう です でした だ だった である という った いた した ない なかった か よ ね".split()
JA_ON = "と は が を に の も で へ や から まで より ので のに けれど".split()
JA_WORDS = "これ それ あれ この その あの ここ そこ こと もの ため よう さん ある いる する なる れる られる せる 私 彼 人 日 年 月 時 件 記事 名前 なぜ しかし また そして".split()
ZH_FINAL = "了 吗 呢 吧 啊 呀 的".split()
ZH_ON = "、 和 与 或 及 的 而".split()
ZH_WORDS = "我们 你们 他们 这个 那个 什么 可以 没有 不会 必须 应该 已经 因为 所以 但是 如果 虽然 而且 要求 认为 表示 新闻 报道 文章 姓名 名字 时候 现在 今天 公司 问题 工作 中国 社会 从 在 是 有 不 人 这 中 会 被 说 将 对 为 上 到 年 月 日".split()
#: A piece between known words joins the dictionary if it stands there so often, and in this share of all pieces, which bounds
#: their number; a word opens sentences if this share of its places are beginnings of lines.
LEARN_TIMES, LEARN_SHARE, OPENS = 5, 1e-5, 0.1
#: Cost of a dictionary word, of an opening one, of one of a single character, and of a character that no word covers.
KNOWN, KNOWN_OPENING, KNOWN_SINGLE, UNKNOWN = 1.0, 0.8, 0.85, 0.9
#: Letters of scripts without spaces, in runs.
DENSE_RUN = re.compile(r"[\u0e00-\u0e7f]+|[\u3005\u3007\u3041-\u3096\u30a1-\u30fc\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]+")


@dataclass(frozen=True)
class Lexicon:
    """The words of a lattice, by their first character, and those that open and end sentences, or go on with one."""

    words: frozenset[str] = frozenset((*THAI_OPENING, *THAI_OPEN_ENDED, *THAI_FINAL, *THAI_WORDS, *JA_FINAL, *JA_ON, *JA_WORDS, *ZH_FINAL, *ZH_ON, *ZH_WORDS))
    opening: frozenset[str] = frozenset(THAI_OPENING)
    final: frozenset[str] = frozenset((*THAI_FINAL, *JA_FINAL, *ZH_FINAL))
    on: frozenset[str] = frozenset((*JA_ON, *ZH_ON))
    first: dict[str, list[tuple[str, float]]] = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        for w in sorted(self.words | self.opening):
            self.first.setdefault(w[0], []).append((w, KNOWN_OPENING if w in self.opening else KNOWN_SINGLE if len(w) == 1 else KNOWN))

    def path(self, text: str) -> list[tuple[str, bool]]:
        """The cheapest path through a run of letters: (piece, known?); characters that no word covers are joined to one piece."""
        n = len(text)
        best, back, known = [0.0] + [float("inf")] * n, [0] * (n + 1), [False] * (n + 1)
        for i in range(n):
            at = best[i]
            if at + UNKNOWN < best[i + 1]:
                best[i + 1], back[i + 1], known[i + 1] = at + UNKNOWN, i, False
            for w, cost in self.first.get(text[i], ()):
                # of equal paths the one with known words counts
                if text.startswith(w, i) and at + cost <= best[i + len(w)]:
                    best[i + len(w)], back[i + len(w)], known[i + len(w)] = at + cost, i, True
        out: list[tuple[str, bool]] = []
        i = n
        while i > 0:
            j = back[i]
            if not known[i]:
                while j > 0 and not known[j]:
                    j = back[j]
            out.append((text[j:i], known[i]))
            i = j
        return out[::-1]


BASE = Lexicon()


def thai_words(text: str, lexicon: Lexicon = BASE) -> list[str]:
    """The words of a run of letters of a script without spaces."""
    return [w for w, _ in lexicon.path(text)]


def _run_before(line: str, start: int, end: int) -> str:
    """The run of letters of one script without spaces that ends at end."""
    i = end
    thai = bool(THAI.match(line[end - 1]))
    while i > start and (THAI if thai else CJK).match(line[i - 1]):
        i -= 1
    return line[i:end]


def _run_behind(line: str, start: int) -> str:
    m = DENSE_RUN.match(line, start)
    return m[0] if m else ""


def _dense_gaps(line: str, lexicon: Lexicon) -> list[int]:
    """Ends of sentences at the gaps of a Chinese or Japanese line, by the words on both sides."""
    ends = []
    for m in GAP.finditer(line):
        if not m.start() or m.end() >= len(line) or not CJK.match(line[m.start() - 1]) or line[m.end()] in "，、,;:；：・":
            continue
        words = thai_words(_run_before(line, 0, m.start()), lexicon)
        behind = thai_words(_run_behind(line, m.end()), lexicon)
        if behind and behind[0] in lexicon.on:
            continue
        if words[-1] in lexicon.final or words[-1] not in lexicon.on and behind and behind[0] in lexicon.opening:
            ends.append(m.start())
    return ends


def quotations(line: str, cut: bool) -> list[tuple[int, int]]:
    """(opening, closing) places of the quotations in a line; one left open in a text cut short runs to the end."""
    out, i, n = [], 0, len(line)
    gone: set[str] = set()  # closers that don't come any more: they are looked for once

    def find(x: str, at: int) -> int:
        if x in gone:
            return -1
        if (e := line.find(x, at)) < 0:
            gone.add(x)
        return e

    while i < n:
        c = line[i]
        if c in PAIRS:
            ends = [e for x in PAIRS[c] if (e := find(x, i + 1)) >= 0]
            if ends:
                out.append((i, min(ends)))
                i = min(ends)
            elif cut:
                out.append((i, n))
                break
        elif c == '"' and (i == 0 or not (line[i - 1].isalnum() or line[i - 1] in ".,!?…")) or c == '"' and i and line[i - 1] in ".!?" and i + 1 < n and line[i + 1].isalnum():
            e = find('"', i + 1)
            if e >= 0:
                out.append((i, e))
                i = e
            elif cut:
                out.append((i, n))
                break
        i += 1
    return out


def _opens(text: str, i: int, lower_line: bool) -> bool:
    """Can a sentence begin at i?"""
    c = text[i]
    if c.isalpha():
        return not c.islower() or lower_line or bool(CAMEL.match(text, i))
    return c.isdigit() or c in OPENERS or c in "#@$€£&*•{<"


def _latin_end(line: str, start: int, m: re.Match, lower_line: bool) -> bool:
    """Does the terminator end a sentence, by what stands before it and what comes next? (Outside quotations.)"""
    i, end = m.start(), m.end()
    while end < len(line) and line[end] in CLOSERS and not (line[end] == '"' and end + 1 < len(line) and line[end + 1].isalnum()):
        end += 1
    nxt = end
    while nxt < len(line) and line[nxt].isspace():
        nxt += 1
    if nxt >= len(line):
        return True
    marks = m[0]
    before = (BEFORE.search(line, max(start, i - LONGEST_WORD), i) or [""])[0]
    if any(c in WIDE_MARKS for c in marks):
        return not line[nxt] in ",;:、，；："
    if nxt == end:  # nothing between the mark and what follows
        if not (line[nxt].isupper() or line[nxt] in OPENERS and line[nxt] != "(" or ord(line[nxt]) > 0x2FF and line[nxt].isalpha()):
            return False
        if marks != ".":
            return True
        if any(c in before for c in "/@.") and before.casefold() not in MAYBE or len(before) < 2 and not before.isdigit() or before[-1].isupper():
            return False
        after = line[nxt + 1 : nxt + 2]
        return after == " " or after.islower() or line[nxt] in OPENERS or line[nxt].isalpha() and not line[nxt].isupper()
    if not _opens(line, nxt, lower_line):
        return False
    if "!" in marks or "?" in marks:
        return True
    if len(marks) > 1 or "…" in marks:
        return True
    word = before.casefold().lstrip("(")
    if not word:
        return False
    if word in MAYBE:
        return word not in ("u.s", "u.k", "u.n", "e.u") or bool(AFTER_STATE.match(line, nxt))
    if word in NEVER:
        if word == "no":
            return before == "no" and not line[nxt].isdigit()
        return lower_line and word in ("sun", "sat", "mar", "v", "p")
    if len(word) == 1 and word.isalpha() or INITIALS.fullmatch(word):
        return False
    if word.isdigit() and len(word) <= 3:
        if i - start <= LONGEST_WORD and line[start:i].strip() == before:
            return False  # the number of a list entry
        if GERMAN_MONTH.match(line, nxt):
            return False
    return True


def _quoted_end(line: str, quote: tuple[int, int], start: int) -> bool:
    """Does a sentence end behind a quotation that closes with a terminator?"""
    nxt = quote[1] + 1
    while nxt < len(line) and (line[nxt].isspace() or line[nxt] in CLOSERS):
        nxt += 1
    if nxt >= len(line):
        return True
    if not _opens(line, nxt, False) or CJK_ON.match(line, nxt):
        return False
    if line[start : quote[0]].strip() and SPEECH.search(line, start, quote[0]):
        return True  # the speaker came first
    stop = len(line)
    for m in TERMINATOR.finditer(line, nxt):
        word = (BEFORE.search(line, max(nxt, m.start() - LONGEST_WORD), m.start()) or [""])[0].casefold()
        if len(word) > 1 and word not in NEVER:
            stop = m.start()
            break
    return not SPEECH.search(line, nxt, stop)


#: Words from which a Thai clause can be a sentence of its own before a word that opens none.
CLAUSE_WORDS = 5
NAME = r"(?:[A-ZÀ-ÖØ-Þ][\w'’-]+|[A-ZÀ-ÖØ-Þ]\.)"


PERSON = re.compile(rf"({NAME}(?:\s+{NAME})*)(?=[฀-๿])")


def _thai_gaps(line: str, lexicon: Lexicon) -> list[int]:
    """Ends of sentences at the gaps of a Thai line."""
    ends = []
    start, letters, seen = 0, 0, 0  # Thai letters since the last end, and up to where they were counted
    for m in GAP.finditer(line):
        at, nxt = m.start(), m.end()
        letters, seen = letters + len(THAI.findall(line, seen, at)), at
        if at <= start or nxt >= len(line):
            continue
        thai_before, thai_after = THAI.match(line[at - 1]), THAI.match(line[nxt])
        if letters < 6:
            continue  # no clause yet
        if thai_before:
            words = thai_words(_run_before(line, start, at), lexicon)
            if words[-1] in THAI_OPEN_ENDED and words[-1] not in lexicon.final:
                continue
            if line[nxt].isdigit() or line[nxt] in ",;:)–-%":
                continue
            if thai_after and words[-1] not in lexicon.final:
                opening = thai_words(_run_behind(line, nxt), lexicon)[0]
                if opening not in lexicon.opening and sum(len(thai_words(r[0], lexicon)) for r in DENSE_RUN.finditer(line, start, at)) < CLAUSE_WORDS:
                    continue
            end = at
        elif thai_after:
            end = at  # a clause that closes with a foreign name; a verb would stand on it without a gap
        elif run := PERSON.match(line, nxt):
            # foreign words on both sides: the person who opens the next clause has two names, or initials
            names = run[1].split()
            person = 3 if len(names) >= 3 and names[-2].endswith(".") else 2
            if len(names) != person or line[at - 1] == ".":
                continue
            end = at
        else:
            continue
        ends.append(end)
        start, letters, seen = nxt, 0, nxt
    return ends


def sentence_spans(text: str, lexicon: Lexicon = BASE) -> list[tuple[int, int]]:
    """(start, end) of every sentence, in characters from 0, ends exclusive, outer white space left out."""
    spans = []
    offset = 0
    lines = text.split("\n")
    for number, line in enumerate(lines):
        if line and not line.isspace():
            spans.extend((offset + a, offset + b) for a, b in _line_spans(line, number == len(lines) - 1, lexicon))
        offset += len(line) + 1
    return spans


def _line_spans(line: str, last: bool, lexicon: Lexicon) -> Iterator[tuple[int, int]]:
    cuts: list[int] = []
    if TERMINATOR.search(line):
        quotes = quotations(line, last)
        openings = [q[0] for q in quotes]
        lower_line = not any(c.isupper() for c in line)
        start = 0
        for m in TERMINATOR.finditer(line):
            if m.start() < start:
                continue
            k = bisect_right(openings, m.start()) - 1
            inside = quotes[k] if k >= 0 and quotes[k][0] < m.start() < quotes[k][1] else None
            if inside:
                if not line[m.end() : inside[1]].strip() and _quoted_end(line, inside, start):
                    end = min(len(line), inside[1] + 1)
                else:
                    continue
            elif _latin_end(line, start, m, lower_line):
                end = m.end()
            else:
                continue
            while end < len(line) and line[end] in CLOSERS and not (end < len(line) and (j := bisect_right(openings, end)) and openings[j - 1] == end):
                end += 1
            cuts.append(end)
            start = end
    if not line.isascii():
        if THAI.search(line):
            cuts = sorted({*cuts, *_thai_gaps(line, lexicon)})
        elif CJK.search(line):
            cuts = sorted({*cuts, *_dense_gaps(line, lexicon)})
    begin = 0
    for end in [*cuts, len(line)]:
        a, b = begin, end
        while a < b and line[a].isspace():
            a += 1
        while b > a and line[b - 1].isspace():
            b -= 1
        if b > a:
            yield a, b
        begin = end


def _scan(lexicon):
    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        words = Lexicon(*lexicon.value) if lexicon else BASE
        for b in batches:
            out: dict[str, list] = {"id": [], "start_char": [], "end_char": []}
            for key, text in zip(b["id"], b["text"]):
                if text:
                    for start, end in sentence_spans(text, words):
                        out["id"].append(key)
                        out["start_char"].append(start)
                        out["end_char"].append(end)
            yield out

    return run


def _pieces(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    """Per batch: pieces of the runs' cheapest paths, whether the base knows them, how often they stand, how often at a line's beginning."""
    for b in batches:
        counts: dict[tuple[str, bool], list[int]] = {}
        for text in b["text"]:
            if not text or text.isascii():
                continue
            for line in text.split("\n"):
                begin = len(line) - len(line.lstrip())
                for m in DENSE_RUN.finditer(line):
                    for k, piece in enumerate(BASE.path(m[0])):
                        at = counts.setdefault(piece, [0, 0])
                        at[0] += 1
                        at[1] += not k and m.start() == begin
        yield {"piece": [w for w, _ in counts], "known": [x for _, x in counts], "n": [v[0] for v in counts.values()], "opens": [v[1] for v in counts.values()]}


def learn_words(texts: DataFrame) -> Lexicon:
    """The base lexicon with what all texts (column text) teach: pieces that come again and again, and words that open lines."""
    pieces = map_batches(texts.select("text").filter("text IS NOT NULL"), _pieces, "piece string, known boolean, n bigint, opens bigint")
    counted = materialise(pieces.groupBy("piece", "known").agg(F.sum("n").alias("n"), F.sum("opens").alias("opens")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counted.filter((F.col("n") >= max(LEARN_TIMES, LEARN_SHARE * total)) & (F.length("piece") > 1)).collect()
    words = BASE.words | {r["piece"] for r in often if not r["known"]}
    # words that never end a sentence or go on with one don't open one either
    opening = BASE.opening | {r["piece"] for r in often if r["opens"] >= OPENS * r["n"] and r["piece"] not in BASE.final | BASE.on and r["piece"] not in THAI_OPEN_ENDED}
    return Lexicon(frozenset(words), frozenset(opening))


def sentences(df: DataFrame, id_col: str, text_col: str, lexicon: Lexicon = BASE) -> DataFrame:
    """(id, start_char, end_char) of every sentence of every text; places count code points from 0, ends exclusive.

    lexicon may come from learn_words. Null, empty and blank texts have none; whole texts are read; repeated rows give
    their sentences each; one narrow pass.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = None if lexicon is BASE else df.sparkSession.sparkContext.broadcast((lexicon.words, lexicon.opening))
    return map_batches(rows, _scan(shared), f"id {rows.schema['id'].dataType.simpleString()}, start_char int, end_char int")

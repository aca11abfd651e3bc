"""Fixed values shared by the text operators: function words, scripts, sentence marks."""

from __future__ import annotations

import re

# Frequent function words by language (characters or particles where a language has no spaces).
FUNCTION_WORDS = {
    "en": "the of and to in a is that it for on with as was by at from this be are have an or not which had his her they were but been their who has would no when there if more about out up into than them can only other its also after before under over any all some will may must should could did do does we you he she said says",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde está mi porque qué solo han yo hay vez puede todos así nos ni parte según nunca",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wir soll ob",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son ou aux ses mais comme on tout nous sa cette ces être fait été aussi leur bien peut deux même elle si sans entre après avant sous d l n s qu t",
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у свой вы от так за для ты же все тот один было бы о до если или при без об его как т е",
    "hi": "के का की है में को से ने और हैं पर यह कि इस एक नहीं था भी हो कर जो तो ही या थी गया लिए वह क्या कुछ अपना रहेगा",
    "ar": "في من على إلى أن التي الذي هذا هذه عن مع كان لا ما إن هل قد لم كل بعد قبل عام نحو قال بين أو ثم",
    "ja": "の に は を が と で も た し な い さ れ る か ら ま す",
    "zh": "的 了 在 是 不 有 和 人 这 中 会 被 从 说 将 对 为 上 到 与",
    "th": "ที่ ใน ของ ไม่ และ ให้ จาก ออก ได้ มี เป็น การ ถูก ว่า ไว้ กับ",
}
FUNCTION_SETS = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
SPACED_FUNCTION_WORDS = frozenset().union(*(FUNCTION_SETS[x] for x in ("en", "es", "de", "fr", "ru", "hi", "ar")))
# single letters and pairs that names and codes also hold would make anything look like prose
SPACED_FUNCTION_WORDS -= {"d", "l", "n", "s", "t", "e", "am", "an", "no", "so", "se", "me", "a"}

# Marks that end a sentence, and closers that may follow them.
ENDERS = ".!?…。！？｡۔؟।॥"
CLOSERS = "\"'”’»」』）)]›“"

HAN_KANA = re.compile(r"[々-〇぀-ヿ㐀-䶿一-鿿豈-﫿]")
KANA = re.compile(r"[぀-ヿ]")
THAI = re.compile(r"[฀-๿]")
ENDS_LIKE_PROSE = re.compile(rf"[{re.escape(ENDERS)}][{re.escape(CLOSERS)}]*$")


def script_language(text: str) -> str | None:
    """The language that a text's script settles, where it does."""
    if KANA.search(text):
        return "ja"
    for lang, pattern in (("zh", HAN_KANA), ("th", THAI), ("hi", re.compile(r"[ऀ-ॿ]")), ("ar", re.compile(r"[؀-ۿ]")), ("ru", re.compile(r"[Ѐ-ӿ]"))):
        if pattern.search(text):
            return lang
    return None

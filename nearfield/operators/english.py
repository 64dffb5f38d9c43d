"""An English analyzer: stop words and the Porter2 stemmer."""

from __future__ import annotations

import re
from functools import lru_cache
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from nearfield.session import ship

STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
FIXED = frozenset("sky news howe atlas cosmos bias andes".split())
FIXED_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
VOWEL = re.compile("[aeiouy]")
REGION = re.compile("[aeiouy][^aeiouy]")


def regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if first is None:
        m = REGION.search(w)
        first = m.end() if m else len(w)
    m = REGION.search(w, first)
    return first, m.end() if m else len(w)


def short_syllable(w: str) -> bool:
    """Whether w ends in a short syllable."""
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.search("^[aeiouy][^aeiouy]$", w))


@lru_cache(1 << 17)
@lru_cache(1 << 17)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    if word in FIXED:
        return word
    w = re.sub("(^|[aeiouy])y", r"\1Y", word.lstrip("'"))
    r1, r2 = regions(w)
    w = re.sub("'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in FIXED_1A:
        return w
    if w.endswith(("eed", "eedly")):
        cut = 3 if w.endswith("eed") else 5
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    elif m := re.search("(ed|edly|ing|ingly)$", w):
        head = w[: m.start()]
        if VOWEL.search(head):
            w = head
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(DOUBLES):
                w = w[:-1]
            elif short_syllable(w) and r1 >= len(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for end, new in STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end not in ("ogi", "li") or (end == "ogi" and w[at - 1] == "l") or (end == "li" and w[at - 1] in "cdeghkmnrt")):
                w = w[:at] + new
            break
    for end, new in STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ative" or at >= r2):
                w = w[:at] + new
            break
    for end in STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1] in "st"):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not short_syllable(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def analyzed(text: str | None) -> list[str] | None:
    return None if text is None else [stem(t) for t in re.findall(r"[^\W_]+", text.lower()) if t not in STOP]


def english_tokens(text: Column) -> Column:
    """Stemmed words without stop words."""
    ship(SparkSession.active())

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(analyzed)

    return run(text)

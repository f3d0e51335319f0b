"""English stemming after Porter's published algorithm, with some irregular forms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: what a text without stems gives.
UNSTEMMABLE = "[unstemmable]"
#: Stems that stand for irregular forms, and what they become after stemming.
IRREGULAR = dict(pair.split() for pair in """
acadian acadia, african africa, american america, analysi analys, analyz analys, antarctica antarct, asian asia,
australian australia, bacteria bacterium, behaviour behavior, bled bleed, built build, burnt burn, bought bui,
canadian canada, caught catch, chines china, chose choose, colour color, criteria criterion, eaten eat, fallen fall,
fell fall, felt feel, fled flee, men man, women woman, children child, choic choos, dead death, deadli death,
drove drive, driven drive, drainag drain, drank drink, drunk drink, eastern east, failur fail, fertilis fertil,
flew fly, flown fly, forgot forget, forgotten forget, french franc, germani german, healthi health,
indonesian indonesia, influenti influenc, injuri injur, iranian iran, irration irrat, iraqi iraq, japanes japan,
learnt learn, made make, mathemat math, mexican mexico, northern north, norwegian norwai, optimis optim,
persian persia, portugues portug, reduct reduc, registr regist, rose rise, risen rise, russian russia, slept sleep,
spanish spain, southern south, succeed succe, success succe, sang sing, sung sing, sank sink, sunk sink, swede sweden,
swedish sweden, took take, taken take, terrorist terror, thought think, voter vote, wealthi wealth, western west,
wrote write, written write
""".split(","))
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _vowels(word: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c in "aeiou" or (c == "y" and i > 0 and not out[i - 1]))
    return out


def _measure(word: str) -> int:
    v = _vowels(word)
    return sum(a and not b for a, b in zip(v, v[1:], strict=False))


def _ends_cvc(word: str) -> bool:
    v = _vowels(word)
    return len(word) >= 3 and v[-3:] == [False, True, False] and word[-1] not in "wxy"


def stem(word: str) -> str:
    """The stem of a lower-case word; anything but letters stays as it is."""
    w = _porter(word)
    return IRREGULAR.get(w, w)


def _porter(word: str) -> str:
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and any(_vowels(w[: -len(end)])):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and not _vowels(w)[-1] and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _ends_cvc(w):
                    w += "e"
                break
    if w.endswith("y") and any(_vowels(w[:-1])):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for end, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                w = w[: -len(end)] + new if _measure(w[: -len(end)]) > 0 else w
                break
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            left = w[: -len(end)]
            if _measure(left) > 1 and (end != "ion" or left[-1:] in ("s", "t")):
                w = left
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))


def stem_words(text: str) -> str:
    """The stems of the words of a text, without words that have none; UNSTEMMABLE if that leaves nothing.

    Words end at blanks, tabs, line ends, dots and hyphens; a word of anything but ASCII letters has no stem. Suffixes are
    matched in lower case only.
    """
    words = [w for w in re.split("[\t\n .-]+", text) if re.fullmatch("[A-Za-z]+", w)]
    return " ".join(map(stem, words)) or UNSTEMMABLE


@F.pandas_udf(StringType())
def stem_text(texts: pd.Series) -> pd.Series:
    """stem_words of each text; null stays null."""
    return texts.map(lambda t: None if t is None else stem_words(t))

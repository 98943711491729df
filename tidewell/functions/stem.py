"""Porter's stemmer, in two modes: "standard" follows the published algorithm, "classic" keeps four departures of an older
implementation (no iz -> ize; -ion never dropped; any two closing consonants count as double; first listed suffix wins).

Suffix rules are tried in the order of the lists; in both modes the first suffix that fits decides.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP2 = dict(
    x.split(":")
    for x in "ization:ize ational:ate iveness:ive fulness:ful ousness:ous tional:tion biliti:ble entli:ent ousli:ous ation:ate "
    "alism:al aliti:al iviti:ive enci:ence anci:ance izer:ize abli:able alli:al ator:ate eli:e".split()
)
STEP3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ness: ful:".split())
STEP4 = "ement ance ence able ible ment ant ent ion ism ate iti ous ive ize al er ic ou".split()
VOWEL = re.compile("[aeiou]")


def shape(word: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if VOWEL.match(ch) or (ch == "y" and out.endswith("c")) else "c"
    return out


def measure(word: str) -> int:
    return len(re.findall("v+c", shape(word)))


def _double(word: str, classic: bool) -> bool:
    return shape(word[-3:])[-2:] == "cc" and (classic or word[-1] == word[-2])


def _short(word: str) -> bool:
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, rules: dict[str, str]) -> str:
    for end, new in rules.items():
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + new if measure(stem) > 0 else word
    return word


@lru_cache(100_000)
def stem(word: str, mode: str = "standard") -> str:
    classic = mode == "classic"
    if not word or (not classic and len(word) < 3):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = 0
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and "v" in shape(word[:-2]):
        cut = 2
    elif word.endswith("ing") and "v" in shape(word[:-3]):
        cut = 3
    if cut:
        word = word[:-cut]
        if word.endswith(("at", "bl") if classic else ("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and _double(word, classic) and word[-1] not in "lsz":
            word = word[:-1]
        elif measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP2), STEP3)
    for end in STEP4:
        if word.endswith(end):
            rest = word[: -len(end)]
            if measure(rest) > 1 and (end != "ion" or (not classic and rest.endswith(("s", "t")))):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if measure(rest) > 1 or (measure(rest) == 1 and not _short(rest)):
            word = rest
    if measure(word) > 1 and len(word) > 1 and word.endswith("l") and _double(word, classic):
        word = word[:-1]
    return word


def stem_column(word: Column, mode: str = "standard") -> Column:
    @F.pandas_udf(T.StringType())
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: stem(w, mode), na_action="ignore")

    return run(word)

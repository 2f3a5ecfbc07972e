"""Porter's stemmer, from the published description of its five steps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

#: Suffix rules of steps 2 to 4, fixed values.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _measure(w: str) -> int:
    kinds = [_vowel(w, i) for i in range(len(w))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:]))


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _doubled(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


def _short_end(w: str) -> bool:
    return len(w) > 2 and not _vowel(w, len(w) - 1) and _vowel(w, len(w) - 2) and not _vowel(w, len(w) - 3) and w[-1] not in "wxy"


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = next((s for s in ("ed", "ing") if w.endswith(s)), None)
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif cut and _has_vowel(w[: -len(cut)]):
        w = w[: -len(cut)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _doubled(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        s = _longest(w, rules)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + rules[s]
    s = _longest(w, STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stem_words():
    """An Arrow UDF over arrays of words."""

    @F.pandas_udf("array<string>")
    def stems(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in words:
            yield s.map(lambda own: None if own is None else [stem(w) for w in own])

    return stems

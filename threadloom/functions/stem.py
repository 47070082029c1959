"""Tokens and stems: Unicode letters and digits, case-folded, without diacritics, Porter-stemmed."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: str | Column) -> Column:
    """Lower-case runs of letters and digits."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


#: Marks after a letter belong to its token; they go when it is stemmed.
MARKED = r"[\p{L}\p{N}][\p{L}\p{N}\p{Mn}]*"


def word_tokens(text: str | Column) -> Column:
    """The same with combining marks kept on their letters, as the stemmed index takes them."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(MARKED), F.lit(0))


def python_tokens(text: str, marks: bool = False) -> list[str]:
    if marks:
        text = unicodedata.normalize("NFC", text)
        text = "".join(c for c in text if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", text.lower())


def without_marks(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _measure(stem: str) -> int:
    kinds = "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem)))
    return len(re.findall("v+c+", kinds))


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _has_vowel(stem: str) -> bool:
    return any(_vowel(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and not _vowel(w, n - 3) and _vowel(w, n - 2) and not _vowel(w, n - 1) and w[-1] not in "wxy"


# The suffix tables of Porter's published algorithm.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
_LONGEST2, _LONGEST3 = (sorted(t, key=lambda x: -len(x[0])) for t in (_STEP2, _STEP3))
_LONGEST4 = sorted((*_STEP4, "ion"), key=len, reverse=True)


def _replace(w: str, table: list, least: int) -> str:
    for suffix, to in table:
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            return stem + to if _measure(stem) > least else w
    return w


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The stem of a lower-case word; words of other letters than a-z stay as they are."""
    w = word
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and _has_vowel(w[: -len(s)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")) or (_measure(w) == 1 and _cvc(w)):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, _LONGEST2, 0), _LONGEST3, 0)
    for s in _LONGEST4:
        if w.endswith(s):
            stem = w[: len(w) - len(s)]
            if _measure(stem) > 1 and (s != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and w.endswith("ll"):
        w = w[:-1]
    return w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    return porter(without_marks(word.lower()))

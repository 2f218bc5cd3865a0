"""The Porter stemmer, after M. F. Porter, "An algorithm for suffix stripping", 1980."""

from __future__ import annotations

from functools import lru_cache

# The suffix tables of the paper's steps 2, 3 and 4.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _forms(word: str) -> str:
    """c for consonants, v for vowels; y is a vowel behind a consonant."""
    out = ""
    for k, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and k > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant."""
    return _forms(stem).replace("vc", "|").count("|")


def _short_end(word: str) -> bool:
    return _forms(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _forms(word)[-1] == "c"


def _swap(word: str, table, least: int) -> str:
    """The longest suffix of the table that the word ends with is replaced if the stem before it is long enough."""
    for suffix, new in sorted(table, key=lambda p: -len(p[0])):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if suffix == "ion" and stem[-1:] not in ("s", "t"):
                return word
            return stem + new if _measure(stem) > least else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in _forms(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double_end(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _forms(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(word, STEP2, 0)
    word = _swap(word, STEP3, 0)
    word = _swap(word, [(s, "") for s in STEP4], 1)
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if _measure(word) > 1 and _double_end(word) and word.endswith("l"):
        word = word[:-1]
    return word

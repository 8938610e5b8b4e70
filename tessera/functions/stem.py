"""Porter's stemming algorithm (1980, with the author's later revisions to its second step)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The algorithm's suffix tables.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
    "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
_PLAIN = re.compile(r"[a-z]{3,64}")


def shape(word: str) -> str:
    """Each letter as v or c; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def measure(word: str) -> int:
    return len(re.findall("v+c+", shape(word)))


def short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def swap(word: str, table: dict[str, str]) -> str:
    """The longest suffix of the table is replaced if what stands before it has a measure above 0."""
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if measure(stem) > 0 else word
    return word


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words with other characters than a-z, or of fewer than three, stay as they are."""
    if not _PLAIN.fullmatch(word):
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s)), None)
        if cut and "v" in shape(cut):
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif measure(w) == 1 and short(w):
                w += "e"
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    w = swap(swap(w, STEP2), STEP3)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            left = w[: -len(suffix)]
            if measure(left) > 1 and (suffix != "ion" or left[-1:] in ("s", "t")):
                w = left
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def stems(tokens: Column) -> Column:
    """array<string> of words to their stems, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([[stem(w) for w in t] if t is not None else None for t in b])

    return run(tokens)

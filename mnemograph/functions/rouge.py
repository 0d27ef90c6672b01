"""ROUGE-1, -2 and -L of word lists, with Porter's stemmer for English."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

_WORD = re.compile(r"[a-z0-9]+")
# fixed values: suffixes and what they become in the second, third and fourth step of Porter's algorithm
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
SCORES = StructType([StructField(f"{r}_{x}", DoubleType()) for r in ("rouge1", "rouge2", "rougeL") for x in "prf"])


def _shape(word: str) -> str:
    """c for each consonant and v for each vowel; y is a vowel behind a consonant."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _replaced(word: str, table: dict[str, str]) -> str:
    """The longest suffix of the table replaced, if the word before it has a measure of at least one."""
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            before = word[: -len(suffix)]
            return before + table[suffix] if _measure(before) > 0 else word
    return word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            before = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(before):
                word = before
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double_end(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2), STEP_3)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            before = word[: -len(suffix)]
            if _measure(before) > 1 and (suffix != "ion" or before.endswith(("s", "t"))):
                word = before
            break
    if word.endswith("e"):
        n = _measure(word[:-1])
        if n > 1 or (n == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if _measure(word) > 1 and _double_end(word) and word.endswith("l") else word


def words(text: str | None) -> list[str]:
    return [stem(w) if len(w) > 3 else w for w in _WORD.findall((text or "").lower())]


def _prf(same: int, n_predicted: int, n_gold: int) -> tuple[float, float, float]:
    p, r = same / max(1, n_predicted), same / max(1, n_gold)
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def _common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, in memory of one row."""
    if len(a) < len(b):
        a, b = b, a
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rouge(gold: str | None, predicted: str | None) -> tuple[float, ...]:
    g, p = words(gold), words(predicted)
    out: list[float] = []
    for n in (1, 2):
        grams = [Counter(zip(*(x[i:] for i in range(n)))) for x in (p, g)]
        out += _prf(sum((grams[0] & grams[1]).values()), sum(grams[0].values()), sum(grams[1].values()))
    return (*out, *_prf(_common_subsequence(p, g), len(p), len(g)))


@F.pandas_udf(SCORES)
def rouge_scores(gold: pd.Series, predicted: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([rouge(g, p) for g, p in zip(gold, predicted)], columns=SCORES.names)

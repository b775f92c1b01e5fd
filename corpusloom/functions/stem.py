"""Folding and stemming of index terms.  Both run on the distinct vocabulary only, never on token rows."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(term: str) -> str:
    """Lower case without diacritics of single letters."""
    plain = unicodedata.normalize("NFKD", term.lower())
    return "".join(c for c in plain if not unicodedata.combining(c))


def _is_vowel(word: str, i: int) -> bool:
    c = word[i]
    return c in "aeiou" or (c == "y" and i > 0 and not _is_vowel(word, i - 1))


def measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    kinds = [_is_vowel(stem, i) for i in range(len(stem))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:], strict=False))


def _has_vowel(stem: str) -> bool:
    return any(_is_vowel(stem, i) for i in range(len(stem)))


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and not _is_vowel(word, len(word) - 1)


def _short_end(word: str) -> bool:
    n = len(word)
    return n > 2 and not _is_vowel(word, n - 3) and _is_vowel(word, n - 2) and not _is_vowel(word, n - 1) and word[-1] not in "wxy"


# The suffix tables of the published algorithm's steps 2, 3 and 4.
STEP2 = (
    "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate "
    "alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
)
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _table(spec: str) -> list[tuple[str, str]]:
    pairs = [tuple(p.split(":")) if ":" in p else (p, "") for p in spec.split()]
    return sorted(pairs, key=lambda p: -len(p[0]))


_STEP2, _STEP3, _STEP4 = _table(STEP2), _table(STEP3), _table(STEP4)


def _replace(word: str, table: list[tuple[str, str]], least: int) -> str:
    for suffix, new in table:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            if measure(stem) > least and (suffix != "ion" or stem[-1:] in ("s", "t")):
                return stem + new
            return word
    return word


def porter(word: str) -> str:
    """The Porter stem; words under three or over 64 characters stay."""
    if not 3 <= len(word) <= 64:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                stem = word[: -len(suffix)]
                if _has_vowel(stem):
                    if stem.endswith(("at", "bl", "iz")):
                        stem += "e"
                    elif _double_end(stem) and stem[-1] not in "lsz":
                        stem = stem[:-1]
                    elif measure(stem) == 1 and _short_end(stem):
                        stem += "e"
                    word = stem
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, _STEP2, 0)
    word = _replace(word, _STEP3, 0)
    word = _replace(word, _STEP4, 1)
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word


def normalised(terms: list[str], known: dict[str, str]) -> list[str]:
    """The stems of folded ``terms``; ``known`` holds those that were met before, and takes up new ones."""
    out = []
    for term in terms:
        norm = known.get(term)
        if norm is None:
            norm = known[term] = porter(fold(term))
        out.append(norm)
    return out


def normalised_vocabulary(terms: DataFrame, stem: bool = True) -> DataFrame:
    """``term, norm`` for the distinct ``term`` values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            folded = batch["term"].map(fold)
            yield pd.DataFrame({"term": batch["term"], "norm": folded.map(porter) if stem else folded})

    return terms.select("term").distinct().where(F.col("term").isNotNull()).mapInPandas(run, "term string, norm string")

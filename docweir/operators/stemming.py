"""English word stems by Porter's published algorithm (1980), and BM25 over them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexical
from .search import STOP_WORDS

#: Endings and what replaces them, tried from the longest on. Fixed values of the algorithm's steps 2, 3 and 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _kinds(stem: str) -> str:
    """c and v for consonants and vowels; y is a vowel after a consonant."""
    out = ""
    for k, c in enumerate(stem):
        out += "v" if c in "aeiou" or (c == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _kinds(stem)))


def _doubled(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _kinds(stem)[-1] == "c"


def _short_end(stem: str) -> bool:
    return _kinds(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replaced(word: str, endings: dict[str, str], least: int) -> str:
    for end in sorted(endings, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + endings[end] if _measure(stem) > least else word
    return word


def stem(word: str) -> str:
    """The stem of one lower-case word; words of one or two letters and words with other signs than a-z stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and "v" in _kinds(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _kinds(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            word = cut + "e"
        elif _doubled(cut) and cut[-1] not in "lsz":
            word = cut[:-1]
        else:
            word = cut + "e" if _measure(cut) == 1 and _short_end(cut) else cut
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2, 0), STEP_3, 0)
    for end in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(end):
            rest = word[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        m = _measure(rest)
        if m > 1 or (m == 1 and not _short_end(rest)):
            word = rest
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


_stems: dict[str, str] = {}


def stems(text: str) -> list[str]:
    """The stems of a text's folded words; a worker remembers some hundred thousand of them."""
    if len(_stems) > 300_000:
        _stems.clear()
    out = []
    for word in lexical.folded(text):
        found = _stems.get(word)
        if found is None:
            found = _stems[word] = stem(word)
        out.append(found)
    return out


def stemmed_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the stems of each query's words that aren't stop words."""
    kept = lexical.asked_terms(queries, lexical.words, STOP_WORDS)
    return lexical.asked_terms(kept.select("query_id", F.col("term").alias("text")), stems, [])


def stemmed_bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score) over stems, as a full-text index scores: rare stems more, common ones never below a floor.

    docs has id and text, queries query_id and text; words are runs of letters and digits, diacritics folded, stop words of
    queries left out before stemming. Texts are split and stemmed once, in Arrow batches.
    """
    terms = stemmed_terms(queries)
    return lexical.scored(lexical.term_counts(docs, terms, stems), terms, stemmed_rate, k1, b)


def stemmed_rate(docs: Column, df: Column) -> Column:
    log = F.log((docs - df + 0.5) / (df + 0.5))
    return F.when(log <= 0, 1e-6).otherwise(log)


def stemmed_ranked(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k best rows by stemmed_bm25(), rounded to six places, ties by id."""
    return lexical.ranked(docs, stemmed_terms(queries), k, {"stems": stemmed_rate}, stems)["stems"]

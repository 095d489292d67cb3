"""Stemming by the published Porter algorithm (1980), with a dictionary of exceptions before it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusloom.runtime import ship

#: Suffix and replacement of steps 2, 3 and 4, longest match first.
STEP_2 = [
    ("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"),
    ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"),
    ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("ator", "ate"), ("eli", "e"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"]


def _shape(word: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(word):
        vowel = letter in "aeiou" or letter == "y" and k > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double_end(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _swap(word: str, rules: list[tuple[str, str]]) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


def porter(word: str) -> str:
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
            stem = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(stem):
                if stem.endswith(("at", "bl", "iz")):
                    stem += "e"
                elif _double_end(stem) and stem[-1] not in "lsz":
                    stem = stem[:-1]
                elif _measure(stem) == 1 and _short_end(stem):
                    stem += "e"
                word = stem
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP_2), STEP_3)
    for suffix in STEP_4:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _short_end(stem):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stem_token(word: str, exceptions: dict[str, str] | None = None) -> str:
    """Tokens of up to three characters stay; exceptions come before the rules."""
    if len(word) <= 3:
        return word
    return exceptions[word] if exceptions and word in exceptions else porter(word)


#: Rows of a table of exceptions that arrays of tokens can be stemmed with: about 30 MB on each executor.
MOST_EXCEPTIONS = 200_000


def stem_terms(terms: DataFrame, exceptions: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """(term, stem) of distinct terms. Exceptions are a dictionary or a table (word, stem) of any size, joined by word; words of
    up to three characters stay either way."""
    ship(terms.sparkSession)
    table = isinstance(exceptions, DataFrame)
    known = None if table else exceptions

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda w: stem_token(w, known))

    out = terms.select("term", run("term").alias("stem"))
    if not table:
        return out
    special = exceptions.select(F.col("word").alias("term"), F.col("stem").alias("special")).filter(F.char_length("term") > 3)
    return out.join(special, "term", "left").select("term", F.coalesce("special", "stem").alias("stem"))


def stem_columns(rows: DataFrame, columns: list[str], exceptions: dict[str, str] | DataFrame | None = None, nested: bool = False) -> DataFrame:
    """Stem arrays of tokens (nested: of sentences of tokens), each distinct token of a batch once. Exceptions are a
    dictionary or a table (word, stem) of at most MOST_EXCEPTIONS rows; a larger one is an error: stem distinct terms with `stem_terms`."""
    ship(rows.sparkSession)
    if isinstance(exceptions, DataFrame):
        found = exceptions.limit(MOST_EXCEPTIONS + 1).collect()
        if len(found) > MOST_EXCEPTIONS:
            raise ValueError(f"more than {MOST_EXCEPTIONS} exceptions")
        exceptions = {r["word"]: r["stem"] for r in found}

    @F.pandas_udf("array<array<string>>")
    def run_nested(s: pd.Series) -> pd.Series:
        known = {w: stem_token(w, exceptions) for w in {w for x in s for y in x for w in y}}
        return s.map(lambda x: [[known[w] for w in y] for y in x])

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        known = {w: stem_token(w, exceptions) for w in {w for x in s for w in x}}
        return s.map(lambda x: [known[w] for w in x])

    for c in columns:
        rows = rows.withColumn(c, run_nested(c) if nested else run(c))
    return rows

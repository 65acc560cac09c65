"""Stemmers by the published algorithms: Porter (1980) and Snowball's Russian."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CYRILLIC = re.compile("[а-я]")


_SHAPES = bytes(ord("v") if chr(i) in "aeiou" else ord("y") if chr(i) == "y" else ord("c") for i in range(256))


def _shape(word: str) -> bytes:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    shape = word.encode("latin-1", "replace").translate(_SHAPES)
    if b"y" not in shape:
        return shape
    out = bytearray(shape)
    for i, c in enumerate(shape):
        if c == 121:  # y
            out[i] = 118 if i and out[i - 1] == 99 else 99  # v after c, else c
    return bytes(out)


def _measure(stem: str) -> int:
    return _shape(stem).count(b"vc")


def _short(stem: str) -> bool:
    return len(stem) > 2 and _shape(stem)[-3:] == b"cvc" and stem[-1] not in "wxy"


def _swap(word: str, table: dict[str, str], ends: tuple[str, ...], least: int) -> str:
    """Replace the longest suffix of ``table``, whose keys are ``ends``, if the rest measures over ``least``."""
    if not word.endswith(ends):
        return word
    suffix = next(word[-n:] for n in range(min(len(word), 7), 0, -1) if word[-n:] in table)
    rest = word[: -len(suffix)]
    return rest + table[suffix] if _measure(rest) > least else word


# The suffixes of the published algorithm's steps 2, 3 and 4, with what takes their place.
_STEP2 = dict((
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
))
_STEP3 = dict((("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")))
_STEP4 = dict.fromkeys(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"), "")
_ENDS2, _ENDS3, _ENDS4 = tuple(_STEP2), tuple(_STEP3), tuple(_STEP4)


def stem_english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and b"v" in _shape(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1:] == b"c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and b"v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2, _ENDS2, 0), _STEP3, _ENDS3, 0)
    if word.endswith("ion") and not word.endswith(_ENDS4):
        word = word[:-3] if word[-4:-3] in ("s", "t") and _measure(word[:-3]) > 1 else word
    else:
        word = _swap(word, _STEP4, _ENDS4, 1)
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


# Vowels and endings of the published algorithm; endings of a first group stand after а or я only.
_VOWELS = "аеиоуыэюя"
_GERUND = (("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись"))
_ADJECTIVE = ((), ("ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "его", "ого", "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею"))
_PARTICIPLE = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
_REFLEXIVE = ((), ("ся", "сь"))
_VERB = (("ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно"), ("ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю"))
_NOUN = ((), ("а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я"))


def _cut(rv: str, groups: tuple[tuple[str, ...], tuple[str, ...]]) -> str | None:
    """``rv`` without its longest ending; those of the first group need а or я before them."""
    best = max((s for g in groups for s in g if rv.endswith(s)), key=len, default=None)
    if best is None:
        return None
    rest = rv[: -len(best)]
    return rest if best not in groups[0] or rest.endswith(("а", "я")) else None


def stem_russian(word: str) -> str:
    first = next((i for i, c in enumerate(word) if c in _VOWELS), None)
    if first is None:
        return word
    head, rv = word[: first + 1], word[first + 1 :]
    region = re.compile(f"[{_VOWELS}][^{_VOWELS}]")
    one = region.search(word)
    two = region.search(word, one.end()) if one else None
    r2 = two.end() if two else len(word)

    found = _cut(rv, _GERUND)
    if found is None:
        rv = _cut(rv, _REFLEXIVE) if _cut(rv, _REFLEXIVE) is not None else rv
        adjective = _cut(rv, _ADJECTIVE)
        if adjective is not None:
            participle = _cut(adjective, _PARTICIPLE)
            found = adjective if participle is None else participle
        else:
            verb = _cut(rv, _VERB)
            found = verb if verb is not None else _cut(rv, _NOUN)
    rv = rv if found is None else found
    rv = rv[:-1] if rv.endswith("и") else rv
    for suffix in ("ость", "ост"):
        if rv.endswith(suffix) and len(head) + len(rv) - len(suffix) >= r2:
            rv = rv[: -len(suffix)]
            break
    for suffix in ("ейше", "ейш"):
        if rv.endswith(suffix):
            rv = rv[: -len(suffix)]
            return head + (rv[:-1] if rv.endswith("нн") else rv)
    return head + (rv[:-1] if rv.endswith(("нн", "ь")) else rv)


def stem(token: str) -> str:
    if not token.isascii() and _CYRILLIC.search(token):
        return stem_russian(token)
    return token if token.isdigit() else stem_english(token)


#: Stems that a worker remembers.
MEMORY = 500_000
_known: dict[str, str] = {}


def remembered(token: str) -> str:
    found = _known.get(token)
    if found is None:
        if len(_known) >= MEMORY:
            _known.clear()
        found = _known[token] = stem(token)
    return found


def stemmed(terms: Column) -> Column:
    """An array of terms with each in its stem, for few rows; many are better joined with ``stem_table``."""

    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ts: None if ts is None else [remembered(t) for t in ts])

    return F.pandas_udf(run, "array<string>")(terms)


def stem_table(terms: DataFrame) -> DataFrame:
    """(term, stem) of the distinct values of ``terms(term)``: each is stemmed once, to be joined back."""

    def run(column: pd.Series) -> pd.Series:
        return column.map(stem)

    return terms.select("term").distinct().withColumn("stem", F.pandas_udf(run, "string")("term"))

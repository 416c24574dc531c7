"""Folded words of a text as Column expressions (no Python in the plan)."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinequery.functions.characters import CODE_POINTS, java_ranges


@cache
def _base_letters() -> tuple[str, str, dict[str, str]]:
    """Characters whose folded form is another single character, those forms, and the characters (by form) that fold to several."""
    source, target = [], []
    several: dict[str, str] = {}
    for code in CODE_POINTS:
        c = chr(code)
        if code < 0x80 or 0xAC00 <= code < 0xD7A4:
            continue
        lowered = c.casefold().replace("đ", "d")
        plain = "".join(x for x in unicodedata.normalize("NFD", lowered) if unicodedata.category(x) != "Mn")
        if len(plain) == 1 and plain != c.lower():
            source.append(c), target.append(plain)
        elif len(plain) > 1 and plain != c.lower():
            several[plain] = several.get(plain, "") + c
    return "".join(source), "".join(target), several


def fold(text: Column) -> Column:
    """Case folded, d-stroke as d, canonically decomposed, nonspacing marks dropped. Hangul syllables stay whole."""
    source, target, several = _base_letters()
    def spelled(x: Column) -> Column:
        for plain, letters in several.items():
            x = F.regexp_replace(x, f"[{letters}]", plain)
        return x

    # Few texts hold a ligature or another letter that folds to several; only these go through the replacements.
    # The lambda keeps them out of the generated code of all others.
    rare = F.when(F.rlike(text, F.lit(f"[{''.join(several.values())}]")), F.array(text))
    text = F.coalesce(F.transform(rare, spelled)[0], text)
    plain = F.translate(F.translate(F.lower(text), source, target), "đ", "d")
    return F.regexp_replace(plain, r"\p{Mn}+", "")


def tokens(text: Column) -> Column:
    """Folded runs of letters, digits and ``_``, in order. Null for null."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def words_key(text: Column) -> Column:
    """The words joined by one space: equal for lines that differ in case, marks and punctuation only."""
    return F.array_join(tokens(text), " ")


@cache
def _maybe_uncomposed() -> str:
    """Class of the characters that a composed text does not hold, or may hold as part of something to compose."""
    alone = lambda c: not unicodedata.is_normalized("NFC", c)
    joins = lambda c: unicodedata.combining(c) or unicodedata.category(c)[0] == "M" or "\u1161" <= c <= "\u11ff"
    return java_ranges(lambda c: alone(c) or bool(joins(c)))


@cache
def _composer():
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def compose(texts):
        import pyarrow as pa

        return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    return compose


def composed(text: Column) -> Column:
    """In normal form C. Only texts with a character that may compose leave the JVM."""
    doubtful = F.when(F.rlike(text, F.lit(f"[{_maybe_uncomposed()}]")), text)
    return F.coalesce(_composer()(doubtful), text)


def tidy(text: Column) -> Column:
    """In composed form, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(composed(text), r"(?U)\s+", " "))


def contains_phrase(text: Column, phrases: list[str]) -> Column:
    """Whether the tidied text holds one of the phrases, whatever the case."""
    low = F.lower(tidy(text))
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(low, F.lit(" ".join(phrase.casefold().split())))
    return found

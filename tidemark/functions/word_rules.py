"""Rules on words: phrase lists, phrases near each other, starts and ends. All native.

Rules name words in plain lists; the expressions that look for them are put together here. A phrase's words may stand
apart by any white space or hyphen, letters of either case are the same, and only whole words count.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import bound

GAP = r"[\s\-]+"


def one_of(phrases: Iterable[str]) -> str:
    """An expression for any of the phrases; a word that ends in ``*`` stands for all that begin so."""
    word = lambda w: re.escape(w[:-1]) + r"\w*" if w.endswith("*") else re.escape(w)
    return "(?:" + "|".join(GAP.join(map(word, p.split())) for p in phrases) + ")"


def whole(expression: str) -> str:
    return rf"(?<!\w){expression}(?!\w)"


def then(first: Iterable[str], second: Iterable[str], most: int) -> str:
    """An expression for a phrase of ``first``, at most ``most`` words, and a phrase of ``second``."""
    return whole(rf"{one_of(first)}(?:\W+\w+){{0,{most}}}?\W+{one_of(second)}")


def says(text: Column, *expressions: str) -> Column:
    """Does the text hold one of the expressions, in letters of either case?"""
    return text.rlike("(?i)" + "|".join(f"(?:{e})" for e in expressions))


def holds(text: Column, phrases: Iterable[str]) -> Column:
    return says(text, whole(one_of(phrases)))


def near(text: Column, first: Iterable[str], second: Iterable[str], most: int) -> Column:
    """The two meet in either order, ``most`` words or fewer between them."""
    return says(text, then(first, second, most), then(second, first, most))


def bare(text: Column) -> Column:
    """The words as a-z and 0-9 in lower case, apostrophes dropped, a blank before and behind each."""
    t = F.regexp_replace(F.lower(F.translate(F.coalesce(text, F.lit("")), "'’", "")), "[^a-z0-9]+", " ")
    return F.concat(F.lit(" "), F.trim(t), F.lit(" "))


def either(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def within(spaced: Column, phrases: Iterable[str]) -> Column:
    """``spaced`` by ``bare`` holds one of the phrases."""
    return bound(spaced, lambda s: either(s.contains(f" {p} ") for p in phrases))


def begins(spaced: Column, phrases: Iterable[str]) -> Column:
    return bound(spaced, lambda s: either(s.startswith(f" {p} ") for p in phrases))


def ends(spaced: Column, phrases: Iterable[str]) -> Column:
    return bound(spaced, lambda s: either(s.endswith(f" {p} ") for p in phrases))


def skip(words: Column, *optional: str) -> Column:
    """An array of words without its first one if that is among the optional ones."""
    return F.when(F.get(words, F.lit(0)).isin(*optional), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)

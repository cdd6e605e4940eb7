"""Compatibility decomposition without marks as native expressions; the tables are built from Python's Unicode data.

Marks go whatever their order, so the fold of a text is the fold of its code points one after the other. Most code points
become one letter or nothing, which ``translate`` does; texts with one that becomes several letters are taken apart.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import bound

HANGUL = (0xAC00, 0xD7A3)


def decomposed(text: str) -> str:
    """The fold of a text in Python, which the expression equals."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@cache
def _tables() -> tuple[str, str, dict[str, str]]:
    """Code points that become one other letter and those letters, behind them those that go; and those that become several."""
    one, gone, several = {}, [], {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1))):
        if HANGUL[0] <= ord(c) <= HANGUL[1]:
            continue
        d = decomposed(c)
        if d == c:
            continue
        if len(d) == 1:
            one[c] = d
        elif d:
            several[c] = d
        else:
            gone.append(c)
    return "".join(one) + "".join(gone), "".join(one.values()), several


def _syllable(c: Column) -> Column:
    """The letters of a Hangul syllable, by the arithmetic of their code points."""
    n = F.ascii(c) - HANGUL[0]
    letter = lambda first, count, i: F.substring(F.lit("".join(map(chr, range(first, first + count)))), i.cast("int") + 1, F.lit(1))
    tail = F.when(n % 28 == 0, "").otherwise(letter(0x11A7, 28, n % 28))
    return F.concat(letter(0x1100, 19, F.floor(n / 588)), letter(0x1161, 21, F.floor(n % 588 / 28)), tail)


def fold_marks(c: Column) -> Column:
    """NFKD without combining marks, all in the JVM; null stays null."""
    before, after, several = _tables()
    parts = F.map_from_arrays(F.split(F.lit("\0".join(several)), "\0"), F.split(F.lit("\0".join(several.values())), "\0"))
    hangul = f"[\\x{{{HANGUL[0]:x}}}-\\x{{{HANGUL[1]:x}}}]"
    one = lambda x: F.when(x.rlike(hangul), _syllable(x)).otherwise(F.coalesce(F.try_element_at(parts, x), x))
    apart = lambda x: F.array_join(F.transform(F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0)), one), "")
    plain = lambda x: F.octet_length(x) == F.length(x)
    # An expression with thousands of code points costs a test of each a letter, so only texts that translate leaves
    # beyond ASCII are asked, and by a table.
    wide = lambda x: (F.translate(x, "".join(several), "") != x) | x.rlike(hangul)
    rest = lambda x: F.when(plain(x) | ~wide(x), x).otherwise(apart(x))
    return bound(c, lambda x: F.when(plain(x), x).otherwise(bound(F.translate(x, before, after), rest)))

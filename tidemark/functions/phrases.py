"""Many phrases in one reading of each text: an automaton over all of them, and rules over what it found.

``hits`` gives each text the numbers of the phrases it holds; how many there are hardly matters to the time, since the
automaton follows all at once. Whatever asks "does the text hold one of these" is then a native test on small arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import STOP_WORDS

FOUND = "struct<title:array<int>,body:array<int>,whole:array<int>>"


def plain(s: str | None) -> str:
    """``text.plain`` for a phrase of the taxonomy."""
    return re.sub("[^a-z0-9]+", " ", (s or "").lower()).strip()


def tokens(s: str | None) -> list[str]:
    return list(dict.fromkeys(w for w in plain(s).split(" ") if len(w) >= 2 and w not in STOP_WORDS))


class Lexicon:
    """The phrases and single words that rules ask for, each with a number; blank phrases have none."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}

    def add(self, *phrases: str | None) -> list[int]:
        return [self.number.setdefault(p, len(self.number)) for p in dict.fromkeys(map(plain, phrases)) if p]


def find(patterns: dict[str, int], texts: Iterable[tuple[str, str]]) -> Iterable[tuple[list[int], list[int], list[int]]]:
    """For each pair of normalised texts the phrases in the first, in the second, and in both read as one."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    for p, i in patterns.items():
        # Blanks stand at both ends of phrases and texts, so only whole words are met.
        auto.add_word(f" {p} ", (i, len(p)))
    if patterns:
        auto.make_automaton()
    for title, body in texts:
        first, second, whole = set(), set(), set()
        if patterns:
            bound = len(title) + 1 if title else 0  # where the second text's words begin
            for end, (i, n) in auto.iter(f" {title} {body} " if title and body else f" {title}{body} "):
                whole.add(i)
                if end <= bound:
                    first.add(i)
                elif end - 1 - n >= bound:
                    second.add(i)
        yield sorted(first), sorted(second), sorted(whole)


def hits(lexicon: Lexicon, title: Column, body: Column) -> Column:
    """struct<title, body, whole>: numbers of the phrases that two texts hold, and that both hold read as one.

    The texts come normalised by ``text.plain``; null counts as empty. The lexicon travels with the function and is
    bounded by the taxonomy, not by the data.
    """
    patterns = dict(lexicon.number)

    @F.arrow_udf(FOUND)
    def run(t: pa.Array, b: pa.Array) -> pa.Array:
        rows = [dict(zip(("title", "body", "whole"), x)) for x in find(patterns, ((x or "", y or "") for x, y in zip(t.to_pylist(), b.to_pylist())))]
        ids = pa.list_(pa.int32())
        return pa.array(rows, pa.struct([("title", ids), ("body", ids), ("whole", ids)]))

    return run(title, body)


def rules_of(lexicon: Lexicon, name: str, aliases: list[str], positives: list[str], exclusions: list[str], groups: list[list[str]], broad: bool) -> dict:
    """A category as numbers of the lexicon: what ``score`` compares with what a text holds."""
    own = tokens(" ".join([name, *aliases]))
    single = len(tokens(name)) == 1
    return {
        "field": name,
        "main": lexicon.add(name, *aliases),
        "positive": lexicon.add(*positives),
        "excluded": lexicon.add(*exclusions),
        "concepts": [lexicon.add(*g) for g in groups],
        "own": lexicon.add(*own),
        "broad": bool(broad) and not groups and not positives,
        "single": single,
    }


RULES = "field string, main array<int>, positive array<int>, excluded array<int>, concepts array<array<int>>, own array<int>, broad boolean, single boolean"


def score(found: Column, rule: Column) -> Column:
    """struct<lexical, concept, combined, decision, matched>: how well a text fits a category, from what it holds.

    A name or alias in the title gives 96, another phrase 86, in the body 88 and 76; without a phrase the share r of the
    category's words gives 55 + 35 r (title) or 45 + 30 r (body) from r = 0.6 on. Concept groups count by hits. A broad
    category without groups and positive terms counts for review only, without a phrase or if its name is one word.
    ``matched`` has the numbers of the phrases met, main ones first.
    """
    title, body, whole = found["title"], found["body"], found["whole"]
    met = lambda where, ids: F.arrays_overlap(where, ids)
    share = lambda where: F.when(F.size(rule["own"]) > 0, F.size(F.array_intersect(rule["own"], where)) / F.size(rule["own"])).otherwise(0.0)
    tm, tp, bm, bp = met(title, rule["main"]), met(title, rule["positive"]), met(body, rule["main"]), met(body, rule["positive"])
    rt, rb = share(title), share(body)
    lexical = F.when(tm, 96.0).when(tp, 86.0).when(bm, 88.0).when(bp, 76.0).when(rt >= 0.6, 55 + 35 * rt).when(rb >= 0.6, 45 + 30 * rb).otherwise(0.0)
    n = F.size(rule["concepts"])
    base = F.struct(lexical.alias("l"), F.size(F.filter(rule["concepts"], lambda g: met(whole, g))).alias("hits"), (tm | tp | bm | bp).alias("phrase"), met(whole, rule["excluded"]).alias("out"))

    def judge(x: Column) -> Column:
        lex = x["l"]
        concept = F.when(n > 0, 100.0 * x["hits"] / n).otherwise(F.when(lex > 0, F.least(F.lit(100.0), lex + 5)).otherwise(0.0))
        raw = F.greatest(lex, 0.65 * lex + 0.35 * concept)
        unmet = (n > 0) & (x["hits"] < n)
        loose = rule["broad"] & (~x["phrase"] | rule["single"])
        combined = F.round(F.when(x["out"], F.least(raw, F.lit(20.0))).when(unmet | loose, F.least(raw, F.lit(54.0))).otherwise(raw), 2)
        decision = F.when((combined >= 65) & ~x["out"] & ~unmet & ~loose, "AUTO_ACCEPTED").when(combined >= 45, "REVIEW_REQUIRED").otherwise("AUTO_REJECTED")
        said = F.array_intersect(F.array_union(rule["main"], rule["positive"]), F.array_union(title, body))
        return F.struct(F.round(lex, 2).alias("lexical"), F.round(concept, 2).alias("concept"), combined.alias("combined"), decision.alias("decision"), said.alias("matched"))

    return F.transform(F.array(base), judge)[0]

"""Quality rules: a threshold table compiled into one projection of native expressions.

The measures of a text (lengths, symbols, stop words, lines, repeats) are columns without user functions; the rules
are rows (name, measure, least, most) that become one boolean each and one verdict.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BREAK_RUN, let, words

# Very frequent words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by at from are this he his or not "
    "de la le les des et en un une est que qui dans pour sur pas du par au "
    "der die das und ist von den mit ein zu auf im nicht sich des dem eine als "
    "el los las del y por con para una se su al lo como más no es"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only if ``measure`` is between ``least`` and ``most``; None leaves that side open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("long_enough", "n_words", least=50),
    Rule("few_repeats", "repeat_percent", most=50),
    Rule("usual_words", "mean_word_chars", least=1.5, most=15),
    Rule("few_symbols", "symbol_ratio", most=0.1),
    Rule("stop_words", "stop_ratio", least=0.02),
    Rule("few_equal_lines", "dup_line_ratio", most=0.3),
)


def _repeat_words(w: Column) -> Column:
    """Words in three-word windows that occur twice or more in ``w``.

    Windows are first compared by 33 bits of a hash, sorted together with their positions as plain longs; those with
    an equal neighbour are compared by their words, so a collision never counts.
    """

    def window(i: Column) -> list[Column]:
        return [F.get(w, i + j) for j in range(3)]

    def twins(sorted_keys: Column, key) -> Column:
        def beside(x: Column, j: Column) -> Column:
            return F.coalesce(key(x) == key(F.get(sorted_keys, j - 1)), F.lit(False)) | F.coalesce(key(x) == key(F.get(sorted_keys, j + 1)), F.lit(False))

        return F.filter(sorted_keys, beside)

    high = F.lit(-(1 << 31)).cast("long")
    hashes = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(*window(i)).bitwiseAND(high).bitwiseOR(i.cast("long"))))
    seen = let(hashes, lambda h: twins(h, lambda x: F.shiftright(x, 31)))
    spelled = F.sort_array(F.transform(seen, lambda k: let(k.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"), lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("w"), i.alias("i")))))
    same = let(spelled, lambda s: twins(s, lambda x: x["w"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return F.when(F.size(w) >= 3, covered).otherwise(0)


def measures(text: Column, w: Column) -> dict[str, Column]:
    """The counts of a text, each as an expression; ``w`` is an array of its words that costs nothing to read again."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.regexp_replace(t, BREAK_RUN, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_repeat_words": _repeat_words(w).cast("long"),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
    }


def ratios(m: Callable[[str], Column]) -> dict[str, Column]:
    """What the rules compare; ``m`` gives a count by its name."""
    per_word = F.greatest(m("n_words"), F.lit(1))
    return {
        "repeat_percent": 100 * m("n_repeat_words") / per_word,
        "mean_word_chars": m("word_chars") / per_word,
        "symbol_ratio": m("n_symbols") / per_word,
        "stop_ratio": m("n_stop_words") / per_word,
        "dup_line_ratio": m("n_dup_lines") / F.greatest(m("n_lines"), F.lit(1)),
    }


def verdict(m: Callable[[str], Column], rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(kept, names of the rules that fail); ``m`` gives a count or ratio by its name."""
    fails = []
    for r in rules:
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (m(r.measure) < r.least)
        if r.most is not None:
            bad = bad | (m(r.measure) > r.most)
        fails.append((bad, r.name))
    kept = F.lit(True)
    for bad, _ in fails:
        kept = kept & ~bad
    return kept, F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in fails]))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, then every measure, ``failed_rules`` and ``kept``; one row per row of ``docs``.

    Null, empty and blank texts have no words: all counts are 0 and they fail the length rule. No shuffle, no cap:
    the cost of a text is its length times the logarithm of its length.
    """
    base = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text"))
    base = base.select(*keep, "__text", words(F.col("__text")).alias("__words"))
    counts = measures(F.col("__text"), F.col("__words"))
    base = base.select(*keep, *[v.alias(k) for k, v in counts.items()])
    more = ratios(F.col)
    base = base.select(*keep, *counts, *[v.alias(k) for k, v in more.items()])
    kept, failed = verdict(F.col, rules)
    return base.select(*keep, *counts, *more, failed.alias("failed_rules"), kept.alias("kept"))


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts pass every rule, with their own columns.

    The rules are applied to an array of one row and its counts, so that the optimizer can't move a copy of the
    counts' expressions into a filter below.
    """
    text = F.col(f"`{text_col}`").cast("string")
    counted = let(words(text), lambda w: F.struct(*[v.alias(k) for k, v in measures(text, w).items()]))

    def passes(x: Column) -> Column:
        more = ratios(lambda k: x["m"][k])
        return verdict(lambda k: more[k] if k in more else x["m"][k], rules)[0]

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(F.explode(F.filter(F.array(F.struct(row.alias("row"), counted.alias("m"))), passes)).alias("__x")).select("__x.row.*")

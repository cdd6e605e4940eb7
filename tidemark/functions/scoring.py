"""Scores as column expressions: taxonomy match, profiles, lanes, back-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import phrases
from tidemark.functions.text import SCORE_STOP_WORDS, plain, token_run, tokens


def classify(docs: DataFrame, title: str, body: str, categories: list[tuple]) -> DataFrame:
    """Every row of ``docs`` with every category: its columns, ``field`` and ``m``, what ``phrases.score`` says.

    ``categories`` are (name, aliases, positives, exclusions, concept groups, broad), a list that the caller bounds. A
    text is read once, for the phrases of all categories together; the categories meet small arrays of numbers.
    """
    lexicon = phrases.Lexicon()
    rules = [phrases.rules_of(lexicon, *c) for c in categories]
    found = phrases.hits(lexicon, plain(F.col(title)), plain(F.col(body)))
    taxonomy = docs.sparkSession.createDataFrame([tuple(r.values()) for r in rules], phrases.RULES)
    rule = F.struct(*[taxonomy[c] for c in taxonomy.columns])
    j = docs.withColumn("__found", found).crossJoin(F.broadcast(taxonomy.select(rule.alias("__rule"))))
    return j.select(*docs.columns, F.col("__rule.field").alias("field"), phrases.score(F.col("__found"), F.col("__rule")).alias("m"))


def profiles(evidence: DataFrame, by: list[str], score: str, year: str, now_year: int) -> DataFrame:
    """Expertise, activity and status of each group from scored, dated evidence; one grouped pass.

    Ages weigh 1, 0.85, 0.65 and 0.4 up to 3, 6, 10 and more years; a missing year counts as 11 years and never recent.
    """
    age = F.coalesce(F.lit(now_year) - F.col(year), F.lit(11))
    recent = F.col(year).isNotNull() & (age <= 6)
    weight = F.when(age <= 3, 1.0).when(age <= 6, 0.85).when(age <= 10, 0.65).otherwise(0.4)
    g = evidence.groupBy(*by).agg(F.max(score).alias("top"), F.count(F.lit(1)).alias("n"), F.count_if(recent).alias("n_recent"), F.max(F.when(recent, F.col(score))).alias("top_recent"), F.max(F.col(score) * weight).alias("weighted"))
    status = F.when((F.col("n_recent") > 0) & ((F.col("top_recent") >= 85) | (F.col("n_recent") >= 2)), "CURRENTLY_ACTIVE").when(F.col("n_recent") > 0, "EMERGING_AREA").when(F.col("n") >= 2, "ESTABLISHED_EXPERTISE").otherwise("HISTORICAL_ONLY")
    expertise = F.round(F.least(F.lit(100.0), F.col("top") + F.least(F.lit(15), 3 * (F.col("n") - 1))), 2)
    activity = F.round(F.least(F.lit(100.0), F.col("weighted") + F.least(F.lit(12), 2 * (F.col("n_recent") - 1))), 2)
    return g.select(*by, "n", "n_recent", expertise.alias("expertise"), activity.alias("activity"), status.alias("status"))


def admit(evidence: DataFrame, by: list[str], score: str, year: str, now_year: int) -> DataFrame:
    """Groups with a recent score of 85, two of 65, or one of 92; scored by the best and the number."""
    recent = F.col(year).isNotNull() & (F.lit(now_year) - F.col(year) <= 6)
    g = evidence.groupBy(*by).agg(F.max(score).alias("best"), F.count_if(F.col(score) >= 65).alias("n"), F.count_if(recent & (F.col(score) >= 85)).alias("fresh"))
    return g.where("fresh > 0 or n >= 2 or best >= 92").select(*by, F.round(F.least(F.lit(100.0), F.col("best") + F.least(F.lit(15), 3 * F.greatest(F.col("n") - 1, F.lit(0)))), 2).alias("score"))


def score_document(title: Column, body: Column, query: Column) -> Column:
    """100 for the query in the title, 85 in the body, else by the share r of its tokens from 0.75 on: 60 + 30 r, 45 + 25 r.

    Query and texts are compared as runs of tokens without stop words, so a phrase is found across them.
    """
    run, q = token_run(query), tokens(query, SCORE_STOP_WORDS)

    def met(c: Column) -> Column:
        kept = F.filter(F.split(plain(c), " "), lambda x: (F.length(x) >= 2) & ~x.isin(*SCORE_STOP_WORDS))
        share = lambda k: F.when(F.size(q) > 0, F.size(F.array_intersect(q, k)) / F.size(q)).otherwise(0.0)
        return F.transform(F.array(kept), lambda k: F.struct(((run != "") & F.array_join(k, " ").contains(run)).alias("held"), share(k).alias("r")))[0]

    def points(x: Column) -> Column:
        t, b = x["t"], x["b"]
        return F.when(t["held"], 100.0).when(b["held"], 85.0).when(t["r"] >= 0.75, 60 + 30 * t["r"]).when(b["r"] >= 0.75, 45 + 25 * b["r"]).otherwise(0.0)

    # Each text is normalised once, however many rules look at it.
    return F.round(F.transform(F.array(F.struct(met(title).alias("t"), met(body).alias("b"))), points)[0], 2)


def interest_score(combined: Column, confidence: Column, status: Column) -> Column:
    """A category score from stated interests, weighed by confidence and capped by where the interests come from."""
    # The caps.
    cap = F.when(status.isin("OFFICIAL_INTERESTS", "MANUAL_REVIEWED"), 62.0).when(status == "PAPER_DERIVED", 58.0).when(status == "BIOGRAPHY_DERIVED", 52.0).otherwise(45.0)
    return F.least(cap, F.round(combined * (0.55 + 0.15 * F.coalesce(confidence, F.lit(0.0))), 2))


def grant_boost(title: Column) -> Column:
    """40 for a first award, 30 for a career award, 15 for any other."""
    return F.when(F.upper(title).contains("CRII"), 40).when(F.upper(title).contains("CAREER"), 30).otherwise(15)


def prospect_score(n: Column, cites: Column, recency: Column) -> Column:
    """At most 40: 18, and by the number of works (12 at most), citations (5 at most) and recency."""
    return F.least(F.lit(40.0), 18 + F.least(F.lit(12), 4 * n) + F.least(F.lit(5.0), cites / 20) + recency)


def long_retry(attempts: Column, most: int, delay: Column) -> Column:
    """Six hours or more while attempts remain, nothing after."""
    return F.when(attempts < most, F.greatest(F.lit(21600), F.coalesce(delay, F.lit(0)).cast("long")))


def organic(kind: Column, verified: Column) -> Column:
    return F.when((kind == "official") & verified, 100).when(kind == "official", 95).when(kind == "member", 60).otherwise(0)


def backoff(attempts: Column, requested: Column | None = None) -> Column:
    """Seconds before the next try: 15 doubling up to an hour, or what a server asked for, up to six."""
    base = F.least(F.lit(3600), (15 * F.pow(F.lit(2.0), attempts - 1)).cast("long"))
    return F.least(F.lit(21600), F.greatest(base, F.coalesce(requested, F.lit(0)))).cast("long")


def fair_offset(key: Column, n: int) -> Column:
    """A stable place among n, from the first eight hex digits of a hash."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % n).cast("int")


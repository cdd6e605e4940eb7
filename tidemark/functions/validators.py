"""Checks of extracted answers and decisions against their evidence; all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import names_institution, same_person
from tidemark.functions.text import jaccard, plain, tokens
from tidemark.functions.urls import host, within


def grounded(quotes: Column, source: Column) -> Column:
    """Every quote, its white space evened, stands in the source; no quote at all is not grounded."""
    even = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.coalesce((F.size(quotes) > 0) & F.forall(quotes, lambda q: (even(q) != "") & even(source).contains(even(q))), F.lit(False))


def fit_labels(labels: Column, most: int = 8) -> Column:
    """Labels of 2 to 80 characters and 8 words at most, distinct, ``most`` of them."""
    good = F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: F.length(x).between(2, 80) & (F.size(F.split(x, r"\s+")) <= 8))
    return F.slice(F.array_distinct(good), 1, most)


def one_decision_each(candidates: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """(key, problem): candidates without a decision or with several, and decisions on no candidate."""
    d = decisions.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    j = candidates.select(key, F.lit(True).alias("asked")).join(d, key, "full")
    problem = F.when(F.col("asked").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "several")
    return j.select(key, problem.alias("problem")).where("problem is not null")


def supported_areas(titles: DataFrame, by: list[str], area: str, title: str, known: DataFrame, least: int = 2) -> DataFrame:
    """Areas with at least ``least`` distinct titles that are known word for word."""
    real = titles.join(known.select(*by, title).distinct(), [*by, title], "left_semi")
    return real.groupBy(*by, area).agg(F.countDistinct(title).alias("titles")).where(F.col("titles") >= least)


def identity(name: Column, institution: Column, domain: Column, other_name: Column, affiliation: Column, mail: Column, homepage: Column, linked: Column) -> Column:
    """struct<decision, reasons>: a profile is the person's if the names agree and the affiliation, mail, homepage or an
    official link does. ``name`` and ``other_name`` are name parts."""
    mail_host = F.regexp_extract(F.lower(F.coalesce(mail, F.lit(""))), r"([^@\s]+)$", 1)
    signs = F.array_compact(
        F.array(
            F.when(F.coalesce(names_institution(affiliation, institution), F.lit(False)), F.lit("affiliation")),
            F.when((mail_host != "") & within(mail_host, domain), F.lit("mail")),
            F.when(F.coalesce(within(host(homepage), domain), F.lit(False)), F.lit("homepage")),
            F.when(F.coalesce(linked, F.lit(False)), F.lit("official link")),
        )
    )
    agree = same_person(name, other_name)
    return F.struct(F.when(~agree, "REJECT").when(F.size(signs) > 0, "ACCEPT").otherwise("REVIEW").alias("decision"), F.when(agree, signs).otherwise(F.array(F.lit("name"))).alias("reasons"))


def joint_decision(df: DataFrame, by: list[str], decision: str) -> DataFrame:
    """ACCEPT if any candidate is accepted and none needs review, REJECT if all are rejected, else REVIEW."""
    d = F.col(decision)
    g = df.groupBy(*by).agg(F.bool_or(d == "ACCEPT").alias("a"), F.bool_and(d == "REJECT").alias("r"), F.bool_or(d == "REVIEW").alias("v"))
    return g.select(*by, F.when(F.col("r"), "REJECT").when(F.col("a") & ~F.col("v"), "ACCEPT").otherwise("REVIEW").alias("decision"))


def title_match(title: Column, found: Column, doi: Column) -> Column:
    """How metadata were found: by DOI, by a title that shares 0.55 of its tokens, or in conflict."""
    near = jaccard(tokens(title), tokens(found)) >= 0.55
    return F.when(near & (F.trim(F.coalesce(doi, F.lit(""))) != ""), "VERIFIED_DOI").when(near, "VERIFIED_TITLE").otherwise("TITLE_CONFLICT")


def quota(body: Column) -> Column:
    """The smallest number of calls left that a provider's JSON names, whichever spelling it uses; null if none."""
    v = F.try_parse_json(body)
    get = lambda p: F.try_variant_get(v, p, "int")
    return F.least(*[get(p) for p in ("$.remaining", "$.searches_left", "$.plan.remaining", "$.daily.remaining", "$.monthly.remaining")])


def hit_is_about(title: Column, body: Column, name: Column) -> Column:
    """A search hit mentions the first and the last part of a name."""
    words = F.split(plain(F.concat_ws(" ", title, body)), " ")
    return F.coalesce(F.array_contains(words, F.get(name, F.lit(0))) & F.array_contains(words, F.try_element_at(name, F.lit(-1))), F.lit(False))


def profile_state(explicit: Column, papers: Column, biography: Column, model_ready: Column) -> Column:
    """Where a research profile's interests come from, the best evidence first."""
    return F.when(explicit > 0, "EXPLICIT").when(papers >= 3, "PAPER_SUMMARY").when(biography & model_ready, "BIOGRAPHY").when(biography, "AWAITING_MODEL").when(papers > 0, "AWAITING_PUBLICATIONS").otherwise("MANUAL_REVIEW_REQUIRED")


def guarded_status(old: Column, new: Column, has_papers: Column) -> Column:
    """A publication status never falls back while papers are there."""
    return F.when(has_papers & new.isin("NOT_FOUND", "BLOCKED", "FAILED"), old).otherwise(new)

"""Life cycles: runs, checks of recruiting pages, candidates, remote quotas, submissions, reviewed works and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.relational import distinct_on

COUNTERS = ("found", "ranked", "checked")


def run_updates(runs: DataFrame, updates: DataFrame, at: Column, counters: tuple[str, ...] = COUNTERS) -> DataFrame:
    """Runs after one update each: (run_id, kind, stage, progress, error, counters).

    'update' sets stage and progress (0 to 100) and the counters it names; 'finish' takes the status in ``stage`` if it is
    a final one and closes the run; 'fail' closes it with the error's first thousand characters. Others change nothing.
    """
    j = runs.alias("r").join(updates.alias("u"), "run_id", "left")
    old, new, kind = (lambda c: F.col(f"r.{c}")), (lambda c: F.col(f"u.{c}")), F.col("u.kind")
    done = (kind == "finish") & new("stage").isin("completed", "exhausted", "waiting")
    touched = (kind == "update") | done | (kind == "fail")
    count = lambda c: F.when((kind == "update") | done, F.greatest(F.coalesce(new(c), F.when(done, 0).otherwise(old(c))), F.lit(0))).otherwise(old(c)).alias(c)
    return j.select(
        "run_id",
        F.when(done, new("stage")).when(kind == "fail", "failed").otherwise(old("status")).alias("status"),
        F.when(kind == "update", F.left(new("stage"), F.lit(160))).when(done, "Goal reached").when(kind == "fail", "Failed").otherwise(old("stage")).alias("stage"),
        F.when(kind == "update", F.greatest(F.lit(0), F.least(F.lit(100), new("progress")))).when(done, 100).otherwise(old("progress")).alias("progress"),
        F.when(kind == "fail", F.left(new("error"), F.lit(1000))).when(done, None).otherwise(old("error")).alias("error"),
        F.when(touched, at).otherwise(old("heartbeat_at")).alias("heartbeat_at"),
        *[count(c) for c in counters],
    )


def recruiting_check(state: DataFrame, checks: DataFrame, key: str, at: Column) -> DataFrame:
    """(key, checked_at, status, failures, next_at) after a round of checks (key, status, days).

    A source that can't be reached counts a failure and comes again in two days; any other result clears the failures and
    comes again after its own days, or one day for PRESENT and thirty for the rest.
    """
    j = state.alias("s").join(checks.alias("c"), key, "left")
    new = F.col("c.status")
    out = new == "SOURCE_UNAVAILABLE"
    days = F.when(out, 2).otherwise(F.greatest(F.lit(1), F.coalesce(F.col("c.days"), F.when(new == "PRESENT", 1).otherwise(30))))
    seen = new.isNotNull()
    return j.select(
        key,
        F.when(seen, at).otherwise(F.col("s.checked_at")).alias("checked_at"),
        F.coalesce(new, F.col("s.status")).alias("status"),
        F.when(out, F.col("s.failures") + 1).when(seen, 0).otherwise(F.col("s.failures")).alias("failures"),
        F.when(seen, at + F.make_dt_interval(days)).otherwise(F.col("s.next_at")).alias("next_at"),
    )


def recruiting_signal(status: Column, freshness: Column, at: Column) -> Column:
    """struct<check_status, expires_at>: only present and fresh or undated evidence stays, for 120 days."""
    live = (status == "PRESENT") & F.coalesce(freshness, F.lit("UNDATED")).isin("CURRENT", "UPCOMING", "UNDATED")
    return F.struct(F.when(live, "PRESENT").otherwise("NOT_FOUND").alias("check_status"), F.when(live, at + F.make_dt_interval(F.lit(120))).otherwise(at).alias("expires_at"))


def queue_candidates(found: DataFrame, known: DataFrame, key: str, order: list[Column], at: str, as_of: Column) -> DataFrame:
    """The first of each profile's candidates that is due: unknown, refreshed thirty days ago, or failed six hours ago.
    ``known``: (key, at, failed)."""
    first = distinct_on(found.where(F.col(key).isNotNull()), [key], order)
    wait = F.when(F.col("failed"), F.expr("INTERVAL '6' HOUR")).otherwise(F.expr("INTERVAL '720' HOUR"))
    fresh = known.where(F.col(at) + wait > as_of).select(key)
    return first.join(fresh, key, "left_anti")


def quota_state(health: DataFrame, answers: DataFrame, key: str, as_of: Column, seconds: int = 300) -> DataFrame:
    """(key, remaining, wait): a provider's calls left, from the answer kept for ``seconds`` or else the new one; without
    either, or with none left, it has to wait (unknown is closed)."""
    j = health.alias("h").join(answers.alias("a"), key, "full")
    kept = F.col("h.reset_at") > as_of
    left = F.when(kept, F.col("h.remaining")).otherwise(F.col("a.remaining"))
    until = F.when(kept, F.ceil(F.unix_micros(F.col("h.reset_at")) / 1e6 - F.unix_micros(as_of) / 1e6)).otherwise(seconds)
    return j.select(key, left.alias("remaining"), F.when(F.coalesce(left, F.lit(0)) > 0, 0).otherwise(until).cast("long").alias("wait"))


def submission(role: Column) -> Column:
    """struct<source_kind, score, status> of what a user hands in, by the user's role; nothing is shown before a review."""
    staff, own = role.isin("owner", "moderator"), role == "member"
    return F.struct(F.when(staff, "moderator").when(own, "self_submitted").otherwise("community").alias("source_kind"), F.when(staff, 100).when(own, 95).otherwise(60).alias("score"), F.lit("pending").alias("status"))


def work_bucket(staff: Column, gate: Column, model: Column, confidence: Column) -> Column:
    """ACCEPT, REJECT or REVIEW for every work: a person's decision, else the gate's, else a model's of 0.8 or more."""
    sure = F.coalesce(confidence, F.lit(0)) >= 0.8
    return F.coalesce(F.when(staff.isin("ACCEPT", "REJECT"), staff), F.when(gate.isin("ACCEPT", "REJECT"), gate), F.when(sure & model.isin("ACCEPT", "REJECT"), model), F.lit("REVIEW"))


def two_sided(decision: Column, official: Column, other: Column, official_text: Column, other_text: Column, name: Column) -> Column:
    """The problems of a model's answer on identity: each quote has to stand in its own source and be more than the name,
    and YES needs a sound quote from both."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    sound = lambda q, t: (norm(q) != "") & (norm(q) != norm(name)) & norm(t).contains(norm(q))
    good = lambda quotes, t: F.coalesce(F.exists(quotes, lambda q: sound(q, t)), F.lit(False))
    bad = lambda quotes, t: F.coalesce(F.exists(quotes, lambda q: ~sound(q, t)), F.lit(False))
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(decision, F.lit("")).isin("YES", "NO", "UNCLEAR"), F.lit("decision")),
            F.when(bad(official, official_text), F.lit("official not grounded")),
            F.when(bad(other, other_text), F.lit("other not grounded")),
            F.when((decision == "YES") & ~(good(official, official_text) & good(other, other_text)), F.lit("one-sided")),
        )
    )


def card_needs_review(title: Column, family: Column, mail: Column, url: Column, mails: Column, links: Column) -> Column:
    """A roster's card is for a person to look at: without title, with an address that doesn't hold the family name, or
    with several mails or profile links."""
    where = F.lower(F.concat_ws(" ", mail, F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^https?://[^/?#]+([^?#]*)", 1)))
    return (F.trim(F.coalesce(title, F.lit(""))) == "") | ~where.contains(family) | (F.size(F.array_distinct(mails)) > 1) | (F.size(F.array_distinct(links)) > 1)


def catalog(groups: DataFrame, special: DataFrame, key: str = "category_key") -> DataFrame:
    """Categories of the seed groups and the specialised ones; a specialised one takes the place of its namesake."""
    return groups.join(special.select(key), key, "left_anti").unionByName(special, allowMissingColumns=True)

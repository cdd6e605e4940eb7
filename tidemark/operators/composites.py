"""Whole steps of the work, put together from the other operators: topics, programs, directories, units, works, awards.

Each takes tables and returns tables; what was fetched comes in as a table. Nothing is collected but the number of rows of
a frontier that a parameter bounds.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, hiring, html, names, profiles, rules, scoring, urls
from tidemark.functions.text import bound, even
from tidemark.operators import relational as R
from tidemark.operators import state as S
from tidemark.operators import walks
from tidemark.sources import readers
from tidemark.streaming.windows import shared_folder


def topic_candidates(matches: DataFrame, by: list[str], rank: str, as_of: Column, version: int, limit: int, deferred: bool = False, direct: Column | None = None) -> DataFrame:
    """The first ``limit`` people of each topic whose identity is to be checked again: not settled by hand, past their
    retry (unless ``deferred`` ones are wanted), of an older version or due. ``matches``: (by, rank, method, retry_at,
    version, next_at)."""
    wanted = [
        R.differs(F.col("method"), F.lit("manual_review")),
        None if deferred else R.due("retry_at", as_of),
        (F.col("version") < version) | R.due("next_at", as_of),
        direct,
    ]
    return R.topk_per_key(matches.where(R.conjunction(wanted)), by, [F.asc(rank)], max(1, min(100, limit)), "__r").drop("__r")


def needs_index(version: Column, indexed_at: Column, refresh_at: Column, as_of: Column, current: int) -> Column:
    """A topic has to be indexed: by an older version, never, or its refresh is due."""
    return F.coalesce((F.coalesce(version, F.lit(0)) < current) | indexed_at.isNull() | refresh_at.isNull() | (refresh_at <= as_of), F.lit(True))


def seed_topics(wanted: DataFrame, position: str, key: str, topics: DataFrame, jobs: DataFrame, as_of: Column, current: int, limit: int = 20) -> DataFrame:
    """(key, position, outcome) of a caller's list of topics in its order: 'ready' for fresh ones, 'reused' where a job
    waits or runs, 'new' for the others until ``limit`` are new; what comes behind isn't looked at and has no row."""
    first = wanted.groupBy(key).agg(F.min(position).alias(position))
    there = topics.select(key, "version", "refresh_at")
    busy = jobs.where(F.col("status").isin("queued", "running")).select(key).distinct().withColumn("__busy", F.lit(True))
    ready = F.coalesce((F.col("version") >= current) & (F.col("refresh_at") > as_of), F.lit(False))
    j = first.join(there, key, "left").join(busy, key, "left").select(key, position, F.when(ready, "ready").when(F.col("__busy"), "reused").otherwise("new").alias("outcome"))
    # The place of the last new one bounds the list: a top-k, not a running count over all.
    last = j.where("outcome = 'new'").orderBy(position).limit(limit).agg(F.max(position).alias("__last"), F.count(F.lit(1)).alias("__n"))
    return j.crossJoin(F.broadcast(last)).where((F.col("__n") < limit) | (F.col(position) <= F.col("__last"))).select(key, position, "outcome")


def rebuilds(jobs: DataFrame, outdated: DataFrame, priority: int, attempts: int = 10) -> DataFrame:
    """(key, priority, reused) of the jobs of outdated topics after they are queued once each."""
    asked = outdated.select("key").distinct()
    after = S.enqueue(jobs, asked.select("key", F.lit(priority).alias("priority"), F.lit(attempts).alias("max_attempts")))
    old = jobs.where(F.col("status").isin("queued", "running")).select("key").distinct().withColumn("__old", F.lit(True))
    live = after.where(F.col("status").isin("queued", "running"))
    return live.join(asked, "key", "left_semi").join(old, "key", "left").select("key", "priority", F.coalesce("__old", F.lit(False)).alias("reused"))


# Marks of a setting that nobody has filled in, and hosts that are this machine.
PLACEHOLDERS = ("replace-with", "example.com", "user:password", "your-")
LOCAL = ("", "localhost", "127.0.0.1", "::1")


def configuration_checks(settings: DataFrame, by: str) -> DataFrame:
    """(by, check, passed) of settings (by, name, value): production mode, login, database, its TLS, search, contact. No
    value leaves the table."""
    names_ = ("APP_ENV", "DEV_AUTH_BYPASS", "DATABASE_URL", "BRAVE_SEARCH_API_KEY", "SEARXNG_URL", "CONTACT_EMAIL")
    one = settings.groupBy(by).agg(*[F.trim(F.coalesce(F.max(F.when(F.col("name") == n, F.col("value"))), F.lit(""))).alias(n) for n in names_])
    c = F.col
    empty = lambda x: (x == "") | reduce(lambda a, b: a | b, [F.lower(x).contains(m) for m in PLACEHOLDERS])
    host = F.lower(F.regexp_extract(c("DATABASE_URL"), r"^[a-zA-Z+]+://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    managed = ~empty(c("DATABASE_URL")) & ~F.regexp_replace(host, r"[\[\]]", "").isin(*LOCAL)
    tls = F.lower(F.regexp_extract(c("DATABASE_URL"), r"[?&]sslmode=([^&#]*)", 1)).isin("require", "verify-ca", "verify-full")
    mail = c("CONTACT_EMAIL")
    checks = {
        "production": F.lower(c("APP_ENV")) == "production",
        "login": ~F.lower(c("DEV_AUTH_BYPASS")).isin("1", "true", "yes", "on"),
        "database": managed,
        "database_tls": ~managed | tls,
        "search": ~empty(c("BRAVE_SEARCH_API_KEY")) | (~empty(c("SEARXNG_URL")) & c("SEARXNG_URL").rlike(r"(?i)^https?://[^/?#]+")),
        "contact": mail.contains("@") & F.substring_index(mail, "@", -1).contains(".") & ~empty(mail),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in checks.items()])
    return one.select(by, F.inline(rows))


# A program's check and the policy that it makes.
POLICIES = {"PUBLISHED_MINIMUM": "HARD_MINIMUM", "EXPLICIT_NO_MINIMUM": "NO_FORMAL_MINIMUM", "NOT_FOUND": "NOT_STATED", "NEEDS_REVIEW": "NEEDS_REVIEW"}


def manual_requirement(status: Column, minimum: Column, scale: Column, url: Column, evidence: Column) -> Column:
    """What is wrong with a requirement that a person enters; null if nothing is."""
    return (
        F.when(~F.coalesce(status, F.lit("")).isin(*POLICIES), "status")
        .when((status == "PUBLISHED_MINIMUM") != minimum.isNotNull(), "minimum")
        .when((minimum < 0) | (minimum > scale), "value")
        .when(scale <= 0, "scale")
        .when((urls.host(F.coalesce(url, F.lit(""))) == "") | (F.trim(F.coalesce(evidence, F.lit(""))) == ""), "evidence")
    )


def program_requirements(state: DataFrame, sources: DataFrame, by: str, text: str, degree: str = "phd") -> DataFrame:
    """(by, policy, minimum, manual) of programs after their sources are read: sources that agree decide, requirements
    that a person entered stay. ``state``: (by, policy, minimum, manual)."""
    read = sources.select(by, rules.grades(F.col(text), degree).alias("g")).select(by, "g.status", "g.minimum", "g.scale", "g.basis")
    said = rules.agreed(read, [by], ["minimum", "scale", "basis"])
    s = F.col("status")
    policy = F.when(s == "FOUND", "HARD_MINIMUM").when(s == "NO_MINIMUM", "NO_FORMAL_MINIMUM").when(s == "NEEDS_REVIEW", "NEEDS_REVIEW").otherwise("NOT_STATED")
    new = said.select(by, policy.alias("policy"), F.col("minimum"), F.lit(False).alias("manual"))
    take = lambda old, fresh: fresh
    return S.upsert(state, new, [by], {"policy": take, "minimum": take, "manual": take}, locked=F.col("o.manual"))


def crawl(pages: DataFrame, institutions: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, url, name, title, email, profile_url, status, lead) of the people on a directory's pages: 'PENDING' for those
    to be validated on their own page, 'NOT_A_ROSTER' for all of a page that can't be read as one.

    ``pages`` (id, url, html), ``institutions`` (domain, canonical host of an institution). People of one page that share an
    address count once, the first by name.
    """
    people = html.roster_tables(pages, id_col).where(names.looks_personal(F.col("name")))
    people = people.withColumn("name", names.display_name(F.col("name"))).withColumn("profile_url", urls.canonical(F.col("profile_url")))
    people = people.where((F.col("profile_url") != "") & (F.col("profile_url") != urls.canonical(F.col("url"))))
    people = R.distinct_on(people, [id_col, "profile_url"], [F.asc("name"), F.asc("card")])
    parsed = html.parse(pages, id_col).select(id_col, F.col("title").alias("__title"), F.get(F.filter("blocks", lambda b: b["tag"] == "h1"), F.lit(0))["text"].alias("__head"), F.left(F.array_join(F.transform("main", lambda b: b["text"]), " "), F.lit(4000)).alias("__said"))
    count = people.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("title") == "").alias("__bare"))
    j = people.join(count, id_col).join(parsed, id_col)
    kind = rules.roster_page(F.col("url"), F.col("__title"), F.col("__head"), F.lit(None).cast("string"), F.col("__said"), F.col("__n"), F.col("__bare"))["status"]
    j = R.suffix_host_join(j.withColumn("__host", urls.host(F.col("url"))).withColumn("__row", F.concat_ws(" ", F.col(id_col), "profile_url")), "__host", institutions.select(F.col("domain").alias("__d"), F.col("domain").alias("__known")), "__d", "__row", ["__known"])
    outside = F.col("__known").isNull() | ~urls.within(urls.host(F.col("profile_url")), F.col("__known"))
    status = F.when(kind == "NOT_A_ROSTER", "NOT_A_ROSTER").when(kind != "APPROVED_ROSTER", "NEEDS_REVIEW").when(outside, "INSTITUTION_UNRESOLVED").when((F.col("title") != "") & ~F.col("title").rlike(profiles.ROLE), "NOT_GROUP_LEADING_FACULTY").otherwise("PENDING")
    return j.select(id_col, "url", "name", "title", "email", "profile_url", status.alias("status"), F.coalesce(rules.leads_group(F.col("title")), F.lit(False)).alias("lead"))


def directories(links: DataFrame, domain: str, url: str, known: DataFrame) -> DataFrame:
    """(domain, url) of addresses that may be new directories of their domain: by their path, each once, unknown so far."""
    found = links.select(domain, urls.directory_candidate(F.col(url), F.col(domain)).alias("url")).where("url <> ''").distinct()
    return found.join(known.select("url"), "url", "left_anti").select(domain, "url")


# Labels of links to lists of units and to directories, and what a unit is called.
UNIT_LISTS = r"(?i)\b(?:academics|colleges and schools|schools and colleges)\b"
DIRECTORY_LABEL = r"(?i)\b(?:directory|our faculty|faculty and staff)\b"
UNIT = r"(?i)\b(?:college|school|department|program)\b"


def academic_units(links: DataFrame, home: DataFrame, site: str, pages: int = 12, units: int = 80) -> DataFrame:
    """(site, url, name, kind) of the first ``units`` units that a walk from each site's home finds on ``pages`` pages; the
    walk ends with the page that has brought that many.

    ``links``: (site, page, place, url, label), within the site. Links with the label of a list of units lead on. Of a
    unit's labels the last one read counts.
    """
    lists = links.where(F.col("label").rlike(UNIT_LISTS))
    found = links.where(F.col("label").rlike(UNIT) & (F.length("label") <= 180)).withColumn("url", F.regexp_replace("url", "/+$", ""))
    start = home.select(site, F.lit(0).alias("place"), F.col("page").alias("url"))
    visits = walks.walk(lists, found, start, site, pages, units)
    last = F.max_by("label", F.struct("visit", "place")).alias("name")
    kept = walks.first_found(visits, found, site, units, [last])
    return kept.select(site, "url", "name", F.upper(F.regexp_extract("name", UNIT, 0)).alias("kind"))


def roster_candidates(units: DataFrame, links: DataFrame, site: str, domain: str, most_units: int = 40, most: int = 100) -> DataFrame:
    """(site, rank, url) of the first ``most`` addresses that may be directories, read off the pages of each site's first
    ``most_units`` units. ``units``: (site, rank, url), ``links``: (site, page, place, url, label)."""
    visits = units.where(F.col("rank") <= most_units).select(site, F.col("url").alias("page"), F.col("rank").alias("visit"))
    found = links.where(F.col("label").rlike(DIRECTORY_LABEL)).withColumn("url", urls.directory_candidate(F.col("url"), F.col(domain))).where("url <> ''")
    return walks.first_found(visits, found.select(site, "page", "place", "url"), site, most)


def sitemap_directories(documents: DataFrame, domain: str, pages: int = 30, most: int = 150) -> DataFrame:
    """(domain, rank, url) of addresses that may be directories, from a walk over each domain's site maps: its two usual
    ones first, then the maps that these name, on the domain only. ``documents``: (domain, page, xml) as fetched.

    Addresses count each time they are met until ``most`` are; the walk ends with the map that brings the last one.
    """
    locs = readers.sitemap_locations(documents.select(domain, "page", "xml"), "xml").drop("xml")
    is_map = F.lower("loc").rlike(r"\.xml(?:\.gz)?$") & bound(urls.host(F.col("loc")), lambda h: urls.within(h, F.col(domain)))
    kind = bound(F.coalesce(is_map, F.lit(False)), lambda m: F.struct(m.alias("is_map"), F.when(m, F.col("loc")).otherwise(urls.directory_candidate(F.col("loc"), F.col(domain))).alias("url")))
    # Documents are read once: maps and directories are a table that the walk, and what it finds, read again. A site
    # without either has nothing to find.
    locs = locs.select(domain, "page", "place", F.inline(F.filter(F.array(kind), lambda x: x["url"] != "")))
    folder = f"{shared_folder(locs.sparkSession)}/maps-{uuid.uuid4().hex}"
    locs.write.parquet(folder)
    locs = locs.sparkSession.read.parquet(folder)
    maps, found = (locs.where(test).drop("is_map") for test in ("is_map", "NOT is_map"))
    names = F.array(*[F.concat(F.lit("https://"), F.col(domain), F.lit(f"/{n}")) for n in ("sitemap.xml", "sitemap_index.xml")])
    home = locs.select(domain).distinct().select(domain, F.posexplode(names).alias("place", "url"))
    return walks.first_found(walks.walk(maps, found, home, domain, pages, most, distinct=False), found, domain, most)


def paged_profile(works: DataFrame, sheets: DataFrame, by: str, size: int = 100, most: int = 300) -> tuple[DataFrame, DataFrame]:
    """(status of each profile, its works): saved sheets of a profile are read in order up to one that is missing, brings
    nothing new, is short, or bears another name; works count once, ``most`` at most.

    ``sheets``: (by, sheet from 0, name), ``works``: (by, sheet, place, key). A profile whose name changes keeps nothing.
    """
    last = (most + size - 1) // size
    first = works.groupBy(by, "key").agg(F.min(F.struct("sheet", "place")).alias("at"))
    fresh = first.groupBy(by, F.col("at.sheet").alias("sheet")).agg(F.count(F.lit(1)).alias("new"))
    n = works.groupBy(by, "sheet").agg(F.count(F.lit(1)).alias("n"))
    j = sheets.where(F.col("sheet") < last).join(n, [by, "sheet"], "left").join(fresh, [by, "sheet"], "left").na.fill(0, ["n", "new"])
    asked = F.least(F.lit(size), most - F.col("sheet") * size)
    why = F.when((F.col("n") > 0) & (F.col("new") == 0), "REPEATED_PAGE").when(F.col("n") < asked, "END_OF_LIST")
    # A profile has no more than ``last`` sheets left here.
    g = j.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("sheet", "name", why.alias("why")))).alias("s"))
    whole = F.filter("s", lambda x, i: x["sheet"] == i)
    stop = F.coalesce(F.nullif(F.array_position(F.transform(whole, lambda x: x["why"].isNotNull()), True), F.lit(0)), F.size(whole))
    g = g.select(by, F.slice(whole, F.lit(1), stop.cast("int")).alias("s")).where(F.size("s") > 0)
    own = F.col("s")[0]["name"]
    parts = lambda x: names.parts(names.fold(x, ascii_only=True))
    other = F.array_position(F.transform("s", lambda x, i: (i > 0) & ~names.same_person(parts(own), parts(x["name"]))), True).cast("int")
    read = F.when(other > 0, other).otherwise(F.size("s"))
    status = g.select(by, own.alias("name"), read.alias("sheets"), F.when(F.coalesce(own, F.lit("")) == "", "UNREADABLE").when(other > 0, "IDENTITY_CHANGED").otherwise(F.coalesce(F.element_at("s", -1)["why"], F.lit("LIMIT_REACHED"))).alias("status"))
    good = status.where(~F.col("status").isin("IDENTITY_CHANGED", "UNREADABLE"))
    kept = first.select(by, "key", "at.sheet", "at.place").join(good.select(by, "sheets"), by).where(F.col("sheet") < F.col("sheets"))
    kept = R.topk_per_key(kept, by, [F.asc("sheet"), F.asc("place")], most, "rank")
    return status, kept.select(by, "rank", "key")


def recruiting_signals(sources: DataFrame, by: str, today: Column) -> DataFrame:
    """(by, status, tier, quote) of each person's sources in order of trust (by, tier, institution, reached, held, text,
    snippet date text): the first with an invitation of its own that is fresh and names no other employer's program."""
    q = sources.withColumn("quote", hiring.quote(F.col("text"), F.year(today)))
    q = q.withColumn("__fresh", dates.freshness(F.col("quote"), today))
    hit = F.col("reached") & F.col("held") & (F.col("quote") != "") & ~hiring.conflicting_program(F.col("quote"), F.col("institution")) & ~F.col("__fresh").isin("OLDER", "HISTORICAL", "EXPIRED")
    return profiles.first_of(q, by, "tier", F.coalesce(hit, F.lit(False)), F.coalesce(F.col("reached"), F.lit(False)), ["quote"])


def awards(found: DataFrame, people: DataFrame, by: str, asked: Column) -> DataFrame:
    """(by, award, boost): awards (award, person, institution, title, body) of the people (by, name, institution) whom
    they name, at their institution and about what was asked; each award once a person."""
    key = lambda c: F.array_join(names.parts(names.fold(c, ascii_only=True)), "")
    f = found.select("award", "title", "body", F.col("institution").alias("__there"), key(F.col("person")).alias("__k"))
    j = f.join(people.select(by, "institution", key(F.col("name")).alias("__k")), "__k")
    about = hiring.grant_fits(asked, F.concat_ws(" ", "title", "body"))
    j = j.where(names.names_institution(F.col("__there"), F.col("institution")) & about)
    return j.groupBy(by, "award").agg(F.max(scoring.grant_boost(F.col("title"))).alias("boost"))


def discovered_works(works: DataFrame, by: str) -> DataFrame:
    """(by, found, accepted, rejected, waiting, status) of the works that a person's pages list (by, title, authors, venue,
    year, doi): each work once by its title, gated by the rules."""
    one = R.distinct_on(works.withColumn("__t", F.lower(even(F.col("title")))), [by, "__t"], [F.desc_nulls_last("doi"), F.asc_nulls_last("year"), F.asc_nulls_last("authors")])
    d = F.col("__d")
    one = one.withColumn("__d", rules.publication(F.col("title"), F.col("authors"), F.col("venue"), F.col("year"), F.col("doi"))["decision"])
    g = one.groupBy(by).agg(F.count(F.lit(1)).alias("found"), *[F.count_if(d == k).alias(n) for k, n in (("ACCEPT", "accepted"), ("REJECT", "rejected"), ("AMBIGUOUS", "waiting"))])
    return g.withColumn("status", F.when(F.col("accepted") > 0, "OFFICIAL_PUBLICATIONS_FOUND").when(F.col("waiting") > 0, "REVIEW_REQUIRED").otherwise("NO_PUBLICATIONS_FOUND"))


def batch_step(due: DataFrame, topic: str, order: list[Column], n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(the next ``n`` of each topic, topics with ``checked`` and ``more``): one step of a job that works in batches."""
    n = max(1, min(25, n))
    top = R.topk_per_key(due, topic, order, n + 1, "__r")
    summary = top.groupBy(topic).agg(F.least(F.count(F.lit(1)), F.lit(n)).alias("checked"), (F.count(F.lit(1)) > n).alias("more"))
    return top.where(F.col("__r") <= n).drop("__r"), summary


def ranked_board(name: str, df: DataFrame, order: list[Column], limit: int, id_col: str, note: Column, at: Column) -> DataFrame:
    """(board, id, note, at) of the first rows of one result set of a board."""
    return df.orderBy(*order).limit(max(1, min(250, limit))).select(F.lit(name).alias("board"), F.col(id_col).cast("string").alias("id"), note.cast("string").alias("note"), at.cast("timestamp").alias("at"))


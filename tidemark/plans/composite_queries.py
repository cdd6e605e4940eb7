"""Registered queries on whole steps: profiles, rosters, units, topics, programs, recruiting, awards, works, boards.

The synthetic pages hold none of these, so every row makes its own page or sentence, and the SQL works from the values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import html, names, profiles
from tidemark.operators import composites as C
from tidemark.operators import relational as R
from tidemark.operators import state as S
from tidemark.plans.registry import case, query, table
from tidemark.plans.sentence_queries import pick, say

AS_OF = "TIMESTAMP '2024-01-10 00:00:00'"


def _rows(*rows: Column) -> Column:
    return F.inline(F.array(*rows))


def _row(**fields: Column | str | int | None) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


@query(
    "page_profiles",
    """SELECT page_id, ['PROFILE_VERIFIED', 'INSTITUTION_UNRESOLVED', 'ROSTER_CONFIRMED_PROFILE_UNAVAILABLE', 'ROSTER_CONFIRMED_PROFILE_UNAVAILABLE', 'HISTORICAL_PROFILE', 'NAME_MISMATCH', 'PROFILE_VERIFIED', 'NOT_GROUP_LEADING_FACULTY'][page_id % 8 + 1] status,
    CASE page_id % 8 WHEN 0 THEN 'Associate Professor' WHEN 6 THEN 'Senior Lecturer' WHEN 7 THEN 'Facilities Manager' END "role", CASE page_id % 8 WHEN 0 THEN 'official_profile' WHEN 6 THEN 'official_roster' WHEN 7 THEN 'official_roster' END role_source, CASE page_id % 8 WHEN 0 THEN 'Ana B. Lee' WHEN 6 THEN 'Ana Lee' WHEN 7 THEN 'Ana Lee' END AS name FROM pages""",
)
def page_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    own = F.lit("<title>Ana Lee | A University</title><main><h1>Ana Lee</h1><p>Studies things.</p></main>")
    page = pick(
        "page_id",
        say("<title>Ana B. Lee | A University</title><nav>Professor Else</nav><main><header><h1>Ana B. Lee</h1></header><p>Associate Professor of things ", i, ".</p></main>"),
        own,
        F.lit("<title>Just a moment...</title><p>Ana Lee, Professor</p>"),
        F.lit("<title>Ana Lee</title><main><nav>Home</nav></main><p>Professor</p>"),
        say("<title>Ana Lee</title><main><h1>In memoriam: Ana Lee</h1><p>Professor from ", 1900 + i % 99, " on.</p></main>"),
        F.lit("<title>Bea Ray</title><main><h1>Bea Ray</h1><p>Professor of things.</p></main>"),
        own,
        own,
    )
    url = F.when(i % 8 == 1, say("https://b.org/people/", i)).otherwise(say("https://www.a.edu/people/", i))
    stated = F.when(i % 8 == 6, "Senior Lecturer").when(i % 8 == 7, "Facilities Manager")
    df = html.parse(table(spark, sf_dir, "pages").select("page_id", page.alias("html"))).select("page_id", "title", "main", url.alias("url"), F.lit("Ana Lee").alias("who"), stated.alias("stated"), (i % 8 == 7).alias("labelled"), F.lit("a.edu").alias("domain"))
    v = profiles.validate_profiles(df, "url", "title", "main", "who", "stated", "labelled", "domain")
    return v.select("page_id", "verdict.status", "verdict.role", "verdict.role_source", "verdict.name")


@query("directory_records", "SELECT page_id, ['ROSTER_VERIFIED', 'NAME_MISMATCH', 'NOT_A_PERSON', 'ROLE_UNCLEAR'][page_id % 4 + 1] status, CASE WHEN page_id % 4 < 2 THEN 'room ' || page_id END office FROM pages")
def directory_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    page = pick(
        "page_id",
        say("<main><table><tr><th>First Name</th><td>Ana</td></tr><tr><th>Title</th><td>Professor of things</td></tr></table><p><strong>Office:</strong> room ", i, "</p></main>"),
        say("<main><p>Name: Bea Ray</p><p>Role: Professor</p><p>Office: room ", i, "</p></main>"),
        F.lit("<main><p>Name: Ana Lee</p><p>Role(s): Office Manager</p></main>"),
        F.lit("<main><p>Name: Ana Lee</p><p>Email: ana@a.edu</p></main>"),
    )
    df = html.parse(table(spark, sf_dir, "pages").select("page_id", page.alias("html"))).select("page_id", profiles.labelled_fields(F.col("main")).alias("f"))
    seen = names.parts(names.fold(F.col("f")["name"]))
    same = F.when(F.col("f")["name"].isNotNull(), names.compatible(F.split(F.lit("ana lee"), " "), seen))
    return df.select("page_id", profiles.directory_detail(F.col("f"), same, F.lit(None).cast("string"))["status"].alias("status"), F.col("f")["office"].alias("office"))


@query(
    "reviewed_cards",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 3 THEN 'Professor' END title, CASE s_suppkey % 5 WHEN 1 THEN 'NEEDS_REVIEW' WHEN 2 THEN 'NOT_A_PERSON' END status FROM supplier""",
)
def reviewed_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards without a title: invalid answer, conflict, a student, a role that the card holds, one that it doesn't."""
    k, name = F.col("s_suppkey") % 5, F.col("s_name")
    role = F.when(k == 4, "Associate Professor").otherwise("Professor")
    r = profiles.reviewed_card(k > 0, k == 1, F.when(k == 2, "student").otherwise("faculty"), role, say(name, " professor  of things"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", r["title"].alias("title"), r["status"].alias("status"))


@query("site_links", "SELECT s_suppkey, s_suppkey % 5 IN (0, 1) own, CASE WHEN s_suppkey % 2 = 0 THEN 'lab site Visit ' || s_name ELSE 'lab site' END context FROM supplier")
def site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("s_suppkey")
    target = pick("s_suppkey", say("https://lab", i, ".a.edu/"), say("https://www.lab", i, ".a.edu/x/"), say("https://lab", i, ".b.edu/"), F.lit("https://news.a.edu/"), F.lit("https://people.a.edu/me"))
    label = pick("s_suppkey", say("http://lab", i, ".a.edu"), say("lab", i, ".a.edu/x"), say("lab", i, ".b.edu"), F.lit("news.a.edu"), F.lit("people.a.edu/me"))
    around = F.when(i % 2 == 0, say("Visit  ", F.col("s_name"))).otherwise(F.repeat(F.lit("far "), 90))
    return table(spark, sf_dir, "supplier").select("s_suppkey", profiles.bare_site(label, target, F.lit("https://people.a.edu/ana")).alias("own"), profiles.link_context(F.lit("lab site"), around).alias("context"))


@query(
    "crawled_rosters",
    """SELECT page_id, n AS name, CASE WHEN page_id % 3 = 1 THEN 'NOT_A_ROSTER' WHEN n = 'Cy Roe' THEN 'INSTITUTION_UNRESOLVED' WHEN n = 'Di Fox' THEN 'NOT_GROUP_LEADING_FACULTY' ELSE 'PENDING' END status, n = 'Ann Lee' AND page_id % 3 <> 2 "lead", CASE WHEN n = 'Ann Lee' AND page_id % 3 <> 2 THEN 'ann@a.edu' ELSE '' END email
    FROM pages, (SELECT unnest(['Ann Lee', 'Bo Ray', 'Cy Roe', 'Di Fox']) n) p""",
)
def crawled_rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table, a page on awards with the same table, and a grid of a page builder; repeated rows and menu entries go."""
    i = F.col("page_id")
    people = (("Ann Lee", "Professor", "/p/ann"), ("Ray, Bo", "Lecturer", "/p/bo"), ("Ann Lee", "Professor", "/p/ann/"), ("Cy Roe", "Instructor", "https://b.org/cy"), ("Di Fox", "Office Manager", "/p/di"), ("Faculty Home", "", "/home"))
    mail = '<a href="mailto:ann@a.edu?subject=x">write</a>'
    rows = "".join(f'<tr><td><a href="{u}">{n}</a></td><td>{t}</td><td>{mail if n == "Ann Lee" else ""}</td></tr>' for n, t, u in people)
    flat = f"<main><h1>Faculty</h1><table><tr><th>Name</th><th>Title</th><th>Mail</th></tr>{rows}</table></main>"
    teach = {"Professor": "Lecturer"}
    cells = "".join(f'<div id="profile_row" class="vc_row"><div class="vc_column_container"><a href="{u}">{n}</a></div><div class="vc_column_container">{teach.get(t, t)}</div></div>' for n, t, u in people)
    grid = f'<main><h1>Faculty</h1><div class="vc_row"><div class="vc_column_container">Name</div><div class="vc_column_container">Position</div></div><div class="js-wpv-view-layout">{cells}</div></main>'
    head = "<title>Faculty | Department of Physics</title>"
    page = F.concat(F.lit(head), pick("page_id", F.lit(flat), F.lit(flat), F.lit(grid)))
    url = pick("page_id", say("https://www.a.edu/people/", i), say("https://www.a.edu/awards/", i), say("https://www.a.edu/people/", i))
    pages = table(spark, sf_dir, "pages").select("page_id", url.alias("url"), page.alias("html"))
    known = spark.range(1).select(F.lit("a.edu").alias("domain"))
    return C.crawl(pages, known).select("page_id", "name", "status", "lead", "email")


@query("unit_walk", "SELECT n_nationkey, '/d1' url, 'Department of Physics, new' AS name, 'DEPARTMENT' kind FROM nation UNION ALL SELECT n_nationkey, '/d2', 'School of Art ' || n_nationkey, 'SCHOOL' FROM nation")
def unit_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation as a site: lists of units that name each other, a unit met twice, a page that nothing leads to."""
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    link = lambda page, place, url, label: _row(page=page, place=place, url=url, label=label)
    links = n.select(
        "n_nationkey",
        _rows(
            link("/", 0, "/academics", "Academics"), link("/", 1, "/d1", "Department of Physics"), link("/", 2, "/news", "News"), link("/academics", 0, "/schools", "Schools and Colleges of ours"),
            link("/academics", 1, "/d2/", say("School of Art ", F.col("n_nationkey"))), link("/schools", 0, "/d1/", "Department of Physics, new"), link("/schools", 1, "/academics", "Academics"), link("/far", 0, "/d3", "College of Law"),
        ),
    )
    return C.academic_units(links, n.withColumn("page", F.lit("/")), "n_nationkey")


@query("paged_profiles", "SELECT c_custkey, ['END_OF_LIST', 'REPEATED_PAGE', 'IDENTITY_CHANGED', 'LIMIT_REACHED', 'END_OF_LIST'][c_custkey % 5 + 1] status, [3, 2, 2, 3, 1][c_custkey % 5 + 1] sheets, [5, 2, 0, 6, 1][c_custkey % 5 + 1] works FROM customer")
def paged_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a profile of saved sheets with two works each, six at most."""
    lists = pick("c_custkey", *map(F.lit, ("a,b;c,d;e", "a,b;b,a;c,d", "a,b;c,d;e", "a,b;c,d;e,f;g", "a;b,c")))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(F.split(lists, ";")).alias("sheet", "w"))
    sheets = c.select("c_custkey", "sheet", F.when((F.col("c_custkey") % 5 == 2) & (F.col("sheet") == 1), "Bea Ray").otherwise("Ana Lee").alias("name"))
    works = c.select("c_custkey", "sheet", F.posexplode(F.split("w", ",")).alias("place", "key"))
    status, kept = C.paged_profile(works, sheets, "c_custkey", 2, 6)
    n = kept.groupBy("c_custkey").agg(F.count(F.lit(1)).cast("int").alias("works"))
    return status.join(n, "c_custkey", "left").select("c_custkey", "status", "sheets", F.coalesce("works", F.lit(0)).alias("works"))


@query(
    "topic_candidate_ids",
    f"""SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) r FROM orders
    WHERE o_orderstatus <> 'P' AND o_orderdate <= {AS_OF} AND (o_custkey % 5 < 3 OR o_custkey % 2 = 0)) WHERE r <= 24""",
)
def topic_candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of, k = F.expr(AS_OF), F.col("o_custkey")
    m = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", F.when(F.col("o_orderstatus") == "P", "manual_review").alias("method"), F.col("o_orderdate").alias("retry_at"), (k % 5).alias("version"), F.when(k % 2 != 0, as_of + F.expr("INTERVAL '1' DAY")).alias("next_at"))
    return C.topic_candidates(m, ["o_orderpriority"], "o_orderkey", as_of, 3, 24).select("o_orderpriority", "o_orderkey")


@query("index_requests", "SELECT p_partkey, p_size < 10 OR p_partkey % 3 = 0 OR p_partkey % 4 < 2 needed FROM part")
def index_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of, k = F.expr(AS_OF), F.col("p_partkey")
    refresh = F.when(k % 4 == 0, None).when(k % 4 == 1, as_of).otherwise(as_of + F.expr("INTERVAL '1' DAY"))
    return table(spark, sf_dir, "part").select("p_partkey", C.needs_index(F.col("p_size"), F.when(k % 3 != 0, as_of), refresh, as_of, 10).alias("needed"))


@query(
    "seeded_topics",
    """WITH o AS (SELECT n_nationkey position, n_name AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'ready' WHEN n_nationkey % 5 = 1 THEN 'reused' ELSE 'new' END outcome FROM nation)
    SELECT * FROM o WHERE position <= (SELECT max(position) FROM (SELECT position FROM o WHERE outcome = 'new' ORDER BY position LIMIT 5))""",
)
def seeded_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list that names every topic twice; five new jobs are enough."""
    as_of, n = F.expr(AS_OF), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("key"))
    twice = n.unionByName(n.select((F.col("position") + 100).alias("position"), "key"))
    topics = n.select("key", F.lit(7).alias("version"), F.when(F.col("position") % 3 == 0, as_of + F.expr("INTERVAL '1' DAY")).alias("refresh_at"))
    jobs = n.select("key", F.when(F.col("position") % 5 == 1, "queued").otherwise("failed").alias("status"))
    return C.seed_topics(twice, "position", "key", topics, jobs, as_of, 7, 5).select("position", "key", "outcome")


@query("rebuild_jobs", "SELECT s_suppkey::VARCHAR AS key, CASE WHEN s_suppkey % 4 = 0 THEN 99 WHEN s_suppkey % 4 = 1 THEN 5 ELSE 95 END priority, s_suppkey % 4 < 3 reused FROM supplier WHERE s_suppkey % 3 = 0")
def rebuild_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that are out of date: jobs that wait get the higher priority, running ones keep theirs, ended ones come again."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    key = k.cast("string").alias("key")
    jobs = s.select(key, F.when(k % 4 == 1, "running").when(k % 4 == 3, "succeeded").otherwise("queued").alias("status"), F.when(k % 4 == 0, 99).otherwise(5).alias("priority"), F.lit(1).alias("attempts"), F.lit(3).alias("max_attempts"))
    return C.rebuilds(jobs, s.where(k % 3 == 0).select(key), 95)


@case(
    "configuration",
    """SELECT s_suppkey, c."check", CASE c."check" WHEN 'production' THEN s_suppkey % 2 = 0 WHEN 'login' THEN s_suppkey % 3 <> 0 WHEN 'database' THEN s_suppkey % 4 > 1 WHEN 'database_tls' THEN s_suppkey % 4 <> 2 WHEN 'search' THEN s_suppkey % 5 = 1 ELSE s_suppkey % 2 = 1 END passed
    FROM supplier, (SELECT unnest(['production', 'login', 'database', 'database_tls', 'search', 'contact']) "check") c""",
)
def configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as an installation with its settings."""
    k = F.col("s_suppkey")
    put = lambda n, v: _row(name=n, value=v)
    base = pick("s_suppkey", *map(F.lit, ("postgresql://u:p@localhost:5432/x", "postgresql://user:password@db.a.org/x", "postgresql://u:p@db.a.org/x?a=1", "postgresql://u:p@db.a.org/x?sslmode=verify-full")))
    settings = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        _rows(
            put("APP_ENV", F.when(k % 2 == 0, " Production").otherwise("test")), put("DEV_AUTH_BYPASS", F.when(k % 3 == 0, "On").otherwise("")), put("DATABASE_URL", base),
            put("SEARXNG_URL", F.when(k % 5 == 1, "https://search.a.org/").when(k % 5 == 2, "your-url").otherwise("ftp://a.org")), put("CONTACT_EMAIL", F.when(k % 2 == 1, "help@a.org").otherwise("help@example.com")),
        ),
    )
    return C.configuration_checks(settings, "s_suppkey")


@query("manual_requirements", "SELECT p_partkey, ['status', 'minimum', 'value', 'scale', 'evidence', NULL][p_partkey % 6 + 1] problem FROM part")
def manual_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    num = lambda *v: pick("p_partkey", *[F.lit(x).cast("double") for x in v])
    status = pick("p_partkey", *map(F.lit, ("SAID", "PUBLISHED_MINIMUM", "PUBLISHED_MINIMUM", "NOT_FOUND", "NOT_FOUND", "PUBLISHED_MINIMUM")))
    p = C.manual_requirement(status, num(None, None, 5.0, None, None, 3.0), num(None, 4.0, 4.0, 0.0, 4.0, 4.0), F.lit("https://a.edu/x"), F.when(F.col("p_partkey") % 6 == 4, "  ").otherwise(F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", p.alias("problem"))


@query(
    "program_checks",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'HARD_MINIMUM' WHEN 1 THEN CASE WHEN p_size % 5 = 0 THEN 'HARD_MINIMUM' ELSE 'NEEDS_REVIEW' END WHEN 2 THEN 'NOT_STATED' ELSE 'NO_FORMAL_MINIMUM' END policy, CASE WHEN p_partkey % 4 = 0 THEN 3.2 WHEN p_partkey % 4 = 1 AND p_size % 5 = 0 THEN 3.0 END::DOUBLE minimum, p_partkey % 4 = 3 manual FROM part""",
)
def program_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources a program: they agree, differ by the part's size, or say nothing; what a person entered stays."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    one = pick("p_partkey", F.lit("A GPA of 3.2 is required."), F.lit("A GPA of 3.0 is required."), F.lit("Write to us."), F.lit("A GPA of 3.9 is required."))
    two = pick("p_partkey", F.lit("Write to us."), say("A minimum GPA of 3.", F.col("p_size") % 5, " is required."), F.lit("Write again."), F.lit("A GPA of 3.9 is required."))
    sources = p.select("p_partkey", F.explode(F.array(one, two)).alias("text"))
    state = p.where(k % 2 == 1).select("p_partkey", F.when(k % 4 == 3, "NO_FORMAL_MINIMUM").otherwise("HARD_MINIMUM").alias("policy"), F.when(k % 4 == 1, 2.0).cast("decimal(5,2)").alias("minimum"), (k % 4 == 3).alias("manual"))
    return C.program_requirements(state, sources, "p_partkey", "text").select("p_partkey", "policy", F.col("minimum").cast("double").alias("minimum"), "manual")


@query("new_directories", "SELECT 'a.edu' AS domain, 'https://a.edu/x/faculty/' || page_id url FROM pages WHERE page_id % 4 = 0")
def new_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page, each twice; addresses of news, of other domains and known ones are none."""
    i = F.col("page_id")
    u = pick("page_id", say("https://a.edu/x/faculty/", i, "/?q=1"), say("https://a.edu/news/faculty/", i), say("https://b.org/faculty/", i), say("https://a.edu/people/", i))
    p = table(spark, sf_dir, "pages").select("page_id", F.lit("a.edu").alias("domain"), u.alias("href"))
    known = p.where(i % 4 == 3).select(F.col("href").alias("url"))
    return C.directories(p.union(p), "domain", "href", known)


@query("recruiting_scan", "SELECT c_custkey, ['PRESENT', 'PRESENT', 'NOT_FOUND', 'SOURCE_UNAVAILABLE', 'NOT_FOUND'][c_custkey % 5 + 1] status, CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 END tier, CASE WHEN c_custkey % 5 < 2 THEN 'I am recruiting PhD students for group ' || c_custkey || '.' END quote FROM customer")
def recruiting_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources a person: the most trusted invitation wins; old ones, other employers' and unreached ones don't count."""
    k = F.col("c_custkey")
    yes = say("I am recruiting PhD students for group ", k, ". Other things.")
    none, old, far = F.lit("We study things."), F.lit("Jan 5, 2019 ... I am recruiting PhD students."), F.lit("I am recruiting PhD students through the UX PhD program.")
    source = lambda tier, text, reached: _row(tier=tier, text=text, reached=reached, held=True)
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lit("University of North Texas").alias("institution"), _rows(source(3, pick("c_custkey", none, yes, old, yes, far), k % 5 != 3), source(1, pick("c_custkey", yes, none, none, yes, none), k % 5 != 3), source(2, pick("c_custkey", yes, yes, none, yes, none), k % 5 == 0))
    )
    return C.recruiting_signals(c, "c_custkey", F.expr(AS_OF).cast("date")).select("c_custkey", "status", "tier", "quote")


@query("award_matches", "SELECT s_suppkey, 'A' || s_suppkey award, CASE WHEN s_suppkey % 2 = 0 THEN 30 ELSE 15 END boost FROM supplier WHERE s_suppkey % 3 = 0")
def award_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An award a supplier, listed twice: the right person, another institution, another subject."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    who = say("Ana Lee", F.translate(k.cast("string"), "0123456789", "abcdefghij"))
    people = s.select("s_suppkey", who.alias("name"), F.lit("University of North Texas").alias("institution"))
    a = s.select(say("A", k).alias("award"), F.upper(who).alias("person"), F.when(k % 3 == 1, "Ohio State University").otherwise("North Texas University").alias("institution"), F.when(k % 2 == 0, "CAREER: on nets").otherwise("On nets").alias("title"), F.when(k % 3 == 2, "of fish").otherwise("deep and wide").alias("body"))
    return C.awards(a.union(a), people, "s_suppkey", F.lit("deep nets"))


@query("found_works", "SELECT o_orderkey, [2, 1, 2][o_orderkey % 3 + 1] found, [1, 0, 0][o_orderkey % 3 + 1] accepted, ['OFFICIAL_PUBLICATIONS_FOUND', 'NO_PUBLICATIONS_FOUND', 'REVIEW_REQUIRED'][o_orderkey % 3 + 1] status FROM orders")
def found_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works listed by every order's pages, one of them twice in other letters."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    work = lambda title, doi: _row(title=title, authors=none, venue=none, year=F.lit(None).cast("int"), doi=doi)
    title = pick("o_orderkey", F.lit("Learning things from other things"), F.lit("Program committee of things"), F.lit("Short things"))
    second = pick("o_orderkey", F.lit("Phone the office"), title, F.lit("Call 555-1234"))
    doi = F.when(k % 3 == 0, say("10.1000/", k))
    w = table(spark, sf_dir, "orders").select("o_orderkey", _rows(work(title, doi), work(F.upper(title), none), work(second, none)))
    return C.discovered_works(w, "o_orderkey").select("o_orderkey", F.col("found").cast("int").alias("found"), F.col("accepted").cast("int").alias("accepted"), "status")


@query("batch_steps", "SELECT o_custkey, least(count(*), 3)::INTEGER checked, count(*) > 3 more FROM orders GROUP BY 1")
def batch_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of each customer's orders a step, and whether more wait."""
    _, summary = C.batch_step(table(spark, sf_dir, "orders"), "o_custkey", [F.asc("o_orderdate"), F.asc("o_orderkey")], 3)
    return summary.select("o_custkey", F.col("checked").cast("int").alias("checked"), "more")


@query(
    "category_sync",
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new ' || p_name ELSE p_name END AS name, p_partkey % 3 = 0 is_current FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0",
)
def category_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories after a catalog is read again: those that it names are active with its names, the others are not."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    old = p.where(k % 2 == 0).select("p_partkey", F.col("p_name").alias("name"), F.lit(True).alias("is_current"))
    return S.snapshot_swap(old, p.where(k % 3 == 0).select("p_partkey", say("new ", F.col("p_name")).alias("name")), ["p_partkey"], ["name"])


def _set(name: str, table_: str, id_: str, note: str, at: str, where: str, order: str) -> str:
    return f"(SELECT '{name}' board, {id_}::VARCHAR id, ({note})::VARCHAR note, ({at})::TIMESTAMP \"at\" FROM {table_} WHERE {where} ORDER BY {order} LIMIT 50)"


LATEST = "LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) said, max(o_orderdate) seen FROM orders GROUP BY 1) ON o_custkey = c_custkey"
BOARDS = " UNION ALL ".join(
    [
        _set("topics", "(SELECT n_nationkey, count(DISTINCT c_custkey) n, count(*) FILTER (WHERE o_orderstatus = 'P') p FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)", "n_nationkey", "n || '/' || p || '/' || CASE WHEN p > 0 THEN 'Needs attention' WHEN n > 0 THEN 'Partial' ELSE 'Waiting' END", "NULL", "true", "n_nationkey"),
        _set("workers", "(SELECT user_id, max(ts::TIMESTAMP) t FROM events GROUP BY 1)", "user_id", f"CASE WHEN t > {AS_OF} THEN 'healthy' ELSE 'silent' END", "t", "true", "t DESC, user_id"),
        _set("providers", "supplier", "s_suppkey", "CASE WHEN s_acctbal < 0 THEN 'blocked' ELSE 'open' END", "NULL", "true", "s_name, s_suppkey"),
        _set("identity_review", f"customer {LATEST}", "c_custkey", "said", "seen", "c_mktsegment = 'BUILDING'", "c_acctbal DESC, c_custkey"),
        _set("identity_decisions", f"customer {LATEST}", "c_custkey", "said", "seen", "seen IS NOT NULL AND c_mktsegment <> 'MACHINERY'", "seen DESC, c_custkey"),
        _set("model_use", "(SELECT count(*) n, max(ts::TIMESTAMP) t FROM events WHERE event_type = 'nothing of the kind')", "0", "n", "t", "true", "1"),
        _set("recruiting_issues", "customer", "c_custkey", "c_mktsegment", "NULL", "c_acctbal < 0", "c_acctbal, c_custkey"),
        _set("directory_issues", "supplier JOIN nation ON n_nationkey = s_nationkey", "s_suppkey", "n_name", "NULL", "s_acctbal < 500", "s_acctbal, s_suppkey"),
        _set("page_issues", "pages", "page_id", "url", "NULL", "page_id % 3 = 0", "page_id DESC"),
        _set("member_issues", "lineitem JOIN supplier ON s_suppkey = l_suppkey", "l_orderkey || '-' || l_linenumber", "s_name", "l_shipdate", "l_returnflag = 'A'", "l_shipdate DESC, l_orderkey, l_linenumber"),
        _set("fetch_issues", "events", "event_id", "CASE WHEN props->>'$.k' IN ('4', '10') THEN 'week' ELSE 'hours' END", "ts::TIMESTAMP + CASE WHEN props->>'$.k' IN ('4', '10') THEN INTERVAL 168 HOUR ELSE INTERVAL 6 HOUR END", "event_type = 'purchase'", "ts, event_id"),
        _set("profile_issues", "part", "p_partkey", "p_brand", "NULL", "p_size > 45", "p_size DESC, p_partkey"),
        _set("work_issues", "orders JOIN customer ON c_custkey = o_custkey", "o_orderkey", "c_name", "o_orderdate", "o_orderstatus = 'P'", "o_orderdate DESC, o_orderkey DESC"),
    ]
)


@query("operations_boards", BOARDS)
def operations_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirteen result sets of a board in one table: each is cut to its first rows before the names are joined; children are
    grouped before they are joined."""
    t = lambda n: table(spark, sf_dir, n)
    c, none = F.col, F.lit(None)
    o = t("orders")
    latest = o.groupBy(c("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("said"), F.max("o_orderdate").alias("seen"))
    who = t("customer")
    n = t("nation").select("n_nationkey")
    held = who.join(o.groupBy(c("o_custkey").alias("c_custkey")).agg(F.count_if(c("o_orderstatus") == "P").alias("p")), "c_custkey", "left").groupBy(c("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("p", F.lit(0).cast("long"))).alias("p"))
    topics = n.join(held, "n_nationkey", "left").na.fill(0)
    workers = t("events").groupBy("user_id").agg(F.max(c("ts").cast("timestamp")).alias("t"))
    review = who.where("c_mktsegment = 'BUILDING'").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50).join(latest, "c_custkey", "left")
    slow = F.get_json_object("props", "$.k").isin("4", "10")
    wait = F.when(slow, F.expr("INTERVAL '168' HOUR")).otherwise(F.expr("INTERVAL '6' HOUR"))
    poor = t("supplier").where("s_acctbal < 500").orderBy("s_acctbal", "s_suppkey").limit(50).join(t("nation"), c("n_nationkey") == c("s_nationkey"))
    back = t("lineitem").where("l_returnflag = 'A'").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber").limit(50).join(t("supplier"), c("s_suppkey") == c("l_suppkey")).withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    works = o.where("o_orderstatus = 'P'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).join(who, c("c_custkey") == c("o_custkey"))
    b = lambda name, df, order, id_, note, at=none: C.ranked_board(name, df, order, 50, id_, note, at)
    stage = F.when(c("p") > 0, "Needs attention").when(c("n") > 0, "Partial").otherwise("Waiting")
    sets = [
        b("topics", topics, [F.asc("n_nationkey")], "n_nationkey", F.concat_ws("/", "n", "p", stage)),
        b("workers", workers, [F.desc("t"), F.asc("user_id")], "user_id", F.when(c("t") > F.expr(AS_OF), "healthy").otherwise("silent"), c("t")),
        b("providers", t("supplier"), [F.asc("s_name"), F.asc("s_suppkey")], "s_suppkey", F.when(c("s_acctbal") < 0, "blocked").otherwise("open")),
        b("identity_review", review, [F.desc("c_acctbal"), F.asc("c_custkey")], "c_custkey", c("said"), c("seen")),
        b("identity_decisions", who.where("c_mktsegment <> 'MACHINERY'").join(latest, "c_custkey"), [F.desc("seen"), F.asc("c_custkey")], "c_custkey", c("said"), c("seen")),
        b("model_use", t("events").where("event_type = 'nothing of the kind'").agg(F.count(F.lit(1)).alias("n"), F.max(c("ts").cast("timestamp")).alias("t")).withColumn("id", F.lit(0)), [F.asc("id")], "id", c("n"), c("t")),
        b("recruiting_issues", who.where("c_acctbal < 0"), [F.asc("c_acctbal"), F.asc("c_custkey")], "c_custkey", c("c_mktsegment")),
        b("directory_issues", poor, [F.asc("s_acctbal"), F.asc("s_suppkey")], "s_suppkey", c("n_name")),
        b("page_issues", t("pages").where("page_id % 3 = 0"), [F.desc("page_id")], "page_id", c("url")),
        b("member_issues", back, [F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber")], "id", c("s_name"), c("l_shipdate")),
        b("fetch_issues", t("events").where("event_type = 'purchase'"), [F.asc("ts"), F.asc("event_id")], "event_id", F.when(slow, "week").otherwise("hours"), c("ts").cast("timestamp") + wait),
        b("profile_issues", t("part").where("p_size > 45"), [F.desc("p_size"), F.asc("p_partkey")], "p_partkey", c("p_brand")),
        b("work_issues", works, [F.desc("o_orderdate"), F.desc("o_orderkey")], "o_orderkey", c("c_name"), c("o_orderdate")),
    ]
    return reduce(DataFrame.unionByName, sets)


@query(
    "joint_reviews",
    """SELECT o_orderkey, c_custkey, s_suppkey FROM (SELECT o_orderkey, unnest([o_custkey, o_custkey + 1]) c_custkey FROM orders WHERE o_orderstatus = 'P') r LEFT JOIN (SELECT c_custkey k, c_nationkey FROM customer) c ON k = c_custkey
    LEFT JOIN (SELECT s_nationkey, arg_max(s_suppkey, (s_acctbal, -s_suppkey)) s_suppkey FROM supplier GROUP BY 1) s ON s_nationkey = c_nationkey""",
)
def joint_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open reviews of several people each: a row per person, with the person's latest source where there is one."""
    r = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.explode(F.array(F.col("o_custkey"), F.col("o_custkey") + 1)).alias("c_custkey"))
    best = R.distinct_on(table(spark, sf_dir, "supplier"), "s_nationkey", [F.desc("s_acctbal"), F.asc("s_suppkey")]).select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey")
    who = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return r.join(who, "c_custkey", "left").join(best, "c_nationkey", "left").select("o_orderkey", "c_custkey", "s_suppkey")

"""Registered queries on names, addresses, dates, recruiting, grades, hits, pages and job outcomes over whole tables.

The synthetic prose holds no such sentences, so each row says one about its own values; the SQL works from the values,
not from the sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, hiring, html, names, rules, text, urls
from tidemark.plans.registry import query, table


def say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def pick(key: str, *choices: Column) -> Column:
    """The choice that the key's remainder names."""
    c, k = F.lit(None), F.col(key) % len(choices)
    for i, x in reversed(list(enumerate(choices))):
        c = F.when(k == i, x).otherwise(c)
    return c


@query("customer_name_keys", "SELECT c_custkey, 'ana' || lpad(c_custkey::VARCHAR, 5, '0') || 'onunez' AS key, c_custkey % 4 <> 3 same FROM customer")
def customer_name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lpad(F.col("c_custkey").cast("string"), 5, "0")
    spelt = pick("c_custkey", say("Ana ", n, " O'Núñez"), say("Dr. Ana ", n, " O’Nunez, PhD"), say("O'NÚÑEZ, Ana ", n), say("Prof. Ana ", n, " O'Nuñez Jr."))
    other = pick("c_custkey", F.lit("A. Onunez"), F.lit("Ana Onunez"), F.lit("Ana X. Onunez"), F.lit("Bea Onunez"))
    df = table(spark, sf_dir, "customer").select("c_custkey", names.fold(spelt).alias("a"), other.alias("b"))
    return df.select("c_custkey", F.array_join(names.parts(F.col("a")), "").alias("key"), names.same_person(names.parts(F.col("a")), names.parts(names.fold(F.col("b"), ascii_only=True))).alias("same"))


@query(
    "supplier_name_rules",
    """SELECT s_suppkey, s_suppkey % 3 <> 2 compatible, s_suppkey % 4 <> 3 heading, 'Ana Lee' || repeat('x', s_nationkey + 1) shown, s_suppkey % 5 < 3 personal,
    CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END spellings, 3 tokens FROM supplier""",
)
def supplier_name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda c: names.parts(names.fold(c, ascii_only=True))
    tail = F.expr("repeat('x', s_nationkey + 1)")
    compatible = names.compatible(p(say("Ana Maria Lee", tail)), p(pick("s_suppkey", say("Ana Lee", tail), say("Lee", tail, ", B. Maria"), say("Bea Lee", tail))))
    heading = names.heading_holds(p(say("Ana Lee", tail)), p(pick("s_suppkey", say("Professor Ana Lee", tail, " at Home"), say("Profile of A. Lee", tail), say("Lee", tail, ", Ana"), say("Ana of the Lee", tail, " group"))))
    shown = names.display_name(pick("s_suppkey", say("Dr. Ana Lee", tail), say("Lee", tail, ", Ana"), say("Ana  Lee", tail, " headshot")))
    personal = names.looks_personal(pick("s_suppkey", say("Ana Lee", tail), say("Lee", tail, ", Ana"), say("Dr. Ana (Bo) Lee", tail), say("Lab of ", tail), say("Room ", F.col("s_suppkey"), " ", tail)))
    spellings = names.spellings(pick("s_suppkey", say("ana lee", tail), say("Ána Lee", tail)))
    df = table(spark, sf_dir, "supplier")
    return df.select("s_suppkey", compatible.alias("compatible"), heading.alias("heading"), shown.alias("shown"), personal.alias("personal"), F.size(spellings).alias("spellings"), F.size(names.name_tokens(names.fold(say("Ána B. Lee ", tail, "y")))).alias("tokens"))


@query("institution_hits", "SELECT n_nationkey, true own, n_nationkey % 2 = 0 hit, true short FROM nation")
def institution_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = say("University of North ", F.translate(F.col("n_name"), "_0123456789", "xabcdefghij"))
    other = pick("n_nationkey", say("news from ", F.translate(F.col("n_name"), "_0123456789", "xabcdefghij")), F.lit("news from elsewhere"))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", names.names_institution(whole, whole).alias("own"), names.hit_names_institution(whole, other).alias("hit"), names.hit_names_institution(F.lit("Institute of Modern Physics"), F.lit("the IMP team")).alias("short")
    )


@query("public_pages", "SELECT page_id, regexp_matches(url, '^https?://') AND page_id % 4 <> 3 ok, page_id % 4 <> 2 AND page_id % 4 <> 3 AND regexp_matches(url, '^https?://') clickable FROM pages")
def public_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' addresses as they are, with a user's name in them, and on private hosts."""
    u = F.col("url")
    url = pick("page_id", u, u, F.regexp_replace(u, "://", "://me:pw@"), say("http://10.0.0.", F.col("page_id") % 250, "/x"))
    return table(spark, sf_dir, "pages").select("page_id", urls.public(url).alias("ok"), urls.clickable(url).alias("clickable"))


@query("same_pages", "SELECT page_id, true a, regexp_matches(url, 'https?://[^/]+/?$') b FROM pages")
def same_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_extract("url", "^([^?#]*?)/*(?:[?#]|$)", 1)
    return table(spark, sf_dir, "pages").select("page_id", urls.same_document(F.col("url"), say(bare, "/?x=1#top")).alias("a"), urls.same_document(F.col("url"), F.regexp_extract("url", "https?://[^/]+", 0)).alias("b"))


HOST = "regexp_extract(lower(url), '^https?://([^/:?#]+)', 1)"


@query(
    "page_address_rules",
    f"""SELECT page_id, page_id % 3 = 0 recruiting, CASE WHEN page_id % 4 = 0 THEN 'https://' || {HOST} || '/faculty/' || page_id ELSE '' END directory, page_id % 2 = 0 away,
    CASE WHEN page_id % 3 = 0 THEN 'u' || page_id END scholar, CASE page_id % 3 WHEN 0 THEN 'https://doi.org/10.1/' || page_id WHEN 1 THEN '' ELSE url END meta, CASE WHEN page_id % 4 < 2 THEN 'x' || page_id || CASE page_id % 4 WHEN 0 THEN '.edu' ELSE '.ac.uk' END ELSE '' END academic FROM pages""",
)
def page_address_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, i, u = urls.host(F.col("url")), F.col("page_id"), F.col("url")
    site = say("https://", h)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.may_recruit(pick("page_id", say(site, "/join-us"), say(site, "/news/", i), say("https://x.linkedin.com/", i))).alias("recruiting"),
        urls.directory_candidate(pick("page_id", say(site, "/faculty/", i, "/?a=1#b"), say(site, "/news/faculty/", i), say(site, "/x"), say("https://other.org/faculty/", i)), h).alias("directory"),
        urls.abroad(pick("page_id", say("https://www.rit.edu/dubai/", i), say("https://www.rit.edu/", i))).alias("away"),
        urls.scholar_user(pick("page_id", say("https://scholar.google.co.uk/citations?hl=en&user=u", i), say(site, "/citations?user=u", i), say("https://scholar.google.com/x?user=u", i))).alias("scholar"),
        urls.metadata_url(pick("page_id", say("http://dx.doi.org/10.1/", i), F.lit(" "), F.lit(None).cast("string")), pick("page_id", F.lit("LAB_SITE"), F.lit("lab_site"), F.lit("JOURNAL")), u).alias("meta"),
        urls.academic_domain(say("X", i, pick("page_id", F.lit(".edu"), F.lit(".ac.uk."), F.lit(".com"), F.lit(" .edu")))).alias("academic"),
    )


SEASON = "CASE WHEN month(d) < 6 THEN 'spring' WHEN month(d) < 9 THEN 'summer' ELSE 'fall' END"


@query(
    "order_date_intervals",
    """SELECT o_orderkey, CASE k WHEN 2 THEN date_trunc('month', d)::DATE WHEN 3 THEN make_date(year(d), CASE WHEN month(d) < 6 THEN 1 WHEN month(d) < 9 THEN 6 ELSE 9 END, 1) WHEN 4 THEN make_date(year(d), 1, 1) ELSE d END::VARCHAR start_day,
    CASE k WHEN 2 THEN last_day(d) WHEN 3 THEN last_day(make_date(year(d), CASE WHEN month(d) < 6 THEN 5 WHEN month(d) < 9 THEN 8 ELSE 12 END, 1)) WHEN 4 THEN make_date(year(d), 12, 31) ELSE d END::VARCHAR end_day,
    CASE k WHEN 2 THEN 'MONTH' WHEN 3 THEN 'SEASON' WHEN 4 THEN 'YEAR' ELSE 'DAY' END AS precision, d::VARCHAR any_day
    FROM (SELECT o_orderkey, o_orderkey % 5 k, (o_orderdate + INTERVAL 20 YEAR)::DATE d FROM orders)""",
)
def order_date_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' dates, twenty years on, in five spellings."""
    f = lambda p: F.date_format("d", p)
    season = F.when(F.month("d") < 6, "Spring").when(F.month("d") < 9, "summer").otherwise("Fall")
    t = pick("o_orderkey", say("Posted ", f("MMMM d, yyyy"), " by us"), say("opening of ", f("yyyy-MM-dd"), "."), say("start in ", f("MMM"), ". ", f("yyyy")), say("For ", season, " '", f("yy")), say("since ", f("yyyy")))
    day = pick("o_orderkey", f("yyyy-MM-dd"), f("MM/dd/yyyy"), f("MMM d, yyyy"), f("MMMM d, yyyy"), f("d MMM yyyy"))
    df = table(spark, sf_dir, "orders").withColumn("d", F.add_months(F.col("o_orderdate").cast("date"), 240)).select("o_orderkey", dates.interval(t).alias("i"), dates.any_date(day).cast("string").alias("any_day"))
    return df.select("o_orderkey", F.col("i.start").cast("string").alias("start_day"), F.col("i.end").cast("string").alias("end_day"), F.col("i.precision").alias("precision"), "any_day")


@query(
    "order_freshness",
    """SELECT o_orderkey, CASE WHEN d > DATE '2020-01-01' THEN 'UPCOMING' WHEN o_orderkey % 2 = 0 AND d < DATE '2020-01-01' THEN 'EXPIRED' WHEN DATE '2020-01-01' - d <= 30 THEN 'CURRENT' WHEN DATE '2020-01-01' - d <= 180 THEN 'OLDER' ELSE 'HISTORICAL' END fresh
    FROM (SELECT o_orderkey, (o_orderdate + INTERVAL 20 YEAR)::DATE d FROM orders)""",
)
def order_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.date_format(F.add_months(F.col("o_orderdate").cast("date"), 240), "MMMM d, yyyy")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.freshness(pick("o_orderkey", say("Deadline: ", d), say("Posted ", d)), F.lit("2020-01-01").cast("date")).alias("fresh"))


@query(
    "customer_invitations",
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN true WHEN 2 THEN true WHEN 4 THEN c_nationkey <= 7 ELSE false END recruits,
    CASE c_custkey % 6 WHEN 0 THEN 'PhD' WHEN 1 THEN 'Intern' WHEN 2 THEN 'Postdoc' WHEN 4 THEN 'Research Assistant' WHEN 5 THEN 'PhD' END role, c_custkey % 6 = 2 funded FROM customer""",
)
def customer_invitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.col("c_name")
    t = pick(
        "c_custkey",
        say(who, " is looking for two motivated PhD students."),
        say(who, " is not accepting interns."),
        say("We are seeking postdocs; the work is funded by ", who, "."),
        say(who, " is looking for a quiet place."),
        say("Seeking ", F.expr("repeat('very ', c_nationkey)"), "good research assistants for ", who),
        say("We welcome ", who, ", who will be a PhD student."),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", hiring.recruits(t).alias("recruits"), hiring.primary_role(hiring.roles(t)).alias("role"), hiring.funded(t).alias("funded"))


@query(
    "customer_quotes",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || ' is recruiting PhD students. We seek postdocs!' WHEN 1 THEN '' WHEN 2 THEN c_name || ' is seeking interns.' ELSE '' END quote FROM customer""",
)
def customer_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.col("c_name")
    t = pick(
        "c_custkey",
        say("Mar 3, 2025 ... Welcome here. ", who, " is recruiting PhD students. We seek postdocs! We invite interns."),
        say("Mar 3, 2021 — ", who, " is recruiting PhD students."),
        say(who, " is seeking interns. Like on Twitter 12 We are seeking PhD students."),
        say(who, " has no new openings for PhD students. See you."),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", hiring.quote(t, F.lit(2026)).alias("quote"))


@query(
    "customer_shared_pages",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'We are seeking PhD students.' ELSE '' END said, c_custkey % 3 <> 2 held, true own, c_custkey % 2 = 0 clash FROM customer""",
)
def customer_shared_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory's blocks: only what stands below a person's own heading counts."""
    block = lambda tag, t: F.struct(F.lit(tag).alias("tag"), t.alias("text"))
    who = F.col("c_name")
    want = F.lit("We are seeking PhD students.")
    blocks = pick(
        "c_custkey",
        F.array(block("h1", F.lit("People")), block("h3", who), block("p", F.lit("Office 12.")), block("p", want), block("h3", F.lit("Someone Else")), block("p", F.lit("We are seeking interns now."))),
        F.array(block("h3", who), block("p", F.lit("Office 12.")), block("h2", F.lit("Someone Else")), block("p", want)),
        F.array(block("h3", F.lit("Someone Else")), block("p", want)),
    )
    page = F.array_join(F.transform(blocks, lambda b: b["text"]), " ")
    clash = hiring.conflicting_program(pick("c_custkey", F.lit("Apply to the UX PhD program."), F.lit("Apply to the UNT PhD program.")), F.lit("University of North Texas"))
    df = table(spark, sf_dir, "customer").select("c_custkey", F.array_join(hiring.scoped_sentences(blocks, who), "|").alias("said"), hiring.attributed(page, who, F.lit(True)).alias("held"), hiring.person_page(say("https://a.org/people/", F.lower(F.replace(who, F.lit("#"), F.lit("-")))), F.lit("People"), who).alias("own"), clash.alias("clash"))
    return df


@query(
    "part_grade_texts",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'FOUND' WHEN 1 THEN 'NO_MINIMUM' WHEN 2 THEN 'NEEDS_REVIEW' WHEN 3 THEN 'NOT_FOUND' WHEN 4 THEN CASE WHEN p_size % 4 = 1 THEN 'FOUND' ELSE 'NEEDS_REVIEW' END ELSE 'NOT_FOUND' END status,
    CASE WHEN p_partkey % 6 = 0 THEN 2 + (p_size % 20) / 10.0 WHEN p_partkey % 6 = 4 AND p_size % 4 = 1 THEN 3.1 END::DOUBLE minimum, CASE WHEN p_partkey % 6 = 0 THEN 4.0 END::DOUBLE scale, CASE p_partkey % 6 WHEN 0 THEN 'HARD_MINIMUM' WHEN 1 THEN 'NO_FORMAL_MINIMUM' WHEN 4 THEN CASE WHEN p_size % 4 = 1 THEN 'HARD_MINIMUM' END WHEN 5 THEN 'RECOMMENDED' END policy FROM part""",
)
def part_grade_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission texts of several lines: sections, another degree, lines that disagree, advice."""
    size = F.col("p_size")
    least = F.format_number(2 + (size % 20) / 10, 1)
    t = pick(
        "p_partkey",
        say("Admission\nApplicants must have a GPA of ", least, " on a 4.0 scale.\nWrite to us."),
        say(F.col("p_name"), "\nThere is no minimum GPA."),
        say("Master's program\nA GPA of 3.0 is required."),
        say("Scholarships\nA GPA of 3.0 is required.\nIs a GPA of 3.9 required?"),
        say("Admission\nA GPA of 3.1 is required.\nThe minimum GPA is 3.", size % 4, " for all."),
        say("Admission\nA GPA of 3.", size % 10, " is recommended."),
    )
    df = table(spark, sf_dir, "part").select("p_partkey", t.alias("t"), rules.grades(t).alias("g"))
    return df.select("p_partkey", F.col("g.status").alias("status"), F.col("g.minimum").cast("double").alias("minimum"), F.col("g.scale").cast("double").alias("scale"), rules.grade_policy(F.col("g"), F.col("t")).alias("policy"))


@query(
    "part_group_grades",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'no_lab_cutoff' WHEN 1 THEN 'holistic_review' WHEN 2 THEN 'minimum' END policy, CASE WHEN p_partkey % 4 = 2 THEN 3 + (p_size % 10) / 10.0 END::DOUBLE minimum, CASE WHEN p_partkey % 4 = 2 THEN CASE WHEN p_size % 2 = 0 THEN 'program' ELSE 'lab' END END AS "scope" FROM part""",
)
def part_group_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pick("p_partkey", F.lit("We have no minimum GPA."), F.lit("Your GPA is read in a holistic way."), say("The ", F.when(F.col("p_size") % 2 == 0, "program").otherwise("lab"), " asks for a minimum GPA of 3.", F.col("p_size") % 10), F.lit("A GPA is a number."))
    g = hiring.group_grade(F.array(F.col("p_name"), s))
    return table(spark, sf_dir, "part").select("p_partkey", g.alias("g")).select("p_partkey", F.col("g.policy").alias("policy"), F.col("g.minimum").cast("double").alias("minimum"), F.col("g.scope").alias("scope"))


@query("part_grant_fit", "SELECT p_partkey, p_size % 3 = 0 security, p_size % 2 = 0 topic FROM part")
def part_grant_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, size = F.col("p_name"), F.col("p_size")
    guard = F.when(size % 3 == 0, "privacy-preserving systems").otherwise("large systems")
    return table(spark, sf_dir, "part").select("p_partkey", hiring.grant_fits(F.lit("AI security"), say(name, " ", guard)).alias("security"), hiring.grant_fits(F.lit("deep nets"), say(name, F.when(size % 2 == 0, " deeper nets").otherwise(" deeper seas"))).alias("topic"))


@query(
    "part_title_rules",
    """SELECT p_partkey, 'On ' || p_name clean, p_partkey % 3 <> 0 none, CASE WHEN p_partkey % 2 = 0 THEN 'A study of things ' || p_partkey ELSE '' END marked, p_partkey % 2 = 0 supported, 'unit-' || p_partkey slug FROM part""",
)
def part_title_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, i = F.col("p_name"), F.col("p_partkey")
    titles = F.array(F.lit("short one"), say("careful measurement across moving platforms ", name))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.clean_title(say("[Best paper award] On ", name)).alias("clean"),
        text.no_title(pick("p_partkey", say("On ", name), say("files/", i, "/x.pdf"), say("A. Lee. On things. Proceedings of ", i, ", 2020."))).alias("none"),
        text.title_in_markup(pick("p_partkey", say('<a href="/x">A study of things ', i, ". Journal of X, 2020"), say("href=/x>Short ", i))).alias("marked"),
        text.supporting_title(titles, pick("p_partkey", say("We did careful measurement across moving platforms: ", name), say("We did careful work on ", name))).alias("supported"),
        text.slug(say("Unit: ", i)).alias("slug"),
    )


@query(
    "nation_units",
    """SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Department of Physics ' || n_nationkey WHEN 1 THEN 'Applied Optics' ELSE 'University faculty' END unit, CASE n_nationkey % 3 WHEN 0 THEN 'optics|lasers ' || n_nationkey WHEN 1 THEN 'deep nets|vision' ELSE '' END labels FROM nation""",
)
def nation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("n_nationkey")
    unit = text.unit_name(pick("n_nationkey", F.lit("https://a.edu/x/y"), F.lit("https://a.edu/applied-optics/people/list"), F.lit("https://a.edu/people")), pick("n_nationkey", say("Directory | Department of Physics ", i, " | University College of Somewhere"), F.lit("People"), F.lit(None).cast("string")))
    labels = text.interest_labels(pick("n_nationkey", say("• optics; lasers ", i, "\nCall the office at 555-123-4567"), F.lit("deep nets, vision, and others"), F.lit("I work on many things, all of them good.\nand more")))
    return table(spark, sf_dir, "nation").select("n_nationkey", unit.alias("unit"), F.array_join(labels, "|").alias("labels"))


@query("customer_hits", "SELECT c_custkey, c_custkey % 5 <> 3 kept FROM customer")
def customer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits against the phrase that the query quotes."""
    none = F.lit(None).cast("string")
    n = F.col("c_custkey")
    asked = pick("c_custkey", F.lit('"Vari Ny" phd'), F.lit('"Vari Ny" phd'), F.lit("no quotation"), F.lit('"Vari Ny" phd'), F.lit('"Vari Ny" site:a.edu'))
    title = pick("c_custkey", say("Ny, Vari: page ", n), say("Va ri N y ", n), F.lit("x"), say("Vari Nyman ", n), F.lit("People"))
    href = pick("c_custkey", none, none, none, F.lit("https://a.edu/x"), F.lit("https://www.a.edu/our/faculty"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.about_anchor(asked, title, none, href).alias("kept"))


@query(
    "order_job_outcomes",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'REVIEW_REQUIRED' WHEN o_custkey % 3 > 0 THEN 'APPROVED' ELSE 'NO_CHANGE' END WHEN 1 THEN 'APPROVED' WHEN 2 THEN 'REVIEW_REQUIRED' WHEN 3 THEN CASE WHEN o_orderstatus = 'F' THEN 'SOURCE_UNAVAILABLE' WHEN o_custkey % 3 > 0 THEN 'APPROVED' ELSE 'NO_CHANGE' END WHEN 4 THEN 'NO_CHANGE' ELSE 'SUCCEEDED' END outcome FROM orders""",
)
def order_job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = pick("o_orderkey", *map(F.lit, ("CRAWL_DIRECTORY", "MATCH_PUBLICATIONS", "CHECK_GRADES", "CHECK_HIRING", "REVIEW_INTERESTS", "OTHER")))
    status = pick("o_orderkey", F.lit(None), F.lit("SCHOLAR_VERIFIED"), F.lit("NEEDS_REVIEW"), F.lit(None), F.lit("NOT_APPLICABLE"), F.lit(None))
    late = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.job_outcome(kind, status, F.col("o_custkey") % 3, late.cast("int"), late).alias("outcome"))


@query(
    "page_roster_class",
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'DEPARTMENT_FACULTY_ROSTER' WHEN 1 THEN 'EDITORIAL_OR_HISTORICAL' WHEN 2 THEN 'MIXED_PEOPLE_DIRECTORY' WHEN 3 THEN 'NO_PERSON_ROSTER' WHEN 4 THEN 'UNKNOWN' ELSE 'AWARD_OR_HONOR' END page_type, page_id % 3 = 0 past FROM pages""",
)
def page_roster_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    url = pick("page_id", say("https://a.edu/people/", i), say("https://a.edu/news/", i), say("https://a.edu/people/", i), say("https://a.edu/people/", i), say("https://a.org/p/", i), say("https://a.edu/people/", i))
    title = pick("page_id", *map(F.lit, ("Faculty | Department of Physics", "Faculty", "Faculty and staff | Department of Physics", "Faculty | Department of Physics", "Somewhere", "Faculty honors of the department")))
    members = pick("page_id", *map(F.lit, (12, 12, 12, 0, 12, 12)))
    blank = F.lit(None).cast("string")
    past = rules.historical(pick("page_id", F.lit("In memoriam: Ana Lee (1930)"), F.lit("Ana Lee studies how her teacher passed on."), F.lit("Bea Ray passed away. Ana Lee writes.")), F.lit("Ana  Lee"))
    return table(spark, sf_dir, "pages").select("page_id", rules.roster_page(url, title, blank, blank, blank, members, F.lit(0))["page_type"].alias("page_type"), past.alias("past"))


@query("page_sections", "SELECT page_id, 'optics ' || page_id || '|lasers' interests, 'Born in year ' || page_id || '.' || repeat(' Then work.', 9) bio, 2 aliases, 'A title long enough of ' || page_id titles FROM pages")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with a profile's sections behind it: interests, biography, works."""
    i = F.col("page_id")
    page = say(
        "<main><h1>Ana B. Lee</h1><h2>Research Interests:</h2><ul><li>optics ", i, "</li><li>lasers</li></ul><h2>Biography</h2><p>Born in year ", i, ".", F.expr("repeat(' Then work.', 9)"),
        "</p><h2>Selected Publications</h2><ul><li>A title long enough of ", i, "</li><li>short</li></ul><h2>Contact</h2><p>Office 1</p></main><aside><p>", F.lit("Else"), "</p></aside>",
    )
    df = html.parse(table(spark, sf_dir, "pages").select("page_id", page.alias("html")))
    s = html.profile_signals(F.col("main"), F.lit("Ana Lee"))
    return df.select("page_id", F.array_join(html.interests(F.col("main")), "|").alias("interests"), html.biography(F.col("main")).alias("bio"), F.size(F.filter(s["aliases"], lambda a: a.contains("Lee"))).alias("aliases"), F.array_join(s["titles"], "|").alias("titles"))


@query("scholar_profiles", "SELECT page_id, 'Ana Lee' AS name, 'Lab ' || page_id affiliation, 'Verified email at a.edu' mail, 'On things ' || page_id title, 'A Lee' authors, 'Venue, 2020' venue, 2020 AS \"year\" FROM pages")
def scholar_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    page = say(
        '<div id="gsc_prf_in">Ana Lee</div><div class="gsc_prf_il">Lab ', i, '</div><div class="gsc_prf_il">Verified email at a.edu</div><table><tr class="gsc_a_tr"><td><a class="gsc_a_at">On things ', i,
        '</a><div class="gs_gray">A Lee</div><div class="gs_gray">Venue, 2020</div></td><td class="gsc_a_y"><span>2020</span></td></tr><tr class="gsc_a_tr"><td>no title</td></tr></table>',
    )
    spark.udtf.register("tidemark_scholar", html.ScholarProfile)
    table(spark, sf_dir, "pages").select("page_id", page.alias("html")).createOrReplaceTempView("tidemark_scholar_pages")
    df = spark.sql("SELECT p.page_id, x.* FROM tidemark_scholar_pages p, LATERAL tidemark_scholar(p.html) x")
    return df.select("page_id", "name", "affiliation", F.col("verified_email").alias("mail"), "title", "authors", "venue", "year")


def _through(spark: SparkSession, sf_dir: str, page: Column, name: str, function) -> DataFrame:
    spark.udtf.register(name, function)
    table(spark, sf_dir, "pages").select("page_id", page.alias("html")).createOrReplaceTempView(f"{name}_pages")
    return spark.sql(f"SELECT p.page_id, x.* FROM {name}_pages p, LATERAL {name}(p.html) x")


@query(
    "roster_people",
    """SELECT page_id, 'Ann B. Lee' AS name, 'Associate Professor of Things ' || page_id title, 'ann' || page_id || '@x.edu' email, '/p/' || page_id profile_url FROM pages
    UNION ALL SELECT page_id, 'Bob Ray', 'Lecturer', NULL, NULL FROM pages""",
)
def roster_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory behind every page's own menu: people with their titles, not the bare name at the end."""
    i = F.col("page_id")
    page = say('<nav><a href="/x">Home Page</a></nav><div><h3><a href="/p/', i, '">Ann B. Lee</a></h3><p>Associate Professor of Things ', i, "</p><p>ann", i, "@x.edu</p></div><div><h3>Bob Ray</h3><p>Lecturer</p></div><div><h3>Cy Roe</h3></div>")
    return _through(spark, sf_dir, page, "tidemark_people", html.Directory)


@query("listed_works", "SELECT page_id, 'Learning things from other things' title, 'A. Lee, B. Ray' authors, 2000 + (page_id % 20)::INTEGER \"year\", '10.1000/x' || page_id doi FROM pages")
def listed_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    page = say('<h2>Publications</h2><ul><li>A. Lee, B. Ray. "Learning things from other things," Venue, ', 2000 + i % 20, ". 10.1000/x", i, "</li><li>no year</li></ul><h2>Contact</h2><p>since 1999</p>")
    return _through(spark, sf_dir, page, "tidemark_listed", html.Publications).select("page_id", "title", "authors", "year", "doi")

"""Registered queries on life cycles, the whole integrity audit, status reports and operations boards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import rules, scoring, text
from tidemark.operators import lifecycle as L
from tidemark.operators import relational as R
from tidemark.operators import state as S
from tidemark.plans.function_queries import ASKED, RUN
from tidemark.plans.registry import query, table

AS_OF = "TIMESTAMP '2024-01-10 00:00:00'"


@query(
    "run_life_cycle",
    """SELECT o_orderkey run_id, CASE k WHEN 1 THEN 'exhausted' WHEN 2 THEN 'failed' ELSE 'running' END status, CASE k WHEN 0 THEN left(repeat('step ', 40), 160) WHEN 1 THEN 'Goal reached' WHEN 2 THEN 'Failed' ELSE 'start' END stage,
    CASE k WHEN 0 THEN 100 WHEN 1 THEN 100 ELSE 5 END progress, CASE k WHEN 1 THEN NULL WHEN 2 THEN 'broken' ELSE 'old' END error, k < 3 touched, CASE k WHEN 0 THEN 7 WHEN 1 THEN 0 ELSE 3 END found
    FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN 3 ELSE o_orderkey % 5 END k FROM orders)""",
)
def run_life_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 5).alias("k"))
    at = F.lit("2024-01-01").cast("timestamp")
    runs = o.select("run_id", F.lit("running").alias("status"), F.lit("start").alias("stage"), F.lit(5).alias("progress"), F.lit("old").alias("error"), F.lit(None).cast("timestamp").alias("heartbeat_at"), *[F.lit(3).alias(c) for c in L.COUNTERS])
    none = F.lit(None).cast("int")
    kind = F.when(F.col("k") == 0, "update").when(F.col("k") == 2, "fail").otherwise("finish")
    stage = F.when(F.col("k") == 0, F.repeat(F.lit("step "), 40)).when(F.col("k") == 1, "exhausted").otherwise("unknown")
    new = o.where("k < 4").select("run_id", kind.alias("kind"), stage.alias("stage"), F.lit(250).alias("progress"), F.lit("broken").alias("error"), F.when(F.col("k") == 0, 7).alias("found"), none.alias("ranked"), F.when(F.col("k") == 0, -4).alias("checked"))
    return L.run_updates(runs, new, at).select("run_id", "status", "stage", "progress", "error", F.col("heartbeat_at").isNotNull().alias("touched"), "found")


@query(
    "recruiting_checks",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'SOURCE_UNAVAILABLE' WHEN 1 THEN 'PRESENT' WHEN 2 THEN 'NOT_FOUND' ELSE 'NEW' END status, CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 3 THEN 2 ELSE 0 END failures, CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 30 ELSE 9 END next_days, CASE WHEN c_custkey % 4 = 1 AND c_nationkey % 2 = 0 THEN 'PRESENT' ELSE 'NOT_FOUND' END signal FROM customer""",
)
def recruiting_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2024-01-01").cast("timestamp")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 4).alias("k"))
    state = c.select("c_custkey", "c_nationkey", F.lit(None).cast("timestamp").alias("checked_at"), F.lit("NEW").alias("status"), F.lit(2).alias("failures"), (at + F.make_dt_interval(F.lit(9))).alias("next_at"))
    status = F.when(F.col("k") == 0, "SOURCE_UNAVAILABLE").when(F.col("k") == 1, "PRESENT").otherwise("NOT_FOUND")
    done = L.recruiting_check(state, c.where("k < 3").select("c_custkey", status.alias("status"), F.lit(None).cast("int").alias("days")), "c_custkey", at)
    signal = L.recruiting_signal(F.col("status"), F.when(F.col("c_nationkey") % 2 == 0, "CURRENT").otherwise("HISTORICAL"), at)["check_status"]
    return done.join(c.select("c_custkey", "c_nationkey"), "c_custkey").select("c_custkey", "status", "failures", F.datediff("next_at", at).alias("next_days"), signal.alias("signal"))


@query(
    "candidate_queue",
    """WITH f AS (SELECT o_custkey, min(o_orderkey) o_orderkey FROM orders GROUP BY 1)
    SELECT o_custkey, o_orderkey FROM f WHERE NOT (o_custkey % 3 = 0 OR (o_custkey % 3 = 1 AND o_custkey % 2 = 0))""",
)
def candidate_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as profiles: a third refreshed yesterday, a third failed, half of these an hour ago."""
    as_of = F.expr(AS_OF)
    found = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    k = F.col("o_custkey") % 3
    hours = F.when(k == 0, 24).when(F.col("o_custkey") % 2 == 0, 1).otherwise(8)
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")).where(k < 2).select("o_custkey", (as_of - F.make_dt_interval(F.lit(0), hours)).alias("at"), (k == 1).alias("failed"))
    return L.queue_candidates(found, known, "o_custkey", [F.asc("o_orderkey")], "at", as_of)


@query(
    "quota_cache",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 5 WHEN s_suppkey % 4 = 1 THEN NULL WHEN s_suppkey % 4 = 2 THEN s_nationkey END remaining, CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 60 WHEN 2 THEN CASE WHEN s_nationkey > 0 THEN 0 ELSE 300 END ELSE 300 END wait FROM supplier""",
)
def quota_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of, k = F.expr(AS_OF), F.col("s_suppkey") % 4
    s = table(spark, sf_dir, "supplier")
    health = s.select("s_suppkey", F.when(k != 1, 5).alias("remaining"), F.when(k < 2, as_of + F.expr("INTERVAL '60' SECOND")).otherwise(as_of - F.expr("INTERVAL '1' SECOND")).alias("reset_at"))
    return L.quota_state(health, s.where(k <= 2).select("s_suppkey", F.col("s_nationkey").alias("remaining")), "s_suppkey", as_of)


@query("submissions", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'moderator' WHEN 'MACHINERY' THEN 'self_submitted' ELSE 'community' END source_kind, CASE c_mktsegment WHEN 'BUILDING' THEN 100 WHEN 'MACHINERY' THEN 95 ELSE 60 END score, 'pending' status FROM customer")
def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("c_mktsegment") == "BUILDING", "moderator").when(F.col("c_mktsegment") == "MACHINERY", "member")
    return table(spark, sf_dir, "customer").select("c_custkey", L.submission(role).alias("x")).select("c_custkey", "x.*")


@query(
    "work_buckets",
    """SELECT bucket, count(*) n FROM (SELECT CASE WHEN l_returnflag = 'A' THEN 'REJECT' WHEN l_linestatus = 'F' AND l_quantity > 25 THEN 'ACCEPT' WHEN l_discount >= 0.05 THEN 'ACCEPT' ELSE 'REVIEW' END bucket FROM lineitem) GROUP BY 1""",
)
def work_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a work: a person's decision, the gate's, a model's with its confidence."""
    staff = F.when(F.col("l_returnflag") == "A", "REJECT")
    gate = F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 25), "ACCEPT").otherwise("AMBIGUOUS")
    bucket = L.work_bucket(staff, gate, F.lit("ACCEPT"), F.when(F.col("l_discount") >= 0.05, 0.8).otherwise(0.79))
    return table(spark, sf_dir, "lineitem").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "two_sided_evidence",
    """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'official not grounded|one-sided' WHEN 2 THEN 'one-sided' ELSE 'decision|other not grounded' END problems, s_suppkey % 3 <> 0 card FROM supplier""",
)
def two_sided_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name, none = F.col("s_suppkey") % 4, F.col("s_name"), F.array().cast("array<string>")
    official = F.when(k == 1, F.array(name)).otherwise(F.array(F.lit("Soft  Matter")))
    other = F.when(k == 2, none).when(k == 3, F.array(F.lit("elsewhere"))).otherwise(F.array(F.lit("at A.edu")))
    said = F.when(k == 3, "MAYBE").otherwise("YES")
    bad = L.two_sided(said, official, other, F.concat(name, F.lit(" works on soft matter")), F.concat(name, F.lit(" at a.edu")), name)
    three = F.col("s_suppkey") % 3
    one = F.array(F.lit("lee@a.edu"))
    card = L.card_needs_review(F.when(three != 1, F.lit("Professor")), F.lit("lee"), F.lit("lee@a.edu"), F.lit("https://a.edu/p"), F.when(three == 2, F.array(F.lit("lee@a.edu"), F.lit("x@a.edu"))).otherwise(one), one)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(bad, "|").alias("problems"), card.alias("card"))


@query("category_catalog", "SELECT lower(replace(replace(p_brand, '#', '-'), ' ', '-')) category_key, CASE WHEN min(p_size) = 1 THEN 'NARROW' ELSE 'BROAD' END breadth FROM part GROUP BY p_brand")
def category_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").groupBy(text.slug(F.col("p_brand")).alias("category_key")).agg(F.min("p_size").alias("least"))
    return L.catalog(g.select("category_key", F.lit("BROAD").alias("breadth")), g.where("least = 1").select("category_key", F.lit("NARROW").alias("breadth")))


AUDIT = """SELECT 'no_current_evidence' issue, c_custkey id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase')
UNION ALL SELECT 'historical_source', page_id FROM pages WHERE regexp_matches(url, '(?i)/(news|stories?|events?|awards?|honors?|alumni|archive|grantsandawards)/')
UNION ALL SELECT 'institution_conflict', l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IS DISTINCT FROM s_nationkey AND l_quantity > 49)
UNION ALL SELECT 'several_institutions', l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey HAVING count(DISTINCT s_nationkey) > 6
UNION ALL SELECT 'listed_nowhere', s_suppkey FROM supplier WHERE s_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50)
UNION ALL SELECT 'topic_without_evidence', doc_id FROM labels WHERE quality = 1 AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id AND d.lang = 'en')
UNION ALL SELECT 'supported_without_works', c_custkey FROM customer WHERE (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') OR EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')"""


@query("whole_integrity_audit", AUDIT)
def whole_integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven checks, one row per finding: anti-joins, a null-safe conflict, a group over several parents, a pattern."""
    t = lambda n: table(spark, sf_dir, n)
    who, o = t("customer").select("c_custkey", "c_nationkey"), t("orders").withColumnRenamed("o_custkey", "c_custkey")
    open_ = o.where("o_orderstatus = 'O'")
    seen = t("events").withColumnRenamed("user_id", "c_custkey")
    line = t("lineitem").select("l_orderkey", "l_quantity", F.col("l_suppkey").alias("s_suppkey"))
    sup = t("supplier").select("s_suppkey", "s_nationkey")
    placed = line.join(sup, "s_suppkey")
    far = placed.where("l_quantity > 49").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "c_custkey"), "l_orderkey").join(who, "c_custkey").where(~F.col("c_nationkey").eqNullSafe(F.col("s_nationkey")))
    found = {
        "no_current_evidence": R.any_of_semi(who, [open_, seen.where("event_type = 'purchase'")], "c_custkey", negate=True).select("c_custkey"),
        "historical_source": t("pages").where(F.col("url").rlike(r"(?i)/(news|stories?|events?|awards?|honors?|alumni|archive|grantsandawards)/")).select("page_id"),
        "institution_conflict": far.select("l_orderkey").distinct(),
        "several_institutions": placed.groupBy("l_orderkey").agg(F.countDistinct("s_nationkey").alias("n")).where("n > 6").select("l_orderkey"),
        "listed_nowhere": R.any_of_semi(t("supplier").where("s_acctbal > 0"), [line.where("l_quantity = 50")], "s_suppkey", negate=True).select("s_suppkey"),
        "topic_without_evidence": R.any_of_semi(t("labels").where("quality = 1"), [t("documents").where("lang = 'en'")], "doc_id", negate=True).select("doc_id"),
        "supported_without_works": R.any_of_semi(R.any_of_semi(who, [open_, seen], "c_custkey"), [o.where(F.col("o_orderpriority").startswith("1"))], "c_custkey", negate=True).select("c_custkey"),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("issue"), F.col(df.columns[0]).cast("long").alias("id")) for n, df in found.items()])


REPORTS = """SELECT 'people' report, '' part, count(*) n, count(DISTINCT c_nationkey) m FROM customer
UNION ALL SELECT 'directories', '', count(*), count(*) FILTER (WHERE s_acctbal > 0) FROM supplier
UNION ALL SELECT 'memberships', '', count(*), count(*) FILTER (WHERE l_linestatus = 'O') FROM lineitem
UNION ALL SELECT 'topics', p_brand || '/' || p_size, count(*), 0 FROM part GROUP BY 2
UNION ALL SELECT 'active_jobs', o_orderpriority || '/' || o_orderstatus, count(*), 0 FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 2
UNION ALL SELECT 'signals_by_origin', c_mktsegment || '/' || event_type, count(*), 0 FROM events JOIN customer ON c_custkey = user_id GROUP BY 2
UNION ALL SELECT 'grades_by_origin', c_mktsegment, count(*) FILTER (WHERE c_acctbal > 0), count(*) FILTER (WHERE c_acctbal > 5000 OR c_nationkey = 1) FROM customer GROUP BY 2
UNION ALL (SELECT 'reused_sources', p_partkey::VARCHAR, n, 0 FROM (SELECT l_partkey p_partkey, count(DISTINCT l_suppkey) n FROM lineitem GROUP BY 1) WHERE n >= 2 ORDER BY n DESC, p_partkey LIMIT 30)"""


@query("status_reports", REPORTS)
def status_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight reports in one table: (report, part, n, m)."""
    t = lambda n: table(spark, sf_dir, n)
    n, zero = F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("m")
    pair = lambda a, b: F.concat_ws("/", a, b).alias("part")
    signals = t("events").join(t("customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment"), "user_id")
    reused = t("lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("n")).where("n >= 2").orderBy(F.desc("n"), "l_partkey").limit(30)
    found = {
        "people": t("customer").agg(n, F.countDistinct("c_nationkey").alias("m")).withColumn("part", F.lit("")),
        "directories": t("supplier").agg(n, F.count_if(F.col("s_acctbal") > 0).alias("m")).withColumn("part", F.lit("")),
        "memberships": t("lineitem").agg(n, F.count_if(F.col("l_linestatus") == "O").alias("m")).withColumn("part", F.lit("")),
        "topics": t("part").groupBy(pair("p_brand", F.col("p_size").cast("string"))).agg(n, F.max(zero).alias("m")),
        "active_jobs": t("orders").where("o_orderstatus in ('O', 'P')").groupBy(pair("o_orderpriority", "o_orderstatus")).agg(n, F.max(zero).alias("m")),
        "signals_by_origin": signals.groupBy(pair("c_mktsegment", "event_type")).agg(n, F.max(zero).alias("m")),
        "grades_by_origin": t("customer").groupBy(F.col("c_mktsegment").alias("part")).agg(F.count_if(F.col("c_acctbal") > 0).alias("n"), F.count_if((F.col("c_acctbal") > 5000) | (F.col("c_nationkey") == 1)).alias("m")),
        "reused_sources": reused.select(F.col("l_partkey").cast("string").alias("part"), "n", zero),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(r).alias("report"), "part", "n", "m") for r, df in found.items()])


@query(
    "review_counters",
    """SELECT (SELECT count(*) FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING') approved, (SELECT count(*) FROM supplier WHERE s_acctbal < 0) + (SELECT count(*) FROM part WHERE p_size < 3) + (SELECT count(*) FROM labels WHERE quality = 0) needs_review,
    (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') + (SELECT count(*) FROM labels WHERE toxic = 1) rejected, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') failures, (SELECT count(DISTINCT o_custkey) FROM orders) with_works, (SELECT count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) without_works""",
)
def review_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counters over many tables: each table is read once for all of its own counters."""
    t = lambda n: table(spark, sf_dir, n)
    n = F.count(F.lit(1))
    parts = [
        t("customer").agg(F.count_if((F.col("c_acctbal") > 0) & (F.col("c_mktsegment") == "BUILDING")).alias("approved")),
        t("supplier").agg(F.count_if(F.col("s_acctbal") < 0).alias("a")),
        t("part").agg(F.count_if(F.col("p_size") < 3).alias("b")),
        t("labels").agg(F.count_if(F.col("quality") == 0).alias("c"), F.count_if(F.col("toxic") == 1).alias("d")),
        t("lineitem").agg(F.count_if(F.col("l_returnflag") == "R").alias("e")),
        t("orders").agg(F.count_if(F.col("o_orderstatus") == "P").alias("failures"), F.countDistinct("o_custkey").alias("with_works")),
        t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(n.alias("without_works")),
    ]
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # single rows
    return one.select("approved", (F.col("a") + F.col("b") + F.col("c")).alias("needs_review"), (F.col("d") + F.col("e")).alias("rejected"), "failures", "with_works", "without_works")


@query(
    "job_board",
    f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '2000-01-01' THEN 'stalled' ELSE o_orderstatus END status, o_orderstatus stored, CASE WHEN o_orderstatus = 'P' THEN floor(epoch({AS_OF} - o_orderdate))::BIGINT END running, c_name, n_name
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey LIMIT 100""",
)
def job_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred jobs that a board shows, joined with their names only after they are chosen."""
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    top = table(spark, sf_dir, "orders").orderBy(rank, F.desc("o_orderdate"), "o_orderkey").limit(100)
    who = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").select("c_custkey", "c_name", "n_name")
    late = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp"))
    ran = F.datediff(F.expr(AS_OF).cast("date"), F.col("o_orderdate").cast("date")).cast("long") * 86400
    return top.join(who, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", F.when(late, "stalled").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderstatus").alias("stored"), F.when(F.col("o_orderstatus") == "P", ran).alias("running"), "c_name", "n_name")


@query(
    "grade_sources",
    """SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE l_quantity > 20) = 0 THEN 'NOT_FOUND' WHEN count(*) FILTER (WHERE l_quantity > 47) > 0 OR count(DISTINCT CASE WHEN l_quantity > 20 THEN l_returnflag END) > 1 THEN 'NEEDS_REVIEW' ELSE 'FOUND' END status, CASE WHEN count(*) FILTER (WHERE l_quantity > 47) = 0 AND count(DISTINCT CASE WHEN l_quantity > 20 THEN l_returnflag END) = 1 THEN min(CASE WHEN l_quantity > 20 THEN l_returnflag END) END minimum FROM lineitem GROUP BY 1""",
)
def grade_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program's sources, each read for its own grade: agreement stands, anything else is for a person."""
    status = F.when(F.col("l_quantity") > 47, "NEEDS_REVIEW").when(F.col("l_quantity") > 20, "FOUND").otherwise("NOT_FOUND")
    return rules.agreed(table(spark, sf_dir, "lineitem").select("l_orderkey", status.alias("status"), F.col("l_returnflag").alias("minimum")), ["l_orderkey"], ["minimum"])


@query(
    "topic_index",
    f"""WITH e AS (SELECT source, lang, 2018 + doc_id % 10 y, CASE WHEN contains(t, 'anon ention') THEN 100 WHEN contains(b, 'anon ention') THEN 85 WHEN r1 >= 0.75 THEN 60 + 30 * r1 WHEN r2 >= 0.75 THEN 45 + 25 * r2 ELSE 0 END::DOUBLE s
      FROM (SELECT *, len(list_intersect(['anon', 'ention'], string_split(t, ' '))) / 2 r1, len(list_intersect(['anon', 'ention'], string_split(b, ' '))) / 2 r2
      FROM (SELECT doc_id, source, lang, {RUN.format("split_part(text, chr(10), 1)")} t, {RUN.format("coalesce(text, '')")} b FROM documents))),
    g AS (SELECT source, lang, max(s) best, count(*) FILTER (WHERE s >= 65) n, count(*) FILTER (WHERE 2026 - y <= 6 AND s >= 85) fresh FROM e WHERE s > 0 GROUP BY 1, 2)
    SELECT source, lang, round(least(100.0, best + least(15, 3 * greatest(n - 1, 0))), 2)::DOUBLE score, row_number() OVER (ORDER BY least(100.0, best + least(15, 3 * greatest(n - 1, 0))) DESC, source, lang)::INTEGER result_rank FROM g WHERE fresh > 0 OR n >= 2 OR best >= 92 ORDER BY result_rank LIMIT 100""",
)
def topic_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic's index: every document scored, its source and language as the entity that it speaks for, entities
    admitted by their evidence and ranked; the index shows a hundred."""
    d = table(spark, sf_dir, "documents")
    title = F.split_part(F.coalesce(F.col("text"), F.lit("")), F.lit("\n"), F.lit(1))
    e = d.select("source", "lang", (2018 + F.col("doc_id") % 10).cast("int").alias("year"), scoring.score_document(title, F.col("text"), F.lit(ASKED)).alias("score")).where("score > 0")
    best = scoring.admit(e, ["source", "lang"], "score", "year", 2026).orderBy(F.desc("score"), "source", "lang").limit(100)
    return best.withColumn("result_rank", F.row_number().over(W.orderBy(F.desc("score"), "source", "lang")))  # of a hundred rows


@query(
    "directory_admin",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'REJECTED' WHEN s_suppkey % 3 = 0 THEN 'VERIFIED' ELSE 'NEEDS_REVIEW' END status, CASE WHEN s_suppkey % 5 = 0 THEN false ELSE s_suppkey % 3 = 0 END active, CASE WHEN s_suppkey % 3 = 0 THEN 'new ' || s_name ELSE s_name END AS name FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 OR s_suppkey % 5 = 0""",
)
def directory_admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories that are registered, added again by hand, and rejected: two upserts, the second on top of the first."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    rows = lambda cond, status, active, name: s.where(cond).select("s_suppkey", F.lit(status).alias("status"), F.lit(active).alias("active"), name.alias("name"))
    merge = {"status": S.newest, "active": S.newest, "name": S.filled}
    there = rows(k % 2 == 0, "NEEDS_REVIEW", False, F.col("s_name"))
    with_added = S.upsert(there, rows(k % 3 == 0, "VERIFIED", True, F.concat(F.lit("new "), "s_name")), ["s_suppkey"], merge)
    rejected = rows(k % 5 == 0, "REJECTED", False, F.when((k % 2 != 0) & (k % 3 != 0), F.col("s_name")))
    return S.upsert(with_added, rejected, ["s_suppkey"], merge)


@query(
    "pending_reviews",
    """SELECT o_orderkey, c_name, n_name, CASE WHEN n_name IS NULL THEN 'unplaced' ELSE 'placed' END kind FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 2 = 0 WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 250""",
)
def pending_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest 250 that wait for a person, joined with their names only after they are chosen."""
    top = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(250)
    place = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0")
    j = top.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").join(place, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return j.select("o_orderkey", "c_name", "n_name", F.when(F.col("n_name").isNull(), "unplaced").otherwise("placed").alias("kind"))

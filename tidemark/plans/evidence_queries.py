"""Registered queries on validators, identity and the remaining read models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import names, validators
from tidemark.operators import relational as R
from tidemark.plans.function_queries import _cases, _values
from tidemark.plans.registry import case, query, table

AS_OF = "TIMESTAMP '1998-06-01 00:00:00'"

QUOTES = [(["a  b", "C"], "x A b y c", True), (["z"], "x", False), ([], "x", False), (["x", " "], "x", False)]


@case("grounded_quotes", _values("ok", [(x[2],) for x in QUOTES]))
def grounded_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, "q array<string>, s string", [x[:2] for x in QUOTES]).select("id", validators.grounded(F.col("q"), F.col("s")).alias("ok"))


@query("one_decision_each", "SELECT coalesce(c_custkey, k) k, CASE WHEN c_custkey IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' ELSE 'several' END problem FROM customer FULL JOIN (SELECT o_custkey + 5 k, count(*) n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON k = c_custkey WHERE c_custkey IS NULL OR n IS NULL OR n > 1")
def one_decision_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return validators.one_decision_each(c, table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select((F.col("o_custkey") + 5).alias("k")), "k")


@query("supported_areas", "SELECT l_suppkey, p_brand, count(DISTINCT p_name) titles FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 10 GROUP BY 1, 2 HAVING count(DISTINCT p_name) >= 2")
def supported_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).where("p_size > 10").select("l_suppkey", "p_brand", "p_name")
    return validators.supported_areas(said, ["l_suppkey"], "p_brand", "p_name", said)


WHO = [
    ("Jane A. Smith", "J. Smith", "Dept, University of North Texas", "x@cs.unt.edu", "https://jane.org", False, "ACCEPT", "affiliation,mail"),
    ("Jane Smith", "Jane Smith", "Elsewhere", None, "https://www.unt.edu/~j", False, "ACCEPT", "homepage"),
    ("Jane Smith", "Jane Smith", "Elsewhere", None, None, False, "REVIEW", ""),
    ("Jane Smith", "Ann Jones", "University of North Texas", None, None, True, "REJECT", "name"),
]


@case("identity_decision", _values("decision, reasons", [x[6:] for x in WHO]))
def identity_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda c: names.parts(names.fold(F.col(c), ascii_only=True))
    d = validators.identity(p("a"), F.lit("University of North Texas"), F.lit("unt.edu"), p("b"), F.col("aff"), F.col("mail"), F.col("home"), F.col("linked"))
    return _cases(spark, "a string, b string, aff string, mail string, home string, linked boolean", [x[:6] for x in WHO]).select("id", d["decision"].alias("decision"), F.array_join(d["reasons"], ",").alias("reasons"))


@query("joint_decision", "SELECT l_orderkey, CASE WHEN bool_and(l_returnflag = 'N') THEN 'REJECT' WHEN bool_or(l_returnflag = 'R') AND NOT bool_or(l_returnflag = 'A') THEN 'ACCEPT' ELSE 'REVIEW' END decision FROM lineitem GROUP BY 1")
def joint_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("l_returnflag") == "R", "ACCEPT").when(F.col("l_returnflag") == "A", "REVIEW").otherwise("REJECT")
    return validators.joint_decision(table(spark, sf_dir, "lineitem").select("l_orderkey", d.alias("d")), ["l_orderkey"], "d")


MATCH = [("Deep nets for vision tasks", "Deep nets for vision", "10.1/x", "VERIFIED_DOI"), ("Deep nets for vision tasks", "Deep nets for vision", None, "VERIFIED_TITLE"), ("Deep nets", "Shallow wells", "10.1/x", "TITLE_CONFLICT")]


@case("metadata_match", _values("status", [(x[3],) for x in MATCH]))
def metadata_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, "a string, b string, d string", [x[:3] for x in MATCH]).select("id", validators.title_match(F.col("a"), F.col("b"), F.col("d")).alias("status"))


LEFT = [('{"remaining": 5, "daily": {"remaining": 3}}', 3), ('{"searches_left": 9}', 9), ("{}", None), ("no", None)]


@case("provider_quota", _values("remaining", [(x[1],) for x in LEFT]))
def provider_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, "b string", [x[:1] for x in LEFT]).select("id", validators.quota(F.col("b")).alias("remaining"))


@query("profile_state", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'EXPLICIT' WHEN n >= 12 THEN 'PAPER_SUMMARY' WHEN c_acctbal > 5000 AND c_nationkey % 2 = 0 THEN 'BIOGRAPHY' WHEN c_acctbal > 5000 THEN 'AWAITING_MODEL' WHEN n > 0 THEN 'AWAITING_PUBLICATIONS' ELSE 'MANUAL_REVIEW_REQUIRED' END state FROM (SELECT *, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) n FROM customer)")
def profile_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    papers = F.when(F.col("n") >= 12, 3).when(F.col("n") > 0, 1).otherwise(0)
    state = validators.profile_state((F.col("c_mktsegment") == "BUILDING").cast("int"), papers, F.col("c_acctbal") > 5000, F.col("c_nationkey") % 2 == 0)
    return c.select("c_custkey", state.alias("state"))


@query("guarded_status", "SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AND o_orderkey % 3 = 0 THEN o_orderstatus ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'FAILED' ELSE 'FOUND' END END status FROM orders")
def guarded_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 45").withColumnRenamed("l_orderkey", "o_orderkey")
    o = R.exists_flag(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), big, "o_orderkey", "papers")
    new = F.when(F.col("o_orderkey") % 3 == 0, "FAILED").otherwise("FOUND")
    return o.select("o_orderkey", validators.guarded_status(F.col("o_orderstatus"), new, F.col("papers")).alias("status"))


@query("replace_interests", "SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY i) labels FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) i, row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey)) r FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1")
def replace_interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal labels wins; at most three labels for each owner."""
    first = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("i"))
    top = R.topk_per_key(first, "o_custkey", [F.asc("i")], 3)
    return R.ordered_collect(top, "o_custkey", [F.col("i")], F.col("o_orderpriority"), "a").select("o_custkey", F.array_join("a", ",").alias("labels"))


@query("run_results", "SELECT c_custkey, c_name, o_orderkey latest, coalesce(n, 0) n, round(spent, 2) spent FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) r, count(*) OVER (PARTITION BY o_custkey) n, sum(o_totalprice) OVER (PARTITION BY o_custkey) spent FROM orders) ON o_custkey = c_custkey AND r = 1 WHERE n_regionkey = 1")
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").where("n_regionkey = 1")
    who = table(spark, sf_dir, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    who = R.latest_child(who, o, "c_custkey", [F.desc("o_orderdate"), F.asc("o_orderkey")], ["o_orderkey"], count="n")
    spent = o.groupBy("c_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return who.join(spent, "c_custkey", "left").select("c_custkey", "c_name", F.col("o_orderkey").alias("latest"), "n", "spent")


@query("operations_board", "SELECT 'orders' board, o_orderstatus status, count(*) n, count(*) FILTER (WHERE o_orderpriority LIKE '1%') urgent FROM orders GROUP BY 2 UNION ALL SELECT 'lines', l_linestatus, count(*), count(*) FILTER (WHERE l_quantity > 45) FROM lineitem GROUP BY 2 UNION ALL SELECT 'events', event_type, count(*), count(*) FILTER (WHERE value > 90) FROM events GROUP BY 2")
def operations_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    one = lambda name, df, key, cond: R.group_counts(df.withColumn("status", F.col(key)), "status", urgent=cond).select(F.lit(name).alias("board"), "status", "n", "urgent")
    return one("orders", t("orders"), "o_orderstatus", F.col("o_orderpriority").startswith("1")).unionByName(one("lines", t("lineitem"), "l_linestatus", F.col("l_quantity") > 45)).unionByName(one("events", t("events"), "event_type", F.col("value") > 90))


@query("review_context", "SELECT s_suppkey, coalesce(ks, '') latest, coalesce(sizes, '') sizes FROM supplier LEFT JOIN (SELECT l_suppkey, string_agg(l_orderkey::VARCHAR, ',' ORDER BY r) ks FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) r FROM lineitem) WHERE r <= 5 GROUP BY 1) a ON a.l_suppkey = s_suppkey LEFT JOIN (SELECT l_suppkey, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) sizes FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) b ON b.l_suppkey = s_suppkey")
def review_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents with two capped or distinct child lists, each aggregated before it is joined."""
    line = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    top = R.topk_per_key(line, "s_suppkey", [F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber")], 5)
    a = R.ordered_collect(top, "s_suppkey", [F.col("rank")], F.col("l_orderkey").cast("string"), "a")
    b = line.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("s_suppkey").agg(F.array_sort(F.collect_set("p_brand")).alias("b"))
    j = table(spark, sf_dir, "supplier").select("s_suppkey").join(a, "s_suppkey", "left").join(b, "s_suppkey", "left")
    return j.select("s_suppkey", F.coalesce(F.array_join("a", ","), F.lit("")).alias("latest"), F.coalesce(F.array_join("b", ","), F.lit("")).alias("sizes"))


@query("reuse_run", f"SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_orderdate > {AS_OF} - INTERVAL 300 DAY) run FROM customer")
def reuse_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest finished and still fresh run for each request, null where a new one is due."""
    fresh = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") > F.expr(AS_OF) - F.expr("INTERVAL 300 DAYS")))
    runs = fresh.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("run"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(runs, "c_custkey", "left")


@query("rebuild_status", "SELECT n_nationkey, total, done, CASE WHEN total = 0 THEN 'empty' WHEN done = total THEN 'complete' WHEN done > 0 THEN 'running' ELSE 'queued' END state FROM (SELECT n_nationkey, count(o_orderkey) total, count(*) FILTER (WHERE o_orderstatus = 'F') done FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def rebuild_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    j = table(spark, sf_dir, "nation").select("n_nationkey").join(g, "n_nationkey", "left").select("n_nationkey", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "done")])
    return j.withColumn("state", F.when(F.col("total") == 0, "empty").when(F.col("done") == F.col("total"), "complete").when(F.col("done") > 0, "running").otherwise("queued"))


@query("bounded_accumulation", "SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY r) kept FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, event_id) r FROM events) WHERE r <= 10 GROUP BY 1")
def bounded_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit trail that keeps identity sources first and ten entries in all; the bound is the trail's own."""
    top = R.topk_per_key(table(spark, sf_dir, "events"), "user_id", [(F.col("event_type") != "purchase").cast("int").asc(), F.asc("event_id")], 10)
    return R.ordered_collect(top, "user_id", [F.col("rank")], F.col("event_id").cast("string"), "a").select("user_id", F.array_join("a", ",").alias("kept"))

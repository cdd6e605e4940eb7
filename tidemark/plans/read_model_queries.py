"""Registered queries on predicates, best units, life cycles, moderation and status boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import scoring, urls
from tidemark.operators import state as S
from tidemark.plans.registry import query, table

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


@query("version_predicate", "SELECT p_partkey FROM part WHERE coalesce(p_size, 0) < 20 OR p_brand = 'Brand#11'")
def version_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an older version, and those that a person set aside whatever their version."""
    return table(spark, sf_dir, "part").where((F.coalesce("p_size", F.lit(0)) < 20) | (F.col("p_brand") == "Brand#11")).select("p_partkey")


@query("json_field_predicate", "SELECT event_type, count(*) n FROM events WHERE (props->>'$.k') IN ('1', '2', '3', '69') GROUP BY 1")
def json_field_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.get_json_object("props", "$.k").isin("1", "2", "3", "69")
    return table(spark, sf_dir, "events").where(hit).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("clamped_parameter", "SELECT l_orderkey, l_linenumber, greatest(1, least(25, l_quantity::INTEGER)) n FROM lineitem")
def clamped_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.clamp(F.col("l_quantity").cast("int"), 1, 25).alias("n"))


@query("derived_key_join", "SELECT c_mktsegment, count(*) n FROM (SELECT o_custkey || ':' || o_orderkey k FROM orders) o JOIN customer ON split_part(k, ':', 1) = c_custkey::VARCHAR GROUP BY 1")
def derived_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on the first part of a composed key, cast once so that both sides are dealt by the same number."""
    o = table(spark, sf_dir, "orders").select(F.concat_ws(":", "o_custkey", "o_orderkey").alias("k"))
    j = o.select(F.split_part("k", F.lit(":"), F.lit(1)).cast("long").alias("c_custkey")).join(table(spark, sf_dir, "customer"), "c_custkey")
    return j.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("best_unit", "SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) r FROM lineitem) WHERE r = 1")
def best_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group the unit of the highest score, the first on ties; one partial aggregate, no sort of whole groups."""
    least = F.struct(-F.col("l_quantity"), "l_orderkey", "l_linenumber")
    best = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min_by(F.struct("l_orderkey", "l_linenumber", "l_quantity"), least).alias("b"))
    return best.select("l_suppkey", "b.*")


@query("frequent_structure", "WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<([a-z0-9]+)[^>]*>', '<\\1>', 'g'), '>[^<]+<', '><', 'g'), '(<[^>]*>)', '\\1', 'g') sig FROM pages), k AS (SELECT md5(left(sig, 60)) k, page_id FROM s) SELECT page_id FROM k WHERE k IN (SELECT k FROM k GROUP BY 1 HAVING count(*) >= 3)")
def frequent_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose tags begin like those of two others or more: a grouped count and a semi join, so no window on one key."""
    sig = F.regexp_replace(F.regexp_replace("html", "<([a-z0-9]+)[^>]*>", "<$1>"), ">[^<]+<", "><")
    k = table(spark, sf_dir, "pages").select("page_id", F.md5(F.left(sig, F.lit(60)).cast("binary")).alias("k"))
    return k.join(k.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n >= 3"), "k", "left_semi").select("page_id")


@query("prospect_score", "SELECT l_suppkey, least(40.0, 18 + least(12, 4 * count(DISTINCT l_partkey)) + least(5.0, sum(l_quantity) / 20) + CASE WHEN max(l_shipdate) > TIMESTAMP '1998-01-01' THEN 5 ELSE 0 END)::DOUBLE score FROM lineitem GROUP BY 1")
def prospect_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n"), F.sum("l_quantity").alias("cites"), F.max("l_shipdate").alias("last"))
    recency = F.when(F.col("last") > F.lit("1998-01-01").cast("timestamp"), 5).otherwise(0)
    return g.select("l_suppkey", scoring.prospect_score(F.col("n"), F.col("cites"), recency).cast("double").alias("score"))


@query("source_url", "SELECT page_id, lower(regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1)) || regexp_extract(url, '(?i)^https?://[^/?#]+([^#]*)', 1) url FROM pages")
def source_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.source_url(F.col("url")).alias("url"))


@query("interest_score", "SELECT o_orderkey, least(CASE o_orderpriority WHEN '1-URGENT' THEN 62 WHEN '2-HIGH' THEN 58 WHEN '3-MEDIUM' THEN 52 ELSE 45 END, round((o_orderkey % 101) * (0.55 + 0.15 * ((o_custkey % 5) / 4)), 2))::DOUBLE score FROM orders")
def interest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "OFFICIAL_INTERESTS").when(F.col("o_orderpriority") == "2-HIGH", "PAPER_DERIVED").when(F.col("o_orderpriority") == "3-MEDIUM", "BIOGRAPHY_DERIVED").otherwise("NONE")
    return table(spark, sf_dir, "orders").select("o_orderkey", scoring.interest_score(F.col("o_orderkey") % 101, (F.col("o_custkey") % 5) / 4, status).alias("score"))


@query("grant_boost", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 40 WHEN p_partkey % 5 = 0 THEN 30 ELSE 15 END boost FROM part")
def grant_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.when(F.col("p_partkey") % 7 == 0, "CRII: ").when(F.col("p_partkey") % 5 == 0, "Career: ").otherwise(""), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", scoring.grant_boost(title).alias("boost"))


@query("long_retry", "SELECT event_id, CASE WHEN event_id % 7 < 5 THEN greatest(21600, floor(value * 500)) END::BIGINT wait FROM events")
def long_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scoring.long_retry(F.col("event_id") % 7, 5, F.floor(F.col("value") * 500)).alias("wait"))


@query("fenced_object", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN (props->>'$.k') END k FROM events")
def fenced_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in a code fence or bare, of which only JSON objects count; a third of the rows hold a list instead."""
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("  "), "props")).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(S.object_text(answer), "$.k").alias("k"))


@query("job_transitions", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'COMPLETE' WHEN o_orderkey % 5 = 1 AND o_orderstatus IN ('O', 'P') THEN 'CANCELLED' WHEN o_orderkey % 5 = 2 AND o_orderstatus = 'F' THEN 'PENDING' WHEN o_orderkey % 5 = 3 AND o_orderstatus = 'P' THEN 'PENDING' ELSE CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'RUNNING' ELSE 'FAILED' END END status, CASE WHEN o_orderkey % 5 = 2 AND o_orderstatus = 'F' THEN 0 ELSE o_custkey % 4 END::BIGINT attempts FROM orders")
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete, cancel, retry and recover requests against jobs; requests that a job's state does not allow change nothing."""
    status = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("FAILED")
    asked = F.element_at(F.array(*map(F.lit, ("complete", "cancel", "retry", "recover", "none"))), (F.col("o_orderkey") % 5).cast("int") + 1)
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), (F.col("o_custkey") % 4).alias("attempts"), asked.alias("asked"))
    return S.job_transitions(jobs).select("o_orderkey", "status", "attempts")


@query("moderation_state", "SELECT user_id, arg_max(event_type, event_id) state, count(*) n_actions, max(event_id) last_action FROM events WHERE event_type IN ('click', 'error', 'purchase') GROUP BY 1")
def moderation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that a log of moderation actions leaves, with the number of audit rows and the last of them."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "error", "purchase"))
    return e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"), F.count(F.lit(1)).alias("n_actions"), F.max("event_id").alias("last_action"))


@query("single_owner", "SELECT c_nationkey, min(c_custkey) FILTER (WHERE c_mktsegment = 'BUILDING') owner, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') > 1 violated FROM customer GROUP BY 1")
def single_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One active owner of each account: the first stays, more than one is a violation."""
    owner = F.col("c_mktsegment") == "BUILDING"
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min(F.when(owner, F.col("c_custkey"))).alias("owner"), (F.count_if(owner) > 1).alias("violated"))


@query("heartbeat_upsert", f"SELECT user_id, max(ts) seen, CASE WHEN max(ts) >= {NOW} - INTERVAL 2 HOUR THEN 'live' WHEN max(ts) >= {NOW} - INTERVAL 6 HOUR THEN 'stalled' ELSE 'stopped' END state FROM events GROUP BY 1")
def heartbeat_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("seen"))
    live = lambda h: F.col("seen") >= F.expr(f"{NOW} - INTERVAL {h} HOURS")
    return seen.select("user_id", "seen", F.when(live(2), "live").when(live(6), "stalled").otherwise("stopped").alias("state"))


@query("recheck_upsert", "SELECT c_custkey, count(o_orderkey) n_found, max(o_orderdate) + INTERVAL 30 DAY next_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def recheck_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found rows and the next check, thirty days after the last; nothing found leaves it open."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last"))
    j = table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return j.select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n_found"), (F.col("last") + F.expr("INTERVAL 30 DAYS")).alias("next_at"))


@query("run_prospects", "SELECT o_custkey, o_orderkey, o_totalprice, n, lane FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) r, count(*) OVER (PARTITION BY o_custkey) n, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END lane FROM orders WHERE year(o_orderdate) = 1996 AND o_orderkey % 32 >= 19) WHERE r = 1 ORDER BY lane, o_totalprice DESC, o_orderkey LIMIT 100")
def run_prospects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one run (a year) and rows of a version of 19 and up: each entity's best row and number of rows, by lanes."""
    o = table(spark, sf_dir, "orders").where((F.year("o_orderdate") == 1996) & (F.col("o_orderkey") % 32 >= 19))
    best = o.groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_totalprice", "o_orderpriority"), F.struct(-F.col("o_totalprice"), "o_orderkey")).alias("b"), F.count(F.lit(1)).alias("n"))
    lane = F.when(F.col("b.o_orderpriority") == "1-URGENT", 1).when(F.col("b.o_orderpriority") == "2-HIGH", 2).otherwise(3)
    return best.select("o_custkey", "b.o_orderkey", "b.o_totalprice", "n", lane.alias("lane")).orderBy("lane", F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("topic_with_job", "SELECT c_custkey, c_name, o_orderkey job, o_orderdate since FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) r FROM orders WHERE o_orderstatus IN ('O', 'P')) o ON o_custkey = c_custkey AND r = 1")
def topic_with_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P"))
    last = live.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("j"))
    return table(spark, sf_dir, "customer").join(last, "c_custkey", "left").select("c_custkey", "c_name", F.col("j.o_orderkey").alias("job"), F.col("j.o_orderdate").alias("since"))


@query("enrichment_due", "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) last FROM orders GROUP BY 1) o ON o_custkey = c_custkey WHERE (last IS NULL OR last < TIMESTAMP '1997-06-01') AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = c_custkey AND p.o_orderstatus = 'P') ORDER BY last NULLS FIRST, c_custkey LIMIT 25")
def enrichment_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities never or long not enriched and without a running job, the never enriched first."""
    o = table(spark, sf_dir, "orders")
    last = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"), F.bool_or(F.col("o_orderstatus") == "P").alias("busy"))
    j = table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left")
    due = (F.col("last").isNull() | (F.col("last") < F.lit("1997-06-01").cast("timestamp"))) & ~F.coalesce("busy", F.lit(False))
    return j.where(due).orderBy(F.col("last").asc_nulls_first(), "c_custkey").limit(25).select("c_custkey")


@query(
    "live_status",
    f"""
    SELECT 'count' part, event_type label, count(*)::VARCHAR v FROM events GROUP BY 2
    UNION ALL SELECT 'oldest', event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') FROM events GROUP BY 2
    UNION ALL SELECT 'busy', user_id::VARCHAR, n::VARCHAR FROM (SELECT user_id, count(*) n FROM events WHERE ts >= {NOW} - INTERVAL 7 DAY GROUP BY 1 ORDER BY n DESC, user_id LIMIT 8)
    UNION ALL SELECT 'latest', event_id::VARCHAR, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 10)
    UNION ALL SELECT 'total', 'late', count(*) FILTER (WHERE ts < {NOW} - INTERVAL 20 DAY)::VARCHAR FROM events
    """,
)
def live_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status board as one table of parts: counts and oldest by state, the busiest, the latest, and what is late."""
    e = table(spark, sf_dir, "events")
    since = lambda d: F.expr(f"{NOW} - INTERVAL {d} DAYS")
    by = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest"))
    rows = lambda df, part, label, v: df.select(F.lit(part).alias("part"), F.col(label).cast("string").alias("label"), v.cast("string").alias("v"))
    busy = e.where(F.col("ts") >= since(7)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(8)
    late = e.agg(F.count_if(F.col("ts") < since(20)).alias("n")).select(F.lit("late").alias("l"), "n")
    parts = [rows(by, "count", "event_type", F.col("n")), rows(by, "oldest", "event_type", F.date_format("oldest", "yyyy-MM-dd HH:mm:ss")), rows(busy, "busy", "user_id", F.col("n")), rows(e.orderBy(F.desc("ts"), "event_id").limit(10), "latest", "event_id", F.col("event_type")), rows(late, "total", "l", F.col("n"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("backlog_report", "SELECT lang, count(*) n, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') blank, count(*) FILTER (WHERE n_chars > 10000) long, count(DISTINCT source) FILTER (WHERE n_chars <= 10000) sources FROM documents GROUP BY 1")
def backlog_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.col("text").isNull() | (F.trim("text") == "")
    d = table(spark, sf_dir, "documents").groupBy("lang")
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("blank"), F.count_if(F.col("n_chars") > 10000).alias("long"), F.countDistinct(F.when(F.col("n_chars") <= 10000, F.col("source"))).alias("sources"))


@query("readiness_checks", "SELECT 'orders have customers' AS \"check\", (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))::BIGINT bad UNION ALL SELECT 'lines have quantities', (SELECT count(*) FROM lineitem WHERE l_quantity IS NULL OR l_quantity <= 0) UNION ALL SELECT 'nations have regions', (SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)) UNION ALL SELECT 'events are not ahead', (SELECT count(*) FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00')")
def readiness_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named checks with their numbers of bad rows; zero everywhere means ready."""
    t = lambda n: table(spark, sf_dir, n)
    bad = {
        "orders have customers": t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "lines have quantities": t("lineitem").where(F.col("l_quantity").isNull() | (F.col("l_quantity") <= 0)),
        "nations have regions": t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left_anti"),
        "events are not ahead": t("events").where(F.col("ts") > F.expr(NOW)),
    }
    out = None
    for name, rows in bad.items():
        one = rows.agg(F.count(F.lit(1)).alias("bad")).select(F.lit(name).alias("check"), "bad")
        out = one if out is None else out.unionByName(one)
    return out


@query("signal_inspection", "SELECT o_orderkey, c_name, o_orderpriority, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def signal_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest rows with their entity: the limit is taken before the join, so only its rows are looked up."""
    top = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return top.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "c_name", "o_orderpriority", "o_orderdate")


@query("recent_runs", "SELECT c_custkey, c_name, o_orderkey, o_orderstatus FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) r FROM orders) o ON o_custkey = c_custkey WHERE r <= 3 AND c_mktsegment = 'BUILDING'")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three runs of each member of a group."""
    members = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").join(members, F.col("o_custkey") == F.col("c_custkey"))
    w = W.partitionBy("c_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return o.withColumn("r", F.row_number().over(w)).where("r <= 3").select("c_custkey", "c_name", "o_orderkey", "o_orderstatus")

"""Registered queries on state tables, queues, limits, audits, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import relational as R
from tidemark.operators import state as S
from tidemark.plans.registry import case, query, table
from tidemark.sources import readers
from tidemark.streaming import machines, read_model
from tidemark.streaming import windows as T

AS_OF = "TIMESTAMP '1998-06-01 00:00:00'"


def _t(spark: SparkSession, sf_dir: str):
    return lambda name: table(spark, sf_dir, name)


def _crawls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as two crawls of customers: an old state and a new one."""
    o = table(spark, sf_dir, "orders")
    agg = lambda d: d.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("best"), F.count(F.lit(1)).alias("n"), F.min("o_orderpriority").alias("label"))
    return agg(o.where("o_orderkey % 2 = 0")), agg(o.where("o_orderkey % 2 = 1 and o_orderstatus <> 'F'"))


OLD = "(SELECT o_custkey k, max(o_totalprice) best, count(*) n, min(o_orderpriority) label FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)"
NEW = "(SELECT o_custkey k, max(o_totalprice) best, count(*) n, min(o_orderpriority) label FROM orders WHERE o_orderkey % 2 = 1 AND o_orderstatus <> 'F' GROUP BY 1)"


@query("upsert_merge", f"SELECT coalesce(o.k, n.k) k, CASE WHEN o.n > 12 THEN o.best ELSE greatest(o.best, n.best) END best, CASE WHEN o.n > 12 THEN o.n ELSE coalesce(o.n, 0) + coalesce(n.n, 0) END n, CASE WHEN o.n > 12 THEN o.label ELSE coalesce(n.label, o.label) END label FROM {OLD} o FULL JOIN {NEW} n ON o.k = n.k")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _crawls(spark, sf_dir)
    return S.upsert(old, new, ["k"], {"best": S.larger, "n": S.added, "label": S.newest}, locked=F.col("o.n") > 12)


@query("insert_or_ignore", f"SELECT k, n FROM {OLD} UNION ALL SELECT k, n FROM {NEW} x WHERE NOT EXISTS (SELECT 1 FROM {OLD} o WHERE o.k = x.k)")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _crawls(spark, sf_dir)
    return S.insert_new(old, new, ["k"]).select("k", "n")


@query("snapshot_swap", f"SELECT coalesce(o.k, n.k) k, CASE WHEN n.k IS NOT NULL THEN n.n ELSE o.n END n, n.k IS NOT NULL is_current FROM {OLD} o FULL JOIN {NEW} n ON o.k = n.k")
def snapshot_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _crawls(spark, sf_dir)
    return S.snapshot_swap(old.select("k", "n"), new, ["k"], ["n"])


@query("apply_misses", f"SELECT coalesce(o.k, n.k) k, CASE WHEN n.k IS NOT NULL THEN 0 ELSE o.k % 3 + 1 END::INTEGER misses, n.k IS NOT NULL OR (o.k % 3 + 1) < 2 listed FROM {OLD} o FULL JOIN {NEW} n ON o.k = n.k")
def apply_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _crawls(spark, sf_dir)
    state = old.select("k", (F.col("k") % 3).cast("int").alias("misses"), F.lit(True).alias("listed"))
    return S.apply_misses(state, new, ["k"])


@query("json_merge", "SELECT event_id, '{\"a\":\"' || event_type || '\",\"b\":\"new\",\"k\":\"' || (props->>'$.k') || '\"}' j FROM events")
def json_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.to_json(F.struct(F.lit("new").alias("b"), F.col("event_type").alias("a")))
    return table(spark, sf_dir, "events").select("event_id", S.json_merge(F.col("props"), new).alias("j"))


@query("cache_reuse", f"SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate > {AS_OF} - INTERVAL 200 DAY AND o_orderstatus <> 'F') hit FROM customer")
def cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    return S.cache_reuse(table(spark, sf_dir, "customer").select("c_custkey"), cache, "c_custkey", "o_orderdate", F.expr("TIMESTAMP_NTZ '1998-06-01 00:00:00'"), 200, ("F",))


@query("soft_delete", f"SELECT k, n FROM {OLD} o WHERE EXISTS (SELECT 1 FROM {NEW} n WHERE n.k = o.k) OR n > 5")
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete by anti-condition: rows that are not seen again, unless protected."""
    old, new = _crawls(spark, sf_dir)
    return R.exists_flag(old, new, "k", "seen").where("seen or n > 5").select("k", "n")


@query("data_repair", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') THEN 'F' ELSE o_orderstatus END status FROM orders")
def data_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_lines = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").withColumnRenamed("l_orderkey", "o_orderkey")
    o = R.exists_flag(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), open_lines, "o_orderkey", "any_open")
    return o.select("o_orderkey", F.when((F.col("o_orderstatus") == "O") & ~F.col("any_open"), "F").otherwise(F.col("o_orderstatus")).alias("status"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    status = F.when(i % 10 < 6, "queued").when(i % 10 < 8, "running").otherwise("done")
    return e.select(i.alias("id"), F.concat_ws(":", "event_type", (F.col("user_id") % 20).cast("string"), i.cast("string")).alias("key"), F.col("event_type").alias("job_type"), status.alias("status"), (i % 7).cast("int").alias("priority"), (i % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), F.col("ts").alias("created_at"), F.col("ts").alias("available_at"), F.col("ts").alias("locked_at"), (i % 5 == 0).alias("model"), (F.col("event_type") == "search").alias("needs_search"))


JOBS = "(SELECT event_id id, event_type || ':' || (user_id % 20) || ':' || event_id AS \"key\", event_type job_type, CASE WHEN event_id % 10 < 6 THEN 'queued' WHEN event_id % 10 < 8 THEN 'running' ELSE 'done' END status, (event_id % 7)::INTEGER priority, (event_id % 4)::INTEGER attempts, 3 max_attempts, ts created_at, event_id % 5 = 0 model FROM events)"
NOW = "(SELECT max(ts) FROM events)"


def _now(spark: SparkSession, sf_dir: str):
    """The latest event's time as the queue's clock: one value."""
    return F.lit(table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]).cast("timestamp")


@query("job_enqueue", f"WITH r AS (SELECT \"key\", max(priority + 3) rp FROM {JOBS} WHERE id % 2 = 0 GROUP BY 1) SELECT \"key\", status, CASE WHEN status = 'queued' THEN greatest(priority, coalesce(rp, priority)) ELSE priority END priority, attempts FROM {JOBS} j LEFT JOIN r USING (\"key\") WHERE status IN ('queued', 'running') UNION ALL SELECT \"key\", status, priority, attempts FROM {JOBS} WHERE status = 'done' UNION ALL SELECT \"key\", 'queued', rp, 0 FROM r WHERE NOT EXISTS (SELECT 1 FROM {JOBS} j WHERE j.\"key\" = r.\"key\" AND status <> 'done')")
def job_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    asked = jobs.where("id % 2 = 0").select("key", (F.col("priority") + 3).alias("priority"), "max_attempts")
    return S.enqueue(jobs.select("key", "status", "priority", "attempts", "max_attempts"), asked).select("key", "status", "priority", "attempts")


@query("job_claim", f"WITH q AS (SELECT *, priority + least(30, floor(epoch({NOW} - created_at) / 21600))::BIGINT aged FROM {JOBS} WHERE status = 'queued' AND attempts < max_attempts AND created_at <= {NOW} AND job_type <> 'click'), busy AS (SELECT count(*) > 0 b FROM {JOBS} WHERE status = 'running' AND model), one AS (SELECT id FROM q, busy WHERE model AND NOT b ORDER BY aged DESC, created_at, id LIMIT 1) SELECT id, aged FROM q WHERE NOT model OR id IN (SELECT id FROM one) ORDER BY aged DESC, created_at, id LIMIT 20")
def job_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.claim(_jobs(spark, sf_dir), _now(spark, sf_dir), 20, excluded=("click",)).select("id", "aged")


@query("job_fail", f"SELECT id, CASE WHEN id % 3 <> 0 THEN status WHEN id % 2 = 0 OR attempts < 3 THEN 'queued' ELSE 'failed' END status, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN greatest(attempts - 1, 0) ELSE attempts END attempts, CASE WHEN id % 3 = 0 AND (id % 2 = 0 OR attempts < 3) THEN floor(epoch({NOW}))::BIGINT + least(21600, greatest(least(3600, 15 * power(2.0, greatest(attempts, 1) - 1)), id % 100))::BIGINT END wait_until FROM {JOBS}")
def job_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir).select("id", "status", "attempts", "max_attempts")
    failed = jobs.where("id % 3 = 0").select("id", (F.col("id") % 2 == 0).alias("outage"), (F.col("id") % 100).alias("retry_after"))
    return S.fail(jobs, failed, _now(spark, sf_dir))


@query("job_recover", f"SELECT id, CASE WHEN status = 'running' AND created_at < {NOW} - INTERVAL 10 MINUTE THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE status END status FROM {JOBS}")
def job_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jobs(spark, sf_dir).withColumn("locked_at", F.col("locked_at").cast("timestamp"))
    return S.recover(j, _now(spark, sf_dir)).select("id", "status")


@query("rate_limit", f"SELECT user_id, count(*) FILTER (WHERE ts > {NOW} - INTERVAL 12 HOUR) used, count(*) FILTER (WHERE ts > {NOW} - INTERVAL 12 HOUR) < 3 allowed FROM events GROUP BY 1")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.within_last(table(spark, sf_dir, "events"), ["user_id"], "ts", _now(spark, sf_dir), "INTERVAL 12 HOURS", 3)


@query("budget_delay", "SELECT user_id, d, m, t, CASE WHEN t >= 30 THEN 'total' WHEN m >= 20 THEN 'month' WHEN d >= 2 THEN 'day' END reason FROM (SELECT user_id, count(*) FILTER (WHERE date_trunc('day', ts) = date_trunc('day', n)) d, count(*) FILTER (WHERE date_trunc('month', ts) = date_trunc('month', n)) m, count(*) t FROM events, (SELECT max(ts) n FROM events) GROUP BY 1)")
def budget_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, at = _now(spark, sf_dir), F.col("ts").cast("timestamp")
    same = lambda unit: F.count_if(F.date_trunc(unit, at) == F.date_trunc(unit, now))
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(same("day").alias("d"), same("month").alias("m"), F.count(F.lit(1)).alias("t"))
    return g.withColumn("reason", S.budget_reason(F.col("d"), F.col("m"), F.col("t"), 2, 20, 30))


@query("due_planner", f"SELECT 'order' kind, o_orderkey id FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= {AS_OF} - INTERVAL 30 DAY ORDER BY o_orderdate NULLS FIRST, o_orderkey LIMIT 20) UNION ALL SELECT 'customer', c_custkey FROM (SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) ORDER BY c_acctbal, c_custkey LIMIT 20)")
def due_planner(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    a = t("orders").where((F.col("o_orderstatus") == "O") & R.due("o_orderdate", F.expr(AS_OF) - F.expr("INTERVAL 30 DAYS"))).orderBy(F.asc_nulls_first("o_orderdate"), "o_orderkey").limit(20)
    b = R.any_of_semi(t("customer").where("c_acctbal < 0"), [t("events").withColumnRenamed("user_id", "c_custkey")], "c_custkey", negate=True).orderBy("c_acctbal", "c_custkey").limit(20)
    return a.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id")).unionByName(b.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")))


@query("constraint_violations", "SELECT 'balance' AS \"constraint\", c_custkey::VARCHAR id FROM customer WHERE NOT c_acctbal >= 0 UNION ALL SELECT 'segment', c_custkey::VARCHAR FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT 'one_name', c_custkey::VARCHAR FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) n FROM customer) WHERE n > 1 UNION ALL SELECT 'supplier', c_custkey::VARCHAR FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY")}
    return S.constraint_violations(table(spark, sf_dir, "customer"), "c_custkey", checks, {"one_name": ["c_nationkey", "c_mktsegment"]}, {"supplier": (table(spark, sf_dir, "supplier"), "c_custkey", "s_suppkey")})


@case("schema_gaps", "SELECT * FROM (VALUES ('customer', 'c_phone'), ('ghosts', '*')) t(\"table\", \"column\")")
def schema_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = {n: table(spark, sf_dir, n).schema for n in ("customer", "orders")}
    return spark.createDataFrame(S.schema_gaps(found, {"customer": ["c_custkey", "c_phone"], "orders": ["o_orderkey"], "ghosts": ["x"]}), "table string, column string")


@query("integrity_audit", "SELECT 'order_without_lines' issue, o_orderkey id, o_orderstatus detail FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) UNION ALL SELECT 'nation_of_one_kind', n_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey HAVING count(DISTINCT c_mktsegment) > 1 UNION ALL SELECT 'copied_text', min(doc_id), count(*)::VARCHAR FROM documents GROUP BY text HAVING count(*) > 1")
def integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    issue = lambda n: F.lit(n).alias("issue")
    a = R.any_of_semi(t("orders"), [t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")], "o_orderkey", negate=True).select(issue("order_without_lines"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("detail"))
    b = t("customer").groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("s")).where(F.size("s") > 1).select(issue("nation_of_one_kind"), "id", F.array_join("s", ",").alias("detail"))
    c = t("documents").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")).where("n > 1").select(issue("copied_text"), "id", F.col("n").cast("string").alias("detail"))
    return a.unionByName(b).unionByName(c)


@query("status_report", "SELECT n_name, count(*) suppliers, count(*) FILTER (WHERE s_acctbal > 0) solvent, count(DISTINCT CASE WHEN s_acctbal > 5000 THEN s_suppkey END) rich, round(max(s_acctbal), 2) top FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return s.groupBy("n_name").agg(F.count(F.lit(1)).alias("suppliers"), F.count_if(F.col("s_acctbal") > 0).alias("solvent"), F.countDistinct(F.when(F.col("s_acctbal") > 5000, F.col("s_suppkey"))).alias("rich"), F.round(F.max("s_acctbal"), 2).alias("top"))


@query("coverage_refresh", "SELECT n_nationkey, CASE WHEN due = 0 AND verified < 60 THEN 'exhausted' WHEN verified >= 60 THEN 'ready' ELSE 'partial' END status, verified, due FROM (SELECT c_nationkey n_nationkey, count(*) FILTER (WHERE c_acctbal > 0) verified, count(*) FILTER (WHERE c_acctbal < -500) due FROM customer GROUP BY 1)")
def coverage_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_if(F.col("c_acctbal") > 0).alias("verified"), F.count_if(F.col("c_acctbal") < -500).alias("due"))
    return g.withColumn("status", F.when((F.col("due") == 0) & (F.col("verified") < 60), "exhausted").when(F.col("verified") >= 60, "ready").otherwise("partial"))


@query("tumbling_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1, 2")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.run_to_table(T.tumbling(T.event_stream(spark, sf_dir, "events"), "1 hour", ["event_type"]), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("sliding_window", "SELECT s AS start, count(*) n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) s FROM events) GROUP BY 1")
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.run_to_table(T.sliding(T.event_stream(spark, sf_dir, "events"), "1 hour", "30 minutes", []), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("session_window", "SELECT min(ts) AS start, user_id, count(*) n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END new FROM events)) GROUP BY user_id, g")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.run_to_table(T.sessions(T.event_stream(spark, sf_dir, "events"), "6 hours", ["user_id"]), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("dedupe_watermark", "SELECT DISTINCT user_id, event_type FROM events")
def dedupe_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.first_of_key(T.event_stream(spark, sf_dir, "events"), ["user_id", "event_type"], "3650 days")
    return T.run_to_table(s.select("user_id", "event_type"), "append")


@query("ttl_expiry", f"SELECT event_id FROM events WHERE ts > {NOW} - INTERVAL 24 HOUR")
def ttl_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.live(table(spark, sf_dir, "events"), "ts", _now(spark, sf_dir), "INTERVAL 24 HOURS").select("event_id")


@query("circuit_breaker", "WITH x AS (SELECT user_id, event_type, row_number() OVER w r, count(*) FILTER (WHERE event_type <> 'error') OVER w g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), y AS (SELECT *, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id, g ORDER BY r) f FROM x) SELECT user_id, arg_max(f, r)::INTEGER failures, max(f) >= 2 blocked FROM y GROUP BY 1")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.run_to_table(T.circuit_breaker(T.event_stream(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), 2), "update", ["user_id"])


@query("provider_merge", "SELECT url FROM (SELECT url, min(p) p, min(page_id) i FROM (SELECT url, 0 p, page_id FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, 1, page_id FROM pages WHERE page_id % 3 = 0) GROUP BY 1) ORDER BY p, i LIMIT 50")
def provider_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("url", "page_id")
    return readers.merged_hits([p.where("page_id % 2 = 0"), p.where("page_id % 3 = 0")], "url", [F.col("page_id")], 50).select("url")


@case("award_feed", "SELECT * FROM (VALUES (0, 'A', '1', 10.00, 'X'), (1, 'B', '2', 20.50, 'Y'), (2, NULL, NULL, NULL, NULL)) t(id, title, award_id, amount, investigator)")
def award_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, '{"title":"A","id":"1","fundsObligatedAmt":"10","pi":{"name":"X"}}'), (1, '{"project_title":"B","project_num":"2","award_amount":20.5,"investigators":[{"name":"Y"}]}'), (2, "not json")]
    out = readers.awards(spark.createDataFrame(rows, "id int, body string"), "body")
    return out.select("id", "title", "award_id", F.col("amount").cast("double").alias("amount"), "investigator")


@case("sitemap_scan", "SELECT * FROM (VALUES (0, 'https://a.org/x', FALSE), (0, 'https://a.org/sitemap-2.xml', TRUE)) t(id, loc, is_map)")
def sitemap_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = "<urlset><url><loc>https://a.org/x</loc></url><url><loc>https://a.org/sitemap-2.xml</loc></url><url><loc>https://a.org/x</loc></url></urlset>"
    return readers.sitemap(spark.createDataFrame([(0, xml)], "id int, xml string"), "xml").select("id", "loc", "is_map")


_MARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query(
    "liveness_changes",
    f"""WITH g AS (SELECT user_id, ts, lead(ts) OVER w nxt, lag(ts) OVER w prv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, date_trunc('millisecond', ts) "at", 'LIVE' what FROM g WHERE prv IS NULL OR date_trunc('millisecond', ts) > date_trunc('millisecond', prv) + INTERVAL 6 HOUR
    UNION ALL SELECT user_id, date_trunc('millisecond', ts) + INTERVAL 6 HOUR, 'STALLED' FROM g WHERE date_trunc('millisecond', coalesce(nxt, {_MARK})) > date_trunc('millisecond', ts) + INTERVAL 6 HOUR
    UNION ALL SELECT user_id, date_trunc('millisecond', ts) + INTERVAL 10 HOUR, 'LOST' FROM g WHERE date_trunc('millisecond', coalesce(nxt, {_MARK})) > date_trunc('millisecond', ts) + INTERVAL 10 HOUR""",
)
def liveness_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each user went silent, was given up, and came back; timers tell of it without another event."""
    out = T.run_to_table(machines.run(T.event_stream(spark, sf_dir, "events"), machines.Liveness(6 * 3600, 10 * 3600), "user_id", "event_type", "event_id"), "append")
    return out.select("user_id", F.col("at").cast("timestamp_ntz").alias("at"), "what")


@query(
    "retries_due",
    f"""WITH x AS (SELECT user_id, event_id, date_trunc('millisecond', ts) ts, event_type, count(*) FILTER (WHERE event_type <> 'error') OVER w g, lead(date_trunc('millisecond', ts)) OVER w nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    y AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) n FROM x WHERE event_type = 'error'),
    z AS (SELECT *, ts + to_seconds(least(3600, 15 * power(2, least(n, 20) - 1))::INT) due FROM y)
    SELECT user_id, due "at", n::INTEGER n FROM z WHERE coalesce(nxt, date_trunc('millisecond', {_MARK})) > due""",
)
def retries_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retries of each user's failures that no later event took the place of."""
    out = T.run_to_table(machines.run(T.event_stream(spark, sf_dir, "events"), machines.Retry("error"), "user_id", "event_type", "event_id"), "append")
    return out.select("user_id", F.col("at").cast("timestamp_ntz").alias("at"), "n")


@query("breaker_states")
def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A breaker per user that opens at two failures in a row for an hour and then tries again."""
    out = T.run_to_table(machines.run(T.event_stream(spark, sf_dir, "events"), machines.Breaker(2, 3600), "user_id", "event_type", "event_id"), "append")
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("live_model", "SELECT user_id, event_type, count(*) n, round(sum(value), 4) total, max(ts) seen, arg_max(event_id, (ts, event_id)) latest FROM events GROUP BY 1, 2")
def live_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, sums and latest event of each user and kind, kept up from the stream of events."""
    top = f"{T.shared_folder(spark)}/model-{uuid.uuid4().hex}"
    model = read_model.ReadModel(spark, f"{top}/rows", ["user_id", "event_type"], {"n": read_model.add, "total": read_model.add, "seen": read_model.most, "latest": read_model.newest("version"), "version": read_model.most}, 16)
    stream = T.event_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    version = F.struct("ts", "event_id")
    delta = lambda df: df.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("ts").alias("seen"), F.max_by("event_id", version).alias("latest"), F.max(version).alias("version"))
    rows = model.follow(stream, delta, f"{top}/checkpoint")
    return rows.select("user_id", "event_type", "n", F.round("total", 4).alias("total"), "seen", "latest")

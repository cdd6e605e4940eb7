"""Registered queries on joins, aggregates, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import relational as R
from tidemark.operators import sketches as K
from tidemark.plans.registry import query, table

AS_OF = "TIMESTAMP '1998-06-01 00:00:00'"


@query(
    "entity_radar_page",
    f"""
    WITH op AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey) r FROM orders WHERE o_orderstatus = 'O'),
    grants AS (SELECT o_custkey, count(*) n_grants, max(l_shipdate) last_ship FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY 1),
    sig AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) r FROM events WHERE event_type = 'purchase'),
    x AS (
      SELECT c_custkey, c_name, n_name, r_name, op.o_orderkey opening_id, op.o_totalprice opening_price, sig.event_id signal_id, coalesce(n_grants, 0) n_grants,
        c_mktsegment = 'MACHINERY' early,
        CASE WHEN op.o_orderkey IS NOT NULL AND op.o_orderpriority LIKE '1%' THEN 1 WHEN sig.event_id IS NOT NULL THEN 2 WHEN c_mktsegment = 'MACHINERY' AND n_grants > 0 THEN 3 WHEN c_mktsegment = 'MACHINERY' THEN 4 WHEN n_grants > 0 THEN 5 ELSE 6 END lane,
        least(100, floor(greatest(c_acctbal, 0) / 200) + CASE WHEN op.o_orderkey IS NOT NULL AND op.o_orderpriority LIKE '1%' THEN 50 WHEN sig.event_id IS NOT NULL THEN 35 ELSE 0 END + CASE WHEN n_grants > 0 THEN 15 ELSE 0 END + CASE WHEN c_mktsegment = 'MACHINERY' THEN 10 ELSE 0 END) score
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      LEFT JOIN op ON op.o_custkey = c_custkey AND op.r = 1 LEFT JOIN grants ON grants.o_custkey = c_custkey LEFT JOIN sig ON sig.user_id = c_custkey AND sig.r = 1
      WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey))
    SELECT c_custkey, c_name, n_name, r_name, opening_id, round(opening_price, 2) opening_price, signal_id, n_grants, CAST(lane AS INTEGER) lane, CAST(score AS BIGINT) score, count(*) OVER () total
    FROM x ORDER BY lane, score DESC, c_custkey LIMIT 25 OFFSET 0
    """,
)
def entity_radar_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked, paged lanes: gates by semi-join, first children by window, scores by expression."""
    t = lambda n: table(spark, sf_dir, n)
    orders = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    who = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    who = R.any_of_semi(who, [orders], "c_custkey")
    who = R.latest_child(who, orders.where("o_orderstatus = 'O'"), "c_custkey", [F.desc("o_totalprice"), F.desc("o_orderdate"), F.asc("o_orderkey")], ["o_orderkey", "o_totalprice", "o_orderpriority"])
    grants = orders.join(t("lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_grants"))
    who = who.join(grants, "c_custkey", "left").withColumn("n_grants", F.coalesce("n_grants", F.lit(0).cast("long")))
    signals = t("events").where("event_type = 'purchase'").withColumnRenamed("user_id", "c_custkey")
    who = R.latest_child(who, signals, "c_custkey", [F.desc("ts"), F.asc("event_id")], ["event_id"])
    opening = F.col("o_orderkey").isNotNull() & F.col("o_orderpriority").startswith("1")
    early, funded, signal = F.col("c_mktsegment") == "MACHINERY", F.col("n_grants") > 0, F.col("event_id").isNotNull()
    lane = F.when(opening, 1).when(signal, 2).when(early & funded, 3).when(early, 4).when(funded, 5).otherwise(6)
    plus = F.when(opening, 50).when(signal, 35).otherwise(0) + F.when(funded, 15).otherwise(0) + F.when(early, 10).otherwise(0)
    score = F.least(F.lit(100), F.floor(F.greatest("c_acctbal", F.lit(0)) / 200) + plus).cast("long")
    rows = who.select("c_custkey", "c_name", "n_name", "r_name", F.col("o_orderkey").alias("opening_id"), F.round("o_totalprice", 2).alias("opening_price"), F.col("event_id").alias("signal_id"), "n_grants", lane.alias("lane"), score.alias("score"))
    return R.page(rows, [F.asc("lane"), F.desc("score"), F.asc("c_custkey")], 25, 0, "total")


@query(
    "active_openings_search",
    f"""SELECT o_orderkey, o_custkey, c_name, round(o_totalprice, 2) price, o_orderpriority IN ('1-URGENT', '2-HIGH') urgent
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus = 'O' AND (o_orderdate + INTERVAL 90 DAY > {AS_OF}) AND (c_name ILIKE '%1%' OR o_orderpriority ILIKE '%1%' OR c_mktsegment ILIKE '%1%')
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
)
def active_openings_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.withColumn("expires_at", F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"))
    keep = R.conjunction([F.col("o_orderstatus") == "O", R.unexpired("expires_at", F.expr(AS_OF)), R.any_contains("1", "c_name", "o_orderpriority", "c_mktsegment"), None])
    rows = rows.where(keep).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
    return rows.select("o_orderkey", "o_custkey", "c_name", F.round("o_totalprice", 2).alias("price"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("urgent"))


@query("latest_child_per_parent", "SELECT c_custkey, o_orderkey, o_orderdate FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) r FROM orders) o ON o.o_custkey = c_custkey AND r = 1")
def latest_child_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return R.latest_child(table(spark, sf_dir, "customer").select("c_custkey"), child, "c_custkey", [F.desc("o_orderdate"), F.asc("o_orderkey")], ["o_orderkey", "o_orderdate"])


@query("latest_child_with_count", "SELECT o_orderkey, l_linenumber, round(l_extendedprice, 2) price, coalesce(n, 0) n FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) r, count(*) OVER (PARTITION BY l_orderkey) n FROM lineitem WHERE l_returnflag <> 'N') l ON l_orderkey = o_orderkey AND r = 1")
def latest_child_with_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = R.latest_child(table(spark, sf_dir, "orders").select("o_orderkey"), child, "o_orderkey", [F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")], ["l_linenumber", "l_extendedprice"], F.col("l_returnflag") != "N", "n")
    return out.select("o_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"), "n")


@query("lateral_array_agg", "SELECT n_nationkey, coalesce(max_bal, 0) max_bal, coalesce(names, '') names FROM nation LEFT JOIN (SELECT s_nationkey, round(max(s_acctbal), 2) max_bal, string_agg(s_name, '|' ORDER BY s_acctbal DESC, s_suppkey) names FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey")
def lateral_array_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    names = R.ordered_collect(s, "n_nationkey", [-F.col("s_acctbal"), F.col("s_suppkey")], F.col("s_name"), "names")
    best = s.groupBy("n_nationkey").agg(F.round(F.max("s_acctbal"), 2).alias("max_bal"))
    out = table(spark, sf_dir, "nation").select("n_nationkey").join(best, "n_nationkey", "left").join(names, "n_nationkey", "left")
    return out.select("n_nationkey", F.coalesce("max_bal", F.lit(0.0)).alias("max_bal"), F.coalesce(F.array_join("names", "|"), F.lit("")).alias("names"))


@query("lateral_json_agg", "SELECT r_name, '[' || string_agg('{\"k\":' || n_nationkey || ',\"n\":\"' || n_name || '\"}', ',' ORDER BY n_name) || ']' j FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def lateral_json_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    a = R.ordered_collect(n, "r_name", [F.col("n_name")], F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n")), "a")
    return a.select("r_name", F.to_json("a").alias("j"))


@query("array_contains_join", "SELECT s_suppkey, count(*) n, sum(p_size) sizes FROM (SELECT l_partkey, list(DISTINCT l_suppkey) s FROM lineitem GROUP BY 1) l JOIN part ON p_partkey = l_partkey, supplier WHERE list_contains(s, s_suppkey) AND p_size > 40 GROUP BY 1")
def array_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in an array column as an equality join on its elements."""
    sets = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.collect_set("l_suppkey").alias("s"))
    one = sets.select("l_partkey", F.explode("s").alias("s_suppkey"))
    part = table(spark, sf_dir, "part").where("p_size > 40")
    return one.join(part, F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), "s_suppkey").groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("sizes"))


@query("unnest_left_join", "SELECT c_custkey, k, p_name FROM (SELECT c_custkey, unnest([c_custkey * 2, c_custkey * 50]) k FROM customer) LEFT JOIN part ON p_partkey = k")
def unnest_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.explode_outer(F.array(F.col("c_custkey") * 2, F.col("c_custkey") * 50)).alias("k"))
    return c.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name"), "k", "left").select("c_custkey", "k", "p_name")


@query("conditional_lateral", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN n END n FROM customer LEFT JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'")
def conditional_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer")
    return c.join(n, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_mktsegment") == "BUILDING"), "left").select("c_custkey", "n")


@query("left_join_chain", "SELECT s_suppkey, n_name, r_name, c_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_custkey = s_suppkey AND c_nationkey = s_nationkey")
def left_join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return s.join(table(spark, sf_dir, "customer"), (F.col("c_custkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")), "left").select("s_suppkey", "n_name", "r_name", "c_name")


@query("exists_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.any_of_semi(table(spark, sf_dir, "customer"), [table(spark, sf_dir, "orders").where("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey")], "c_custkey").select("c_custkey")


@query("not_exists_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def not_exists_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.any_of_semi(table(spark, sf_dir, "customer"), [table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")], "c_custkey", negate=True).select("c_custkey")


@query("exists_or_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'error')")
def exists_or_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("c_custkey"))
    return R.any_of_semi(table(spark, sf_dir, "customer"), [o, e], "c_custkey").select("c_custkey")


@query("or_correlated_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey OR (c_nationkey = s_nationkey AND c_acctbal > 9900))")
def or_correlated_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An OR between correlations as two semi-joins of one key each."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    a = s.join(c, F.col("c_custkey") == F.col("s_suppkey"), "left_semi").select("s_suppkey")
    b = s.join(c.where("c_acctbal > 9900"), F.col("c_nationkey") == F.col("s_nationkey"), "left_semi").select("s_suppkey")
    return a.union(b).distinct()


@query("exists_projection", "SELECT p_partkey, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49) big FROM part")
def exists_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 49").withColumnRenamed("l_partkey", "p_partkey")
    return R.exists_flag(table(spark, sf_dir, "part").select("p_partkey"), big, "p_partkey", "big")


@query("coalesced_key_left_join", "SELECT o_orderkey, k, s_name FROM (SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_custkey END, o_orderkey % 50) k FROM orders) LEFT JOIN supplier ON s_suppkey = k")
def coalesced_key_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_custkey")).alias("a"), (F.col("o_orderkey") % 50).alias("b"))
    return R.coalesced_key_join(o, ["a", "b"], table(spark, sf_dir, "supplier"), "s_suppkey").select("o_orderkey", F.coalesce("a", "b").alias("k"), "s_name")


@query("null_safe_self_dedupe", "SELECT min(event_id) event_id, user_id, CASE WHEN value > 50 THEN event_type END kind FROM events GROUP BY user_id, CASE WHEN value > 50 THEN event_type END")
def null_safe_self_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("value") > 50, F.col("event_type")).alias("kind"))
    return R.null_safe_dedupe(e, ["user_id", "kind"], [F.asc("event_id")])


@query(
    "host_suffix_join",
    """WITH d AS (SELECT * FROM (VALUES ('example.net', 'net'), ('example.com', 'com'), ('ththon.example.com', 'ththon')) t(domain, owner)),
    h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) host FROM pages),
    m AS (SELECT page_id, owner, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC) r FROM h JOIN d ON host = domain OR host LIKE '%.' || domain)
    SELECT h.page_id, host, owner FROM h LEFT JOIN m ON m.page_id = h.page_id AND r = 1""",
)
def host_suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = spark.createDataFrame([("example.net", "net"), ("example.com", "com"), ("ththon.example.com", "ththon")], "domain string, owner string")
    p = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)).alias("host"))
    return R.suffix_host_join(p, "host", dim, "domain", "page_id", ["owner"]).select("page_id", "host", "owner")


@query("or_key_lookup", "SELECT c_custkey, (SELECT n_name FROM nation WHERE n_nationkey = c_custkey % 40 OR n_name = upper(c_mktsegment) OR n_regionkey = c_nationkey % 5 ORDER BY CASE WHEN n_nationkey = c_custkey % 40 THEN 0 ELSE 1 END, n_nationkey LIMIT 1) n_name FROM customer")
def or_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 40).alias("a"), F.upper("c_mktsegment").alias("b"), (F.col("c_nationkey") % 5).alias("d"))
    return R.ranked_lookup(c, [(["a"], ["n_nationkey"]), (["b"], ["n_name"]), (["d"], ["n_regionkey"])], table(spark, sf_dir, "nation"), "c_custkey", ["n_name"], "n_nationkey").select("c_custkey", "n_name")


@query("update_from_join", "SELECT c_custkey, coalesce(s_name, c_name) name, coalesce(s_acctbal, c_acctbal) bal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def update_from_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("c_custkey"), "left")
    return j.select("c_custkey", F.coalesce("s_name", "c_name").alias("name"), F.coalesce("s_acctbal", "c_acctbal").alias("bal"))


@query("children_capped_per_parent", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY r) ks FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) r FROM orders) WHERE r <= 4 GROUP BY 1")
def children_capped_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = R.topk_per_key(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 4)
    return R.ordered_collect(top, "o_custkey", [F.col("rank")], F.col("o_orderkey").cast("string"), "a").select("o_custkey", F.array_join("a", ",").alias("ks"))


@query("filtered_counts", "SELECT event_type, count(*) n, count(*) FILTER (WHERE value > 50) high, count(*) FILTER (WHERE value IS NULL) blank, count(DISTINCT user_id) users, count(DISTINCT CASE WHEN value > 50 THEN user_id END) high_users, min(ts) first, max(ts) last FROM events GROUP BY 1")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = F.col("value") > 50
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(high).alias("high"), F.count_if(F.col("value").isNull()).alias("blank"), F.countDistinct("user_id").alias("users"), F.countDistinct(F.when(high, F.col("user_id"))).alias("high_users"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("having_distinct", "SELECT l_partkey, count(DISTINCT l_suppkey) suppliers FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 3")
def having_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("suppliers")).where("suppliers > 3")


@query("computed_group", f"SELECT CASE WHEN o_orderstatus = 'O' AND o_orderdate < {AS_OF} - INTERVAL 360 DAY THEN 'stalled' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'done' END state, count(*) n, ceil(epoch({AS_OF} - min(o_orderdate)))::BIGINT age FROM orders GROUP BY 1")
def computed_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.expr(AS_OF)
    state = F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < now - F.expr("INTERVAL 360 DAYS")), "stalled").when(F.col("o_orderstatus") == "O", "running").otherwise("done")
    return table(spark, sf_dir, "orders").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.ceil((F.unix_micros(now) - F.unix_micros(F.min("o_orderdate").cast("timestamp"))) / 1e6).alias("age"))


@query("string_agg_sorted", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) kinds FROM events GROUP BY 1")
def string_agg_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


@query("scalar_counter_row", "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') open_orders, (SELECT count(*) FROM customer WHERE c_acctbal < 0) in_debt, (SELECT count(DISTINCT user_id) FROM events) users, (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) items")
def scalar_counter_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of many tables: one row each, side by side."""
    t = lambda n: table(spark, sf_dir, n)
    rows = [t("orders").agg(F.count_if(F.col("o_orderstatus") == "O").alias("open_orders")), t("customer").agg(F.count_if(F.col("c_acctbal") < 0).alias("in_debt")), t("events").agg(F.countDistinct("user_id").alias("users")), t("supplier").agg(F.count(F.lit(1)).alias("a")), t("part").agg(F.count(F.lit(1)).alias("b"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(r)  # of single rows
    return out.select("open_orders", "in_debt", "users", (F.col("a") + F.col("b")).alias("items"))


@query("correlated_counts", "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) suppliers FROM nation")
def correlated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "nation").select("n_nationkey")
    for name, key, alias in (("customer", "c_nationkey", "customers"), ("supplier", "s_nationkey", "suppliers")):
        n = table(spark, sf_dir, name).groupBy(F.col(key).alias("n_nationkey")).agg(F.count(F.lit(1)).alias(alias))
        out = out.join(n, "n_nationkey", "left").withColumn(alias, F.coalesce(alias, F.lit(0).cast("long")))
    return out


@query("union_max_label_top8", "SELECT nk, string_agg(label, ',' ORDER BY top DESC, label) labels FROM (SELECT *, row_number() OVER (PARTITION BY nk ORDER BY top DESC, label) r FROM (SELECT nk, label, max(v) top FROM (SELECT s_nationkey nk, p_brand label, p_retailprice v FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey UNION ALL SELECT c_nationkey, c_mktsegment, c_acctbal FROM customer) GROUP BY 1, 2)) WHERE r <= 8 GROUP BY 1")
def union_max_label_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    a = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_nationkey").alias("nk"), F.col("p_brand").alias("label"), F.col("p_retailprice").alias("v"))
    b = t("customer").select(F.col("c_nationkey").alias("nk"), F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("v"))
    top = R.topk_per_key(a.unionByName(b).groupBy("nk", "label").agg(F.max("v").alias("top")), "nk", [F.desc("top"), F.asc("label")], 8)
    return R.ordered_collect(top, "nk", [F.col("rank")], F.col("label"), "a").select("nk", F.array_join("a", ",").alias("labels"))


@query("window_total_and_partition_count", "SELECT s_suppkey, s_nationkey, count(*) OVER () total, count(*) OVER (PARTITION BY s_nationkey) same FROM supplier")
def window_total_and_partition_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return s.crossJoin(F.broadcast(s.agg(F.count(F.lit(1)).alias("total")))).withColumn("same", F.count(F.lit(1)).over(W.partitionBy("s_nationkey")))


@query("topk_per_key", "SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS \"rank\" FROM lineitem) WHERE \"rank\" <= 5")
def topk_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.topk_per_key(table(spark, sf_dir, "lineitem"), "l_suppkey", [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], 5).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("distinct_on", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id")
def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distinct_on(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.asc("event_id")]).select("user_id", "event_id", "event_type")


@query("nulls_order_page", "SELECT o_orderkey, d FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END d FROM orders) ORDER BY d DESC NULLS FIRST, o_orderkey LIMIT 25 OFFSET 50")
def nulls_order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("d"))
    return R.page(o, [F.desc_nulls_first("d"), F.asc("o_orderkey")], 25, 50)


@query("ageing_priority_sort", f"SELECT o_orderkey, p + least(30, floor(epoch({AS_OF} - o_orderdate) / 21600 / 100))::BIGINT aged FROM (SELECT *, left(o_orderpriority, 1)::BIGINT * 10 p FROM orders) ORDER BY aged DESC, o_orderdate, o_orderkey LIMIT 50")
def ageing_priority_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = (F.unix_micros(F.expr(AS_OF)) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 1e6
    aged = F.left("o_orderpriority", F.lit(1)).cast("long") * 10 + F.least(F.lit(30), F.floor(age / 21600 / 100))
    return table(spark, sf_dir, "orders").select("o_orderkey", aged.cast("long").alias("aged"), "o_orderdate").orderBy(F.desc("aged"), "o_orderdate", "o_orderkey").limit(50).drop("o_orderdate")


@query("stale_first_sort", "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) a FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, max(ts) b FROM events GROUP BY 1) ON user_id = c_custkey ORDER BY CASE WHEN a IS NULL AND b IS NULL THEN 0 ELSE 1 END, least(a, b) NULLS FIRST, c_custkey LIMIT 40")
def stale_first_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("a"))
    b = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("b"))
    j = table(spark, sf_dir, "customer").join(a, "c_custkey", "left").join(b, "c_custkey", "left")
    never = F.when(F.col("a").isNull() & F.col("b").isNull(), 0).otherwise(1)
    return j.orderBy(never, F.asc_nulls_first(F.least("a", "b")), "c_custkey").limit(40).select("c_custkey")


@query("representative_sample", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) r, count(*) OVER (PARTITION BY o_custkey) n FROM orders), s AS (SELECT *, unnest(range(0, 3)) i FROM r) SELECT DISTINCT o_custkey, o_orderkey FROM s WHERE r <= 5 OR n - 5 <= 3 OR r - 6 = floor(i * (n - 5) / 3)")
def representative_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.spread_sample(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), F.asc("o_orderkey")], 5, 3).select("o_custkey", "o_orderkey")


@query("keep_caller_order", "SELECT n_name, pos FROM nation JOIN (SELECT unnest([7, 3, 21, 1]) k, unnest([0, 1, 2, 3]) pos) ON k = n_nationkey")
def keep_caller_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(k, i) for i, k in enumerate((7, 3, 21, 1))], "n_nationkey int, pos int")
    return R.keep_order(table(spark, sf_dir, "nation"), "n_nationkey", wanted, "pos").select("n_name", "pos")


@query("union_all_queues", "SELECT 'order' kind, o_orderkey id, o_orderdate seen_at FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'event', event_id, ts FROM events WHERE event_type = 'error' UNION ALL SELECT 'line', l_orderkey, l_shipdate FROM lineitem WHERE l_quantity = 50 AND l_tax > 0.07")
def union_all_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    a = t("orders").where("o_orderstatus = 'P'").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("seen_at"))
    b = t("events").where("event_type = 'error'").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("seen_at"))
    c = t("lineitem").where("l_quantity = 50 and l_tax > 0.07").select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("seen_at"))
    return a.unionByName(b).unionByName(c)


@query("activity_feed", "SELECT * FROM (SELECT 'order' kind, o_orderkey id, o_orderdate seen_at, o_orderpriority detail, NULL::DOUBLE amount FROM orders UNION ALL SELECT 'event', event_id, ts, event_type, value FROM events) ORDER BY seen_at DESC, kind, id LIMIT 100")
def activity_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("seen_at"), F.col("o_orderpriority").alias("detail"))
    b = table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("seen_at"), F.col("event_type").alias("detail"), F.col("value").alias("amount"))
    return a.unionByName(b, allowMissingColumns=True).orderBy(F.desc("seen_at"), "kind", "id").limit(100)


@query("set_union_array", "SELECT c_custkey, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ',') u FROM customer LEFT JOIN (SELECT o_custkey, list(DISTINCT o_orderstatus) a FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, list(DISTINCT event_type) b FROM events GROUP BY 1) ON user_id = c_custkey")
def set_union_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderstatus").alias("a"))
    b = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.collect_set("event_type").alias("b"))
    j = table(spark, sf_dir, "customer").join(a, "c_custkey", "left").join(b, "c_custkey", "left")
    return j.select("c_custkey", F.array_join(R.set_union(F.col("a"), F.col("b")), ",").alias("u"))


@query("intersect_except", "SELECT 'both' side, k FROM (SELECT o_custkey k FROM orders INTERSECT SELECT user_id FROM events) UNION ALL SELECT 'left', k FROM (SELECT o_custkey k FROM orders EXCEPT SELECT user_id FROM events)")
def intersect_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "events").select(F.col("user_id").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("side"), "k").unionByName(a.subtract(b).select(F.lit("left").alias("side"), "k"))


@query(
    "distinct_sketches",
    "SELECT event_type, year(ts) * 100 + month(ts) AS \"month\", count(DISTINCT user_id) exact_users, count(DISTINCT event_id) exact_events, TRUE AS within FROM events GROUP BY 1, 2",
)
def distinct_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users and events of each kind and month from daily sketches, held against the exact counts."""
    e = table(spark, sf_dir, "events").withColumn("month", F.year("ts") * 100 + F.month("ts"))
    daily = K.sketches(e.withColumn("day", F.to_date("ts")), ["event_type", "month", "day"], users="user_id", events="event_id")
    monthly = K.estimates(K.united(daily, ["event_type", "month"], "users", "events"), "users", "events")
    exact = e.groupBy("event_type", "month").agg(F.countDistinct("user_id").alias("exact_users"), F.countDistinct("event_id").alias("exact_events"))
    near = lambda n: F.abs(F.col(n) - F.col(f"exact_{n}")) <= K.error() * F.col(f"exact_{n}")
    return exact.join(monthly, ["event_type", "month"]).select("event_type", "month", "exact_users", "exact_events", (near("users") & near("events")).alias("within"))

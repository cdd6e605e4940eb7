"""Queries of moderation and workers: events as requests on customers' entries, rights following from earlier events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import moderation as M
from tidemark.plans.registry import query, table

#: A fifth of the events grant or take rights: user 0 owns the site, 1 moderates, 2 owned it once, 3 to 9 are users, 10 and 11
#: none. The others are reviews of entries, one a customer, its kind by its key.
_RIGHTS = """r AS (SELECT event_id seq, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END actor, CASE WHEN event_type IN ('click', 'view') THEN 'grant' ELSE 'revoke' END act, user_id % 12 target FROM events WHERE event_id % 5 = 0),
    g AS (SELECT * FROM (SELECT *, coalesce(lag(act) OVER (PARTITION BY target ORDER BY seq) = 'grant', target = 1) active FROM r WHERE actor = 0 AND target BETWEEN 1 AND 9) WHERE act = 'grant' OR active)"""
_REVIEWS = f"""{_RIGHTS}, v AS (SELECT event_id seq, user_id % 12 actor, ['profile', 'membership', 'opportunity'][event_id // 5 % 200 % 3 + 1] kind, event_id // 5 % 200 id, event_type <> 'error' yes, event_type notes, ts "at" FROM events WHERE event_id % 5 <> 0),
    d AS (SELECT v.* FROM v ASOF LEFT JOIN g ON g.target = v.actor AND g.seq < v.seq WHERE (v.actor = 0 OR coalesce(g.act = 'grant', v.actor = 1)) AND v.id IN (SELECT c_custkey FROM customer))"""


def _steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Admins, entries, decided grants and decided reviews."""
    e, i, n = table(spark, sf_dir, "events"), F.col("event_id"), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("user_id"))
    user = F.col("user_id") % 12
    kind = lambda k: F.when(k % 3 == 0, "profile").when(k % 3 == 1, "membership").otherwise("opportunity")
    admins = n.where("user_id < 3").select("user_id", F.when(F.col("user_id") == 1, "moderator").otherwise("owner").alias("role"), (F.col("user_id") < 2).alias("active"))
    asks = e.where(i % 5 == 0).select(i.alias("seq"), F.when(i % 4 == 0, 1).otherwise(0).alias("actor"), F.when(F.col("event_type").isin("click", "view"), "grant").otherwise("revoke").alias("action"), user.alias("target"))
    at = F.floor(i / 5) % 200
    looks = e.where(i % 5 != 0).select(i.alias("seq"), user.alias("actor"), kind(at).alias("kind"), at.alias("id"), (F.col("event_type") != "error").alias("approve"), F.concat(F.lit(" "), "event_type").alias("notes"), F.col("ts").alias("at"))
    k, none = F.col("c_custkey"), F.lit(None).cast("timestamp_ntz")
    entries = table(spark, sf_dir, "customer").select(kind(k).alias("kind"), k.alias("id"), F.lit("pending").alias("status"), none.alias("since"), none.alias("until"), (k % 50).alias("owner"))
    granted = M.grants(admins, n.where("user_id < 10"), asks)
    return admins, entries, granted, M.reviews(admins, granted, entries, looks)


@query(
    "moderator_rights",
    f"""WITH {_RIGHTS}, l AS (SELECT target user_id, arg_max(act, seq) act, max(actor) FILTER (WHERE act = 'grant') granted_by FROM g GROUP BY 1), a AS (SELECT n_nationkey user_id, CASE WHEN n_nationkey = 1 THEN 'moderator' ELSE 'owner' END AS role, n_nationkey < 2 active FROM nation WHERE n_nationkey < 3)
    SELECT coalesce(a.user_id, l.user_id) user_id, CASE WHEN granted_by IS NOT NULL THEN 'moderator' ELSE role END AS role, coalesce(act = 'grant', active) active, granted_by FROM a FULL JOIN l ON a.user_id = l.user_id""",
)
def moderator_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who owns or moderates the site after all grants and revokes."""
    admins, _, granted, _ = _steps(spark, sf_dir)
    return M.moderators(admins, granted)


@query(
    "review_audit",
    f"""WITH {_REVIEWS} SELECT seq, actor, act || '_moderator' AS action, 'user' target_type, target target_id, CASE WHEN act = 'grant' THEN 'Moderator access granted by owner' ELSE 'Moderator access revoked by owner' END notes FROM g
    UNION ALL SELECT seq, actor, CASE WHEN yes THEN 'approve' ELSE 'reject' END, kind, id, notes FROM d""",
)
def review_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit row for each grant, revoke and review that took effect."""
    _, _, granted, decided = _steps(spark, sf_dir)
    return M.audit(granted, decided)


@query(
    "review_state",
    f"""WITH {_REVIEWS}, s AS (SELECT id, arg_max(yes, seq) yes, max(seq) FILTER (WHERE yes) s, arg_max("at", seq) FILTER (WHERE yes) t FROM d GROUP BY 1), e AS (SELECT c_custkey id, ['profile', 'membership', 'opportunity'][c_custkey % 3 + 1] kind FROM customer)
    SELECT e.kind, e.id, CASE WHEN yes IS NULL THEN 'pending' WHEN NOT yes THEN 'rejected' WHEN kind = 'opportunity' THEN 'active' ELSE 'verified' END status, CASE WHEN yes OR kind = 'opportunity' THEN t END since, CASE WHEN kind = 'opportunity' THEN t + INTERVAL 90 DAY WHEN yes THEN t + INTERVAL 365 DAY END until FROM e LEFT JOIN s USING (id)""",
)
def review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry after its reviews."""
    _, entries, _, decided = _steps(spark, sf_dir)
    return M.reviewed(entries, decided).drop("owner")


@query(
    "worker_state",
    """WITH l AS (SELECT user_id, arg_max(event_type, event_id) t, arg_max(ts, event_id) seen, max(event_id) job, bool_or(event_type <> 'error') beat FROM events GROUP BY 1), c AS (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)
    SELECT coalesce(c_custkey, user_id) worker, CASE WHEN t <> 'error' THEN job END job, seen, CASE WHEN t = 'error' THEN seen END stopped FROM c FULL JOIN (SELECT * FROM l WHERE beat OR user_id IN (SELECT c_custkey FROM c)) l ON c_custkey = user_id""",
)
def worker_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers after all beats and stops; of customers every second is known before."""
    none = F.lit(None)
    state = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("worker"), none.cast("bigint").alias("job"), none.cast("timestamp_ntz").alias("seen"), none.cast("timestamp_ntz").alias("stopped"))
    e = table(spark, sf_dir, "events")
    signals = e.select(F.col("user_id").alias("worker"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "stop").otherwise("beat").alias("kind"), F.col("event_id").alias("job"))
    return M.workers(state, signals)

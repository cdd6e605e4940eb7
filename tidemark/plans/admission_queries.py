"""Queries of order-dependent admission, with SQL that goes from grant to grant by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import admission as A
from tidemark.plans.registry import query, table

#: Half of all events ask one provider, the others twenty; times to the hour, so that requests meet at one instant.
_ASKED = "(SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'shared' ELSE 'own ' || (user_id % 20) END provider, date_trunc('hour', ts) \"at\" FROM events)"
_FIRST = "TIMESTAMP '2024-01-04 00:00:00'"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    own = F.concat(F.lit("own "), (F.col("user_id") % 20).cast("string"))
    return e.select("event_id", F.when(F.col("event_id") % 2 == 0, "shared").otherwise(own).alias("provider"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("at"))


def _plain_time(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


#: A request each 90 minutes, 8 a day, 90 a month, 300 in all; 'shared' has used 250, 'own 3' is shut until the fourth.
_BUDGET = A.Budget(5400, 8, 90, 300)
_GRANTS = f"""e AS (SELECT *, row_number() OVER (PARTITION BY provider, "at" ORDER BY event_id) r, CASE WHEN provider = 'own 3' THEN {_FIRST} ELSE TIMESTAMP '1970-01-01' END shut FROM {_ASKED}),
    g AS (SELECT provider, TIMESTAMP '1970-01-01' t, 0 d, 0 m, CASE WHEN provider = 'shared' THEN 250 ELSE 0 END n FROM e GROUP BY ALL
    UNION ALL SELECT provider, t2, CASE WHEN date_trunc('day', t2) = date_trunc('day', t) THEN d + 1 ELSE 1 END, CASE WHEN date_trunc('month', t2) = date_trunc('month', t) THEN m + 1 ELSE 1 END, n + 1
    FROM (SELECT g.*, min(e."at") t2 FROM g JOIN e USING (provider) WHERE e."at" >= shut AND e."at" >= t + INTERVAL 90 MINUTE AND n < 300 AND (m < 90 OR date_trunc('month', e."at") <> date_trunc('month', t)) AND (d < 8 OR date_trunc('day', e."at") <> date_trunc('day', t)) GROUP BY ALL))"""


@query(
    "slot_reservation",
    f"""WITH RECURSIVE {_GRANTS}, x AS (SELECT e.*, g.t, g.d, g.m, g.n FROM e ASOF JOIN g ON e.provider = g.provider AND e."at" >= g.t),
    y AS (SELECT *, CASE WHEN t = "at" AND r = 1 THEN NULL WHEN "at" < shut THEN 'cooldown' WHEN n >= 300 THEN 'total' WHEN m >= 90 AND date_trunc('month', t) = date_trunc('month', "at") THEN 'month' WHEN d >= 8 AND date_trunc('day', t) = date_trunc('day', "at") THEN 'day' ELSE 'pace' END reason FROM x)
    SELECT event_id, provider, "at", reason, CASE reason WHEN 'cooldown' THEN shut WHEN 'month' THEN date_trunc('month', "at") + INTERVAL 1 MONTH WHEN 'day' THEN date_trunc('day', "at") + INTERVAL 1 DAY WHEN 'pace' THEN t + INTERVAL 90 MINUTE END until FROM y""",
)
def slot_reservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event asks its provider for a slot; the budget begins with what two providers bring along."""
    return _plain_time(A.admit(_asked(spark, sf_dir), "provider", "at", ["event_id"], _BUDGET, _before(spark)), "at", "until")


def _before(spark: SparkSession) -> DataFrame:
    until = F.unix_micros(F.lit("2024-01-04").cast("timestamp"))
    shared = F.struct(F.lit("shared").alias("provider"), F.lit(None).cast("bigint").alias("blocked_until"), F.lit(250).alias("in_all"))
    shut = F.struct(F.lit("own 3").alias("provider"), until.alias("blocked_until"), F.lit(0).alias("in_all"))
    return spark.range(1).select(F.inline(F.array(shared, shut)))


@query(
    "slot_usage",
    f"""WITH RECURSIVE {_GRANTS}, l AS (SELECT provider, max(t) t, max(n) n, arg_max(d, t) d, arg_max(m, t) m FROM g GROUP BY 1)
    SELECT provider, CASE WHEN provider = 'own 3' THEN {_FIRST} END blocked_until, t + INTERVAL 90 MINUTE next_at, t used_at, d::BIGINT in_day, m::BIGINT in_month, n::BIGINT in_all FROM l""",
)
def slot_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each provider has used when all events are decided."""
    done = A.admit(_asked(spark, sf_dir), "provider", "at", ["event_id"], _BUDGET, _before(spark))
    u = A.used(done, "provider", "at", _BUDGET.interval, _before(spark))
    return u.withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("blocked_until", "next_at", "used_at")})


@query(
    "rolling_admission",
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY "at", event_id) r FROM {_ASKED}),
    g AS (SELECT provider, 0::BIGINT r, []::TIMESTAMP[] l FROM e GROUP BY ALL
    UNION ALL SELECT provider, r2, CASE WHEN len(l) < 5 THEN list_append(l, t2) ELSE list_append(l[2:], t2) END FROM (SELECT g.provider, g.r, g.l, min(e.r) r2, arg_min(e."at", e.r) t2 FROM g JOIN e ON e.provider = g.provider AND e.r > g.r WHERE len(l) < 5 OR e."at" >= l[1] + INTERVAL 12 HOUR GROUP BY ALL))
    SELECT event_id, e.provider, "at", CASE WHEN g.r < e.r THEN 'busy' END reason, CASE WHEN g.r < e.r THEN l[1] + INTERVAL 12 HOUR END until FROM e ASOF JOIN g ON e.provider = g.provider AND e.r >= g.r""",
)
def rolling_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five grants within any twelve hours; refused requests count for nothing."""
    return _plain_time(A.admit(_asked(spark, sf_dir), "provider", "at", ["event_id"], A.Rolling(43200, 5)), "at", "until")

"""State tables without row locks: merges, snapshots, misses, queues, limits and audits, each a deterministic plan.

A state operator takes the old state and what is new and returns the next state; the caller writes it as a whole or by
partition. Order never matters: every merge function is commutative or ranks its inputs by a total order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Merge = Callable[[Column, Column], Column]


def newest(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def keep(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def larger(old: Column, new: Column) -> Column:
    return F.greatest(old, new)


def smaller(old: Column, new: Column) -> Column:
    return F.least(old, new)


def added(old: Column, new: Column) -> Column:
    return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))


def filled(old: Column, new: Column) -> Column:
    """The new text unless it is blank."""
    return F.coalesce(F.nullif(F.trim(new), F.lit("")), old)


def upsert(state: DataFrame, new: DataFrame, keys: list[str], merge: dict[str, Merge], locked: Column | None = None) -> DataFrame:
    """One row per key of either side; ``merge`` says how each column combines. Rows for which ``locked`` (over the old
    columns) holds stay as they are. One full outer join."""
    o, n = state.alias("o"), new.alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    j = o.withColumn("__o", F.lit(True)).alias("o").join(n.withColumn("__n", F.lit(True)).alias("n"), on, "full")
    fixed = F.coalesce(F.col("__o") & locked, F.lit(False)) if locked is not None else F.lit(False)
    both = F.col("__o").isNotNull() & F.col("__n").isNotNull()
    cols = [F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys]
    for c, f in merge.items():
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        cols.append(F.when(fixed, a).when(both, f(a, b)).otherwise(F.coalesce(a, b)).alias(c))
    return j.select(*cols)


def insert_new(state: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The state and those new rows whose key it lacks."""
    return state.unionByName(new.join(state.select(*keys), keys, "left_anti"))


def snapshot_swap(state: DataFrame, snapshot: DataFrame, keys: list[str], cols: list[str], flag: str = "is_current") -> DataFrame:
    """All rows of the state lose the flag, those of the snapshot get it with the snapshot's values."""
    s = state.drop(flag).withColumn("__old", F.lit(True))
    n = snapshot.select(*keys, *[F.col(c).alias(f"__{c}") for c in cols]).withColumn("__new", F.lit(True))
    j = s.join(n, keys, "full")
    return j.select(*keys, *[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in cols], F.coalesce("__new", F.lit(False)).alias(flag))


def apply_misses(state: DataFrame, seen: DataFrame, keys: list[str], threshold: int = 2) -> DataFrame:
    """``state`` has misses and listed: a seen key is listed with no miss, an unseen one has a miss more and is delisted
    at the threshold; new keys come in listed."""
    j = state.join(seen.select(*keys).distinct().withColumn("__seen", F.lit(True)), keys, "full")
    there = F.coalesce("__seen", F.lit(False))
    misses = F.when(there, 0).otherwise(F.coalesce("misses", F.lit(0)) + 1)
    return j.select(*keys, misses.alias("misses"), (there | (F.coalesce("listed", F.lit(False)) & (misses < threshold))).alias("listed"))


def json_merge(old: Column, new: Column) -> Column:
    """Shallow merge of JSON objects with string values, the new winning; keys in order."""
    kind = "map<string,string>"
    a, b = (F.coalesce(F.from_json(c, kind), F.create_map().cast(kind)) for c in (old, new))
    both = F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(both))))


def cache_reuse(requests: DataFrame, cache: DataFrame, key: str, at: str, as_of: Column, days: int, retry: tuple[str, ...] = ("error",)) -> DataFrame:
    """Requests with ``hit``: a cached answer that is young enough and whose status is not to be tried again."""
    fresh = cache.where((F.col(at) > as_of - F.make_dt_interval(F.lit(days))) & ~F.col("status").isin(*retry))
    return requests.join(fresh.select(key).distinct().withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def enqueue(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Jobs and requests (key, priority, max_attempts): an active job of the same key gets the higher priority if it is
    queued, and the higher number of attempts; other keys become queued jobs."""
    r = requests.groupBy("key").agg(F.max("priority").alias("rp"), F.max("max_attempts").alias("rm"))
    active = jobs.where(F.col("status").isin("queued", "running"))
    done = jobs.where(~F.col("status").isin("queued", "running"))
    j = active.join(r, "key", "full")
    new = F.col("status").isNull()
    active = j.select(
        "key",
        F.coalesce("status", F.lit("queued")).alias("status"),
        F.when(new, F.col("rp")).when(F.col("status") == "queued", F.greatest("priority", "rp")).otherwise(F.col("priority")).alias("priority"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.greatest("max_attempts", "rm").alias("max_attempts"),
    )
    return active.unionByName(done.select(*active.columns))


def recover(jobs: DataFrame, as_of: Column, lease: str = "INTERVAL 10 MINUTES") -> DataFrame:
    """Running jobs whose lease is over return to the queue, or fail if they have no attempt left."""
    stale = (F.col("status") == "running") & (F.col("locked_at") < as_of - F.expr(lease))
    return jobs.withColumn("status", F.when(stale & (F.col("attempts") >= F.col("max_attempts")), "failed").when(stale, "queued").otherwise(F.col("status")))


def claim(jobs: DataFrame, as_of: Column, n: int, excluded: tuple[str, ...] = (), search_ready: bool = True) -> DataFrame:
    """The next n jobs: queued, due, with attempts left; at most one model job, and none while one runs. Priority ages by
    one in six hours, thirty at most."""
    ok = (F.col("status") == "queued") & (F.col("available_at") <= as_of) & (F.col("attempts") < F.col("max_attempts"))
    if excluded:
        ok = ok & ~F.col("job_type").isin(*excluded)
    if not search_ready:
        ok = ok & ~F.col("needs_search")
    busy = jobs.where((F.col("status") == "running") & F.col("model")).agg((F.count(F.lit(1)) > 0).alias("busy"))
    aged = F.col("priority") + F.least(F.lit(30), F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(F.col("created_at").cast("timestamp"))) / 21600))
    order = [F.desc("aged"), F.asc("available_at"), F.asc("created_at"), F.asc("id")]
    q = jobs.where(ok).withColumn("aged", aged.cast("long")).crossJoin(F.broadcast(busy))  # one row
    q = q.where(~(F.col("model") & F.col("busy")))
    # One model job takes part: the first of them. Both picks are bounded by n.
    plain = q.where(~F.col("model")).orderBy(*order).limit(n)
    model = q.where("model").orderBy(*order).limit(1)
    return plain.unionByName(model).orderBy(*order).limit(n).drop("busy")


def fail(jobs: DataFrame, failed: DataFrame, as_of: Column) -> DataFrame:
    """``failed`` (id, outage, retry_after): another try while attempts are left or after an outage, which gives its
    attempt back; else failed. The wait doubles from 15 seconds, within an hour, or is what was asked, within six."""
    j = jobs.join(failed, "id", "left")
    hit, outage = F.col("outage").isNotNull(), F.coalesce("outage", F.lit(False))
    again = outage | (F.col("attempts") < F.col("max_attempts"))
    base = F.least(F.lit(3600.0), 15 * F.pow(F.lit(2.0), F.greatest(F.col("attempts"), F.lit(1)) - 1))
    wait = F.least(F.lit(21600.0), F.greatest(base, F.coalesce("retry_after", F.lit(0)))).cast("long")
    return j.select(
        "id",
        F.when(~hit, F.col("status")).when(again, "queued").otherwise("failed").alias("status"),
        F.when(hit & outage, F.greatest(F.col("attempts") - 1, F.lit(0))).otherwise(F.col("attempts")).alias("attempts"),
        F.when(hit & again, F.unix_timestamp(as_of) + wait).alias("wait_until"),
    )


def within_last(df: DataFrame, by: list[str], at: str, as_of: Column, span: str, limit: int) -> DataFrame:
    """Uses per key within the span, and whether another is allowed."""
    n = F.count_if((F.col(at).cast("timestamp") > as_of - F.expr(span)) & (F.col(at).cast("timestamp") <= as_of))
    return df.groupBy(*by).agg(n.alias("used")).withColumn("allowed", F.col("used") < limit)


def budget_reason(day: Column, month: Column, total: Column, per_day: int, per_month: int, in_all: int) -> Column:
    """Why no slot is free, the widest limit first; null if one is."""
    return F.when(total >= in_all, "total").when(month >= per_month, "month").when(day >= per_day, "day")


def constraint_violations(df: DataFrame, key: str, checks: dict[str, Column], unique: dict[str, list[str]] | None = None, parents: dict[str, tuple[DataFrame, str, str]] | None = None) -> DataFrame:
    """(constraint, id) of rows that break a check, share a key that must be unique, or lack their parent. A check that
    is null passes."""
    out = df.select(F.explode(F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]))).alias("constraint"), F.col(key).cast("string").alias("id"))
    for name, cols in (unique or {}).items():
        whole = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
        twice = whole.join(whole.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"), cols, "left_semi")
        out = out.unionByName(twice.select(F.lit(name).alias("constraint"), F.col(key).cast("string").alias("id")))
    for name, (parent, own, theirs) in (parents or {}).items():
        lost = df.where(F.col(own).isNotNull()).join(parent, F.col(own) == parent[theirs], "left_anti")
        out = out.unionByName(lost.select(F.lit(name).alias("constraint"), F.col(key).cast("string").alias("id")))
    return out


def schema_gaps(found: dict[str, StructType], wanted: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(table, column) pairs that are asked for and not there; a missing table lacks '*'."""
    out = []
    for t, cols in sorted(wanted.items()):
        if t not in found:
            out.append((t, "*"))
        else:
            out += [(t, c) for c in cols if c not in found[t].fieldNames()]
    return out


def clamp(c: Column, low: int, high: int) -> Column:
    """The value, no lower than ``low`` and no higher than ``high``; a missing one counts as ``low``."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c, F.lit(low))))


def object_text(answer: Column) -> Column:
    """The JSON object of an answer, a code fence around it taken off; null for anything but an object."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
    return F.when(bare.startswith("{") & bare.endswith("}"), bare)


def job_transitions(jobs: DataFrame) -> DataFrame:
    """``jobs`` (status, attempts, asked) after the request of each: complete ends any job, cancel one that waits or
    runs, retry makes a failed one wait again from its first attempt, recover one that was running."""
    s, a = F.col("status"), F.col("asked")
    retry = (a == "retry") & (s == "FAILED")
    now = F.when(a == "complete", "COMPLETE").when((a == "cancel") & s.isin("PENDING", "RUNNING"), "CANCELLED").when(retry | ((a == "recover") & (s == "RUNNING")), "PENDING").otherwise(s)
    return jobs.withColumns({"attempts": F.when(retry, F.lit(0)).otherwise(F.col("attempts")), "status": now})

"""State, requests in order, new state and audit rows: moderators, reviews of entries, workers that beat and stop.

A request counts by what holds when it comes: who may ask follows from the grants before it, so rights are read off a
window over one user's grants and requests. Whatever can't be done changes nothing and leaves no audit row; it comes back
with its reason. ``seq`` orders requests and must tell them apart; those without one take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a review sets, by kind of entry; the days for which an approval holds; the role it gives its owner.
REVIEWS = {"profile": ("verified", 365, "professor"), "membership": ("verified", 365, "institution_admin"), "opportunity": ("active", 90, None)}


def grants(admins: DataFrame, users: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (seq, actor, action grant or revoke, target) with ``refused``: null for those that take effect.

    ``admins``: (user_id, role, active) before the first request, ``users``: (user_id). Only active owners may ask, an owner is
    never made a moderator, and only an active moderator can lose the right.
    """
    a = admins.where("active").groupBy("user_id").agg(F.max(F.col("role") == "owner").alias("owner"))
    r = requests.where("seq IS NOT NULL")
    j = r.join(a.where("owner").select(F.col("user_id").alias("actor"), F.lit(True).alias("__may")), "actor", "left")
    j = j.join(users.select(F.col("user_id").alias("target")).distinct().withColumn("__there", F.lit(True)), "target", "left")
    j = j.join(a.select(F.col("user_id").alias("target"), F.col("owner").alias("__owner")), "target", "left")
    # A revoke that fails finds no right and leaves none, so of the requests of owners the one before tells the state.
    may = F.col("__may").isNotNull()
    counts = may & F.col("action").isin("grant", "revoke") & F.col("__there").isNotNull()
    before = F.last(F.when(counts, F.col("action") == "grant"), ignorenulls=True).over(Window.partitionBy("target").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    active = F.coalesce(before, F.col("__owner").isNotNull())
    why = F.when(~may, "not_owner").when(F.col("__there").isNull(), "no_user").when(F.col("__owner"), "is_owner").when((F.col("action") == "revoke") & ~active, "no_moderator").when(~F.coalesce(F.col("action").isin("grant", "revoke"), F.lit(False)), "no_action")
    return j.select(*requests.columns, why.alias("refused"))


def moderators(admins: DataFrame, decided: DataFrame) -> DataFrame:
    """(user_id, role, active, granted_by) after the requests that took effect."""
    last = decided.where("refused IS NULL").groupBy(F.col("target").alias("user_id")).agg(F.max_by("action", "seq").alias("__act"), F.max(F.when(F.col("action") == "grant", F.struct("seq", "actor")))["actor"].alias("granted_by"))
    old = admins.groupBy("user_id").agg(F.min(F.struct(F.when(F.col("role") == "owner", 0).otherwise(1), F.col("role")))["role"].alias("role"), F.max("active").alias("active"))
    j = old.join(last, "user_id", "full")
    return j.select("user_id", F.when(F.col("granted_by").isNotNull(), "moderator").otherwise(F.col("role")).alias("role"), F.coalesce(F.col("__act") == "grant", "active").alias("active"), "granted_by")


def reviews(admins: DataFrame, decided: DataFrame, entries: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (seq, actor, kind, id, approve, notes, at) with ``refused``; one sequence with those of ``decided`` grants.

    The reviewer has to be an owner or a moderator when the review comes, the kind known, the entry in ``entries`` (kind, id).
    A review without a verdict is refused.
    """
    old = admins.where("active").groupBy("user_id").agg(F.lit(True).alias("__was"))
    turn = decided.where("refused IS NULL").select(F.col("target").alias("actor"), "seq", (F.col("action") == "grant").alias("__turn"))
    r = requests.where("seq IS NOT NULL").withColumn("__turn", F.lit(None).cast("boolean")).withColumn("__ask", F.lit(True))
    u = r.unionByName(turn, allowMissingColumns=True)
    now = F.last("__turn", ignorenulls=True).over(Window.partitionBy("actor").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    u = u.withColumn("__now", now).where("__ask").join(old.withColumnRenamed("user_id", "actor"), "actor", "left")
    u = u.join(entries.select("kind", "id").distinct().withColumn("__there", F.lit(True)), ["kind", "id"], "left")
    allowed = F.coalesce("__now", "__was", F.lit(False))
    known = F.coalesce(F.col("kind").isin(*REVIEWS), F.lit(False))
    why = F.when(~allowed, "not_admin").when(~known, "no_kind").when(F.col("__there").isNull(), "no_entry").when(F.col("approve").isNull(), "no_verdict")
    return u.select(*requests.columns, why.alias("refused"))


def reviewed(entries: DataFrame, decided: DataFrame) -> DataFrame:
    """``entries`` (kind, id, status, since, until, ...) after their reviews. The last one sets the status; an approval
    sets since and until, a rejection empties them but for opportunities, which keep those of their last approval."""
    ok = decided.where("refused IS NULL")
    g = ok.groupBy("kind", "id").agg(F.max_by("approve", "seq").alias("__yes"), F.max(F.when(F.col("approve"), F.struct("seq", "at")))["at"].alias("__at"))
    pick = lambda i: F.coalesce(*[F.when(F.col("kind") == k, F.lit(v[i])) for k, v in REVIEWS.items()])
    j = entries.join(g, ["kind", "id"], "left")
    hit, yes, keeps = F.col("__yes").isNotNull(), F.col("__yes"), F.col("kind") == "opportunity"
    end = F.col("__at") + F.make_interval(days=pick(1))
    set_to = lambda new, old: F.when(~hit, F.col(old)).when(yes, new).when(keeps, F.coalesce(new, F.col(old))).alias(old)
    fixed = {"status": F.when(~hit, F.col("status")).when(yes, pick(0)).otherwise("rejected").alias("status"), "since": set_to(F.col("__at"), "since"), "until": set_to(end, "until")}
    return j.select(*[fixed.get(c, F.col(f"`{c}`")) for c in entries.columns])


def roles(entries: DataFrame, decided: DataFrame) -> DataFrame:
    """(user_id, account_role) that approvals give the entries' owners; of several the last one."""
    given = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v[2])) for k, v in REVIEWS.items()])
    j = decided.where("refused IS NULL AND approve").withColumn("__role", given).where("__role IS NOT NULL").join(entries.select("kind", "id", F.col("owner").alias("user_id")), ["kind", "id"])
    return j.where("user_id IS NOT NULL").groupBy("user_id").agg(F.max_by("__role", "seq").alias("account_role"))


def audit(granted: DataFrame, decided: DataFrame) -> DataFrame:
    """(seq, actor, action, target_type, target_id, notes): a row for each request that took effect."""
    word: dict[str, Column] = {"grant": F.lit("Moderator access granted by owner"), "revoke": F.lit("Moderator access revoked by owner")}
    g = granted.where("refused IS NULL").select("seq", "actor", F.concat("action", F.lit("_moderator")).alias("action"), F.lit("user").alias("target_type"), F.col("target").alias("target_id"), F.when(F.col("action") == "grant", word["grant"]).otherwise(word["revoke"]).alias("notes"))
    r = decided.where("refused IS NULL").select("seq", "actor", F.when(F.col("approve"), "approve").otherwise("reject").alias("action"), F.col("kind").alias("target_type"), F.col("id").alias("target_id"), F.trim("notes").alias("notes"))
    return g.unionByName(r)


def workers(state: DataFrame, signals: DataFrame) -> DataFrame:
    """(worker, job, seen, stopped) after ``signals`` (worker, seq, at, kind beat or stop, job). A beat makes a worker known, takes
    its job and undoes a stop; a stop ends its job and says nothing of workers unknown so far."""
    s = signals.where("seq IS NOT NULL AND worker IS NOT NULL").join(state.select("worker").distinct().withColumn("__known", F.lit(True)), "worker", "left")
    g = s.groupBy("worker").agg(F.max_by(F.struct("at", "kind", "job"), "seq").alias("last"), (F.count_if(F.col("kind") == "beat") > 0).alias("beat"), F.first("__known").alias("known"))
    g = g.where(F.col("known").isNotNull() | F.col("beat")).select("worker", "last")
    j = state.join(g, "worker", "full")
    hit, stop = F.col("last").isNotNull(), F.col("last.kind") == "stop"
    return j.select("worker", F.when(~hit, F.col("job")).when(~stop, F.col("last.job")).alias("job"), F.when(hit, F.col("last.at")).otherwise(F.col("seen")).alias("seen"), F.when(~hit, F.col("stopped")).when(stop, F.col("last.at")).alias("stopped"))

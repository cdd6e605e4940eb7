"""Requests admitted in their order, where a refused one takes nothing: slots of a budget and limits over a rolling span.

Whether a request is granted depends on every grant before it, so a key is folded in order. What reaches the fold is thin:
of requests of one key at one instant only as many as could be granted at all, two columns wide, streamed in sorted
batches. The fold holds one small state, jumps from grant to grant by binary search and never looks at a refused request
by itself, so a key with half of all requests costs its sort. All other requests get their answer by a join on key and time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000
#: What a decision can be; None grants.
REASONS = (None, "cooldown", "total", "month", "day", "pace", "busy")
NEVER = np.iinfo(np.int64).min
#: What is known of a key before its first request: times in microseconds, and what of its counts is used.
STATE = {"blocked_until": "bigint", "next_at": "bigint", "used_at": "bigint", "in_day": "bigint", "in_month": "bigint", "in_all": "bigint"}


def _month(at: int) -> int:
    return int(np.int64(at).astype("datetime64[us]").astype("datetime64[M]").astype(np.int64))


@dataclass(frozen=True)
class Budget:
    """A request every ``interval`` seconds, so many a UTC day and month and in all; 0 is no limit."""

    interval: int
    per_day: int
    per_month: int = 0
    in_all: int = 0

    def at_once(self) -> int:
        """How many requests of one instant can be granted at most."""
        return 1 if self.interval else min(x for x in (self.per_day, self.per_month, self.in_all) if x)

    def start(self, known: dict) -> _Budget:
        return _Budget(self, known)


class _Budget:
    def __init__(self, rule: Budget, known: dict):
        self.rule = rule
        self.blocked = NEVER if known["blocked_until"] is None else known["blocked_until"]
        self.next = NEVER if known["next_at"] is None else known["next_at"]
        used = known["used_at"]
        self.day, self.month = (None, None) if used is None else (used // DAY, _month(used))
        self.in_day, self.in_month, self.total = (known[c] or 0 for c in ("in_day", "in_month", "in_all"))

    def _refusal(self, at: int) -> tuple[int, int | None]:
        """Reason and end of it, the widest limit first."""
        r, day, month = self.rule, at // DAY, _month(at)
        if at < self.blocked:
            return 1, self.blocked
        if r.in_all and self.total >= r.in_all:
            return 2, None
        if r.per_month and self.month == month and self.in_month >= r.per_month:
            return 3, int(np.datetime64(month + 1, "M").astype("datetime64[us]").astype(np.int64))
        if r.per_day and self.day == day and self.in_day >= r.per_day:
            return 4, (day + 1) * DAY
        return (5, self.next) if at < self.next else (0, None)

    def decide(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per request in order: reason and its end, and both for one more at the same instant."""
        n, i = len(at), 0
        why, then = np.zeros(n, np.int8), np.zeros(n, np.int8)
        end, later = np.full(n, NEVER), np.full(n, NEVER)
        while i < n:
            now = int(at[i])
            reason, until = self._refusal(now)
            if reason:
                j = n if until is None else i + int(np.searchsorted(at[i:], until))
                why[i:j] = then[i:j] = reason
                end[i:j] = later[i:j] = NEVER if until is None else until
                i = j
                continue
            day, month = now // DAY, _month(now)
            self.in_day = self.in_day + 1 if self.day == day else 1
            self.in_month = self.in_month + 1 if self.month == month else 1
            self.day, self.month, self.total = day, month, self.total + 1
            self.next = now + self.rule.interval * 1_000_000
            then[i], until = self._refusal(now)
            later[i] = NEVER if until is None else until
            i += 1
        return why, end, then, later


@dataclass(frozen=True)
class Rolling:
    """At most ``limit`` grants within any ``span`` seconds."""

    span: int
    limit: int

    def at_once(self) -> int:
        return self.limit

    def start(self, known: dict) -> _Rolling:
        return _Rolling(self)


class _Rolling:
    def __init__(self, rule: Rolling):
        self.limit, self.span, self.live = rule.limit, rule.span * 1_000_000, deque(maxlen=rule.limit)

    def _full(self, at: int) -> int | None:
        """When a place is free again; None if one is."""
        if len(self.live) < self.limit or self.live[0] + self.span <= at:
            return None
        return self.live[0] + self.span

    def decide(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n, i = len(at), 0
        why, then = np.zeros(n, np.int8), np.zeros(n, np.int8)
        end, later = np.full(n, NEVER), np.full(n, NEVER)
        while i < n:
            now = int(at[i])
            until = self._full(now)
            if until is not None:
                j = i + int(np.searchsorted(at[i:], until))
                why[i:j] = then[i:j] = 6
                end[i:j] = later[i:j] = until
                i = j
                continue
            self.live.append(now)  # the oldest of a full line has run out and goes
            until = self._full(now)
            if until is not None:
                then[i], later[i] = 6, until
            i += 1
        return why, end, then, later


def _fold(rule: Budget | Rolling):
    names = pa.array(REASONS, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for b in batches:
            if not b.num_rows:
                continue
            # Runs of equal keys: a partition is sorted by key, and a run may go on in the next batch.
            key, at = b.column("__k"), b.column("__at").to_numpy()
            lone = key.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(lone)) + 1).tolist(), len(at)]
            parts = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                k = key[lo].as_py()
                if state is None or k != current:
                    current, state = k, rule.start({c: b.column(f"__{c}")[lo].as_py() for c in STATE})
                parts.append(state.decide(at[lo:hi]))
            why, end, then, later = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [key, b.column("__at"), b.column("__n"), names.take(pa.array(why)), pa.array(end, mask=end == NEVER), names.take(pa.array(then)), pa.array(later, mask=later == NEVER)],
                names=["__k2", "__at2", "__n2", "__why", "__end", "__then", "__later"],
            )

    return run


def admit(requests: DataFrame, key: str, at: str, order: list[str], rule: Budget | Rolling, state: DataFrame | None = None) -> DataFrame:
    """All requests with ``reason`` (null: granted) and ``until``, when the reason ends (null: never, or granted).

    Requests of a key are asked in the order of ``at`` and then ``order``, which should name them; equal rows are asked one
    by one. A null key is a key. A request without a time is refused as 'no_time' and takes nothing. ``state``: (key, and
    the columns of STATE that matter), one row a key; without one a key starts unused. A budget without any limit is refused.
    """
    k = rule.at_once()
    w = Window.partitionBy("__k", "__at").orderBy(*order)
    asked = requests.withColumn("__k", F.col(key)).withColumn("__at", F.unix_micros(F.col(at).cast("timestamp")))
    timed = asked.where(F.col("__at").isNotNull()).withColumn("__n", F.row_number().over(w))
    thin = timed.where(F.col("__n") <= k).select("__k", "__at", "__n")
    known = {c: F.lit(None).cast(t) for c, t in STATE.items()}
    if state is None:
        thin = thin.select("*", *[v.alias(f"__{c}") for c, v in known.items()])
    else:
        s = state.select(F.col(key).alias("__ks"), *[(F.col(c).cast(STATE[c]) if c in state.columns else v).alias(f"__{c}") for c, v in known.items()])
        thin = thin.join(s, F.col("__k").eqNullSafe(F.col("__ks")), "left").drop("__ks")
    kind = requests.schema[key].dataType.simpleString()
    folded = (
        thin.repartition("__k").sortWithinPartitions("__k", "__at", "__n")
        .mapInArrow(_fold(rule), f"__k2 {kind}, __at2 bigint, __n2 int, __why string, __end bigint, __then string, __later bigint")
    )
    beyond = F.col("__n") > k
    same = F.col("__k").eqNullSafe(F.col("__k2")) & (F.col("__at") == F.col("__at2")) & (F.least("__n", F.lit(k)) == F.col("__n2"))
    j = timed.join(folded, same).select(
        *[F.col(f"`{c}`") for c in requests.columns],
        F.when(beyond, F.col("__then")).otherwise(F.col("__why")).alias("reason"),
        F.timestamp_micros(F.when(beyond, F.col("__later")).otherwise(F.col("__end"))).alias("until"),
    )
    lost = asked.where(F.col("__at").isNull()).select(*[F.col(f"`{c}`") for c in requests.columns], F.lit("no_time").alias("reason"), F.lit(None).cast("timestamp").alias("until"))
    return j.unionByName(lost)


def used(decisions: DataFrame, key: str, at: str, interval: int, state: DataFrame | None = None) -> DataFrame:
    """The state of each key after its decisions, to begin the next run with: one grouping, no order needed."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    day, month = F.date_trunc("day", F.timestamp_micros(t)), F.date_trunc("month", F.timestamp_micros(t))
    granted = decisions.where(F.col("reason").isNull()).select(F.col(key), t.alias("__t"), day.alias("__d"), month.alias("__m"))
    # Days of a key first, so that a hot key is cut; then its latest day and month.
    d = granted.groupBy(key, "__m", "__d").agg(F.count("*").alias("n"), F.max("__t").alias("t"))
    m = d.groupBy(key, "__m").agg(F.sum("n").alias("n"), F.max("t").alias("t"), F.max_by("n", "__d").alias("last"))
    g = m.groupBy(key).agg(F.max("t").alias("used_at"), F.max_by("last", "__m").alias("in_day"), F.max_by("n", "__m").alias("in_month"), F.sum("n").alias("in_all"))
    g = g.withColumn("next_at", F.col("used_at") + interval * 1_000_000)
    if state is None:
        return g.select(key, F.lit(None).cast("bigint").alias("blocked_until"), "next_at", "used_at", "in_day", "in_month", "in_all")
    o = state.select(F.col(key).alias("__k"), *[(F.col(c) if c in state.columns else F.lit(None)).cast(t).alias(f"__{c}") for c, t in STATE.items()])
    j = g.join(o, F.col(key).eqNullSafe(F.col("__k")), "full")
    same = lambda unit: F.date_trunc(unit, F.timestamp_micros("used_at")) == F.date_trunc(unit, F.timestamp_micros("__used_at"))
    kept = lambda c, unit: F.when(F.col("used_at").isNull(), F.col(f"__{c}")).otherwise(F.col(c) + F.when(same(unit), F.coalesce(F.col(f"__{c}"), F.lit(0))).otherwise(0)).alias(c)
    return j.select(
        F.when(F.col("used_at").isNull(), F.col("__k")).otherwise(F.col(key)).alias(key),
        F.col("__blocked_until").alias("blocked_until"),
        F.coalesce("next_at", "__next_at").alias("next_at"),
        F.coalesce("used_at", "__used_at").alias("used_at"),
        kept("in_day", "day"),
        kept("in_month", "month"),
        (F.coalesce("in_all", F.lit(0)) + F.coalesce("__in_all", F.lit(0))).alias("in_all"),
    )


"""Small machines per key with timers: liveness, retries and a breaker that closes again, without a new event.

A machine is a rule for one event and a rule for its timer; ``run`` keeps its state and timer across micro-batches in the
state store. A timer is due when the key's next event lies behind it, or when the watermark has passed it, so what comes
out does not hang on how events fall into batches, as long as none is later than the watermark allows.

Ties in time go by the ``order`` column. Rows behind the key's newest event are too late and dropped. A machine whose
state is None is forgotten. Null keys are a key; null times never come up.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Out = list[tuple[int, str, int]]  # time in milliseconds, what, a number


class Liveness:
    """LIVE at the first beat and at any after silence, STALLED and LOST after pauses of their lengths (seconds)."""

    def __init__(self, stalled: int, lost: int) -> None:
        self.stalled, self.lost = stalled * 1000, lost * 1000

    def event(self, state: dict | None, at: int, what: str) -> tuple[dict | None, int | None, Out]:
        out = [] if state and state["s"] == "LIVE" else [(at, "LIVE", 0)]
        return {"s": "LIVE", "t": at}, at + self.stalled, out

    def timer(self, state: dict, at: int) -> tuple[dict | None, int | None, Out]:
        if state["s"] == "LIVE":
            return {**state, "s": "STALLED"}, state["t"] + self.lost, [(at, "STALLED", 0)]
        return None, None, [(at, "LOST", 0)]


class Retry:
    """After a failure a RETRY is due in 15 seconds, doubled with each failure in a row up to an hour; another event before
    it takes its place."""

    def __init__(self, failure: str = "error") -> None:
        self.failure = failure

    def event(self, state: dict | None, at: int, what: str) -> tuple[dict | None, int | None, Out]:
        if what != self.failure:
            return None, None, []
        n = (state["n"] if state else 0) + 1
        return {"n": n}, at + 1000 * min(3600, 15 * 2 ** (min(n, 20) - 1)), []

    def timer(self, state: dict, at: int) -> tuple[dict | None, int | None, Out]:
        return state, None, [(at, "RETRY", state["n"])]


class Breaker:
    """OPEN after so many failures in a row, HALF_OPEN when its time is over; meanwhile events don't count. The next
    failure opens it again, the next success closes it."""

    def __init__(self, threshold: int, seconds: int, failure: str = "error") -> None:
        self.threshold, self.rest, self.failure = threshold, seconds * 1000, failure

    def event(self, state: dict | None, at: int, what: str) -> tuple[dict | None, int | None, Out]:
        state = state or {"s": "CLOSED", "n": 0, "until": 0}
        if state["s"] == "OPEN":
            return state, state["until"], []
        if what != self.failure:
            return None, None, [(at, "CLOSED", 0)] if state["s"] == "HALF_OPEN" else []
        n = state["n"] + 1
        if state["s"] == "HALF_OPEN" or n >= self.threshold:
            return {"s": "OPEN", "n": n, "until": at + self.rest}, at + self.rest, [(at, "OPEN", n)]
        return {"s": "CLOSED", "n": n, "until": 0}, None, []

    def timer(self, state: dict, at: int) -> tuple[dict | None, int | None, Out]:
        return {**state, "s": "HALF_OPEN"}, None, [(at, "HALF_OPEN", state["n"])]


class _Processor(StatefulProcessor):
    def __init__(self, machine: Any, key: str) -> None:
        self.machine, self.key = machine, key

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "state string, due long, newest long")

    def _load(self) -> tuple[dict | None, int | None, int]:
        import json

        if not self.kept.exists():
            return None, None, -(1 << 62)
        state, due, newest = self.kept.get()
        return (json.loads(state) if state is not None else None), due, newest

    def _save(self, state: dict | None, due: int | None, newest: int, was: int | None) -> None:
        import json

        if was is not None and was != due:
            self.handle.deleteTimer(was)
        if due is not None and was != due:
            self.handle.registerTimer(due)
        self.kept.update((json.dumps(state) if state is not None else None, due, newest))

    def _frame(self, key: tuple, out: Out) -> Iterator[pd.DataFrame]:
        if out:
            at, what, n = zip(*out)
            yield pd.DataFrame({self.key: [key[0]] * len(out), "at": pd.to_datetime(pd.Series(at), unit="ms"), "what": what, "n": n})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state, due, newest = self._load()
        was, out = due, []
        whole = pd.concat(list(rows)).sort_values(["event_ms", "event_order"], kind="stable")  # Arrow batches cut a key anywhere
        for at, what in zip(whole["event_ms"].tolist(), whole["event_what"].tolist()):
            if at < newest:
                continue
            while due is not None and due < at:
                state, due, more = self.machine.timer(state, due)
                out += more
            state, due, more = self.machine.event(state, at, what)
            out += more
            newest = at
        mark = timerValues.getCurrentWatermarkInMs()
        while due is not None and due < mark:
            state, due, more = self.machine.timer(state, due)
            out += more
        self._save(state, due, newest, was)
        yield from self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state, due, newest = self._load()
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        if due != at:
            return
        was, mark = None, timerValues.getCurrentWatermarkInMs()
        while due is not None and due <= max(mark, at):
            state, due, more = self.machine.timer(state, due)
            out += more
        self._save(state, due, newest, was)
        yield from self._frame(key, out)

    def close(self) -> None:
        pass


def run(events: DataFrame, machine: Any, key: str, what: str, order: str, late: str = "10 minutes") -> DataFrame:
    """(key, at, what, n): what the machine says of each key of a stream with event times in ``ts``."""
    _rocks(events.sparkSession)
    rows = events.where(F.col("ts").isNotNull()).withWatermark("ts", late).select(key, "ts", F.unix_millis("ts").alias("event_ms"), F.col(what).cast("string").alias("event_what"), F.col(order).alias("event_order"))
    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).transformWithStateInPandas(_Processor(machine, key), f"{key} {kind}, at timestamp, what string, n int", "append", "EventTime")


def _rocks(spark: SparkSession) -> None:
    """Timers live in RocksDB; a session that names no provider of its own gets it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name):
        spark.conf.set(name, ROCKS)


def fold(machine: Any, events: list[tuple[int, Any, str]], mark: int) -> Out:
    """What the machine says of one key's events (time, order, what) in one go, with the watermark at ``mark`` after them."""
    state, due, out = None, None, []
    for at, _, what in sorted(events, key=lambda e: e[:2]):
        while due is not None and due < at:
            state, due, more = machine.timer(state, due)
            out += more
        state, due, more = machine.event(state, at, what)
        out += more
    while due is not None and due <= mark:
        state, due, more = machine.timer(state, due)
        out += more
    return out

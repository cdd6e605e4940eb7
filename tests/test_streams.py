"""Machines with timers and the incremental read model, over several micro-batches, against one fold in plain Python."""

import random
import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import machines, read_model
from tidemark.streaming import windows as T

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def events(n=400):
    """Key 0 has half of all events; two of a key may share a time."""
    rng = random.Random(3)
    at, out = 0, []
    for i in range(n):
        at += rng.choice([0, 1, 5, 20, 60, 200])
        out.append((i, START + timedelta(seconds=at), 0 if rng.random() < 0.5 else rng.randint(1, 6), rng.choice(["error", "error", "ok"])))
    return out


def batches(spark, tmp_path, rows, parts):
    """The rows as a stream of one file after the other."""
    folder = f"{tmp_path}/in-{uuid.uuid4().hex}"
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("machine", [machines.Liveness(30, 90), machines.Retry("error"), machines.Breaker(3, 45)], ids=lambda m: type(m).__name__)
def test_machines(spark, tmp_path, machine, parts):
    rows = events()
    out = T.run_to_table(machines.run(batches(spark, tmp_path, rows, parts), machine, "user_id", "event_type", "event_id", late="30 seconds"), "append", folder=f"file://{tmp_path}").collect()
    got = sorted((r["user_id"], int(r["at"].replace(tzinfo=timezone.utc).timestamp() * 1000) if r["at"].tzinfo else round(r["at"].timestamp() * 1000), r["what"], r["n"]) for r in out)
    ms = lambda t: round(t.timestamp() * 1000)
    mark = max(ms(t) for _, t, *_ in rows) - 30_000
    want = []
    for key in {r[2] for r in rows}:
        for at, what, n in machines.fold(machine, [(ms(t), i, w) for i, t, k, w in rows if k == key], mark):
            want.append((key, at, what, n))
    assert {g for g in got if g[1] < mark} == {w for w in want if w[1] < mark} and set(got) <= set(want)
    assert len(got) == len(set(got))


def test_breaker_rests():
    out = machines.fold(machines.Breaker(2, 10), [(0, 0, "error"), (1, 1, "error"), (5000, 2, "error"), (12000, 3, "error"), (30000, 4, "ok")], 40000)
    assert out == [(1, "OPEN", 2), (10001, "HALF_OPEN", 2), (12000, "OPEN", 3), (22000, "HALF_OPEN", 3), (30000, "CLOSED", 0)]


def test_model_equals_recomputation(spark, tmp_path):
    rows = events(120)
    model = read_model.ReadModel(spark, f"file://{tmp_path}/model", ["user_id"], {"n": read_model.add, "kind": read_model.newest("version"), "version": read_model.most}, buckets=8)
    delta = lambda part: spark.createDataFrame([(k, 1, w, i) for i, _, k, w in part], "user_id long, n long, kind string, version long")
    seen = []
    for b in range(4):
        part = rows[b * 30 : (b + 1) * 30]
        seen += part
        model.merge(delta(part), b)
        model.merge(delta(part), b)  # run twice, counted once
        want = {}
        for i, _, k, w in seen:
            want[k] = (want.get(k, (0,))[0] + 1, w)
        assert {r["user_id"]: (r["n"], r["kind"]) for r in model.rows().collect()} == want


def test_untouched_buckets_stay_and_late_versions_lose(spark, tmp_path):
    path = f"{tmp_path}/model"
    model = read_model.ReadModel(spark, f"file://{path}", ["k"], {"v": read_model.newest("version"), "version": read_model.most}, buckets=16)
    frame = lambda *rows: spark.createDataFrame(rows, "k long, v string, version long")
    model.merge(frame(*[(k, "old", 5) for k in range(40)]), 0)
    files = lambda: {str(p) for p in (tmp_path / "model").rglob("*.parquet")}
    before = files()
    model.merge(frame((3, "late", 4), (7, "new", 6), (7, "newer", 7), (3, "same", 5)), 1)
    got = {r["k"]: r["v"] for r in model.rows().collect()}
    assert got[7] == "newer" and got[3] == "old" and sum(v == "old" for v in got.values()) == 39
    gone = {f.rpartition("/")[0] for f in before - files()}
    assert 1 <= len(gone) <= 2
    model.merge(frame((3, "x", 9)).where(F.lit(False)), 2)
    assert files() - before and {r["k"] for r in model.rows().collect()} == set(range(40))

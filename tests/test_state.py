"""Stateful runs over parts equal one run over all."""

import datetime as dt
import random

import pytest

from tarnweave.operators import rules
from tarnweave.streaming import state

EVENT = "event_id long, user_id long, ts timestamp"
START = dt.datetime(2024, 1, 1)


def events(n, seed=1):
    r = random.Random(seed)
    return [(i, r.choice([None, 1, 2, 3, 4, 4, 4, 4]), None if i % 50 == 7 else START + dt.timedelta(minutes=r.randrange(4000))) for i in range(n)]


def walk(rows, gap=30):
    out = []
    for user in {u for _, u, t in rows if t}:
        run = []
        for t in sorted(t for _, u, t in rows if u == user and t):
            if run and t - run[-1] < dt.timedelta(minutes=gap):
                run.append(t)
            else:
                out += [(user, run[0], run[-1], len(run))] if run else []
                run = [t]
        out.append((user, run[0], run[-1], len(run)))
    return sorted(out, key=repr)


def parts(rows, n=3, seed=2):
    r = random.Random(seed)
    dealt = [[] for _ in range(n)]
    for x in rows:
        dealt[r.randrange(n)].append(x)
    return dealt


def test_sessions_over_parts_with_late_rows(spark, tmp_path):
    rows = events(400)
    src, sink, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for k, part in enumerate(parts(rows)):
        spark.createDataFrame(part, EVENT).write.parquet(f"{src}/{k}")
        state.run_sessions(spark, src, EVENT, sink, ckpt, "user_id", "ts", 30 * 60 * 1_000_000)
    got = state.current(spark, sink, f"user_id long, {state.SESSIONS}", ["user_id", "first"], "gone").select("user_id", "first", "last", "n")
    assert sorted(map(tuple, got.collect()), key=repr) == walk(rows)


def test_sessions_that_no_row_can_reach_leave_the_state(spark, tmp_path):
    """Rows behind the watermark are dropped; what is in order gives the same sessions as without a watermark."""
    rows = sorted(((i, 1, START + dt.timedelta(hours=i)) for i in range(60)), key=lambda x: x[2])
    src, sink, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for k in range(3):
        extra = [(999, 1, START)] if k == 2 else []
        spark.createDataFrame(rows[20 * k : 20 * k + 20] + extra, EVENT).coalesce(1).write.parquet(f"{src}/{k}")
        state.run_sessions(spark, src, EVENT, sink, ckpt, "user_id", "ts", 30 * 60 * 1_000_000, late="2 hours")
    got = state.current(spark, sink, f"user_id long, {state.SESSIONS}", ["user_id", "first"], "gone").select("user_id", "first", "last", "n")
    assert sorted(map(tuple, got.collect()), key=repr) == walk(rows)


def test_ids_go_on_over_runs(spark, tmp_path):
    rows = events(300, 3)
    src, sink, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    want = {}
    for k, part in enumerate(parts(rows)):
        spark.createDataFrame(part, EVENT).write.parquet(f"{src}/{k}")
        state.run_ids(spark, src, EVENT, sink, ckpt, "user_id", "event_id")
        for _, u, _ in sorted(part):
            if u is not None:
                want.setdefault(u, len(want))
    state.run_ids(spark, src, EVENT, sink, ckpt, "user_id", "event_id")  # nothing new
    got = state.current(spark, sink, "user_id long, first long, id long", ["user_id"])
    assert {r["user_id"]: r["id"] for r in got.collect()} == want


FOUND = "domain string, rule_group int, route_id long, label string, trigger_context string, source string, sink string, destination string, observed_trackers string, party string"


@pytest.mark.parametrize("seed", [1, 2])
def test_threats_over_parts_equal_one_merge(spark, tmp_path, seed):
    from tarnweave import registries as R
    from pyspark.sql import functions as F

    r = random.Random(seed)
    labels = [label for label, _, _ in R.LABELS]
    rows = [(r.choice(["a.com", "b.com"]), r.randrange(1, 6), i, r.choice(labels), r.choice(["AUTONOMOUS", "EVENT_DRIVEN"]), r.choice("st"), r.choice(["k", "document.cookie"]), r.choice([R.DYNAMIC, "https://x.com/a", "https://a.com/p?q=1"]), "None", r.choice(["Unknown", "1st-Party", None])) for i in range(120)]
    src, sink, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for k, part in enumerate(parts(rows, seed=seed)):
        spark.createDataFrame(part, FOUND).write.parquet(f"{src}/{k}")
        state.run_threats(spark, src, sink, ckpt)
    whole = rules.merge_threats(spark.createDataFrame(rows, FOUND).withColumn("seq", F.struct("rule_group", "route_id")))
    got = state.current_threats(spark, sink).select(*whole.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_nothing_has_come_yet(spark, tmp_path):
    assert state.current(spark, str(tmp_path / "none"), state.MERGED, ["domain"]).count() == 0

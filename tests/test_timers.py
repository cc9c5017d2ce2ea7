"""Stateful jobs: resumed from their checkpoints, with deadlines that fire once, items that are forgotten, and the functions of SQL's surface."""

import datetime as dt
import random
import time
from collections import defaultdict

import pytest

from scrivane.sources.readers import register_functions
from scrivane.streaming import timers
from scrivane.streaming.jobs import source

START = dt.datetime(2024, 3, 1)


def brute(events, gap, upto):
    by = defaultdict(list)
    for k, at, v in events:
        by[k].append((at, v))
    out = set()
    for k, rows in by.items():
        rows.sort()
        sessions, n = [[rows[0]]], 0
        for r in rows[1:]:
            if (r[0] - sessions[-1][-1][0]).total_seconds() <= gap:
                sessions[-1].append(r)
            else:
                sessions.append([r])
        for s in sessions:
            if s[-1][0] + dt.timedelta(seconds=gap, milliseconds=1) < upto:
                n += 1
                out.add((k, n, int((s[0][0] - dt.datetime(1970, 1, 1)).total_seconds() * 1e6 + 0.5), int((s[-1][0] - dt.datetime(1970, 1, 1)).total_seconds() * 1e6 + 0.5), len(s), round(sum(v for _, v in s), 6)))
    return out


def write(spark, rows, path):
    spark.createDataFrame(rows, "user_id bigint, ts timestamp, value double").coalesce(1).write.mode("append").parquet(path)


def test_sessions_of_a_job_that_is_resumed(spark, tmp_path):
    rng = random.Random(2)
    at = START
    events = []
    for _ in range(400):
        at += dt.timedelta(seconds=rng.choice([1, 5, 40, 200]), microseconds=rng.randrange(10**6))
        events.append((rng.randrange(6), at, float(rng.randrange(9))))
    path, out, check = (str(tmp_path / n) for n in ("events", "out", "check"))
    seen = []
    for lo in range(0, 400, 100):
        part = events[lo : lo + 100]
        write(spark, random.Random(lo).sample(part, 100) + [(None, part[0][1], 1.0)], path)
        got = [tuple(r) for r in timers.timed_sessions(spark, path, 60, out=out, checkpoint=check).collect()]
        assert len(got) == len(set(got)) and set(seen) <= set(got)  # what was written stays, and once
        seen = got
        rounded = {(*r[:5], round(r[5], 6)) for r in got}
        assert rounded == brute(events[: lo + 100], 60, events[lo + 99][1])
    assert len(seen) > 40
    assert sorted(tuple(r) for r in timers.timed_sessions(spark, path, 60, out=out, checkpoint=check).collect()) == sorted(seen)  # nothing new, nothing twice
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != "x"


def test_items_are_forgotten_after_a_while(spark, tmp_path):
    path = str(tmp_path / "items")

    def run(name, ttl, rows):
        spark.createDataFrame(rows, "k string, item string").coalesce(1).write.mode("append").parquet(path)
        df = timers.first_of_each(source(spark, path), "k", "item", ttl, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-check"))
        return sorted(tuple(r) for r in df.collect())

    rows = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")]
    assert run("long", 3_600_000, rows) == [("a", "x"), ("a", "y"), ("b", "x")]
    assert run("long", 3_600_000, [("a", "x"), ("b", "z")]) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "z")]
    path = str(tmp_path / "short")
    assert run("brief", 1, rows) == [("a", "x"), ("a", "y"), ("b", "x")]
    time.sleep(0.1)
    assert run("brief", 1, [("a", "x")]) == [("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")]


def test_functions_of_sql(spark):
    register_functions(spark)
    got = spark.sql("SELECT * FROM with_gaps(TABLE(SELECT k, v, 'z' AS more FROM VALUES (1, 5), (1, 2), (2, 7), (1, CAST(NULL AS INT)) AS t(k, v)) PARTITION BY (k) ORDER BY (v), 'v')").collect()
    assert sorted(tuple(r) for r in got if r["k"] == 2) == [(2, 7, "z", 1, None)]
    assert [tuple(r) for r in sorted((r for r in got if r["k"] == 1), key=lambda r: r["n"])] == [(1, None, "z", 1, None), (1, 2, "z", 2, None), (1, 5, "z", 3, 3.0)]
    with pytest.raises(Exception, match="column of the table"):
        spark.sql("SELECT * FROM with_gaps(TABLE(SELECT 1 AS k), 'nothing')").collect()
    e = spark.sql("SELECT g, count_entropy(n, m) AS e FROM VALUES ('a', 2, 4), ('b', 5, 1), ('c', CAST(NULL AS INT), 1) AS t(g, n, m) GROUP BY g").collect()
    assert {r["g"]: round(r["e"], 9) for r in e} == {"a": 2.0, "b": 0.0, "c": 0.0}


def test_progress_of_a_stream(spark, tmp_path):
    path = str(tmp_path / "events")
    write(spark, [(i % 3, START, 1.0) for i in range(30)], path)
    from scrivane.streaming import jobs

    result, seen = timers.with_progress(spark, lambda: jobs.budgets(spark, path))
    assert result.count() == 3 and seen.agg({"rows": "sum"}).first()[0] == 30


def test_state_is_touched_few_times_for_a_key():
    """A key's rows cost one read, one write and at most two timer calls, each a message to the JVM, however many sessions are open."""
    calls = []

    class Handle:
        def getValueState(self, name, schema):
            return self

        def get(self):
            calls.append("get")
            return getattr(self, "held", None)

        def update(self, value):
            calls.append("update")
            self.held = value

        def registerTimer(self, at):
            calls.append(("register", at))

        def deleteTimer(self, at):
            calls.append(("delete", at))

    class Now:
        def getCurrentWatermarkInMs(self):
            return 7_500

    p = timers.Sessions(1_000_000)
    p.init(Handle())
    rows = [{"us": us, "value": v} for us, v in [(9_000_000, 1.0), (1_000_000, None), (2_000_000, None), (5_000_000, 3.0), (5_500_000, None)]]
    assert list(p.handleInputRows((1,), iter(rows), None)) == []
    assert calls == ["get", ("register", 3001), "update"]
    calls.clear()
    assert list(p.handleInputRows((1,), iter([{"us": 0, "value": None}]), None)) == []
    assert calls == ["get", "update"]
    calls.clear()
    assert [tuple(r) for r in p.handleExpiredTimer((1,), Now(), None)] == [(1, 1, 0, 2_000_000, 3, None), (1, 2, 5_000_000, 5_500_000, 2, 3.0)]
    assert calls == ["get", ("register", 10_001), "update"]

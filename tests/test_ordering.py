"""Reorder and window rules against golden cases and a plain loop."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tapline.operators import ordering as O
from tapline.operators import windows as W

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def events(spark, data):
    """(key, seq, seconds) rows."""
    at = [(k, s, T0 + timedelta(seconds=t)) for k, s, t in data]
    return spark.createDataFrame(at, "key string, seq long, ts timestamp").repartition(3)


def loop(times, lateness, late):
    """Release trigger per arrival, by the definition."""
    seen, held, out = None, [], {}
    for i, t in enumerate(times):
        is_late = seen is not None and t < seen
        seen = t if seen is None else max(seen, t)
        if t < seen - lateness:
            out[i] = (is_late, True, i if late == "release" else None)
            continue
        held.append((t, i, is_late))
        for h in sorted(held):
            if h[0] <= seen - lateness:
                out[h[1]] = (h[2], False, i)
                held.remove(h)
    for h in held:
        out[h[1]] = (h[2], False, None)
    return out


@pytest.mark.parametrize("late", ["release", "quarantine"])
@pytest.mark.parametrize("size", [6, 10_000])
def test_reorder_matches_loop(spark, late, size):
    rng = random.Random(11)
    series = {"hot": [i + rng.randint(-9, 9) for i in range(150)], "b": [rng.randint(0, 30) for _ in range(25)], "c": [5]}
    data = [(k, i, t) for k, ts in series.items() for i, t in enumerate(ts)]
    got = O.reorder(events(spark, data), ["key"], "ts", "seq", 6.0, late, number=True, rows=size).collect()
    for key, times in series.items():
        want = loop(times, 6, late)
        mine = {r.seq: r for r in got if r.key == key}
        assert {i: (r.late, r.too_late, r.release_arrival) for i, r in mine.items()} == want
        order = sorted((r.release_seq, r.seq) for r in mine.values() if not r.quarantined)
        end = 10**9
        right = sorted((want[i][2] if want[i][2] is not None else end, times[i], i) for i in want if not (late == "quarantine" and want[i][1]))
        assert [s for _, s in order] == [x[2] for x in right] and [n for n, _ in order] == list(range(1, len(order) + 1))


def test_golden_reorder(spark):
    got = rows(O.reorder(events(spark, [("k", 0, 0), ("k", 1, 3), ("k", 2, 1)]), ["key"], "ts", "seq", 3.0), "seq")
    assert [r["late"] for r in got] == [False, False, True] and got[0]["release_arrival"] == 1
    got = rows(O.reorder(events(spark, [("k", 0, 10), ("k", 1, 1)]), ["key"], "ts", "seq", 5.0), "seq")
    assert [r["quarantined"] for r in got] == [False, True]
    stats = O.reorder_stats(O.reorder(events(spark, [("k", 0, 0), ("k", 1, 2)]), ["key"], "ts", "seq", 2.0), ["key"], "seq").first()
    assert (stats.events, stats.peak_buffer_depth, stats.late_events) == (2, 2, 0)


def window_loop(times, context, interval):
    out, due, kept = [], None, []
    for i, t in enumerate(times):
        kept = [x for x in [*kept, t] if x >= t - context]
        due = t + interval if due is None else due
        while t >= due:
            out.append((due - interval, due, i, len(kept)))
            due += interval
    return out


@pytest.mark.parametrize("size", [5, 10_000])
@pytest.mark.parametrize("context, interval", [(10, 5), (20, 5), (7, 3)])
def test_context_windows_match_loop(spark, size, context, interval):
    rng = random.Random(context)
    series = {}
    for k, n in (("hot", 120), ("b", 15), ("c", 1)):
        series[k] = sorted(rng.randint(0, n) for _ in range(n))
    data = [(k, i, t) for k, ts in series.items() for i, t in enumerate(ts)]
    df = events(spark, data).withColumn("v", F.col("seq") + 1)
    got = W.context_windows(df, ["key"], "ts", "seq", context, interval, ["v"], size).collect()
    seconds = lambda t: int((t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t).timestamp() - T0.timestamp())
    for key, times in series.items():
        mine = sorted((seconds(r.scoring_start), seconds(r.scoring_end), r.trigger_seq, r.context_count) for r in got if r.key == key)
        assert mine == sorted(window_loop(times, context, interval))
    members = W.context_members(df, ["key"], "ts", "seq", context, interval, size)
    sums = {(r.key, r.trigger_seq): (r.n, r.s) for r in members.groupBy("key", "trigger_seq").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}
    assert all(sums[(r.key, r.trigger_seq)] == (r.context_count, r.context_v) for r in got)


def test_flush_expiry_and_order(spark):
    df = events(spark, [("a", 0, 0), ("a", 1, 5), ("a", 2, 20), ("b", 0, 1)])
    flushed = rows(W.window_flush(df, ["key"], "ts", "seq", 15.0), "key")
    assert [(r["context_count"], r["last_seq"]) for r in flushed] == [(2, 2), (1, 0)]
    expired = rows(W.expire_keys(df, ["key"], "ts", F.lit(T0 + timedelta(seconds=20)), 10.0))
    assert [r["key"] for r in expired] == ["b"]
    broken = rows(W.order_violations(events(spark, [("a", 0, 5), ("a", 1, 3), ("a", 2, 4), ("a", 3, 6)]), ["key"], "ts", "seq", 2), "seq")
    assert [r["reject_reason"] is not None for r in broken] == [False, True, True, False]


def test_context_sums_of_doubles_do_not_cancel(spark):
    start = datetime(2024, 1, 1)
    values = [1e17, 0.1, 0.2, float("nan"), 0.5, 0.25]
    data = [("k", i, start + timedelta(seconds=10 * i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "key string, seq long, ts timestamp, v double")
    got = {r.trigger_seq: r.context_v for r in W.context_windows(df, ["key"], "ts", "seq", 12, 10, ["v"]).collect()}
    assert got[2] == 0.1 + 0.2 and got[5] == 0.75 and got[1] == 1e17 + 0.1

"""Sketched profiles, components of links, incidents over assets, rolling sketches."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tapline.operators import alerts as A
from tapline.operators import drift as K
from tapline.operators import metrics as M
from tapline.operators import threats as T
from tapline.operators.graph import connected_components

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(50)] + [(7, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_incidents_over_assets(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    data = [
        ("a1", at(0), "h1", "h2", None, "Scan"), ("a2", at(50), "h3", "h2", None, "Flood"), ("a3", at(90), "h3", "h9", "f1", "Exfil"),
        ("a4", at(500), "h1", "h7", None, "Scan"),  # h1 again, but after the gap
        ("a5", at(95), "h2", "h8", None, "Scan"),  # the attacked host attacks
        ("a6", at(3), None, None, None, "Lone"), ("a7", None, "h1", None, None, "Timeless"),
        ("a8", at(560), "h5", "h6", "f9", "Scan"), ("a9", at(570), "h7", "h4", "f9", "Scan"),
    ]
    frame = spark.createDataFrame(data, "alert_id string, ts timestamp, source_ip string, destination_ip string, flow_id string, threat_class string")
    for rows in (1_000_000, 2):
        got = A.asset_incidents(frame, gap_seconds=100, rows=rows)
        assert {r.alert_id: r.incident_id for r in got.collect()} == {
            "a1": "a1", "a2": "a1", "a3": "a1", "a5": "a1", "a4": "a4", "a8": "a4", "a9": "a4", "a6": "a6", "a7": "a7",
        }
    summary = {r.incident_id: r for r in A.incident_summary(got).collect()}
    assert (summary["a1"].alert_count, summary["a1"].asset_count, summary["a1"].threat_chain) == (4, 5, "Scan > Flood > Exfil")
    assert summary["a6"].asset_count is None and summary["a7"].first_seen is None
    assert A.asset_incidents(frame.limit(0)).collect() == []


def test_profiles_merge_and_drift(spark):
    base = spark.range(40_000).select((F.rand(3) * 10).alias("x"), F.randn(4).alias("y"), F.lit(2.0).alias("same"), F.lit(None).cast("double").alias("none"))
    live = spark.range(20_000).select((F.rand(5) * 10).alias("x"), (F.randn(6) * 1.5 + 0.5).alias("y"), F.lit(2.0).alias("same"), F.lit(1.0).alias("none"))
    columns = ["x", "y", "same", "none"]
    parts = [K.profile_features(base.filter(f"pmod(hash(x), 5) = {i}"), columns) for i in range(5)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    stored = K.merge_profiles(merged)
    assert {r.feature: r.n for r in stored.collect()} == {"x": 40_000, "y": 40_000, "same": 40_000}
    got = {r.feature: r for r in K.drift_from_profiles(stored, K.profile_features(live, columns)).collect()}
    exact = {r.feature: r for r in M.drift_score(base.drop("none"), live.drop("none"), ["x", "y", "same"]).collect()}
    assert set(got) == set(exact)
    for name, row in exact.items():
        assert got[name].psi == pytest.approx(row.psi, abs=0.03) and got[name].ks == pytest.approx(row.ks, abs=0.015)
    assert exact["y"].psi > 0.3


def test_rolling_windows(spark):
    rng = random.Random(4)
    rows = [(T0 + timedelta(seconds=rng.random() * 180), f"s{rng.randrange(400)}", "d", "tcp", 2, 100, 2, 0) for _ in range(3_000)] + [(T0 + timedelta(seconds=5), "s", "e", "tcp", 0, 0, 0, 0)]
    frame = spark.createDataFrame(rows, "ts timestamp, src string, dst string, protocol string, pkts long, bytes long, syn long, ack long")
    flags = {"syn": "syn", "ack": "ack"}
    exact = {(r.dst, r.window_start): r for r in T.rolling_ddos(frame, flags=flags, exact=True).collect()}
    second = lambda t: int(t.timestamp())
    start = second(T0)
    for shift in (-55, 0, 60, 175):
        inside = [r for r in rows if r[2] == "d" and start + shift <= r[0].timestamp() < start + shift + 60]
        row = exact["d", start + shift]
        assert (row.flows_per_destination, row.unique_source_ips) == (len(inside), len({r[1] for r in inside}))
        assert row.subtype == "SYN_FLOOD" and row.syn_ratio == 1.0
    assert exact["e", start].subtype == "MIXED"
    sketched = {(r.dst, r.window_start): r for r in T.rolling_ddos(frame, flags=flags).collect()}
    assert set(sketched) == set(exact)
    assert all(abs(sketched[k].unique_source_ips - r.unique_source_ips) <= 1 + 0.05 * r.unique_source_ips for k, r in exact.items())
    with pytest.raises(ValueError):
        T.rolling_ddos(frame, seconds=60, step=7)

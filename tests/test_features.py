import math
import random

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tapline.functions import scoring as S
from tapline.functions.text import entropy
from tapline.operators import beacon as B
from tapline.operators import features as X
from tapline.operators import rolling as R
from tapline.operators import stability as Y
from tapline.operators import threats as T

FLOW = "src string, dst string, timestamp_unix double, bytes double, pkts double, protocol string, flow_dir_reverse boolean, target int"


def test_beacon_golden(spark):
    start = 1312969613.0
    gap = 0.002248029923066497
    data = [
        ("a", "b", 0.0, 5_700_818.0, 6137.0, "tcp", False, 0), ("a", "b", 5.720648914575577e-07, 3_858_512.0, 4153.0, "tcp", False, 0),
        ("c", "d", 0.0, 203.0, 2.0, "UDP", False, 1), ("c", "d", gap, 590.0, 2.0, "udp", True, 0), ("e", "f", start, 1.0, 1.0, "tcp", False, 0),
    ]
    got = rows(B.beacon_features(spark.createDataFrame(data, FLOW)), "src")
    assert len(got) == 2
    benign, bad = got
    assert benign["Dur"] == benign["IAT"] == 5.720648914575577e-07 and benign["Pkts"] == 10290 and benign["Bytes"] == 9559330
    assert benign["Bytes_Variance"] == 848522849409.0 and math.isclose(benign["Bytes_Per_Packet"], 928.9922254616132)
    assert math.isclose(bad["IAT"], gap) and bad["Bytes_Variance"] == 37442.25 and bad["Bytes_Per_Packet"] == 198.25
    assert bad["Proto_udp"] == 1.0 and bad["Proto_tcp"] == 0.0 and bad["FlowDir_Reverse"] == 1.0 and bad["label"] == 1


def beacon_loop(frame, width, step):
    out = []
    for key, group in frame.groupby(["src", "dst"]):
        t0, t1, k = group["timestamp_unix"].min(), group["timestamp_unix"].max(), 0
        while t0 + k * step < t1:
            start = t0 + k * step
            part = group[(group["timestamp_unix"] >= start) & (group["timestamp_unix"] < start + width)].sort_values("timestamp_unix")
            if len(part) >= 2:
                gaps = np.diff(part["timestamp_unix"].to_numpy())
                out.append((*key, k, len(part), gaps.mean(), gaps.var(), part["bytes"].var(ddof=0), part["target"].max()))
            k += 1
    return sorted(out)


@pytest.mark.parametrize("size", [7, 100_000])
def test_beacon_windows_match_loop(spark, size):
    rng = random.Random(2)
    data = [
        ("hot" if i % 3 else f"s{i % 5}", "d", round(rng.choice([rng.uniform(0, 4000), 100.0, 250.5]), 3), float(rng.randint(0, 900)), 3.0, "tcp", False, rng.randint(0, 1))
        for i in range(400)
    ]
    df = spark.createDataFrame(data, FLOW).repartition(5)
    got = sorted(
        (r.src, r.dst, r.window_index, r.flows, r.IAT, r.IAT_Variance, r.Bytes_Variance, r.label) for r in B.beacon_features(df, rows=size).collect()
    )
    want = beacon_loop(df.toPandas(), 300.0, 150.0)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want])


def dns_frame(n=120):
    rng = random.Random(5)
    return pd.DataFrame(
        {
            "source": ["big" if i % 4 else f"s{i % 3}" for i in range(n)], "seq": range(n),
            "rr_count": [float(rng.randint(0, 9)) for _ in range(n)], "ttl_mean": [rng.random() * 100 for _ in range(n)],
            "ttl_variance": [rng.random() * 10 for _ in range(n)], "rr_name_entropy": [rng.random() * 4 for _ in range(n)],
            "rr_name_length": [float(rng.randint(0, 30)) for _ in range(n)], "PTR_frequency": [float(rng.randint(0, 3)) for _ in range(n)],
            "rr_type": [rng.choice(["{'A'}", "{'PTR', 'A'}", "set()"]) for _ in range(n)],
            "reverse_dns": [rng.choice(["Unknown", "host"]) for _ in range(n)], "unique_ttl": [rng.choice(["[60, 300]", "[]", "[5]"]) for _ in range(n)],
        }
    )


@pytest.mark.parametrize("size", [9, 100_000])
def test_exfil_context(spark, size):
    frame = dns_frame()
    got = R.exfil_context(spark.createDataFrame(frame).repartition(4), ["source"], "seq", size).toPandas().sort_values("seq")
    base = frame.sort_values("seq")
    known = (base["reverse_dns"].str.lower() != "unknown").astype(float)
    per = base.assign(known=known).groupby("source")
    before = lambda c: per[c].transform(lambda s: s.shift(1).rolling(20, min_periods=1).mean()).fillna(0)
    assert np.allclose(got["rr_count_prev20_mean"], before("rr_count")) and np.allclose(got["reverse_dns_known_prev20_mean"], before("known"))
    std = per["ttl_variance"].transform(lambda s: s.shift(1).rolling(20, min_periods=2).std()).fillna(0)
    assert np.allclose(got["ttl_variance_prev20_std"], std)
    assert (got["history_records_used"].to_numpy() == per.cumcount().clip(upper=20).to_numpy()).all()
    first = got.groupby("source").head(1)
    assert (first[list(R.EXFIL_FEATURES)].to_numpy() == 0).all()


def test_alert_id_and_severity(spark):
    one = spark.range(1).select(
        S.alert_id(F.lit("ddos"), F.lit("1.0"), F.lit("packet.log:1")).alias("i"),
        *[S.severity_from_score(F.lit(x)).alias(f"s{i}") for i, x in enumerate((0.95, 0.85, 0.7, 0.69))],
        S.threat_family(F.lit("Malware in Encrypted Sessions")).alias("f"), S.is_non_routable(F.lit("10.0.0.255")).alias("n"),
        entropy(F.lit("aab")).alias("e"),
    ).first()
    assert one.i == "ALT-cf586eb1698d3b2c" and [one.s0, one.s1, one.s2, one.s3] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    assert one.f == "threat_tls" and one.n and math.isclose(one.e, 0.9182958340544896)


def test_tls_evidence(spark):
    df = spark.createDataFrame([(0.4, 0.9, 1, 0, 12)], "iat_cv double, iat_regularity_score double, has_deprecated_cipher int, has_sni int, total_pkt_count int")
    out = df.select(S.tls_rule_score(df.columns).alias("s"), S.tls_evidence(df.columns, F.lit(0.91234), 0.62).alias("e"), S.top_features(df.columns, 2).alias("t")).first()
    assert out.s == 3.0 and out.e["malware_probability"] == "0.9123" and "self_signed_certificate" not in out.e and out.e["total_packets"] == "12"
    assert [p.name for p in out.t] == ["total_pkt_count", "has_deprecated_cipher"]


def test_stability_forms_agree(spark):
    df = spark.createDataFrame([(i, float(i * 10), float(i), 1.0) for i in range(40)], "id long, flow_duration double, pkt_count double, has_sni double")
    cols = ["flow_duration", "pkt_count", "has_sni"]
    formula = lambda c: 1 / (1 + F.exp(-(c["flow_duration"] / 100 + c["pkt_count"] / 20 - 3)))
    one = Y.stability(df, "id", cols, formula, 0.5).toPandas().sort_values("id")
    two = Y.stability_with_model(df, "id", cols, lambda x: x.withColumn("score", formula({c: F.col(c) for c in cols})), 0.5).toPandas().sort_values("id")
    for c in ("robust_probability", "raw_probability", "probability_stddev", "decision_stability"):
        assert np.allclose(one[c], two[c]), c
    assert (one["adversarially_unstable"].to_numpy() == two["adversarially_unstable"].to_numpy()).all()
    assert Y.is_perturbable("flow_duration") and not Y.is_perturbable("has_time")


def test_scan_scores_stay_apart(spark):
    df = spark.createDataFrame([("s", "h", p, False, 10) for p in range(25)], "src string, dst string, dst_port int, failed boolean, t int")
    out = T.scan_fanout(df.withColumn("ts", F.timestamp_seconds("t")), full_score_at=50).first()
    assert out.unique_ports == 25 and out.scan_shape == "vertical" and out.heuristic_score == 0.5


def test_tls_flow_features_read_packets_once(spark):
    rng = random.Random(9)
    data = [("h" if i % 3 else f"u{i % 4}", i, rng.choice([0, 5, 5_000_000, i * 700_001]), rng.random() < 0.6, rng.randint(0, 900), rng.randint(30, 64), i % 32) for i in range(240)]
    data.append(("one", 999, 77, True, 10, 60, 2))
    count = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            count.add(batch.num_rows)
            yield batch

    schema = "uid string, seq long, t long, forward boolean, size long, ttl long, flags long"
    packets = spark.createDataFrame(data, schema).repartition(3).mapInArrow(counted, schema).withColumn("ts", F.timestamp_micros("t"))
    known = [(u, 443, "tls", "TLSv12", "aab", "h2", -1) for u in ("h", "u0", "u1", "u2", "u3", "one")]
    sessions = spark.createDataFrame(known, "uid string, dst_port long, proto string, version string, server_name string, alpn string, cert_days long")
    frame = pd.DataFrame(data, columns=["uid", "seq", "t", "forward", "size", "ttl", "flags"])
    for size in (7, 1_000_000):
        count.value = 0
        got = {r.uid: r for r in X.tls_flow_features(packets, sessions, rows=size).collect()}
        assert count.value == len(data) and set(got) == set(frame["uid"])
        for uid, part in frame.groupby("uid"):
            row, t = got[uid], np.sort(part["t"].to_numpy()) / 1e6
            sides = {"overall": t, "fwd": np.sort(part["t"][part["forward"]]) / 1e6, "bwd": np.sort(part["t"][~part["forward"]]) / 1e6}
            for side, at in sides.items():
                gaps = np.diff(at)
                want = {"mean": gaps.mean() if len(gaps) else 0.0, "std": gaps.std(ddof=1) if len(gaps) > 1 else 0.0}
                want |= {"max": gaps.max() if len(gaps) else 0.0, "min": gaps.min() if len(gaps) else 0.0} if side == "fwd" else {}
                assert all(math.isclose(row[f"{side}_iat_{k}"], v, rel_tol=1e-9, abs_tol=1e-9) for k, v in want.items()), (uid, side)
            ahead = part[part["forward"]]
            assert (row.total_pkt_count, row.fwd_pkt_count, row.fwd_byte_count, row.fwd_pkt_size_max) == (len(part), len(ahead), ahead["size"].sum(), ahead["size"].max())
            assert math.isclose(row.fwd_ttl_mean, ahead["ttl"].mean()) and row.syn_count == (part["flags"] & 2 != 0).sum()
            span = t[-1] - t[0]
            slots = np.minimum((t - t[0]) * 1e6 // 1 * 256 // max(span * 1e6, 1), 255).astype(int)
            power = np.abs(np.fft.rfft(np.bincount(slots, minlength=256) - len(t) / 256))[1:] ** 2 if span else np.zeros(1)
            assert math.isclose(row.dominant_freq_power, power.max() / power.sum() if span else 0.0, rel_tol=1e-6)
            assert math.isclose(row.sni_entropy, math.log2(3) - 2 / 3) and row.cert_expired == 1.0


def test_entropy_sorts_once(spark):
    plan = spark.createDataFrame([("aab",)], "name string").select(entropy(F.col("name")).alias("bits"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 1

from datetime import datetime, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tapline.functions import parsing as P
from tapline.operators import normalize as N

CONN = {"event_type": "conn", "ts": "2026-09-23T12:00:00Z", "id.orig_h": "10.0.0.1", "id.resp_h": "10.0.0.2"}


def normal(spark, *records):
    return rows(N.normalize(spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, raw map<string,string>")), "i")


def utc(r):
    return r.replace(tzinfo=timezone.utc) if r.tzinfo is None else r


def test_conn(spark):
    extra = {"id.resp_p": "443", "orig_bytes": "100", "resp_bytes": "250", "orig_pkts": "2", "resp_pkts": "3"}
    (r,) = normal(spark, CONN | extra)
    assert (r["bytes"], r["packets"], r["destination_port"], r["reject_reason"]) == (350, 5, 443, None)


def test_times_and_alias(spark):
    dns = {"type": "DNS", "ts": "1790164800", "id.orig_h": "a", "id.resp_h": "b", "query": "x.example"}
    ssl = CONN | {"event_type": "ssl", "ts": "2026-09-23T12:00:01+02:00"}
    frame = spark.createDataFrame([(0, dns), (1, ssl)], "i int, raw map<string,string>")
    got = N.normalize(frame).select("event_type", F.unix_seconds("observed_at").alias("s"), "raw").collect()
    assert got[0].event_type == "dns" and got[0].s == 1790164800 and got[0].raw["query"] == "x.example"
    assert got[1].s == int(datetime(2026, 9, 23, 10, 0, 1, tzinfo=timezone.utc).timestamp())


@pytest.mark.parametrize(
    "change, reason",
    [
        ({"ts": "not-a-timestamp"}, "Invalid timestamp: 'not-a-timestamp'"),
        ({"event_type": "dns", "id.resp_h": ""}, "dns event is missing required field: id.resp_h"),
        ({"event_type": "packet", "ts": "2026-09-23T12:00:00"}, "Timestamp must include timezone information"),
        ({"event_type": "x509"}, "Unsupported Zeek event type: 'x509'"),
        ({"event_type": "-"}, "Zeek record is missing event type"),
        ({"id.resp_p": "80/tcp"}, "Expected integer value, got '80/tcp'"),
        ({"bytes": "-4"}, "bytes must not be negative"),
        ({"id.resp_h": "-"}, None),  # a dash is absent for values, but not for required fields
    ],
)
def test_rejects(spark, change, reason):
    (r,) = normal(spark, CONN | change)
    assert r["reject_reason"] == reason


def test_one_sided_counters_and_microseconds(spark):
    frame = spark.createDataFrame([({**CONN, "resp_bytes": "7", "orig_bytes": "-", "ts": "1790164800.123457"},)], "raw map<string,string>")
    r = N.normalize(frame).select("bytes", "packets", F.unix_micros("observed_at").alias("us")).first()
    assert (r.bytes, r.packets, r.us) == (7, None, 1790164800123457)


def test_literals(spark):
    texts = ["set()", "{}", "None", "{'A', 'PTR', 'A'}", "[60, 300, 60]", "('x',)", "{'a': 1, 'b': 2}", "oops", "5", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    got = frame.select("i", P.literal_count(t).alias("n"), P.literal_count(t, 0).alias("m"), P.canonical_value(t).alias("c")).orderBy("i").collect()
    assert [r.n for r in got] == [0, 0, 0, 2, 3, 1, 2, 1, 1, 0]
    assert [r.m for r in got] == [0, 0, 0, 2, 3, 1, 2, 0, 1, 0]
    assert got[3].c == "SET(A|PTR)" and got[6].c == "DICT(a:1|b:2)" and got[9].c == "__NONE__"
    ttl = frame.filter("i = 4").select(*[v.alias(k) for k, v in P.ttl_features(t).items()]).first()
    assert (ttl.ttl_min, ttl.ttl_max, ttl.ttl_range, ttl.ttl_unique_count) == (60.0, 300.0, 240.0, 3)
    strict = frame.filter("i = 4").select(P.ttl_features(t, False)["ttl_unique_count"].alias("n")).first()
    assert strict.n == 2


def test_conn_aliases_and_contract(spark):
    raw = {"event_type": "conn", "id.resp_p": "53", "orig_pkts": "2", "resp_pkts": "x", "ip_proto": "17", "history": "^d"}
    out = spark.createDataFrame([(raw,)], "raw map<string,string>").select(N.zeek_conn_features("raw").alias("f")).first().f
    assert out["Protocol"] == "17" and "Destination Port" not in out and "Total Fwd Packets" not in out
    frame = spark.createDataFrame([(1.0, None), (1.0, 2.0)], "a double, b double")
    got = rows(N.select_contract(frame, ["b", "a"]), "b")
    assert got[0]["vector"] == {"b": 2.0, "a": 1.0} and got[1]["vector"] is None and got[1]["missing_inputs"] == ["b"]
    assert N.select_contract(frame, ["a", "c"]).first()["missing_inputs"] == ["c"]

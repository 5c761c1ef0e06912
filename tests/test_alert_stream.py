"""From growing log files to alert rows: a stream in several starts equals the batch over the whole files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tapline.operators import packet_flows as PF
from tapline.operators.alerts import Detector, to_alerts
from tapline.operators.features import DDOS_FEATURES, ddos_features
from tapline.operators.reports import stage_accounting
from tapline.sources.zeek import packet_rows, read_zeek
from tapline.streaming.alerts import OPPORTUNITY, alert_stream, drop_repeats_stream
from tapline.streaming.ledger import Ledger

IDENTITY = ("detector", "detector_version", "flow_id", "segment")
KEEP = ["flow_id", "segment", "source_ip", "destination_ip", "observed_at"]


def detector(keep):
    score = F.least(F.lit(1.0), F.col("`Flow Packets/s`") / 100)
    return Detector("volume", DDOS_FEATURES, 0.5, "model_score", score, lambda df: ddos_features(df, keep=keep), inputs=PF.DDOS_INPUTS)


def packet(uid, t, **more):
    base = {"ts": t, "uid": uid, "src": "10.0.0.1", "dst": "10.0.0.2", "src_port": 1000, "dst_port": 80, "proto": 6, "payload_len": 40, "tcp_flags": 2, "flow_complete": "F"}
    return json.dumps(base | more) + "\n"


def flow(uid, t, gap, packets=8, end=True):
    lines = [packet(uid, t + i * gap, **({"src": "10.0.0.2", "dst": "10.0.0.1", "src_port": 80, "dst_port": 1000} if i % 3 == 2 else {})) for i in range(packets)]
    return lines + ([json.dumps({"ts": t + packets * gap, "uid": uid, "flow_complete": "T"}) + "\n"] if end else [])


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """The whole log, the alerts of five starts of the stream over it as it grew, its ledger and last progress."""
    tmp = tmp_path_factory.mktemp("chain")
    logs, parts = tmp / "logs", []
    logs.mkdir()
    whole = tmp / "packet.log"
    fast, slow = flow("C1", 1000, 0.001), flow("C2", 1000, 0.5)
    parts.append(fast[:5] + slow[:4] + ["{bad\n"])
    parts.append(fast[5:] + slow[4:] + flow("C3", 1001, 0.002) + flow("C1", 1002, 0.001, end=False)[:4])
    parts.append([packet("C1", 1002.01)] + flow("C1", 1002.02, 0.001) + flow("C4", 1003, 0.001, end=False) + [packet(None, 1003)])
    parts += [[packet(None, 1003 + 4000)], [packet(None, 1003 + 4001)]]  # time goes on: what is silent ends
    ledger = Ledger()
    spark.streams.addListener(ledger)
    out, live = str(tmp / "out"), logs / "packet.log"
    for i, lines in enumerate(parts):
        for path in (live, whole):
            with open(path, "a") as file:
                file.writelines(lines)
        if i == 1:
            os.rename(live, logs / "packet.log.1")
        alerts = alert_stream(spark, str(logs), detector([*KEEP, "emitted_at"]), IDENTITY, start="beginning", quiet_seconds=60)
        query = alerts.writeStream.format("parquet").option("checkpointLocation", str(tmp / "cp")).trigger(availableNow=True).start(out)
        query.awaitTermination(240)
        assert query.exception() is None
        last = query.lastProgress
    yield whole, spark.read.schema(alerts.schema).parquet(out), ledger, last
    spark.streams.removeListener(ledger)


def test_stream_equals_batch(spark, chain):
    whole, alerts, _, _ = chain
    raw = read_zeek(spark, str(whole)).filter("reject_reason IS NULL").withColumn("arrival_seq", F.col("line_number").cast("long"))
    flows = PF.packets_to_flows(packet_rows(raw)).filter("flow_id IS NOT NULL")
    batch = to_alerts(detector(KEEP).run(flows), IDENTITY)
    shape = lambda df: sorted(tuple(r) for r in df.select("alert_id", *KEEP, F.round("score", 9), "raw_model_score", "threat_class").collect())
    assert shape(alerts) == shape(batch) and alerts.count() == 3
    assert sorted((r.flow_id, r.segment) for r in alerts.collect()) == [("C1", 0), ("C1", 1), ("C3", 0)]


def test_state_is_empty_in_the_end(chain):
    assert [s["numRowsTotal"] for s in map(lambda s: json.loads(s.json), chain[3].stateOperators)] == [0, 0]


def test_live_counters(spark, chain):
    whole, alerts, ledger, _ = chain
    totals = ledger.totals()
    lines = read_zeek(spark, str(whole))
    counted = {r.stage: r.records for r in stage_accounting(lines, {"received": F.lit(True), "refused": F.col("reject_reason").isNotNull()}).collect()}
    assert totals["records"] == counted
    assert totals["flows"] == {"flows": 5, "incomplete": 1, "detected": 3}
    assert totals["packets"]["without_id"] == 3
    assert ledger.table(spark).count() == 7


def test_ledger_keeps_sums_of_old_batches():
    ledger = Ledger(batches=2)
    for batch in (0, 1, 1, 2, 3):
        ledger.add("q", batch, "records", {"received": 10 + batch, "refused": None})
    assert ledger.totals() == {"records": {"received": 46, "refused": 0}} and len(ledger.recent["q", "records"]) == 2


def test_repeats_within_a_span(spark, tmp_path):
    rows = [[("d", "k", 0, 5, "x", 10)] * 2 + [("d", "k", 0, 5, "y", 11)], [("d", "k", 0, 5, "x", 14), ("e", "k", 0, 5, "x", 14)], [("d", "z", 0, 5, "x", 90)], [("d", "k", 0, 5, "x", 91)]]
    schema = "detector string, grouping_key string, scoring_start long, scoring_end long, context string, at long"
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in rows:
        spark.createDataFrame(part, schema).withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        kept = drop_repeats_stream(stream, OPPORTUNITY, "at", 20)
        query = kept.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        query.awaitTermination(120)
    got = spark.read.parquet(out).select("detector", "grouping_key", "context", F.unix_seconds("at")).collect()
    # the last one repeats a row whose span is over
    assert sorted(map(tuple, got)) == [("d", "k", "x", 10), ("d", "k", "x", 91), ("d", "k", "y", 11), ("d", "z", "x", 90), ("e", "k", "x", 14)]

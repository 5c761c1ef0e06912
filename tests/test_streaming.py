"""Streams in several micro-batches must give what the batch operators give."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tapline.operators import ordering as O
from tapline.operators import packet_flows as PF
from tapline.operators import rolling as R
from tapline.operators import windows as W
from tapline.streaming.context import BASE, exfil_context_stream
from tapline.streaming.flows import packets_to_flows_stream
from tapline.streaming.logs import stream_zeek
from tapline.streaming.reorder import reorder_stream
from tapline.streaming.windows import context_windows_stream

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def in_batches(spark, df, order, parts, tmp_path):
    """Write the frame as ``parts`` files in order; return a stream of one file per micro-batch."""
    path = str(tmp_path / "in")
    total = df.count()
    local = df.withColumn("_n", F.row_number().over(__import__("pyspark").sql.Window.orderBy(order)))
    for i in range(parts):
        piece = local.filter((F.col("_n") > total * i // parts) & (F.col("_n") <= total * (i + 1) // parts)).drop("_n")
        piece.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream, tmp_path):
    out = str(tmp_path / "out")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.read.schema(stream.schema).parquet(out)


def test_reorder(spark, tmp_path):
    rng = random.Random(4)
    data = [("ab"[i % 2], i, T0 + timedelta(seconds=i + rng.randint(-6, 6))) for i in range(60)]
    df = spark.createDataFrame(data, "key string, seq long, ts timestamp")
    got = run(spark, reorder_stream(in_batches(spark, df, "seq", 3, tmp_path), ["key"], "ts", "seq", 4.0), tmp_path)
    batch = O.reorder(df, ["key"], "ts", "seq", 4.0, "quarantine", number=True)
    want = {(r.key, r.seq): r.release_seq for r in batch.filter("release_arrival is not null or quarantined").collect()}
    assert {(r.key, r.arrival): r.release_seq for r in got.collect()} == want


def test_flows(spark, tmp_path):
    rng = random.Random(6)
    data, seq = [], 0
    for i in range(90):
        uid, way = f"C{i % 5}", rng.random() < 0.6
        a, b = (("10.0.0.1", 1000), ("10.0.0.2", 443)) if way else (("10.0.0.2", 443), ("10.0.0.1", 1000))
        size = None if uid == "C3" and i == 43 else rng.randint(0, 500)
        data.append((uid, T0 + timedelta(seconds=i), a[0], b[0], a[1], b[1], 6, size, rng.randint(0, 31), i >= 75, seq))
        seq += 1
    schema = "uid string, ts timestamp, src string, dst string, src_port long, dst_port long, proto long, payload_len long, tcp_flags long, flow_complete boolean, arrival_seq long"
    df = spark.createDataFrame(data, schema)
    ends = F.col("flow_complete")
    for c in ("src", "dst", "src_port", "dst_port", "proto", "payload_len", "tcp_flags"):
        df = df.withColumn(c, F.when(~ends, F.col(c)))
    got = run(spark, packets_to_flows_stream(in_batches(spark, df, "arrival_seq", 4, tmp_path)), tmp_path)
    batch = PF.packets_to_flows(df)
    assert set(got.columns) - {"emitted_at"} == set(batch.columns)
    shape = lambda d: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.select(*[f"`{c}`" for c in batch.columns]).collect()), key=repr)
    assert shape(got) == shape(batch) and got.count() == 15


def test_windows(spark, tmp_path):
    rng = random.Random(7)
    times = sorted(rng.randint(0, 120) for _ in range(50))
    df = spark.createDataFrame([("k", i, T0 + timedelta(seconds=t)) for i, t in enumerate(times)], "key string, seq long, ts timestamp")
    got = run(spark, context_windows_stream(in_batches(spark, df, "seq", 3, tmp_path), ["key"], "ts", "seq", 20.0, 5.0), tmp_path)
    want = W.context_windows(df, ["key"], "ts", "seq", 20.0, 5.0).select(
        F.unix_micros("scoring_start").alias("start_us"), "trigger_seq", "context_count"
    )
    shape = lambda d: sorted(tuple(r) for r in d.select("start_us", "trigger_seq", "context_count").collect())
    assert shape(got) == shape(want) and got.count() > 5


def test_exfil_context(spark, tmp_path):
    rng = random.Random(9)
    data = [("ab"[i % 2], i, T0 + timedelta(seconds=i), *[rng.random() for _ in BASE]) for i in range(70)]
    df = spark.createDataFrame(data, "source string, seq long, ts timestamp, " + ", ".join(f"{c} double" for c in BASE))
    got = run(spark, exfil_context_stream(in_batches(spark, df, "seq", 3, tmp_path), ["source"], "seq", derive=False), tmp_path)
    want = R.exfil_context(df, ["source"], "seq", derive=False)
    cols = ["source", "seq", "history_records_used", *R.EXFIL_FEATURES]
    shape = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.select(*cols).collect())
    assert shape(got) == shape(want)


def test_log_stream(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "conn.log").write_text("#fields\tts\tuid\n1\tC1\n2\n")
    (logs / "dns.log").write_text('{"ts": 3}\n{bad\n')
    seen = []
    handle = lambda df, batch: seen.extend(r.asDict() for r in df.select("source_file", "line_number", "raw", "reject_reason").collect())
    for _ in range(2):  # the second run finds nothing new
        stream_zeek(spark, str(logs), handle, str(tmp_path / "cp"), available_now=True).awaitTermination(120)
    assert sorted((r["source_file"], r["line_number"], r["reject_reason"] is None) for r in seen) == [
        ("conn.log", 2, True), ("conn.log", 3, False), ("dns.log", 1, True), ("dns.log", 2, False),
    ]


def test_alerts_merge_by_id(spark, tmp_path):
    from tapline.streaming.logs import current_alerts, merge_alerts

    frame = lambda rows: spark.createDataFrame(rows, "alert_id string, observed_at long, status string")
    write = merge_alerts(str(tmp_path / "alerts"))
    write(frame([("a", 1, "NEW"), ("b", 1, "NEW"), ("b", 1, "NEW")]), 0)
    for _ in range(2):  # a batch that is run again gives the same table
        write(frame([("b", 2, "RESOLVED"), ("c", 2, "NEW")]), 1)
    write(frame([("a", 0, "OLD")]), 2)
    got = rows(current_alerts(spark, str(tmp_path / "alerts")), "alert_id")
    assert [(r["alert_id"], r["status"]) for r in got] == [("a", "NEW"), ("b", "RESOLVED"), ("c", "NEW")]


def test_packets_without_a_flow_id_are_reported(spark, tmp_path):
    from tapline.streaming.flows import packets_to_flows_stream

    schema = "uid string, ts timestamp, src string, dst string, src_port long, dst_port long, proto long, payload_len long, tcp_flags long, flow_complete boolean, arrival_seq long"
    data = [(None, T0, "10.0.0.1", "10.0.0.2", 1, 2, 6, 10, 2, False, 0), (None, T0, None, None, None, None, None, None, None, True, 1)]
    df = spark.createDataFrame(data, schema)
    got = run(spark, packets_to_flows_stream(in_batches(spark, df, "arrival_seq", 1, tmp_path)), tmp_path).collect()
    assert [(r.flow_id, r.packet_count, r.incomplete_reasons) for r in got] == [(None, 0, ["packet observation is missing Zeek connection uid"])] * 2


def state_rows(stream, tmp_path, name):
    """Rows of state after all input and a batch more; what came out."""
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").start()
    query.processAllAvailable()
    left = json.loads(query.lastProgress.stateOperators[0].json)["numRowsTotal"]
    query.stop()
    return left


def test_state_ends_with_event_time(spark, tmp_path):
    """Keys that fell silent leave no state: only the key that moved time on is left."""
    data = [(f"k{i % 5}", i, T0 + timedelta(seconds=i)) for i in range(40)] + [("later", 40 + i, T0 + timedelta(seconds=9_000 + i)) for i in range(2)]
    df = spark.createDataFrame(data, "key string, seq long, ts timestamp").select("*", *[F.lit(1.0).alias(c) for c in BASE])
    stream = in_batches(spark, df, "seq", 21, tmp_path)
    windows = context_windows_stream(stream, ["key"], "ts", "seq", 20.0, 5.0)
    assert state_rows(windows, tmp_path, "windows") == 2  # slots and clock of one key
    flushed = spark.table("windows").filter("start_us = end_us").collect()
    expected = {r.key: r.context_count for r in W.window_flush(df.filter("key != 'later'"), ["key"], "ts", "seq", 20.0).collect()}
    assert {r.key: r.context_count for r in flushed} == expected
    reordered = reorder_stream(stream, ["key"], "ts", "seq", 4.0)
    assert state_rows(reordered, tmp_path, "reordered") <= 4
    assert spark.table("reordered").filter("key != 'later'").count() == 40  # drained, none lost
    assert state_rows(exfil_context_stream(stream, ["key"], "seq", derive=False), tmp_path, "context") <= 3
    for make in (lambda: context_windows_stream(stream, ["key"], "ts", "seq", 20.0, 5.0, 0), lambda: packets_to_flows_stream(stream, quiet_seconds=0), lambda: reorder_stream(stream, ["key"], "ts", "seq", 4.0, forget_seconds=1)):
        with pytest.raises(ValueError):
            make()


def test_dns_match(spark, tmp_path):
    """Queries and responses of two streams in three micro-batches, some late, some never answered."""
    from tapline.operators.joins import match_dns
    from tapline.streaming.dns import match_dns_stream

    rng = random.Random(12)
    at = lambda s: T0 + timedelta(milliseconds=int(s * 1000))
    asked = sorted((at(i + rng.random()), f"q{i}", "c" + str(i % 2), i % 5) for i in range(60))
    answers = sorted((t + timedelta(seconds=rng.random() * 4), c, tx) for t, _, c, tx in asked for _ in range(rng.randrange(3)))
    queries = spark.createDataFrame(asked, "query_ts timestamp, query_id string, client string, tx long")
    responses = spark.createDataFrame(answers, "response_ts timestamp, client string, tx long")
    last = at(500)  # moves both watermarks on
    (tmp_path / "q").mkdir()
    (tmp_path / "r").mkdir()
    tail_q = queries.unionByName(spark.createDataFrame([(last, "end", "none", 0), (last + timedelta(seconds=1), "end2", "none", 0)], queries.schema))
    tail_r = responses.unionByName(spark.createDataFrame([(last, "none", 1), (last + timedelta(seconds=1), "none", 1)], responses.schema))
    left = in_batches(spark, tail_q, "query_ts", 4, tmp_path / "q")
    right = in_batches(spark, tail_r, "response_ts", 4, tmp_path / "r")
    got = run(spark, match_dns_stream(left, right, ["client", "tx"], 2.0, late_seconds=30), tmp_path)
    want = match_dns(queries, responses, ["client", "tx"], 2.0)
    shape = lambda d: sorted(((r.query_id, r.response_ts) for r in d.filter("query_id NOT LIKE 'end%'").collect()), key=repr)
    assert shape(got) == shape(want) and any(at is None for _, at in shape(want))

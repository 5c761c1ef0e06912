"""Telemetry views of the given tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import host_of
from .registry import Tables

# --- packets: order lines as packets, orders as flows ----------------------------------------


def packets(t: Tables, dirty: bool = False) -> DataFrame:
    """Order lines as packets of the order's flow, plus an end marker for each finished order.

    ``dirty`` blanks some payloads and flags and flips some protocols.
    """
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    lines = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    back = F.col("l_returnflag") == "R"
    client, client_port = _client(), F.lit(1024) + F.col("o_orderkey") % 50_000
    server, server_port = _server(), F.col("o_orderkey") % 100 + 1
    way = lambda a, b: F.when(back, b).otherwise(a)
    proto = F.when(F.col("o_orderkey") % 5 == 0, 17).otherwise(6)
    payload = F.col("l_quantity").cast("long")
    flags = (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 32
    if dirty:
        payload = F.when(payload != 13, payload)
        flags = F.when(F.col("l_partkey") % 97 != 0, flags)
        proto = F.when(F.col("l_suppkey") % 41 == 0, 23 - proto).otherwise(proto)
    seq = F.col("l_linenumber").cast("long") * 10**15 + F.col("l_partkey") * 10**8 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")
    body = lines.select(
        F.col("o_orderkey").cast("string").alias("uid"),
        F.col("l_shipdate").alias("ts"),
        way(client, server).alias("src"), way(server, client).alias("dst"),
        way(client_port, server_port).cast("long").alias("src_port"), way(server_port, client_port).cast("long").alias("dst_port"),
        proto.cast("long").alias("proto"), payload.alias("payload_len"), flags.cast("long").alias("tcp_flags"),
        F.lit(False).alias("flow_complete"), seq.alias("arrival_seq"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    marks = orders.filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").cast("string").alias("uid"), F.col("o_orderdate").alias("ts"),
        none("string").alias("src"), none("string").alias("dst"), none("long").alias("src_port"), none("long").alias("dst_port"),
        none("long").alias("proto"), none("long").alias("payload_len"), none("long").alias("tcp_flags"),
        F.lit(True).alias("flow_complete"), F.lit(9 * 10**18).cast("long").alias("arrival_seq"),
    )
    return body.unionByName(marks)


def _client():
    return F.concat(F.lit("10.0."), (F.col("o_custkey") % 200).cast("string"), F.lit("."), (F.col("o_custkey") % 199 + 1).cast("string"))


def _server():
    return F.concat(F.lit("192.168.1."), (F.col("o_orderkey") % 100 + 1).cast("string"))


def _packets_sql(dirty: bool) -> str:
    payload, flags, proto = "cast(l_quantity as bigint)", "(l_partkey*7+l_suppkey)%32", "case when o_orderkey%5=0 then 17 else 6 end"
    if dirty:
        payload = f"case when {payload}<>13 then {payload} end"
        flags = f"case when l_partkey%97<>0 then {flags} end"
        proto = f"case when l_suppkey%41=0 then 23-({proto}) else {proto} end"
    client = "'10.0.'||(o_custkey%200)||'.'||(o_custkey%199+1)"
    server = "'192.168.1.'||(o_orderkey%100+1)"
    return f"""v_packets AS (
  SELECT cast(o_orderkey AS varchar) AS uid, epoch_us(l_shipdate) AS t,
    CASE WHEN l_returnflag='R' THEN {server} ELSE {client} END AS src,
    CASE WHEN l_returnflag='R' THEN {client} ELSE {server} END AS dst,
    CASE WHEN l_returnflag='R' THEN o_orderkey%100+1 ELSE 1024+o_orderkey%50000 END AS src_port,
    CASE WHEN l_returnflag='R' THEN 1024+o_orderkey%50000 ELSE o_orderkey%100+1 END AS dst_port,
    {proto} AS proto, {payload} AS payload_len, {flags} AS tcp_flags,
    cast(l_linenumber AS bigint)*1000000000000000 + l_partkey*100000000 + l_suppkey*100 + cast(l_quantity AS bigint) AS arrival_seq
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey),
v_ends AS (SELECT cast(o_orderkey AS varchar) AS uid, epoch_us(o_orderdate) AS t FROM orders WHERE o_orderstatus='F')"""


PACKETS_SQL = _packets_sql(False)
DIRTY_PACKETS_SQL = _packets_sql(True)

FLOWS_SQL = (
    PACKETS_SQL
    + """,
v_heads AS (
  SELECT uid, arg_min(src, arrival_seq) AS source_ip, arg_min(src_port, arrival_seq) AS source_port,
    arg_min(dst, arrival_seq) AS destination_ip, arg_min(dst_port, arrival_seq) AS destination_port,
    arg_min(proto, arrival_seq) AS protocol FROM v_packets GROUP BY uid),
v_flow AS (
  SELECT p.uid, any_value(source_ip) AS source_ip, any_value(source_port) AS source_port,
    any_value(destination_ip) AS destination_ip, any_value(destination_port) AS destination_port,
    any_value(protocol) AS protocol, count(*) AS n, min(t) AS t0, max(t) AS t1,
    count(*) FILTER (p.src=source_ip AND p.src_port=source_port) AS fwd,
    count(*) FILTER (NOT (p.src=source_ip AND p.src_port=source_port)) AS bwd,
    coalesce(sum(payload_len) FILTER (p.src=source_ip AND p.src_port=source_port),0) AS fwd_bytes,
    coalesce(sum(payload_len) FILTER (NOT (p.src=source_ip AND p.src_port=source_port)),0) AS bwd_bytes,
    avg(payload_len) AS mean_len, coalesce(stddev_samp(payload_len),0) AS std_len,
    count(*) FILTER (proto=6 AND tcp_flags&1<>0) AS fin, count(*) FILTER (proto=6 AND tcp_flags&2<>0) AS syn,
    count(*) FILTER (proto=6 AND tcp_flags&4<>0) AS rst, count(*) FILTER (proto=6 AND tcp_flags&16<>0) AS ack
  FROM v_packets p JOIN v_heads h ON p.uid=h.uid GROUP BY p.uid),
v_done AS (
  SELECT f.*, t1-t0 AS us, CASE WHEN t1>t0 THEN n/((t1-t0)/1e6) ELSE 0 END AS pps,
    CASE WHEN t1>t0 THEN (fwd_bytes+bwd_bytes)/((t1-t0)/1e6) ELSE 0 END AS bps,
    CASE WHEN t1>t0 THEN fwd/((t1-t0)/1e6) ELSE 0 END AS fps, CASE WHEN t1>t0 THEN bwd/((t1-t0)/1e6) ELSE 0 END AS rps
  FROM v_flow f JOIN v_ends e ON f.uid=e.uid)"""
)

# --- events ------------------------------------------------------------------------------------


def events(t: Tables) -> DataFrame:
    """Events with a disturbed but unique arrival number and eight sensors."""
    return t.events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        ((F.col("event_id") + (F.col("event_id") * 7919) % 23) * 64 + F.col("event_id") % 64).alias("arrival_seq"),
        (F.col("user_id") % 8).alias("sensor"),
    )


EVENTS_SQL = """v_events AS (
  SELECT event_id, epoch_us(ts) AS t, user_id, event_type, value, cast(json_extract_string(props,'$.k') AS bigint) AS k,
    (event_id + (event_id*7919)%23)*64 + event_id%64 AS arrival_seq, user_id%8 AS sensor FROM events)"""


def flows(t: Tables) -> DataFrame:
    """Events as flow records of a (user, type) conversation; times are hours as doubles."""
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)
    kind = F.col("event_type")
    protocol = F.when(kind == "click", "TCP").when(kind == "view", "udp").when(kind == "error", "icmp").otherwise("tcp")
    return events(t).select(
        "event_id", "ts", hours.alias("timestamp_unix"), F.col("user_id").alias("src"), kind.alias("dst"),
        F.round(F.col("value") * 100).alias("bytes"), F.col("k").alias("pkts"), protocol.alias("protocol"),
        (F.col("k") % 7 == 0).alias("flow_dir_reverse"), (kind == "error").cast("long").alias("target"),
        (F.col("k") + 1).alias("dst_port"), (F.col("k") % 5 == 0).alias("failed"),
    )


FLOW_RECORDS_SQL = (
    EVENTS_SQL
    + """,
v_flows AS (
  SELECT event_id, t, t/3.6e9 AS h, user_id AS src, event_type AS dst, round(value*100) AS bytes, k AS pkts,
    CASE event_type WHEN 'view' THEN 'udp' WHEN 'error' THEN 'icmp' ELSE 'tcp' END AS protocol,
    k%7=0 AS rev, CASE WHEN event_type='error' THEN 1 ELSE 0 END AS target, k+1 AS dst_port, k%5=0 AS failed
  FROM v_events)"""
)

# --- scored rows, alerts, domains, vectors -----------------------------------------------------


def scored(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang", "n_chars", F.col("source").alias("origin"))
    return t.labels.join(docs, "doc_id").select(
        "doc_id", F.col("toxic").cast("long").alias("label"), F.col("quality").cast("long").alias("quality"),
        ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("score"), F.col("lang").alias("source"), "origin", "n_chars",
    )


SCORED_SQL = """v_scored AS (
  SELECT l.doc_id, cast(toxic AS bigint) AS label, cast(quality AS bigint) AS quality, (n_chars%1000)/1000.0::double AS score,
    lang AS source, source AS origin, n_chars FROM labels l JOIN documents d ON l.doc_id=d.doc_id)"""

CLASSES = ("ddos burst", "c2 callback", "dns tunnel", "malware in encrypted sessions, odd", "recon sweep", "exfil upload")


def alerts(t: Tables) -> DataFrame:
    """Error events as alerts."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    n = F.col("user_id")
    severity = F.when(F.col("value") >= 150, "CRITICAL").when(F.col("value") >= 60, "HIGH").otherwise("MEDIUM")
    return events(t).filter("event_type = 'error'").select(
        "event_id", "ts", F.element_at(names, (n % 6 + 1).cast("int")).alias("threat_class"),
        F.concat(F.lit("10.1.0."), n % 40).alias("src_ip"), F.concat(F.lit("10.2.0."), F.col("k") % 10).alias("dst_ip"),
        F.concat(F.lit("flow-"), F.col("event_id").cast("string")).alias("flow_id"),
        F.when(F.col("k") % 4 != 0, F.concat(F.lit("model-"), F.col("k") % 3)).alias("model"),
        severity.alias("severity"), F.when(F.col("k") % 5 == 0, "RESOLVED").otherwise("NEW").alias("status"),
        F.concat(F.lit("det-"), n % 3).alias("detector"), "arrival_seq", "value", "k", "user_id",
    )


ALERTS_SQL = (
    EVENTS_SQL
    + """,
v_alerts AS (
  SELECT event_id, t, CASE user_id%6 """
    + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES))
    + """ END AS threat_class, '10.1.0.'||(user_id%40) AS src_ip, '10.2.0.'||(k%10) AS dst_ip, 'flow-'||event_id AS flow_id,
    CASE WHEN k%4<>0 THEN 'model-'||(k%3) END AS model,
    CASE WHEN value>=150 THEN 'CRITICAL' WHEN value>=60 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    CASE WHEN k%5=0 THEN 'RESOLVED' ELSE 'NEW' END AS status, 'det-'||(user_id%3) AS detector, arrival_seq, value, k, user_id
  FROM v_events WHERE event_type='error')"""
)


def domains(t: Tables) -> DataFrame:
    return t.pages.select("page_id", host_of(F.col("url")).alias("domain"))


DOMAINS_SQL = """v_domains AS (
  SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)) AS domain FROM pages)"""


DIMENSIONS = 64  # components of every embedding of the given table


def vectors(t: Tables) -> DataFrame:
    """All components of each embedding as columns, with the given label (odd classes against even ones)."""
    parts = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIMENSIONS)]
    label = (F.col("label").cast("long") % 2).alias("label")
    return t.embeddings.select("vec_id", *parts, label, (F.col("vec_id") % 7).alias("source"))

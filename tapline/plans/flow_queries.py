"""Packet, flow and record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import scoring as S
from ..functions.text import entropy
from ..operators import features as X
from ..operators import normalize as N
from ..operators import packet_flows as PF
from ..sources.flows import netflow_columns, trimmed
from ..sources.zeek import decode_lines
from . import views as V
from .registry import ORACLES, Tables, micros, query, rounded

_FEATURE_SQL = """SELECT uid AS flow_id, source_ip, source_port, destination_ip, destination_port, protocol, n AS packet_count,
  us AS duration_us, fwd AS fwd_packets, bwd AS bwd_packets, cast(fwd_bytes AS bigint) AS fwd_bytes,
  cast(bwd_bytes AS bigint) AS bwd_bytes, fin, syn, rst, ack, round(pps,6) AS packets_per_s, round(bps,6) AS bytes_per_s,
  round(fps,6) AS fwd_packets_per_s, round(rps,6) AS bwd_packets_per_s, round(mean_len,6) AS length_mean,
  round(std_len,6) AS length_std FROM v_done"""

_SHORT = {
    "Flow Duration": "duration_us", "Total Fwd Packets": "fwd_packets", "Total Backward Packets": "bwd_packets",
    "Fwd Packets Length Total": "fwd_bytes", "Bwd Packets Length Total": "bwd_bytes", "FIN Flag Count": "fin",
    "SYN Flag Count": "syn", "RST Flag Count": "rst", "ACK Flag Count": "ack", "Flow Packets/s": "packets_per_s",
    "Flow Bytes/s": "bytes_per_s", "Fwd Packets/s": "fwd_packets_per_s", "Bwd Packets/s": "bwd_packets_per_s",
    "Packet Length Mean": "length_mean", "Packet Length Std": "length_std",
}


def _complete(t: Tables):
    return PF.packets_to_flows(V.packets(t)).filter("complete")


@query("packet_flow_features", f"WITH {V.FLOWS_SQL} {_FEATURE_SQL}")
def packet_flow_features(t: Tables):
    flows = _complete(t).select(
        "flow_id", "source_ip", "source_port", "destination_ip", "destination_port", F.col("ip_protocol").alias("protocol"),
        "packet_count", *[F.col(f"`{k}`").alias(v) for k, v in _SHORT.items()],
    )
    return rounded(flows)


@query(
    "flow_completeness",
    f"""WITH {V.DIRTY_PACKETS_SQL},
h AS (SELECT uid, arg_min(proto, arrival_seq) AS hp FROM v_packets GROUP BY uid),
r AS (SELECT p.uid, arrival_seq, CASE
    WHEN payload_len IS NULL THEN 'packet observation is missing payload_len'
    WHEN proto<>hp THEN 'IP protocol changed within Zeek connection uid'
    WHEN proto=6 AND tcp_flags IS NULL THEN 'packet observation is missing tcp_flags' END AS why
  FROM v_packets p JOIN h ON p.uid=h.uid),
f AS (SELECT uid, why, min(arrival_seq) AS first_at FROM r WHERE why IS NOT NULL GROUP BY uid, why),
a AS (SELECT uid, string_agg(why, '; ' ORDER BY first_at, why) AS why FROM f GROUP BY uid),
c AS (SELECT p.uid, count(*) FILTER (payload_len IS NOT NULL AND proto=hp) AS n FROM v_packets p JOIN h ON p.uid=h.uid GROUP BY p.uid)
SELECT coalesce(c.uid, e.uid) AS flow_id, coalesce(n,0) AS packet_count, e.uid IS NOT NULL AS flow_end_observed,
  CASE WHEN c.uid IS NULL THEN 'flow-end marker has no packet observations'
    ELSE concat_ws('; ', a.why, CASE WHEN e.uid IS NULL THEN 'Zeek flow-end marker was not observed' END) END AS reasons,
  c.uid IS NOT NULL AND e.uid IS NOT NULL AND a.why IS NULL AS complete
FROM c FULL JOIN v_ends e ON c.uid=e.uid LEFT JOIN a ON a.uid=c.uid""",
)
def flow_completeness(t: Tables):
    return PF.packets_to_flows(V.packets(t, dirty=True)).select(
        "flow_id", "packet_count", "flow_end_observed", F.array_join("incomplete_reasons", "; ").alias("reasons"), "complete"
    )


@query(
    "incomplete_flow_failures",
    f"""SELECT flow_id, 'Skipped: packet-derived flow feature contract is incomplete: '||reasons AS reject_reason, 'INSUFFICIENT_CONTEXT' AS status, NULL::double AS score
FROM ({ORACLES["flow_completeness"]}) WHERE NOT complete""",
)
def incomplete_flow_failures(t: Tables):
    """Every flow goes to the detector; those with a reason come out with it and without a score."""
    from .alert_queries import ddos_detector

    out = ddos_detector().run(PF.packets_to_flows(V.packets(t, dirty=True)))
    return rounded(out.filter("reject_reason IS NOT NULL OR score IS NULL").select("flow_id", "reject_reason", "status", "score"))


@query(
    "flow_segments",
    """WITH p AS (SELECT l_suppkey AS uid, l_orderkey*1000000+l_partkey AS seq, min(l_quantity) AS q FROM lineitem GROUP BY 1,2),
m AS (SELECT *, coalesce(sum(CASE WHEN seq%29=0 THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS segment FROM p)
SELECT cast(uid AS bigint) AS uid, cast(segment AS bigint) AS segment, count(*) AS rows, min(seq) AS first_seq, max(seq) AS last_seq FROM m GROUP BY 1,2""",
)
def flow_segments(t: Tables):
    rows = t.lineitem.select(
        F.col("l_suppkey").cast("long").alias("uid"), (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")).alias("arrival_seq"),
    ).distinct()
    marked = rows.withColumn("flow_complete", F.col("arrival_seq") % 29 == 0)
    return PF.with_segments(marked).groupBy("uid", "segment").agg(
        F.count(F.lit(1)).alias("rows"), F.min("arrival_seq").alias("first_seq"), F.max("arrival_seq").alias("last_seq")
    )


@query(
    "flow_end_markers",
    f"""WITH {V.PACKETS_SQL} SELECT uid, min(t) AS flow_start_us, max(t) AS end_us, count(*) AS packets, true AS flow_complete
FROM v_packets GROUP BY uid""",
)
def flow_end_markers(t: Tables):
    marks = PF.flow_markers(V.packets(t).filter("not flow_complete"))
    return micros(marks, "flow_start_ts", "ts").withColumnsRenamed({"flow_start_ts": "flow_start_us", "ts": "end_us"})


_DDOS_SQL = """SELECT uid AS flow_id, round(pps,6) AS packets_per_s, round(bps,6) AS bytes_per_s, us::double AS duration_us,
  round(fwd_bytes/(fwd_bytes+bwd_bytes+1e-9),6) AS fwd_byte_ratio, round(abs(fwd-bwd)/(n+1e-9),6) AS packet_asymmetry,
  round(abs(fwd_bytes-bwd_bytes)/(fwd_bytes+bwd_bytes+1e-9),6) AS byte_asymmetry, round(syn/(n+1e-9),6) AS syn_ratio,
  round(ack/(n+1e-9),6) AS ack_ratio, round(rst/(n+1e-9),6) AS rst_ratio, round(mean_len,6) AS length_mean,
  round(std_len/(mean_len+1e-9),6) AS packet_size_variability, CASE WHEN protocol=17 THEN 1.0::double ELSE 0.0::double END AS is_udp FROM v_done"""


def _ddos(t: Tables):
    names = {"Flow Packets/s": "packets_per_s", "Flow Bytes/s": "bytes_per_s", "Flow Duration": "duration_us", "Packet Length Mean": "length_mean"}
    return X.ddos_features(_complete(t), ["flow_id"]).withColumnsRenamed(names)


@query("ddos_ratio_features", f"WITH {V.FLOWS_SQL} {_DDOS_SQL}")
def ddos_ratio_features(t: Tables):
    return rounded(_ddos(t))


@query(
    "portscan_features",
    f"""WITH {V.FLOWS_SQL} SELECT uid AS flow_id, destination_port::double AS destination_port, us::double AS duration_us,
  fwd::double AS fwd_packets, bwd::double AS bwd_packets, round(pps,6) AS packets_per_s, round(fps,6) AS fwd_packets_per_s,
  round(rps,6) AS bwd_packets_per_s, fin::double AS fin FROM v_done""",
)
def portscan_features(t: Tables):
    out = X.portscan_features(_complete(t), ["flow_id"])
    names = {"Destination Port": "destination_port", **{k: v for k, v in _SHORT.items() if k in out.columns}}
    return rounded(out.withColumnsRenamed(names))


@query(
    "contract_selection",
    f"""WITH {V.FLOWS_SQL} SELECT f.uid AS flow_id, d.uid IS NOT NULL AS selected,
  CASE WHEN d.uid IS NULL THEN 8 ELSE 0 END::bigint AS missing_count, round(d.pps,6) AS packets_per_s
FROM v_flow f LEFT JOIN v_done d ON f.uid=d.uid""",
)
def contract_selection(t: Tables):
    flows = PF.packets_to_flows(V.packets(t)).filter("packet_count > 0")
    picked = N.select_contract(flows, PF.PORTSCAN_INPUTS)
    return rounded(
        picked.select(
            "flow_id", F.col("vector").isNotNull().alias("selected"), F.size("missing_inputs").cast("long").alias("missing_count"),
            F.col("vector.`Flow Packets/s`").alias("packets_per_s"),
        )
    )


@query(
    "contract_validation",
    f"""WITH {V.FLOWS_SQL} SELECT count(*) AS rows, count(*) FILTER (d.uid IS NULL) AS non_finite_rows, 0::bigint AS missing_columns,
  true AS ordered FROM v_flow f LEFT JOIN v_done d ON f.uid=d.uid""",
)
def contract_validation(t: Tables):
    flows = PF.packets_to_flows(V.packets(t)).filter("packet_count > 0").select(*[f"`{c}`" for c in PF.DDOS_INPUTS])
    return N.validate_contract(flows, PF.DDOS_INPUTS).select(
        "rows", "non_finite_rows", F.size("missing").cast("long").alias("missing_columns"), "ordered"
    )


@query(
    "flow_provenance",
    f"""WITH {V.FLOWS_SQL} SELECT uid AS flow_id, 'zeek_new_packet_v1' AS producer, cast(n AS varchar) AS packet_observations,
  'true' AS flow_end_observed, uid AS record_uid, 'true' AS record_complete FROM v_done""",
)
def flow_provenance(t: Tables):
    at = lambda k: F.col("provenance")[k].alias(k)
    record = lambda k: F.get_json_object(F.col("provenance")["flow_end_record"], f"$.{k}")
    return PF.with_provenance(_complete(t), V.packets(t)).select(
        "flow_id", at("producer"), at("packet_observations"), at("flow_end_observed"), record("uid").alias("record_uid"), record("flow_complete").alias("record_complete")
    )


# --- raw records -------------------------------------------------------------------------------


def _raw(t: Tables):
    """Order lines as connection records with the usual defects, one raw map per row."""
    text = lambda c: c.cast("string")
    k, n = F.col("l_orderkey"), F.col("l_partkey")
    seconds = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    iso = F.date_format(F.col("l_shipdate"), "yyyy-MM-dd'T'HH:mm:ss")
    ts = (
        F.when(n % 11 == 0, F.concat(iso, F.lit("+02:00"))).when(n % 11 == 1, F.concat(iso, F.lit("Z")))
        .when(n % 11 == 2, iso).when(n % 11 == 3, F.lit("not-a-timestamp")).when(n % 11 == 4, F.lit(""))
        .otherwise(F.concat(text(seconds), F.lit(".250000")))
    )
    pairs = {
        "event_type": F.when(n % 7 == 0, F.lit(" DNS ")).when(n % 7 == 1, F.lit("x509")).otherwise("conn"),
        "ts": ts,
        "uid": text(k),
        "id.orig_h": F.when(n % 13 != 0, F.concat(F.lit("10.0.0."), text(k % 250))),
        "id.resp_h": F.concat(F.lit("192.168.0."), text(k % 100)),
        "id.resp_p": F.when(n % 17 == 0, F.lit("80/tcp")).otherwise(text(k % 1000)),
        "proto": F.when(k % 3 == 0, F.lit("udp")).otherwise("-"),
        "protocol": F.lit("tcp"),
        "orig_bytes": F.when(n % 5 != 0, text(F.col("l_quantity").cast("long"))).otherwise("-"),
        "resp_bytes": F.when(n % 3 != 0, text(n % 100)).otherwise("-"),
        "bytes": F.when(n % 19 == 0, text(-n)),
    }
    entries = F.array(*[F.struct(F.lit(a).alias("key"), b.alias("value")) for a, b in pairs.items()])
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.map_from_entries(entries).alias("raw"))


_RAW_SQL = """v_raw AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS n, l_suppkey AS s, cast(l_quantity AS bigint) AS q,
  CASE WHEN l_partkey%7=0 THEN 'dns' WHEN l_partkey%7=1 THEN 'x509' ELSE 'conn' END AS kind,
  CASE WHEN l_partkey%11=0 THEN epoch_us(l_shipdate)-7200000000 WHEN l_partkey%11=1 THEN epoch_us(l_shipdate)
    WHEN l_partkey%11 IN (2,3,4) THEN NULL ELSE epoch_us(l_shipdate)+250000 END AS us,
  strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS iso,
  CASE WHEN l_partkey%13<>0 THEN '10.0.0.'||(l_orderkey%250) END AS src, '192.168.0.'||(l_orderkey%100) AS dst,
  CASE WHEN l_partkey%17<>0 THEN l_orderkey%1000 END AS port,
  CASE WHEN l_partkey%19=0 THEN -l_partkey
    WHEN l_partkey%5=0 AND l_partkey%3=0 THEN NULL
    ELSE (CASE WHEN l_partkey%5<>0 THEN cast(l_quantity AS bigint) ELSE 0 END)+(CASE WHEN l_partkey%3<>0 THEN l_partkey%100 ELSE 0 END) END AS bytes
  FROM lineitem),
v_norm AS (SELECT *, CASE
  WHEN kind='x509' THEN 'Unsupported Zeek event type: ''x509'''
  WHEN n%11=4 THEN kind||' event is missing required field: ts'
  WHEN src IS NULL THEN kind||' event is missing required field: id.orig_h'
  WHEN n%11=2 THEN 'Timestamp must include timezone information'
  WHEN n%11=3 THEN 'Invalid timestamp: ''not-a-timestamp'''
  WHEN port IS NULL THEN 'Expected integer value, got ''80/tcp'''
  WHEN bytes<0 THEN 'bytes must not be negative' END AS reject_reason FROM v_raw)"""


@query(
    "normalize_events",
    f"""WITH {_RAW_SQL} SELECT k, ln::bigint AS ln, n, s, q, us AS observed_us, kind AS event_type, src AS source_ip,
  dst AS destination_ip, port AS destination_port, CASE WHEN k%3=0 THEN 'udp' ELSE 'tcp' END AS protocol, bytes,
  cast(k AS varchar) AS flow_id FROM v_norm WHERE reject_reason IS NULL""",
)
def normalize_events(t: Tables):
    out = N.normalize(_raw(t)).filter(F.col("reject_reason").isNull())
    return micros(out, "observed_at").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("ln"), F.col("l_partkey").alias("n"),
        F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("long").alias("q"), F.col("observed_at").alias("observed_us"),
        "event_type", "source_ip", "destination_ip", F.col("destination_port").cast("long").alias("destination_port"),
        "protocol", "bytes", "flow_id",
    )


@query(
    "normalize_rejects",
    f"WITH {_RAW_SQL} SELECT kind AS event_type, reject_reason, count(*) AS rows FROM v_norm WHERE reject_reason IS NOT NULL GROUP BY 1,2",
)
def normalize_rejects(t: Tables):
    out = N.normalize(_raw(t)).filter(F.col("reject_reason").isNotNull())
    return out.groupBy("event_type", "reject_reason").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "first_present_fields",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey%3=0 THEN cast(o_custkey AS varchar) WHEN o_orderkey%3=1 THEN o_orderstatus
  ELSE o_orderpriority END AS first_value, o_orderkey%3=0 AS from_first FROM orders""",
)
def first_present_fields(t: Tables):
    k = F.col("o_orderkey")
    raw = F.create_map(
        F.lit("a"), F.when(k % 3 == 0, F.col("o_custkey").cast("string")).otherwise("-"),
        F.lit("b"), F.when(k % 3 == 1, F.col("o_orderstatus")).otherwise(""), F.lit("c"), F.col("o_orderpriority"),
    )
    return t.orders.withColumn("raw", raw).select(
        k.alias("k"), P.first_present("raw", "a", "b", "c").alias("first_value"),
        P.first_present("raw", "a").isNotNull().alias("from_first"),
    )


@query(
    "timestamp_parse",
    """SELECT event_id, epoch_us(ts) AS from_epoch, epoch_us(ts) - 5400000000 AS from_iso, epoch_us(ts) AS from_zulu,
  'Timestamp must include timezone information' AS naive_reject FROM events""",
)
def timestamp_parse(t: Tables):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    epoch = F.concat(F.floor(us / 1_000_000).cast("string"), F.lit("."), F.lpad((us % 1_000_000).cast("string"), 6, "0"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    parsed = lambda c: F.unix_micros(P.parse_ts(c))
    return t.events.select(
        "event_id", parsed(epoch).alias("from_epoch"), parsed(F.concat(iso, F.lit("+01:30"))).alias("from_iso"),
        parsed(F.concat(iso, F.lit("Z"))).alias("from_zulu"), P.ts_reject(iso).alias("naive_reject"),
    )


@query(
    "strict_int_parse",
    """SELECT event_id, k AS plain, k AS plus, NULL::bigint AS fraction, NULL::bigint AS suffixed, k%2 AS truth, k%2=0 AS marker FROM
  (SELECT event_id, cast(json_extract_string(props,'$.k') AS bigint) AS k FROM events)""",
)
def strict_int_parse(t: Tables):
    k = F.col("k").cast("string")
    truth = F.when(F.col("k") % 2 == 1, "true").otherwise("false")
    return V.events(t).select(
        "event_id", P.strict_int(k).alias("plain"), P.strict_int(F.concat(F.lit("+"), k)).alias("plus"),
        P.strict_int(F.concat(k, F.lit(".5"))).alias("fraction"), P.strict_int(F.concat(k, F.lit("/tcp"))).alias("suffixed"),
        P.strict_int(truth).alias("truth"), P.flag_marker(F.when(F.col("k") % 2 == 0, " T ").otherwise("0")).alias("marker"),
    )


@query(
    "zeek_conn_features",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey%4<>0 AND o_orderkey%5<>0 THEN cast(o_orderkey%1000 AS varchar) END AS destination_port,
  CASE WHEN o_orderkey%5<>0 THEN '6' END AS protocol, CASE WHEN o_orderkey%5<>0 THEN '77' END AS kept FROM orders""",
)
def zeek_conn_features(t: Tables):
    k = F.col("o_orderkey")
    raw = F.create_map(
        F.lit("event_type"), F.when(k % 5 == 0, "dns").otherwise("conn"), F.lit("id.resp_p"), (k % 1000).cast("string"),
        F.lit("history"), F.when(k % 4 == 0, "^ShADad").otherwise("ShADad"), F.lit("ip_proto"), F.lit("6"),
        F.lit("orig_pkts"), F.lit("12.5"),
    )
    raw = F.when(k % 5 != 0, F.map_concat(raw, F.create_map(F.lit("Total Backward Packets"), F.lit("77")))).otherwise(raw)
    out = t.orders.select(k.alias("k"), raw.alias("raw")).withColumn("f", N.zeek_conn_features("raw"))
    at = lambda n: F.try_element_at("f", F.lit(n))
    return out.select("k", at("Destination Port").alias("destination_port"), at("Protocol").alias("protocol"), at("Total Backward Packets").alias("kept"))


@query(
    "zeek_tsv_decode",
    """SELECT o_orderkey AS line_number, CASE WHEN o_orderkey%9=0 THEN NULL ELSE 'conn' END AS event_type,
  CASE WHEN o_orderkey%9<>0 THEN cast(o_custkey AS varchar) END AS uid,
  CASE WHEN o_orderkey%9<>0 AND o_orderkey%4<>0 THEN o_orderpriority||chr(9)||'x' END AS note,
  CASE WHEN o_orderkey%9=0 THEN 'Zeek TSV line '||o_orderkey||' has 2 values; expected 3' END AS reject_reason FROM orders""",
)
def zeek_tsv_decode(t: Tables):
    k = F.col("o_orderkey")
    note = F.when(k % 4 == 0, F.lit("-")).otherwise(F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('\tx"')))
    line = F.when(k % 9 == 0, F.concat_ws("\t", k.cast("string"), F.lit("x"))).otherwise(
        F.concat_ws("\t", k.cast("string"), F.col("o_custkey").cast("string"), note)
    )
    lines = t.orders.select(
        line.alias("line"), k.alias("line_number"), F.lit("conn.log").alias("source_file"),
        F.array(F.lit("ts"), F.lit("uid"), F.lit("note")).alias("fields"),
    )
    at = lambda n: F.try_element_at("raw", F.lit(n))
    return decode_lines(lines).select(
        "line_number", at("event_type").alias("event_type"), at("uid").alias("uid"), at("note").alias("note"), "reject_reason"
    )


@query(
    "zeek_json_decode",
    """SELECT event_id AS line_number, CASE WHEN event_id%10>2 THEN CASE WHEN event_id%10=5 THEN 'ssl' ELSE 'dns' END END AS event_type,
  CASE WHEN event_id%10>2 THEN cast(user_id AS varchar) END AS uid,
  CASE event_id%10 WHEN 0 THEN 'Invalid JSON on line '||event_id WHEN 1 THEN 'Zeek record on line '||event_id||' is not an object'
    WHEN 2 THEN 'Oversized line '||event_id END AS reject_reason FROM events""",
)
def zeek_json_decode(t: Tables):
    k = F.col("event_id")
    body = F.to_json(F.struct(F.col("user_id").alias("uid"), F.when(k % 10 == 5, "ssl").alias("event_type")))
    line = (
        F.when(k % 10 == 0, F.concat(F.lit("{"), body)).when(k % 10 == 1, F.lit("[1, 2]"))
        .when(k % 10 == 2, F.concat(body, F.repeat(F.lit(" "), 300))).otherwise(body)
    )
    lines = t.events.select(
        line.alias("line"), k.alias("line_number"), F.lit("dns.log").alias("source_file"), F.lit(None).cast("array<string>").alias("fields")
    )
    at = lambda n: F.try_element_at("raw", F.lit(n))
    return decode_lines(lines, 200).select("line_number", at("event_type").alias("event_type"), at("uid").alias("uid"), "reject_reason")


@query(
    "netflow_aliases",
    f"""WITH {V.FLOW_RECORDS_SQL} SELECT event_id, event_id::double + 0.5 AS timestamp_unix, cast(src AS varchar) AS src, dst, bytes,
  CASE WHEN pkts%10=0 THEN 0.0::double ELSE pkts::double END AS pkts, protocol, rev AS flow_dir_reverse, target FROM v_flows""",
)
def netflow_aliases(t: Tables):
    f = V.flows(t)
    kind = F.when(F.col("dst") == "click", "tcp").otherwise(F.lower("protocol"))
    csv = f.select(
        (F.col("event_id") + 0.5).cast("string").alias(" StartTimeUnix"), F.col("src").cast("string").alias("SrcAddr"),
        F.col("dst").alias("DstAddr "), F.col("bytes").cast("string").alias("TotBytes"),
        F.when(F.col("pkts") % 10 == 0, "n/a").otherwise(F.col("pkts").cast("string")).alias("pkts"),
        kind.alias("proto"), F.col("flow_dir_reverse").cast("int").cast("string").alias(" FlowDir_Reverse"),
        F.when(F.col("target") == 1, "flow=From-Botnet-V42").otherwise("flow=Background").alias("Label"),
    )
    out = netflow_columns(trimmed(csv))
    return out.withColumn("event_id", F.floor("timestamp_unix").cast("long")).withColumn("target", F.col("target").cast("long"))


# --- scalar functions --------------------------------------------------------------------------


@query(
    "clean_numeric",
    """SELECT p_partkey AS k, CASE WHEN p_partkey%4 IN (0,1,2) THEN 0.0::double ELSE p_retailprice END AS cleaned,
  CASE WHEN p_partkey%3=0 THEN 0.0::double ELSE p_size::double END AS lenient FROM part""",
)
def clean_numeric(t: Tables):
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    bad = F.when(k % 4 == 0, F.lit(float("nan"))).when(k % 4 == 1, F.lit(float("-inf"))).when(k % 4 == 3, price)
    text = F.when(k % 3 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    return t.part.select(k.alias("k"), P.clean_numeric(bad).alias("cleaned"), P.to_number_or_zero(text).alias("lenient"))


@query(
    "dns_literals",
    """SELECT p_partkey AS k,
  CASE p_partkey%6 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 2 END::bigint AS items,
  CASE p_partkey%6 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 0 WHEN 4 THEN 1 ELSE 2 END::bigint AS items_strict,
  CASE WHEN p_partkey%6=2 THEN least(p_size,60) ELSE 0 END::double AS ttl_min,
  CASE WHEN p_partkey%6=2 THEN abs(p_size-60) ELSE 0 END::double AS ttl_range,
  CASE WHEN p_partkey%6 IN (1,5) THEN 1 ELSE 0 END::bigint AS is_ptr, CASE WHEN p_partkey%6 IN (1) THEN 1 ELSE 0 END::bigint AS is_a,
  CASE p_partkey%6 WHEN 0 THEN 'SET()' WHEN 1 THEN 'SET(A|PTR)' WHEN 2 THEN 'LIST(60|'||p_size||'|60)' WHEN 3 THEN 'oops'
    WHEN 4 THEN 'SET(TXT)' ELSE 'LIST(PTR|PTR)' END AS canonical FROM part""",
)
def dns_literals(t: Tables):
    k = F.col("p_partkey") % 6
    text = (
        F.when(k == 0, "set()").when(k == 1, "{'PTR', 'A'}").when(k == 2, F.concat(F.lit("[60, "), F.col("p_size").cast("string"), F.lit(", 60]")))
        .when(k == 3, "oops").when(k == 4, "{'TXT'}").otherwise("['PTR', 'PTR']")
    )
    c = F.col("text")
    flags, ttl = P.rr_flags(c), P.ttl_features(c, lenient=False)
    return t.part.select(F.col("p_partkey").alias("k"), text.alias("text")).select(
        "k", P.literal_count(c).cast("long").alias("items"), P.literal_count(c, 0).cast("long").alias("items_strict"),
        ttl["ttl_min"].alias("ttl_min"), ttl["ttl_range"].alias("ttl_range"), flags["is_PTR_record"].cast("long").alias("is_ptr"),
        flags["is_A_record"].cast("long").alias("is_a"), P.canonical_value(c).alias("canonical"),
    )


@query(
    "dns_ratios",
    """SELECT p_partkey AS k, round((p_size%7)/greatest(p_size%5,1),6) AS ptr_per_rr,
  round(p_retailprice/greatest(p_size,1),6) AS rr_entropy_per_length, round(p_size/greatest(p_size%9,1),6) AS ttl_variance_ratio,
  CASE WHEN p_partkey%3=0 THEN 0 ELSE 1 END::bigint AS reverse_dns_known,
  round((p_size%7)/((p_size%5)+1.0),6) AS stable_ratio, round((p_size%7)/greatest((p_size%5)::double,1e-6),3) AS clipped_ratio FROM part""",
)
def dns_ratios(t: Tables):
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = t.part.select(
        k.alias("k"), (s % 7).alias("PTR_frequency"), (s % 5).alias("rr_count"), F.col("p_retailprice").alias("rr_name_entropy"),
        s.alias("rr_name_length"), s.alias("ttl_variance"), (s % 9).alias("ttl_mean"),
        F.when(k % 3 == 0, "Unknown").otherwise("host").alias("reverse_dns"), F.lit("[60]").alias("unique_ttl"), F.lit("{'A'}").alias("rr_type"),
    )
    out = X.dns_base_features(rows).withColumn(
        "stable_ratio", X.ptr_rr_ratio(F.col("PTR_frequency").cast("double"), F.col("rr_count").cast("double"))
    ).withColumn("clipped_ratio", X.ptr_rr_ratio(F.col("PTR_frequency").cast("double"), F.col("rr_count").cast("double"), stable=False))
    return rounded(
        out.select("k", "ptr_per_rr", "rr_entropy_per_length", "ttl_variance_ratio", "reverse_dns_known", "stable_ratio", "clipped_ratio"), clipped_ratio=3
    )


@query(
    "quic_metadata",
    """SELECT event_id, q AS is_quic, q AND k%3=0 AS zero_rtt_observed, q AND (k%5=0 OR k%7=0) AS connection_migration_observed,
  CASE WHEN q AND k%4<>0 THEN greatest(0, k-50) END AS observed_stream_count, CASE WHEN q THEN 'c'||k END AS connection_id,
  CASE WHEN q THEN 'sensor_transport_metadata' ELSE 'not_quic' END AS evidence_source FROM
  (SELECT event_id, cast(json_extract_string(props,'$.k') AS bigint) AS k, user_id%2=0 AND event_type IN ('click','view') AS q FROM events)""",
)
def quic_metadata(t: Tables):
    k, text = F.col("k"), lambda c: c.cast("string")
    raw = F.create_map(
        F.lit("proto"), F.when(F.col("user_id") % 2 == 0, "UDP").otherwise("tcp"),
        F.lit("service"), F.when(F.col("event_type") == "click", "gquic").otherwise("ssl"),
        F.lit("alpn"), F.when(F.col("event_type") == "view", "H3-29").otherwise("none"),
        F.lit("zero_rtt"), F.when(k % 3 == 0, " Yes ").otherwise("no"), F.lit("migrated"), F.when(k % 5 == 0, "1").otherwise("0"),
        F.lit("quic_peer_address_changed"), F.when(k % 7 == 0, "T").otherwise("F"),
        F.lit("stream_count"), F.when(k % 4 == 0, "x").otherwise(text(k - 50)), F.lit("dcid"), F.concat(F.lit("c"), text(k)),
    )
    out = V.events(t).withColumn("raw", raw).withColumn("q", N.quic_metadata("raw"))
    return out.select(
        "event_id", "q.is_quic", "q.zero_rtt_observed", "q.connection_migration_observed", "q.observed_stream_count",
        "q.connection_id", "q.evidence_source",
    )


@query(
    "tls_rule_score",
    """SELECT event_id, greatest(CASE WHEN cv>0 THEN abs(cv-0.3)/0.5 END, CASE WHEN reg>0.7 THEN reg*3.0 END,
  CASE WHEN k%4=0 THEN 3.0 END, CASE WHEN k%6=0 THEN 2.0 END, CASE WHEN k%5=0 THEN 1.5 END, CASE WHEN k%9=0 THEN 2.5 END, 0.0)::decimal(18,6)::double AS rule_score,
  CASE WHEN k/100.0>=0.95 THEN 'CRITICAL' WHEN k/100.0>=0.85 THEN 'HIGH' WHEN k/100.0>=0.7 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  (2 + 3 + CASE WHEN k%4=0 THEN 1 ELSE 0 END + CASE WHEN k%9=0 THEN 1 ELSE 0 END + CASE WHEN cv>0 THEN 1 ELSE 0 END
    + CASE WHEN reg>0.5 THEN 1 ELSE 0 END)::bigint AS evidence_items FROM
  (SELECT event_id, k, (k%8)/10.0 AS cv, (user_id%10)/10.0 AS reg FROM
    (SELECT event_id, user_id, cast(json_extract_string(props,'$.k') AS bigint) AS k FROM events))""",
)
def tls_rule_score(t: Tables):
    k = F.col("k")
    flag = lambda cond: F.when(cond, 1).otherwise(0)
    rows = V.events(t).select(
        "event_id", "k", ((k % 8) / 10.0).alias("iat_cv"), ((F.col("user_id") % 10) / 10.0).alias("iat_regularity_score"),
        flag(k % 4 == 0).alias("has_deprecated_cipher"), flag(k % 6 == 0).alias("tls_1_0"), flag(k % 5 != 0).alias("has_sni"),
        flag(k % 9 == 0).alias("cert_self_signed"),
    )
    return rounded(
        rows.select(
            "event_id", S.tls_rule_score(rows.columns).alias("rule_score"), S.severity_from_score(k / 100.0).alias("severity"),
            F.size(S.tls_evidence(rows.columns, k / 100.0, 0.6235448718070984)).cast("long").alias("evidence_items"),
        )
    )


@query(
    "tls_evidence",
    f"""WITH {V.EVENTS_SQL}, x AS (SELECT event_id, k, sensor, (k%8)/10.0 AS cv, (user_id%10)/10.0 AS reg, k%4=0 AS old, k%9=0 AS own, k%5 AS fq, k%7 AS sim, k*3 AS pk, value FROM v_events)
SELECT event_id, round(k/100.0,4)::double AS malware_probability, 0.6235448718070984::double AS decision_threshold, CASE WHEN old THEN 'true' END AS deprecated_cipher_detected,
  CASE WHEN own THEN 'true' END AS self_signed_certificate, CASE WHEN cv>0 THEN round(cv,4) END::double AS iat_coefficient_of_variation,
  CASE WHEN reg>0.5 THEN round(reg,4) END::double AS beaconing_regularity_score, CASE WHEN fq>0 THEN round(fq/3.0,6) END::double AS dominant_frequency_hz,
  CASE WHEN sim>3 THEN sim END::double AS consecutive_periodic_intervals, pk::double AS total_packets, round(value,3)::double AS flow_duration_sec,
  'tls' AS detector, '1.0' AS model_version, '10.0.0.'||sensor AS src_ip, 'unknown' AS dst_ip, '0' AS src_port, coalesce(CASE WHEN k%3<>0 THEN 'tcp' END,'unknown') AS protocol,
  (pk<>0)::bigint+(value<>0)::bigint+(reg<>0)::bigint+(cv<>0)::bigint+(fq<>0)::bigint+(sim<>0)::bigint+old::bigint+own::bigint > 0 AS has_top FROM x""",
)
def tls_evidence(t: Tables):
    """Every entry of the evidence map by value."""
    k = F.col("k")
    flag = lambda cond: F.when(cond, 1).otherwise(0)
    rows = V.events(t).select(
        "event_id", "sensor", "k", ((k % 8) / 10.0).alias("iat_cv"), ((F.col("user_id") % 10) / 10.0).alias("iat_regularity_score"), flag(k % 4 == 0).alias("has_deprecated_cipher"),
        flag(k % 9 == 0).alias("cert_self_signed"), ((k % 5) / 3.0).alias("dominant_freq_hz"), (k % 7).alias("consecutive_similar_iat_count"), (k * 3).alias("total_pkt_count"), F.col("value").alias("flow_duration_sec"),
    )
    features = [c for c in rows.columns if c not in ("event_id", "sensor", "k")]
    where = {"src_ip": F.concat(F.lit("10.0.0."), F.col("sensor").cast("string")), "protocol": F.when(k % 3 != 0, "tcp")}
    found = rows.select("event_id", S.tls_evidence(features, k / 100.0, 0.6235448718070984, "tls", "1.0", where).alias("e"))
    of = lambda n: F.try_element_at("e", F.lit(n))
    numbers = ("malware_probability", "decision_threshold", "iat_coefficient_of_variation", "beaconing_regularity_score", "dominant_frequency_hz", "consecutive_periodic_intervals", "total_packets", "flow_duration_sec")
    texts = ("deprecated_cipher_detected", "self_signed_certificate", "detector", "model_version", "src_ip", "dst_ip", "src_port", "protocol")
    return found.select("event_id", *[of(n).cast("double").alias(n) for n in numbers], *[of(n).alias(n) for n in texts], (of("top_features") != "[]").alias("has_top"))


@query(
    "top_features",
    """SELECT vec_id, names, round(top_value,4) AS top_value FROM (
  SELECT vec_id, string_agg(name, ',' ORDER BY abs(v) DESC, name) AS names, arg_max(v, abs(v)) AS top_value FROM (
    SELECT vec_id, 'e'||i AS name, embedding[i+1]::double AS v, row_number() OVER (PARTITION BY vec_id ORDER BY abs(embedding[i+1]) DESC, i) AS rn
    FROM embeddings, (SELECT unnest(range(0,64)) AS i)) WHERE rn<=5 GROUP BY vec_id)""",
)
def top_features(t: Tables):
    cols = [f"e{i}" for i in range(V.DIMENSIONS)]
    out = V.vectors(t).withColumn("top", S.top_features(cols, 5))
    return out.select(
        "vec_id", F.array_join(F.transform("top", lambda p: p["name"]), ",").alias("names"), F.col("top")[0]["value"].alias("top_value")
    )


@query(
    "non_routable",
    """WITH f AS (SELECT event_id, CASE user_id%9 WHEN 0 THEN '255.255.255.255' WHEN 1 THEN '10.0.0.255' WHEN 2 THEN '169.254.1.9'
    WHEN 3 THEN '224.0.0.251' WHEN 4 THEN '127.0.0.1' WHEN 5 THEN '0.0.0.0' WHEN 6 THEN '239.1.1.1' ELSE '10.0.0.'||(user_id%250) END AS src,
    CASE WHEN event_id%10=0 THEN '192.168.7.255' ELSE '10.9.9.9' END AS dst, user_id%9 AS m FROM events)
SELECT src, dst, count(*) AS flows FROM f WHERE m>6 AND event_id%10<>0 AND src NOT LIKE '%.255' GROUP BY 1,2""",
)
def non_routable(t: Tables):
    m = F.col("user_id") % 9
    fixed = ("255.255.255.255", "10.0.0.255", "169.254.1.9", "224.0.0.251", "127.0.0.1", "0.0.0.0", "239.1.1.1")
    src = F.coalesce(
        F.element_at(F.array(*[F.lit(x) for x in fixed], F.lit(None), F.lit(None)), (m + 1).cast("int")),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")),
    )
    dst = F.when(F.col("event_id") % 10 == 0, "192.168.7.255").otherwise("10.9.9.9")
    return N.drop_non_routable(t.events.select(src.alias("src"), dst.alias("dst")), "src", "dst").groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("flows")
    )


@query(
    "redaction",
    f"""WITH {V.EVENTS_SQL} SELECT event_id, concat_ws(',', 'user', CASE WHEN k%2<>0 THEN 'size' END, CASE WHEN k%3<>0 THEN 'cipher' END,
  CASE WHEN k%5<>0 THEN 'note' END) AS kept, cast(user_id AS varchar) AS user_text FROM v_events""",
)
def redaction(t: Tables):
    k = F.col("k")
    names = F.array(
        F.lit("user"), F.when(k % 2 == 0, "Payload").otherwise("size"), F.when(k % 3 == 0, "TLS_KEYS").otherwise("cipher"),
        F.when(k % 5 == 0, "authorization").otherwise("note"),
    )
    context = F.map_from_arrays(names, F.array(F.col("user_id").cast("string"), F.lit("x"), F.lit("y"), F.lit("z")))
    return V.events(t).select("event_id", S.redact(context).alias("c")).select(
        "event_id", F.array_join(F.map_keys("c"), ",").alias("kept"), F.col("c")["user"].alias("user_text")
    )


@query(
    "metadata_conformance",
    """SELECT event_id, CASE WHEN user_id%3<>0 THEN 'output detector_name conflicts with contract'
  WHEN event_id%4=0 THEN 'output score_type conflicts with contract' END AS reject_reason FROM events""",
)
def metadata_conformance(t: Tables):
    rows = t.events.select(
        "event_id", F.when(F.col("user_id") % 3 == 0, "ddos").otherwise("other").alias("detector_name"),
        F.when(F.col("event_id") % 4 == 0, "probability").otherwise("model_score").alias("score_type"),
    )
    return N.check_contract_metadata(rows, {"detector_name": "ddos", "score_type": "model_score"}).select("event_id", "reject_reason")


@query(
    "label_derivation",
    """SELECT event_id, CASE WHEN event_type='error' THEN 1 ELSE 0 END::bigint AS botnet, CASE WHEN event_type='view' THEN 0 ELSE 1 END::bigint AS attack,
  CASE user_id%6 WHEN 0 THEN 'threat_ddos' WHEN 1 THEN 'threat_c2' WHEN 2 THEN 'threat_dga_dns' WHEN 3 THEN 'threat_ddos'
    WHEN 4 THEN 'threat_recon' ELSE 'threat_exfil' END AS family FROM events""",
)
def label_derivation(t: Tables):
    names = F.array(*[F.lit(c) for c in ("DDoS", "Botnet C2", "DNS tunnel", "unknown thing", "Port Scan", "Data Exfiltration")])
    kind = F.col("event_type")
    return t.events.select(
        "event_id", S.is_botnet(F.when(kind == "error", "flow=From-BOTNET-V1").otherwise("flow=Normal")).cast("long").alias("botnet"),
        S.is_not_benign(F.when(kind == "view", "BENIGN").otherwise("PortScan")).cast("long").alias("attack"),
        S.threat_family(F.element_at(names, (F.col("user_id") % 6 + 1).cast("int"))).alias("family"),
    )


def _tls_sessions(t: Tables):
    p = V.packets(t).filter("not flow_complete")
    packets = p.select(
        "uid", F.col("arrival_seq").alias("seq"), "ts", F.col("src").startswith("10.0.").alias("forward"),
        F.col("payload_len").alias("size"), (64 - F.col("tcp_flags") % 8).alias("ttl"), F.col("tcp_flags").alias("flags"),
    )
    k = F.col("o_orderkey")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    sessions = t.orders.select(
        k.cast("string").alias("uid"), (k % 100 + 1).alias("dst_port"), pick("tls", "quic", "tls").alias("proto"),
        pick("TLSv12", "TLSv13", "TLSv10", "QUICv1").alias("version"), F.when(k % 5 != 0, F.concat(F.col("o_orderpriority"), F.lit(".example"))).alias("server_name"),
        pick("h2", "http/1.1").alias("alpn"), (k % 400 - 20).alias("cert_days"),
    )
    return X.tls_flow_features(packets, sessions)


@query("tls_session_features")
def tls_session_features(t: Tables):
    return rounded(_tls_sessions(t))


_GAP_SQL = "(t-lag(t) OVER (PARTITION BY uid{} ORDER BY t, arrival_seq))/1e6"
_TLS_STATS = {
    "fwd_pkt_count": "count(*) FILTER (fw)", "bwd_pkt_count": "count(*) FILTER (NOT fw)", "total_pkt_count": "count(*)", "fwd_byte_count": "sum(payload_len) FILTER (fw)",
    "bwd_byte_count": "sum(payload_len) FILTER (NOT fw)", "total_byte_count": "sum(payload_len)", "fwd_ttl_mean": "avg(64-tcp_flags%8) FILTER (fw)",
    "bwd_ttl_mean": "avg(64-tcp_flags%8) FILTER (NOT fw)", "fwd_iat_mean": "avg(own) FILTER (fw)", "fwd_iat_std": "stddev_samp(own) FILTER (fw)", "fwd_iat_max": "max(own) FILTER (fw)",
    "fwd_iat_min": "min(own) FILTER (fw)", "bwd_iat_mean": "avg(own) FILTER (NOT fw)", "bwd_iat_std": "stddev_samp(own) FILTER (NOT fw)", "overall_iat_mean": "avg(gap)",
    "overall_iat_std": "stddev_samp(gap)", "fwd_pkt_size_max": "max(payload_len) FILTER (fw)", "bwd_pkt_size_max": "max(payload_len) FILTER (NOT fw)",
    "syn_count": "count(*) FILTER (tcp_flags&2<>0)", "ack_count": "count(*) FILTER (tcp_flags&16<>0)", "fin_count": "count(*) FILTER (tcp_flags&1<>0)", "psh_count": "count(*) FILTER (tcp_flags&8<>0)",
}
_TLS_SESSION = {
    "dst_port": "k%100+1", "tls_1_0": "k%4=2", "tls_1_2": "k%4=0", "tls_1_3": "k%4=1", "tls_quic": "k%4=3 OR k%3=1", "has_sni": "k%5<>0", "sni_length": "CASE WHEN k%5<>0 THEN length(name) ELSE 0 END",
    "sni_entropy": "CASE WHEN k%5<>0 THEN ent ELSE 0 END", "cert_expired": "k%400-20<0", "cert_valid_days_remaining": "k%400-20", "alpn_h2": "k%2=0", "alpn_http1_1": "k%2=1", "proto_quic": "k%3=1",
}


@query(
    "tls_session_columns",
    f"""WITH {V.PACKETS_SQL}, g AS (SELECT *, src LIKE '10.0.%' AS fw, {_GAP_SQL.format("")} AS gap, {_GAP_SQL.format(", src LIKE '10.0.%'")} AS own FROM v_packets),
a AS (SELECT uid, {", ".join(f"{v} AS {k}" for k, v in _TLS_STATS.items())} FROM g GROUP BY uid),
c AS (SELECT name, ch, count(*) AS m FROM (SELECT name, unnest(string_split(name,'')) AS ch FROM (SELECT DISTINCT o_orderpriority||'.example' AS name FROM orders)) GROUP BY 1,2),
e AS (SELECT name, -sum(m/w*log2(m/w)) AS ent FROM (SELECT *, sum(m) OVER (PARTITION BY name) AS w FROM c) GROUP BY 1),
s AS (SELECT o_orderkey AS k, e.* FROM orders JOIN e ON e.name=o_orderpriority||'.example')
SELECT uid, {", ".join(f"round(coalesce({k},0)::double,{3 if 'iat' in k else 6}) AS {k}" for k in _TLS_STATS)},
  {", ".join(f"round(coalesce(({v})::double,0),6)+0.0 AS {k}" for k, v in _TLS_SESSION.items())} FROM a JOIN s ON uid=cast(k AS varchar)""",
)
def tls_session_columns(t: Tables):
    """All session features but the spectral ones, which have no SQL."""
    out = _tls_sessions(t).drop("dominant_freq_hz", "dominant_freq_power")
    return rounded(out, **{c: 3 for c in out.columns if "_iat_" in c})


@query(
    "name_entropy",
    """WITH c AS (SELECT c_custkey, unnest(string_split(c_name,'')) AS ch FROM customer),
n AS (SELECT c_custkey, ch, count(*) AS m FROM c GROUP BY 1,2), s AS (SELECT c_custkey, sum(m) AS total FROM n GROUP BY 1)
SELECT n.c_custkey AS k, round(-sum(m/total*log2(m/total)),6)+0.0 AS entropy FROM n JOIN s ON n.c_custkey=s.c_custkey GROUP BY 1""",
)
def name_entropy(t: Tables):
    return rounded(t.customer.select(F.col("c_custkey").alias("k"), entropy(F.col("c_name")).alias("entropy")))

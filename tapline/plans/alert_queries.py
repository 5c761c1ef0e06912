"""Alerts, reports, enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import alerts as A
from ..operators import joins as J
from ..operators import packet_flows as PF
from ..operators import reports as R
from . import views as V
from .registry import Tables, micros, query, rounded

_ID = lambda parts: f"'ALT-'||substr(sha256({parts}),1,16)"


@query("alert_ids", f"SELECT event_id, {_ID(chr(39) + 'ddos|1.0|packet.log:' + chr(39) + '||event_id')} AS alert_id, {_ID('user_id||' + chr(39) + '|' + chr(39) + '||event_type')} AS window_alert_id FROM events")
def alert_ids(t: Tables):
    event = F.concat(F.lit("packet.log:"), F.col("event_id").cast("string"))
    return t.events.select(
        "event_id", S.alert_id(F.lit("ddos"), F.lit("1.0"), event).alias("alert_id"),
        S.alert_id(F.col("user_id"), F.col("event_type")).alias("window_alert_id"),
    )


_DDOS_SCORE_SQL = "abs(fwd-bwd)/(n+1e-9)*0.5+0.5*fwd_bytes/(fwd_bytes+bwd_bytes+1e-9)"


def ddos_detector() -> A.Detector:
    from ..operators.features import DDOS_FEATURES, ddos_features

    keep = ["flow_id", "source_ip", "source_port", "destination_ip", "destination_port", "ip_protocol", "observed_at"]
    return A.Detector(
        name="ddos", contract=DDOS_FEATURES, threshold=0.6, score_type="model_score",
        scorer=F.col("packet_asymmetry") * 0.5 + 0.5 * F.col("fwd_byte_ratio"),
        features=lambda df: ddos_features(df, keep), labels=("Benign", "DDoS"),
    )


@query(
    "threshold_alerts",
    f"""WITH {V.FLOWS_SQL}, s AS (SELECT *, {_DDOS_SCORE_SQL} AS score FROM v_done)
SELECT uid AS flow_id, source_ip, destination_ip, 'DDoS' AS threat_class, 'NEW' AS status, round(score,6) AS raw_model_score, NULL::double AS confidence,
  {_ID("'ddos|1.0|'||uid")} AS alert_id FROM s WHERE score>=0.6""",
)
def threshold_alerts(t: Tables):
    flows = PF.packets_to_flows(V.packets(t)).filter("complete")
    out = A.to_alerts(ddos_detector().run(flows), ["detector", "detector_version", "flow_id"])
    return rounded(out.select("flow_id", "source_ip", "destination_ip", "threat_class", "status", "raw_model_score", "confidence", "alert_id"))


@query(
    "threshold_decisions",
    f"""WITH {V.FLOWS_SQL}, s AS (SELECT {_DDOS_SCORE_SQL} AS score FROM v_done)
SELECT CASE WHEN score>=0.6 THEN 'DETECTED' ELSE 'BENIGN' END AS status, CASE WHEN score>=0.6 THEN 'DDoS' ELSE 'Benign' END AS threat_class, count(*) AS flows FROM s GROUP BY 1,2""",
)
def threshold_decisions(t: Tables):
    flows = PF.packets_to_flows(V.packets(t)).filter("complete")
    return ddos_detector().run(flows).groupBy("status", "threat_class").agg(F.count(F.lit(1)).alias("flows"))


@query(
    "alert_confidence",
    f"""WITH {V.EVENTS_SQL} SELECT event_id, CASE WHEN k%2=0 AND k/80.0 BETWEEN 0 AND 1 THEN round(k/80.0,6)::double END AS confidence,
  CASE WHEN k%2=1 THEN round(k/80.0,6)::double END AS raw_model_score FROM v_events""",
)
def alert_confidence(t: Tables):
    kind = F.when(F.col("k") % 2 == 0, "probability").otherwise("model_score")
    score = F.col("k") / 80.0
    return rounded(
        V.events(t).select("event_id", S.alert_confidence(score, kind).alias("confidence"), S.raw_model_score(score, kind).alias("raw_model_score"))
    )


@query(
    "detector_gate",
    f"""WITH {V.EVENTS_SQL} SELECT 'det-'||(user_id%4) AS detector, CASE user_id%4 WHEN 0 THEN NULL WHEN 1 THEN 'Skipped: artifact is missing'
  ELSE 'Skipped: Detector is not ready_for_inference' END AS reject_reason, count(*) AS rows FROM v_events GROUP BY 1,2""",
)
def detector_gate(t: Tables):
    status = t.spark.createDataFrame(
        [("det-0", True, None), ("det-1", False, "artifact is missing"), ("det-2", False, None)], "detector string, ready boolean, error_reason string"
    )
    rows = V.events(t).select("event_id", F.concat(F.lit("det-"), (F.col("user_id") % 4).cast("string")).alias("detector"))
    good, bad = A.gate_ready(rows, status)
    both = J.concat(good, bad)
    return both.groupBy("detector", "reject_reason").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "failure_ledger",
    f"""WITH {V.EVENTS_SQL} SELECT 'det-'||(user_id%2) AS detector, r AS reject_reason, count(*) AS failures FROM
  (SELECT user_id, CASE WHEN k%3=0 THEN 'late' END AS r FROM v_events UNION ALL SELECT user_id, CASE WHEN k%5=0 THEN 'parse' END FROM v_events) WHERE r IS NOT NULL GROUP BY 1,2""",
)
def failure_ledger(t: Tables):
    rows = V.events(t).withColumn("detector", F.concat(F.lit("det-"), (F.col("user_id") % 2).cast("string")))
    return A.failure_ledger(
        rows.withColumn("reject_reason", F.when(F.col("k") % 3 == 0, "late")), rows.withColumn("reject_reason", F.when(F.col("k") % 5 == 0, "parse"))
    )


@query(
    "event_routing",
    """SELECT d AS detector, count(*) AS events FROM (SELECT unnest(CASE WHEN event_type='click' THEN ['ddos','portscan'] ELSE ['c2_beaconing','malware_tls'] END) AS d FROM events) GROUP BY 1""",
)
def event_routing(t: Tables):
    rows = t.events.select("event_id", F.when(F.col("event_type") == "click", "flow_features").otherwise("conn").alias("event_type"))
    out = A.route(rows, ["ddos", "portscan", "c2_beaconing", "malware_tls"])
    return out.groupBy("detector").agg(F.count(F.lit(1)).alias("events"))


@query(
    "alert_latest_merge",
    f"""WITH {V.ALERTS_SQL} SELECT src_ip, arg_max(event_id, arrival_seq) AS event_id, arg_max(threat_class, arrival_seq) AS threat_class, max(arrival_seq) AS arrival_seq FROM v_alerts GROUP BY 1""",
)
def alert_latest_merge(t: Tables):
    rows = V.alerts(t).select("src_ip", "event_id", "threat_class", "arrival_seq")
    return J.merge_latest(rows, "src_ip", "arrival_seq")


@query(
    "alert_recent_n",
    f"""WITH {V.ALERTS_SQL}, f AS (SELECT user_id, k, min(arrival_seq) AS arrival_seq FROM v_alerts GROUP BY 1,2)
SELECT user_id||'-'||k AS alert_id, arrival_seq FROM f ORDER BY arrival_seq DESC LIMIT 100""",
)
def alert_recent_n(t: Tables):
    rows = V.alerts(t).select(F.concat_ws("-", F.col("user_id").cast("string"), F.col("k").cast("string")).alias("alert_id"), "arrival_seq")
    return A.keep_latest(rows, "alert_id", "arrival_seq", 100)


@query(
    "alert_cooldown",
    f"""WITH {V.ALERTS_SQL}, c AS (SELECT threat_class, src_ip, detector, (t//86400000000)*86400 AS time_bucket, count(*) AS evidence_count, min(t) AS first_seen, max(t) AS last_seen,
  arg_min(flow_id, t) AS first_flow_id, arg_max(flow_id, t) AS last_flow_id FROM v_alerts GROUP BY 1,2,3,4)
SELECT c.*, (SELECT count(*) FROM c b WHERE b.time_bucket=c.time_bucket AND b.evidence_count>c.evidence_count)>=5 AS over_cap FROM c""",
)
def alert_cooldown(t: Tables):
    out = A.dedup_alerts(V.alerts(t), ["threat_class", "src_ip", "detector"], seconds=86_400, rate_cap=5)
    return micros(out, "first_seen", "last_seen")


_INCIDENTS_SQL = f"""WITH {V.ALERTS_SQL}, g AS (SELECT *, CASE WHEN t-lag(t) OVER w>172800000000 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM v_alerts WINDOW w AS (PARTITION BY dst_ip ORDER BY t, event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY dst_ip ORDER BY t, event_id) AS incident_no FROM g),
c AS (SELECT dst_ip, incident_no, threat_class, min(t) AS f, max(t) AS l, count(*) AS m FROM n GROUP BY 1,2,3)
SELECT dst_ip, incident_no::bigint AS incident_no, sum(m)::bigint AS alert_count, count(*) AS class_count, min(f) AS first_seen, max(l) AS last_seen,
  string_agg(threat_class, ' > ' ORDER BY f, threat_class) AS threat_chain FROM c GROUP BY 1,2"""


@query("alert_incidents", _INCIDENTS_SQL)
def alert_incidents(t: Tables):
    return micros(A.correlate_alerts(V.alerts(t), "dst_ip", gap_seconds=172_800), "first_seen", "last_seen")


@query("alert_incidents_chunked", _INCIDENTS_SQL)
def alert_incidents_chunked(t: Tables):
    """The same with every entity cut into chunks."""
    return micros(A.correlate_alerts(V.alerts(t), "dst_ip", gap_seconds=172_800, rows=20), "first_seen", "last_seen")


_SHARED_SQL = """w AS (SELECT event_id, t, unnest([src_ip, dst_ip]) AS asset FROM v_alerts),
g AS (SELECT *, CASE WHEN t-lag(t) OVER (PARTITION BY asset ORDER BY t, event_id)<=1800000000 THEN 0 ELSE 1 END AS fresh FROM w),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY asset ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g),
h AS (SELECT event_id, min(event_id) OVER (PARTITION BY asset, session) AS head FROM n),
e AS MATERIALIZED (SELECT DISTINCT event_id AS a, head AS b FROM h UNION SELECT DISTINCT head, event_id FROM h),
r AS (SELECT a AS event_id, a AS reached FROM e UNION SELECT r.event_id, e.b FROM r JOIN e ON e.a=r.reached),
i AS (SELECT event_id, min(reached) AS incident_id FROM r GROUP BY 1)"""


@query("asset_incidents", f"WITH RECURSIVE {V.ALERTS_SQL}, {_SHARED_SQL} SELECT event_id, incident_id FROM i")
def asset_incidents(t: Tables):
    return A.asset_incidents(V.alerts(t), ["src_ip", "dst_ip"], alert="event_id", gap_seconds=1_800).select("event_id", "incident_id")


@query(
    "asset_incident_summary",
    f"""WITH RECURSIVE {V.ALERTS_SQL}, {_SHARED_SQL}, m AS (SELECT * FROM v_alerts JOIN i USING (event_id)),
c AS (SELECT incident_id, threat_class, min(t) AS f, max(t) AS l, count(*) AS k FROM m GROUP BY 1,2),
d AS (SELECT incident_id, count(DISTINCT asset) AS assets FROM (SELECT incident_id, unnest([src_ip, dst_ip]) AS asset FROM m) GROUP BY 1)
SELECT incident_id, sum(k)::bigint AS alert_count, count(*) AS class_count, min(f) AS first_seen, max(l) AS last_seen, string_agg(threat_class, ' > ' ORDER BY f, threat_class) AS threat_chain,
  any_value(assets) AS asset_count FROM c JOIN d USING (incident_id) GROUP BY 1""",
)
def asset_incident_summary(t: Tables):
    members = A.asset_incidents(V.alerts(t), ["src_ip", "dst_ip"], alert="event_id", gap_seconds=1_800)
    return micros(A.incident_summary(members, ["src_ip", "dst_ip"]), "first_seen", "last_seen")


@query(
    "threat_matrix",
    f"""WITH {V.ALERTS_SQL}, f AS (SELECT *, CASE WHEN lower(threat_class) LIKE '%ddos%' THEN 'threat_ddos' WHEN lower(threat_class) LIKE '%c2%' THEN 'threat_c2'
  WHEN lower(threat_class) LIKE '%dga%' OR lower(threat_class) LIKE '%dns%' THEN 'threat_dga_dns' WHEN lower(threat_class) LIKE '%encrypted sessions%' THEN 'threat_tls'
  WHEN lower(threat_class) LIKE '%recon%' THEN 'threat_recon' WHEN lower(threat_class) LIKE '%exfil%' THEN 'threat_exfil' ELSE 'threat_ddos' END AS family FROM v_alerts)
SELECT family, count(*) AS alert_count, max(t) AS last_seen, arg_max(model, (t, event_id)) FILTER (model IS NOT NULL) AS latest_model, arg_max(src_ip, (t, event_id)) AS latest_src_ip,
  arg_max(dst_ip, (t, event_id)) AS latest_dst_ip, count(*) FILTER (status<>'RESOLVED') AS active_count, count(*) FILTER (severity='CRITICAL') AS critical_count FROM f GROUP BY 1""",
)
def threat_matrix(t: Tables):
    return micros(R.threat_matrix(V.alerts(t), arrival="event_id"), "last_seen")


@query("alert_filter", f"WITH {V.ALERTS_SQL} SELECT event_id, threat_class FROM v_alerts WHERE severity='HIGH' AND status='NEW'")
def alert_filter(t: Tables):
    return A.filter_alerts(V.alerts(t), "HIGH", "NEW", active=True).select("event_id", "threat_class")


@query(
    "alert_acknowledge",
    f"""WITH {V.ALERTS_SQL} SELECT event_id, CASE WHEN status='NEW' AND severity='CRITICAL' THEN 'ACKNOWLEDGED' ELSE status END AS status FROM v_alerts""",
)
def alert_acknowledge(t: Tables):
    rows = V.alerts(t)
    return A.acknowledge(rows, rows.filter("severity = 'CRITICAL'"), "event_id").select("event_id", "status")


@query(
    "evidence_hash",
    f"""WITH {V.ALERTS_SQL} SELECT event_id, sha256('{{"dst_ip":"'||dst_ip||'","flow_id":"'||flow_id||'","model":'||coalesce('"'||model||'"','null')||'}}') AS evidence_hash,
  CASE WHEN model IS NULL THEN 'model' ELSE '' END AS missing_lineage FROM v_alerts""",
)
def evidence_hash(t: Tables):
    out = A.evidence_hash(V.alerts(t), ["flow_id", "model", "dst_ip"])
    return out.select("event_id", "evidence_hash", F.array_join("missing_lineage", ",").alias("missing_lineage"))


@query(
    "evidence_bundle",
    f"""WITH {V.ALERTS_SQL} SELECT flow_id AS alert_id, '{{"threat_class":"'||replace(threat_class,'/','/')||'","src_ip":"'||src_ip||'"}}' AS bundle FROM v_alerts""",
)
def evidence_bundle(t: Tables):
    return A.evidence_bundle(V.alerts(t).withColumn("alert_id", F.col("flow_id")), ["threat_class", "src_ip"])


@query(
    "risk_score",
    f"""WITH {V.ALERTS_SQL}, p AS (SELECT event_id, least(value/300.0,1.0) AS s, CASE k%5 WHEN 0 THEN NULL WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 WHEN 3 THEN 0.75 ELSE 1.0 END AS c, k/100.0 AS q, (user_id%10)/10.0 AS i FROM v_alerts),
r AS (SELECT event_id, (s*0.4+coalesce(c*0.3,0)+q*0.2+i*0.1)/(0.7+CASE WHEN c IS NULL THEN 0 ELSE 0.3 END) AS risk FROM p)
SELECT event_id, round(risk,6)::double AS risk_score, CASE WHEN round(risk,9)>=0.8 THEN 'CRITICAL' WHEN round(risk,9)>=0.6 THEN 'HIGH' WHEN round(risk,9)>=0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM r""",
)
def risk_score(t: Tables):
    levels = F.array(F.lit(None).cast("string"), F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH"), F.lit("CRITICAL"))
    rows = V.alerts(t).select(
        "event_id", F.least(F.col("value") / 300.0, F.lit(1.0)).alias("score"), F.element_at(levels, (F.col("k") % 5 + 1).cast("int")).alias("criticality"),
        (F.col("k") / 100.0).alias("persistence"), ((F.col("user_id") % 10) / 10.0).alias("impact"),
    )
    return rounded(A.risk_score(rows, "score", "criticality", "persistence", "impact").select("event_id", "risk_score", "severity"))


@query(
    "incident_state",
    f"""WITH {V.ALERTS_SQL}, s AS (SELECT user_id%20 AS incident_id, t, event_id, CASE k%7 WHEN 0 THEN 'NEW' WHEN 1 THEN 'ACKNOWLEDGED' WHEN 2 THEN 'INVESTIGATING' WHEN 3 THEN 'CONFIRMED'
  WHEN 4 THEN 'FALSE_POSITIVE' WHEN 5 THEN 'RESOLVED' ELSE 'bogus' END AS state FROM v_alerts)
SELECT v.incident_id, arg_max(state, t) AS state, max(t) AS since, count(*) AS changes, any_value(n) AS linked_alerts
FROM s v JOIN (SELECT incident_id, count(DISTINCT event_id) AS n FROM s GROUP BY 1) l ON v.incident_id=l.incident_id WHERE state<>'bogus' GROUP BY 1""",
)
def incident_state(t: Tables):
    names = F.array(*[F.lit(s) for s in A.INCIDENT_STATES], F.lit("bogus"))
    rows = V.alerts(t).select((F.col("user_id") % 20).alias("incident_id"), "ts", "event_id", F.element_at(names, (F.col("k") % 7 + 1).cast("int")).alias("state"))
    return micros(A.incident_state(rows, alert="event_id"), "since")


@query("alert_retention", f"WITH {V.ALERTS_SQL} SELECT event_id FROM v_alerts WHERE t >= epoch_us((SELECT max(ts) FROM events) - INTERVAL 7 DAYS)")
def alert_retention(t: Tables):
    return A.apply_retention(V.alerts(t), "ts", t.events.agg(F.max("ts")).scalar(), 7).select("event_id")


# --- reports -----------------------------------------------------------------------------------


@query(
    "run_report",
    f"""WITH {V.EVENTS_SQL}, r AS (SELECT CASE event_type WHEN 'click' THEN 'packet' WHEN 'view' THEN 'conn' ELSE 'dns' END AS kind, k, value FROM v_events)
SELECT count(*) AS input_records, 60.0::double AS elapsed_seconds, round(count(*)/60.0,6)::double AS input_records_per_second, count(*) FILTER (kind='conn') AS conn_records,
  round(count(*) FILTER (kind='conn')/60.0,6)::double AS flows_per_second, count(*) FILTER (kind='packet') AS packet_records, (sum(k) FILTER (kind='packet'))::bigint AS packet_count,
  round((sum(k) FILTER (kind='packet'))/60.0,6)::double AS packets_per_second, NULL::bigint AS packet_bytes, NULL::double AS megabits_per_second FROM r""",
)
def run_report(t: Tables):
    kind = F.when(F.col("event_type") == "click", "packet").when(F.col("event_type") == "view", "conn").otherwise("dns")
    rows = V.events(t).select(kind.alias("kind"), "k", F.when(F.col("k") % 10 != 0, F.col("k") * 10).alias("size"))
    return rounded(R.run_report(rows, "kind", "k", "size", 60.0))


@query("records_by_type", "SELECT event_type, count(*) AS records FROM events GROUP BY 1")
def records_by_type(t: Tables):
    return R.records_by_type(t.events, "event_type")


@query(
    "stage_accounting",
    f"""WITH {V.EVENTS_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (k%10=0) AS a, count(*) FILTER (k%10=1) AS b, count(*) FILTER (user_id%9=0) AS d FROM v_events)
SELECT 'parse' AS stage, a AS records, round(a/n,6) AS share FROM c UNION ALL SELECT 'normalise', b, round(b/n,6) FROM c UNION ALL SELECT 'detector', d, round(d/n,6) FROM c""",
)
def stage_accounting(t: Tables):
    k = F.col("k")
    return rounded(R.stage_accounting(V.events(t), {"parse": k % 10 == 0, "normalise": k % 10 == 1, "detector": F.col("user_id") % 9 == 0}))


def _marks(t: Tables):
    at = lambda ms: F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (ms * 1000).cast("long"))
    k = F.col("k")
    return V.events(t).select(
        "event_id", "sensor", F.col("ts").cast("timestamp").alias("observed_at"), at(k).alias("ingested_at"), at(k * 2 - 10).alias("ordered_at"),
        F.when(k % 3 != 0, at(k * 3)).alias("feature_ready_at"), F.when(k % 5 != 0, at(k * 7)).alias("alert_created_at"),
    )


_MARKS_SQL = """d AS (SELECT event_id, 'queue_wait' AS metric, greatest(0,k-10)/1000.0::double AS v FROM v_events UNION ALL
  SELECT event_id, 'window_wait', greatest(0,k+10)/1000.0::double FROM v_events WHERE k%3<>0 UNION ALL
  SELECT event_id, 'capture_to_alert', k*7/1000.0::double FROM v_events WHERE k%5<>0 AND sensor<>0)"""


def _durations(t: Tables):
    out = R.latency_durations(_marks(t), capture=F.col("sensor") != 0)
    return out.select("event_id", F.explode("durations").alias("metric", "v"))


@query("latency_durations", f"WITH {V.EVENTS_SQL}, {_MARKS_SQL} SELECT event_id, metric, round(v,6) AS v FROM d")
def latency_durations(t: Tables):
    return rounded(_durations(t))


@query(
    "latency_report",
    f"""WITH {V.EVENTS_SQL}, {_MARKS_SQL} SELECT metric, count(*) AS "count", max(v) AS "max", round(quantile_cont(v,0.5),6) AS p50, round(quantile_cont(v,0.95),6) AS p95,
  round(quantile_cont(v,0.99),6) AS p99 FROM d GROUP BY 1""",
)
def latency_report(t: Tables):
    return rounded(R.latency_report(_durations(t), "metric", "v"))


@query(
    "score_summary",
    f"""WITH {V.SCORED_SQL} SELECT count(*) AS flows, count(*) FILTER (score>=0.6) AS malware, count(*) FILTER (score<0.6) AS benign, min(score) AS "min", round(avg(score),6) AS mean, max(score) AS "max",
  count(*) FILTER (score>0.5) AS over_50, count(*) FILTER (score>0.8) AS over_80, count(*) FILTER (score>0.95) AS over_95, round(count(*) FILTER (score>=0.6)/count(*)*100,6) AS malware_percent,
  round(count(*) FILTER (score<0.6)/count(*)*100,6) AS benign_percent, round(quantile_cont(score,0.5),6) AS median FROM v_scored""",
)
def score_summary(t: Tables):
    return rounded(R.score_summary(V.scored(t), "score", 0.6))


# --- enrichment --------------------------------------------------------------------------------


@query(
    "asset_enrich",
    """SELECT l_orderkey, l_linenumber::bigint AS l_linenumber, l_suppkey, o_custkey, c_name AS src_name, c_mktsegment AS src_zone, s_name AS dst_name FROM lineitem JOIN orders ON l_orderkey=o_orderkey
LEFT JOIN customer ON c_custkey=o_custkey LEFT JOIN supplier ON s_suppkey=l_suppkey""",
)
def asset_enrich(t: Tables):
    flows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_suppkey", "o_custkey")
    src = t.customer.select(F.col("c_custkey").alias("ip"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("zone"))
    dst = t.supplier.select(F.col("s_suppkey").alias("ip"), F.col("s_name").alias("name"))
    out = J.enrich_assets(flows, src, "ip", {"src": "o_custkey"})
    return J.enrich_assets(out.drop("dst_zone"), dst, "ip", {"dst": "l_suppkey"})


@query(
    "expected_peers",
    """SELECT o_custkey, count(*) AS unexpected FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders e WHERE e.o_orderstatus='F' AND e.o_custkey=o.o_custkey AND e.o_orderpriority=o.o_orderpriority) GROUP BY 1""",
)
def expected_peers(t: Tables):
    flows = t.orders.select("o_custkey", "o_orderpriority")
    expected = t.orders.filter("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority").distinct()
    return J.unexpected_flows(flows, expected, ["o_custkey", "o_orderpriority"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("unexpected"))


@query(
    "dns_match",
    f"""WITH {V.EVENTS_SQL}, q AS (SELECT event_id AS query_id, sensor, k%5 AS tx, t FROM v_events WHERE event_type<>'view'), r AS (SELECT sensor, k%5 AS tx, t FROM v_events WHERE event_type='view')
SELECT query_id, (SELECT min(r.t) FROM r WHERE r.sensor=q.sensor AND r.tx=q.tx AND r.t>=q.t AND r.t-q.t<=43200000000) AS response_us FROM q""",
)
def dns_match(t: Tables):
    rows = V.events(t).withColumn("tx", F.col("k") % 5)
    is_view = F.col("event_type") == "view"
    queries = rows.filter(~is_view).select(F.col("event_id").alias("query_id"), "sensor", "tx", F.col("ts").alias("query_ts"))
    responses = rows.filter(is_view).select("sensor", "tx", F.col("ts").alias("response_ts"))
    out = J.match_dns(queries, responses, ["sensor", "tx"], 43_200.0)
    return micros(out.withColumnRenamed("response_ts", "response_us"), "response_us").select("query_id", "response_us")


def _scenarios(t: Tables):
    hour = F.date_trunc("hour", F.col("ts"))
    return V.events(t).select(
        F.col("event_id").alias("scenario_id"), "user_id", hour.alias("start_time"), (hour + F.expr("INTERVAL 2 DAYS")).alias("end_time")
    )


_SCENARIO_SQL = """s AS (SELECT event_id AS scenario_id, user_id, (t//3600000000)*3600000000 AS s0, (t//3600000000)*3600000000+172800000000 AS s1 FROM v_events),
m AS (SELECT scenario_id, a.event_id, a.t, s0 FROM s JOIN v_alerts a ON a.user_id=s.user_id AND a.t>=s0 AND a.t<=s1)"""


@query("ground_truth_match", f"WITH {V.ALERTS_SQL}, {_SCENARIO_SQL} SELECT scenario_id, event_id FROM m")
def ground_truth_match(t: Tables):
    return J.match_ground_truth(V.alerts(t), _scenarios(t), ["user_id"], slot_seconds=86_400).select("scenario_id", "event_id")


@query(
    "detection_latency",
    f"""WITH {V.ALERTS_SQL}, {_SCENARIO_SQL}, f AS (SELECT scenario_id, count(*) AS n, min(t) AS d FROM m GROUP BY 1)
SELECT s.scenario_id, coalesce(n,0) AS alert_count, d AS first_detection, round((d-s0)/1e6,6) AS detection_latency, d IS NULL AS missed FROM s LEFT JOIN f ON s.scenario_id=f.scenario_id""",
)
def detection_latency(t: Tables):
    out = J.detection_latency(V.alerts(t), _scenarios(t), ["user_id"])
    return rounded(micros(out.drop("start_time", "end_time", "user_id"), "first_detection"))

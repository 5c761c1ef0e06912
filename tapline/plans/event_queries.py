"""Ordering, windows, rolling context and per-threat aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import beacon as B
from ..operators import ordering as O
from ..operators import rolling as R
from ..operators import splits as L
from ..operators import threats as T
from ..operators import windows as W
from ..operators.normalize import five_tuple
from ..operators.reports import replay_schedule
from . import views as V
from .registry import Tables, micros, query, rounded

LATENESS = 3600.0

_ORDER_SQL = (
    V.EVENTS_SQL
    + """,
o1 AS (SELECT *, max(t) OVER (PARTITION BY sensor ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rm,
  max(t) OVER (PARTITION BY sensor ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v_events),
o2 AS (SELECT *, coalesce(t<before,false) AS late, t<rm-3600000000 AS too_late FROM o1),
o3 AS (SELECT a.*, (SELECT min(b.arrival_seq) FROM o1 b WHERE b.sensor=a.sensor AND b.rm>=a.t+3600000000 AND b.arrival_seq>=a.arrival_seq) AS reached FROM o2 a)"""
)


@query("late_flags", f"WITH {_ORDER_SQL} SELECT event_id, sensor, late, too_late FROM o2")
def late_flags(t: Tables):
    return O.late_flags(V.events(t), ["sensor"], "ts", "arrival_seq", LATENESS).select("event_id", "sensor", "late", "too_late")


@query(
    "reorder_release_order",
    f"""WITH {_ORDER_SQL} SELECT event_id, sensor, too_late, reached AS release_arrival,
  row_number() OVER (PARTITION BY sensor ORDER BY coalesce(reached, 9223372036854775807), t, arrival_seq) AS release_seq
FROM o3 WHERE NOT too_late""",
)
def reorder_release_order(t: Tables):
    out = O.reorder(V.events(t), ["sensor"], "ts", "arrival_seq", LATENESS, "quarantine", number=True)
    return out.filter(~F.col("quarantined")).select("event_id", "sensor", "too_late", "release_arrival", "release_seq")


@query(
    "reorder_release_late",
    f"""WITH {_ORDER_SQL} SELECT event_id, sensor, too_late, CASE WHEN too_late THEN arrival_seq ELSE reached END AS release_arrival FROM o3""",
)
def reorder_release_late(t: Tables):
    return O.reorder(V.events(t), ["sensor"], "ts", "arrival_seq", LATENESS, "release").select(
        "event_id", "sensor", "too_late", "release_arrival"
    )


@query("quarantine_late", f"WITH {_ORDER_SQL} SELECT event_id, sensor, t AS ts_us FROM o2 WHERE too_late")
def quarantine_late(t: Tables):
    out = O.reorder(V.events(t), ["sensor"], "ts", "arrival_seq", LATENESS, "quarantine").filter("quarantined")
    return micros(out.select("event_id", "sensor", F.col("ts").alias("ts_us")), "ts_us")


@query(
    "reorder_stats",
    f"""WITH {_ORDER_SQL}, kept AS (SELECT * FROM o3 WHERE NOT too_late),
d AS (SELECT a.sensor, (SELECT count(*) FROM kept b WHERE b.sensor=a.sensor AND b.arrival_seq<=a.arrival_seq)
   - (SELECT count(*) FROM kept b WHERE b.sensor=a.sensor AND b.reached<a.arrival_seq) AS depth FROM kept a),
p AS (SELECT sensor, max(depth) AS peak FROM d GROUP BY sensor)
SELECT o3.sensor, count(*) AS events, count(*) FILTER (NOT too_late) AS events_accepted, count(*) FILTER (NOT too_late) AS events_released,
  count(*) FILTER (late) AS late_events, count(*) FILTER (too_late) AS too_late_events, any_value(peak) AS peak_buffer_depth
FROM o3 JOIN p ON o3.sensor=p.sensor GROUP BY o3.sensor""",
)
def reorder_stats(t: Tables):
    out = O.reorder(V.events(t), ["sensor"], "ts", "arrival_seq", LATENESS, "quarantine")
    return rounded(O.reorder_stats(out, ["sensor"], "arrival_seq"))


@query(
    "order_violations",
    f"""WITH {V.EVENTS_SQL}, o AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM v_events)
SELECT event_id, user_id, CASE WHEN t<m THEN 'Window events must be timestamp-ordered' END AS reject_reason FROM o""",
)
def order_violations(t: Tables):
    return W.order_violations(V.events(t), ["user_id"], "ts", "arrival_seq").select("event_id", "user_id", "reject_reason")


CONTEXT, INTERVAL = 2 * 86_400.0, 86_400.0

_WINDOW_SQL = (
    V.EVENTS_SQL
    + """,
w1 AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS prev, min(t) OVER (PARTITION BY user_id) AS t0 FROM v_events),
w2 AS (SELECT *, floor((prev-t0)/86400000000.0)::bigint+1 AS k1, floor((t-t0)/86400000000.0)::bigint AS k2 FROM w1 WHERE prev IS NOT NULL),
w3 AS (SELECT w2.*, unnest(range(k1,k2+1)) AS kk FROM w2 WHERE k2>=k1),
ctx AS (SELECT a.user_id, a.event_id, b.event_id AS member, b.k AS member_k FROM (SELECT DISTINCT user_id, event_id, t FROM w3) a JOIN v_events b
  ON a.user_id=b.user_id AND b.t>=a.t-172800000000 AND (b.t<a.t OR (b.t=a.t AND b.event_id<=a.event_id)))"""
)


@query(
    "context_windows",
    f"""WITH {_WINDOW_SQL}, c AS (SELECT user_id, event_id, count(*) AS n, cast(sum(member_k) AS bigint) AS s FROM ctx GROUP BY 1,2)
SELECT w3.user_id, kk AS k, t0+(kk-1)*86400000000 AS scoring_start, t0+kk*86400000000 AS scoring_end, w3.event_id AS trigger_seq,
  n AS context_count, s AS context_k FROM w3 JOIN c ON w3.user_id=c.user_id AND w3.event_id=c.event_id""",
)
def context_windows(t: Tables):
    out = W.context_windows(V.events(t), ["user_id"], "ts", "event_id", CONTEXT, INTERVAL, ["k"])
    return rounded(micros(out, "scoring_start", "scoring_end").drop("triggered_at"))


@query("context_members", f"WITH {_WINDOW_SQL} SELECT user_id, event_id AS trigger_seq, member AS event_id FROM ctx")
def context_members(t: Tables):
    return W.context_members(V.events(t), ["user_id"], "ts", "event_id", CONTEXT, INTERVAL).select("user_id", "trigger_seq", "event_id")


@query(
    "window_flush",
    f"""WITH {V.EVENTS_SQL}, l AS (SELECT user_id, max(t) AS last, arg_max(event_id, t) AS last_seq FROM v_events GROUP BY 1)
SELECT e.user_id, any_value(last) AS scoring_start, any_value(last) AS scoring_end, any_value(last_seq) AS last_seq, count(*) AS context_count
FROM v_events e JOIN l ON e.user_id=l.user_id WHERE t>=last-172800000000 GROUP BY e.user_id""",
)
def window_flush(t: Tables):
    out = W.window_flush(V.events(t), ["user_id"], "ts", "event_id", CONTEXT)
    return micros(out, "scoring_start", "scoring_end")


@query(
    "expired_keys",
    f"""WITH {V.EVENTS_SQL} SELECT user_id, max(t) AS last_us FROM v_events GROUP BY 1
HAVING (SELECT max(t) FROM v_events) - max(t) >= 86400000000""",
)
def expired_keys(t: Tables):
    reference = t.events.agg(F.max("ts")).scalar()
    out = W.expire_keys(V.events(t), ["user_id"], "ts", reference, 86_400.0)
    return micros(out.withColumnRenamed("last_observed_at", "last_us"), "last_us")


@query(
    "scoring_dedup",
    f"""WITH {V.EVENTS_SQL}, u AS (SELECT user_id%3 AS detector, event_id//2 AS event FROM v_events)
SELECT detector, count(DISTINCT event) AS opportunities FROM u GROUP BY 1""",
)
def scoring_dedup(t: Tables):
    rows = V.events(t).select((F.col("user_id") % 3).alias("detector"), F.floor(F.col("event_id") / 2).alias("event"))
    return W.dedup_scoring(rows, ["detector", "event"]).groupBy("detector").agg(F.count(F.lit(1)).alias("opportunities"))


@query(
    "scoring_opportunities",
    f"""WITH {V.EVENTS_SQL} SELECT user_id%3 AS detector, sensor, (t//3600000000)*3600 AS scoring_start, event_type AS context, count(*) AS repeats FROM v_events GROUP BY 1,2,3,4""",
)
def scoring_opportunities(t: Tables):
    """Each (detector, key, interval, context) once, and how many rows asked for it."""
    hour = F.unix_seconds(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    rows = V.events(t).select((F.col("user_id") % 3).alias("detector"), "sensor", hour.alias("scoring_start"), F.col("event_type").alias("context"))
    identity = ["detector", "sensor", "scoring_start", "context"]
    asked = rows.groupBy(*identity).agg(F.count(F.lit(1)).alias("repeats"))
    return W.dedup_scoring(rows, identity).join(asked, identity)


@query(
    "five_tuple",
    f"""WITH {V.PACKETS_SQL} SELECT src AS source_ip, dst AS destination_ip, proto AS protocol, count(*) AS packets FROM v_packets
GROUP BY src, dst, src_port, dst_port, proto""",
)
def five_tuple_counts(t: Tables):
    p = V.packets(t).filter("not flow_complete")
    named = p.withColumnsRenamed({"src": "source_ip", "dst": "destination_ip", "src_port": "source_port", "dst_port": "destination_port", "proto": "protocol"})
    return five_tuple(named).groupBy("grouping_key").agg(F.count(F.lit(1)).alias("packets")).select(
        "grouping_key.source_ip", "grouping_key.destination_ip", "grouping_key.protocol", "packets"
    )


@query(
    "tumbling_windows",
    f"""WITH {V.EVENTS_SQL} SELECT event_type, (t//3600000000)*3600000000 AS window_start, count(*) AS events, round(sum(value),4) AS total
FROM v_events GROUP BY 1,2""",
)
def tumbling_windows(t: Tables):
    out = W.window_agg(V.events(t), ["event_type"], "ts", "1 hour", None, {"events": F.count(F.lit(1)), "total": F.sum("value")})
    return rounded(micros(out, "window_start").drop("window_end"), 4)


@query(
    "sliding_windows",
    f"""WITH {V.EVENTS_SQL}, s AS (SELECT sensor, value, unnest([(t//21600000000)*21600000000, (t//21600000000-1)*21600000000]) AS window_start FROM v_events)
SELECT sensor, window_start, count(*) AS events, round(max(value),6) AS peak FROM s GROUP BY 1,2""",
)
def sliding_windows(t: Tables):
    out = W.window_agg(V.events(t), ["sensor"], "ts", "12 hours", "6 hours", {"events": F.count(F.lit(1)), "peak": F.max("value")})
    return rounded(micros(out, "window_start").drop("window_end"))


@query(
    "replay_schedule",
    f"""WITH {V.EVENTS_SQL} SELECT event_id, round(event_id/500.0,6) AS fixed_rate, round((t-(SELECT min(t) FROM v_events))/1e6,6) AS preserving FROM v_events""",
)
def replay(t: Tables):
    fixed = replay_schedule(V.events(t), "FIXED_RATE", "event_id", "ts", 500.0).withColumnRenamed("due_seconds", "fixed_rate")
    out = replay_schedule(fixed, "TIMESTAMP_PRESERVING", "event_id", "ts").withColumnRenamed("due_seconds", "preserving")
    return rounded(out.select("event_id", "fixed_rate", "preserving"))


# --- rolling context ---------------------------------------------------------------------------


def _rolling_sql(expr: str) -> str:
    frame = "(PARTITION BY user_id ORDER BY event_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"WITH {V.EVENTS_SQL} SELECT event_id, user_id, {expr} FROM v_events".replace("FRAME5", frame.format(n=5)).replace("FRAME20", frame.format(n=20))


_AVG = lambda c, n: f"round(coalesce(avg({c}) OVER FRAME{n},0),6)+0.0 AS {c}_prev{n}_mean"
_STD = lambda c, n: f"round(coalesce(stddev_samp({c}) OVER FRAME{n},0),6)+0.0 AS {c}_prev{n}_std"


@query("rolling_context_5_20", _rolling_sql(", ".join(f(c, n) for c in ("value", "k") for n in (5, 20) for f in (_AVG, _STD))))
def rolling_context(t: Tables):
    rows = V.events(t).select("event_id", "user_id", "value", "k")
    return rounded(R.rolling_context(rows, ["user_id"], "event_id", ["value", "k"]).drop("value", "k"))


@query("rolling_context_chunked", _rolling_sql(", ".join(f(c, n) for c in ("value", "k") for n in (5, 20) for f in (_AVG, _STD))))
def rolling_context_chunked(t: Tables):
    """The same as ``rolling_context_5_20`` with every key cut into chunks, as a key of millions of rows is."""
    rows = V.events(t).select("event_id", "user_id", "value", "k")
    return rounded(R.rolling_context(rows, ["user_id"], "event_id", ["value", "k"], rows=20).drop("value", "k"))


@query("delta_prev", _rolling_sql("round(value-lag(value) OVER (PARTITION BY user_id ORDER BY event_id),6)+0.0 AS value_delta_prev, k-lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS k_delta_prev"))
def delta_prev(t: Tables):
    rows = V.events(t).select("event_id", "user_id", "value", "k")
    return rounded(R.delta_prev(rows, ["user_id"], "event_id", ["value", "k"]).drop("value", "k"))


@query("deviation_prev20", _rolling_sql("round(value-avg(value) OVER FRAME20,6)+0.0 AS value_vs_prev20"))
def deviation_prev20(t: Tables):
    rows = V.events(t).select("event_id", "user_id", "value")
    return rounded(R.vs_prev(rows, ["user_id"], "event_id", ["value"]).drop("value"))


def _dns(t: Tables):
    """Events as DNS records in their own columns."""
    k, v = F.col("k"), F.col("value")
    return V.events(t).select(
        "event_id", "user_id", (k % 9).cast("double").alias("rr_count"), (k * 10).cast("double").alias("ttl_range"),
        v.alias("ttl_variance"), (v / 2).alias("ttl_mean"), (k % 40).cast("double").alias("rr_name_length"),
        (k % 4).cast("double").alias("PTR_frequency"), (k % 2).cast("double").alias("is_PTR_record"),
        (k % 3 > 0).cast("double").alias("reverse_dns_known"), (k % 6).cast("double").alias("ttl_unique_count"),
        (v / 100).alias("rr_entropy_per_length"),
    )


_DNS_VALUE = {
    "rr_count": "k%9", "ttl_range": "k*10", "ttl_variance": "value", "ttl_mean": "value/2", "rr_name_length": "k%40",
    "PTR_frequency": "k%4", "is_PTR_record": "k%2", "reverse_dns_known": "CASE WHEN k%3>0 THEN 1 ELSE 0 END",
    "ttl_unique_count": "k%6", "rr_entropy_per_length": "value/100",
}


def _exfil_sql() -> str:
    out = []
    for name in R.EXFIL_FEATURES:
        column, _, stat = name.rsplit("_", 2)
        f = "avg" if stat == "mean" else "stddev_samp"
        out.append(f"round(coalesce({f}({_DNS_VALUE[column]}) OVER FRAME20,0),8)+0.0 AS {name}")
    return _rolling_sql(", ".join([*out, "count(*) OVER FRAME20 AS history_records_used"]))


@query("exfil_context", _exfil_sql())
def exfil_context(t: Tables):
    out = R.exfil_context(_dns(t), ["user_id"], "event_id", derive=False)
    return rounded(out.select("event_id", "user_id", *R.EXFIL_FEATURES, "history_records_used"), 8)


# --- beacons -----------------------------------------------------------------------------------

_BEACON_COLUMNS = ", ".join(
    f"max(CASE WHEN lower(protocol)='{p}' THEN 1.0::double ELSE 0.0::double END) AS \"Proto_{p}\"" for p in B.PROTOCOLS
)


@query(
    "beacon_windows",
    f"""WITH {V.FLOW_RECORDS_SQL}, b0 AS (SELECT src, dst, min(h) AS h0, max(h) AS h1 FROM v_flows GROUP BY 1,2),
b1 AS (SELECT f.*, h0, h1, unnest([floor((h-h0)/60.0)::bigint-1, floor((h-h0)/60.0)::bigint]) AS window_index FROM v_flows f JOIN b0 ON f.src=b0.src AND f.dst=b0.dst),
b2 AS (SELECT *, h-lag(h) OVER (PARTITION BY src, dst, window_index ORDER BY h, event_id) AS gap FROM b1 WHERE window_index>=0 AND h0+window_index*60.0<h1)
SELECT src, dst, window_index, round(any_value(h0+window_index*60.0),6) AS window_start, count(*) AS flows, round(max(h)-min(h),6) AS "Dur",
  sum(pkts)::double AS "Pkts", sum(bytes)::double AS "Bytes", round(avg(gap),6) AS "IAT", round(var_pop(gap),3) AS "IAT_Variance",
  round(stddev_pop(gap),6) AS "IAT_Std", round(var_pop(bytes),2) AS "Bytes_Variance",
  round(CASE WHEN sum(pkts)<>0 THEN sum(bytes)/sum(pkts) ELSE 0 END,6) AS "Bytes_Per_Packet", {_BEACON_COLUMNS},
  max(CASE WHEN rev THEN 1.0::double ELSE 0.0::double END) AS "FlowDir_Reverse", max(target)::bigint AS label
FROM b2 GROUP BY src, dst, window_index HAVING count(*)>=2""",
)
def beacon_windows(t: Tables):
    out = B.beacon_features(V.flows(t), width=120.0, step=60.0)
    return rounded(out, IAT_Variance=3, Bytes_Variance=2)


@query(
    "iat_stats",
    f"""WITH {V.FLOW_RECORDS_SQL}, g AS (SELECT src, (t-lag(t) OVER (PARTITION BY src ORDER BY t, event_id))/1e6 AS gap FROM v_flows)
SELECT src, count(*) AS flow_count, round(avg(gap),3) AS iat_mean, round(stddev_samp(gap),3) AS iat_std,
  round(min(gap),6) AS iat_min, round(max(gap),6) AS iat_max FROM g GROUP BY 1""",
)
def iat_stats(t: Tables):
    out = B.gaps_by_time(V.flows(t), ["src"], "ts").drop("iat_var_pop")
    return rounded(out, iat_mean=3, iat_std=3)


@query(
    "inter_arrival",
    f"""WITH {V.EVENTS_SQL} SELECT event_id, user_id, round((t-lag(t) OVER (PARTITION BY user_id ORDER BY event_id))/1e6,6) AS iat_seconds FROM v_events""",
)
def inter_arrival(t: Tables):
    out = B.iat(V.events(t), ["user_id"], "event_id", "ts")
    return rounded(out.select("event_id", "user_id", "iat_seconds"))


@query(
    "beacon_periodicity",
    f"""WITH {V.FLOW_RECORDS_SQL}, g AS (SELECT src, t, event_id, (t-lag(t) OVER w)/1e6 AS gap, (lag(t) OVER w-lag(t,2) OVER w)/1e6 AS prev,
  (lag(t,2) OVER w-lag(t,3) OVER w)/1e6 AS prev2, (lag(t,5) OVER w-lag(t,6) OVER w)/1e6 AS prev5 FROM v_flows WINDOW w AS (PARTITION BY src ORDER BY t, event_id)),
s AS (SELECT src, count(*) AS n, avg(gap) AS m, stddev_pop(gap) AS d, min(gap) AS lo, max(gap) AS hi, quantile_cont(gap, 0.5) AS med,
  corr(CASE WHEN prev IS NOT NULL THEN gap END, prev) AS ac, corr(CASE WHEN prev2 IS NOT NULL THEN gap END, prev2) AS ac2,
  corr(CASE WHEN prev5 IS NOT NULL THEN gap END, prev5) AS ac5 FROM g GROUP BY 1),
r AS (SELECT g.src, count(*) FILTER (abs(gap-med)<=0.1*med)/count(*) AS regular FROM g JOIN s ON g.src=s.src WHERE gap IS NOT NULL GROUP BY 1),
u AS (SELECT src, 1-count(DISTINCT dst)/count(*) AS rep FROM v_flows GROUP BY 1),
p AS (SELECT src, dst_port, count(*) AS c FROM v_flows GROUP BY 1,2), q AS (SELECT src, sum(c) AS total FROM p GROUP BY 1),
e AS (SELECT p.src, -sum(c/total*log2(c/total)) AS ent FROM p JOIN q ON p.src=q.src GROUP BY 1)
SELECT s.src, n AS flow_count, round(m,3) AS iat_mean, round(d,3) AS iat_std, round(lo,6) AS iat_min, round(hi,6) AS iat_max, cast(round(med*2e6) AS bigint) AS iat_median_half_us,
  round(ac,6)+0.0 AS autocorrelation, round(ac2,6)+0.0 AS autocorrelation_2, round(ac5,6)+0.0 AS autocorrelation_5, round(d/m,6) AS iat_cv, round((d-m)/(d+m),6)+0.0 AS burstiness,
  round(ent,6)+0.0 AS destination_port_entropy, round(regular,6) AS periodicity_score, round(rep,6) AS destination_repetition
FROM s JOIN e ON s.src=e.src JOIN u ON s.src=u.src LEFT JOIN r ON s.src=r.src""",
)
def beacon_periodicity(t: Tables):
    out = B.beacon_periodicity(V.flows(t), ["src"], "ts", "event_id", "dst_port", destination="dst", lags=(1, 2, 5))
    # A median lies on half microseconds: compared as a whole number, no rounding is left to differ.
    halves = F.round(F.col("iat_median") * 2e6).cast("long")
    return rounded(out.withColumn("iat_median_half_us", halves).drop("iat_median"), iat_mean=3, iat_std=3)


# --- per-threat aggregates ---------------------------------------------------------------------


def _entropy_sql(name: str, key: str, value: str) -> str:
    return f"""{name}c AS (SELECT {key}, {value} AS v, count(*) AS c FROM x GROUP BY {key}, v),
{name}t AS (SELECT {key}, sum(c) AS total, count(*) AS d FROM {name}c GROUP BY {key}),
{name} AS (SELECT {name}c.*, total, d FROM {name}c JOIN {name}t USING ({key})),
{name}e AS (SELECT {key}, any_value(d) AS d, round(-sum(c/total*log2(c/total)),6)+0.0 AS ent FROM {name} GROUP BY {key})"""


@query(
    "ddos_window",
    f"""WITH {V.FLOW_RECORDS_SQL}, x AS (SELECT *, (t//86400000000)*86400 AS window_start FROM v_flows),
{_entropy_sql('s', 'dst, window_start', 'src')},
a AS (SELECT dst, window_start, count(*) AS n, sum(pkts)::bigint AS p, sum(bytes)::double AS b, sum(CASE WHEN protocol='tcp' THEN pkts ELSE 0 END)::bigint AS tp,
  sum(CASE WHEN protocol='udp' THEN pkts ELSE 0 END)::bigint AS up, sum(CASE WHEN protocol='icmp' THEN pkts ELSE 0 END)::bigint AS ip FROM x GROUP BY 1,2)
SELECT a.dst, a.window_start, n AS flows_per_destination, p AS packets_per_destination, b AS bytes_per_destination, tp AS tcp_packets,
  up AS udp_packets, ip AS icmp_packets, d AS unique_source_ips, ent AS source_ip_entropy, round(p/86400,6) AS packets_per_second,
  round(CASE WHEN b<>0 THEN p/b ELSE 0 END,6) AS bidirectional_ratio,
  CASE WHEN p>0 AND up/p>=0.8 THEN 'UDP_FLOOD' WHEN p>0 AND ip/p>=0.8 THEN 'ICMP_FLOOD' WHEN p>0 AND tp/p>=0.8 THEN 'TCP_FLOOD' ELSE 'MIXED' END AS subtype
FROM a JOIN se USING (dst, window_start)""",
)
def ddos_window(t: Tables):
    return rounded(T.ddos_window(V.flows(t), seconds=86_400, reply="pkts"))


@query(
    "scan_fanout",
    f"""WITH {V.FLOW_RECORDS_SQL}, x AS (SELECT *, (t//86400000000)*86400 AS window_start FROM v_flows),
{_entropy_sql('p', 'src, window_start', 'dst_port')},
a AS (SELECT src, window_start, count(*) AS n, count(*) FILTER (failed) AS f, count(DISTINCT dst) AS hosts FROM x GROUP BY 1,2)
SELECT a.src, a.window_start, n AS connection_count, f AS failed_connections, d AS unique_ports, ent AS ports_entropy, hosts AS unique_hosts,
  round((d+hosts)/86400,6) AS fanout_rate, round(f/n,6) AS failed_ratio, CASE WHEN d>=hosts THEN 'vertical' ELSE 'horizontal' END AS scan_shape,
  round(least(1.0, greatest(d,hosts)/50.0),6)::double AS heuristic_score FROM a JOIN pe USING (src, window_start)""",
)
def scan_fanout(t: Tables):
    return rounded(T.scan_fanout(V.flows(t), seconds=86_400))


def _tagged_flows(t: Tables):
    """Flow records with flag counts, a direction and what became of the connection."""
    k, pkts = F.col("pkts"), F.col("pkts")
    return V.flows(t).select(
        "*", F.when(k % 3 != 0, pkts).otherwise(0).alias("syn"), F.when(k % 7 == 0, pkts).otherwise(0).alias("ack"),
        (k % 2 == 0).alias("from_outside"), (k % 4 == 0).alias("unanswered"), (k % 6 == 0).alias("syn_only"), (F.col("bytes") / 100.0).alias("seconds"),
    )


_SPREAD_SQL = "unnest(range((t//3600000000)*3600-18000, (t//3600000000)*3600+3600, 3600)) AS window_start"
_TAGGED_SQL = f"""x AS (SELECT *, CASE WHEN pkts%3<>0 THEN pkts ELSE 0 END AS syn, CASE WHEN pkts%7=0 THEN pkts ELSE 0 END AS ack, {_SPREAD_SQL} FROM v_flows)"""


@query(
    "rolling_ddos",
    f"""WITH {V.FLOW_RECORDS_SQL}, {_TAGGED_SQL},
a AS (SELECT dst, window_start, count(*) AS n, sum(pkts)::bigint AS p, sum(bytes)::double AS b, count(DISTINCT src) AS d, coalesce(sum(pkts) FILTER (protocol='tcp'),0)::bigint AS tp,
  coalesce(sum(pkts) FILTER (protocol='udp'),0)::bigint AS up, coalesce(sum(pkts) FILTER (protocol='icmp'),0)::bigint AS ip, sum(syn)::bigint AS syn, sum(ack)::bigint AS ack,
  coalesce(sum(pkts) FILTER (pkts%2=0),0)::bigint AS inb FROM x GROUP BY 1,2)
SELECT dst, window_start, n AS flows_per_destination, p AS packets_per_destination, b AS bytes_per_destination, tp AS tcp_packets, up AS udp_packets, ip AS icmp_packets,
  syn AS syn_count, ack AS ack_count, inb AS inbound_packets, p-inb AS outbound_packets, d AS unique_source_ips, round(p/21600,6) AS packets_per_second,
  round(CASE WHEN b<>0 THEN p/b ELSE 0 END,6) AS bidirectional_ratio, round(CASE WHEN p<>0 THEN syn/p ELSE 0 END,6) AS syn_ratio,
  round(CASE WHEN p<>0 THEN ack/p ELSE 0 END,6) AS ack_ratio, round(CASE WHEN p<>0 THEN inb/p ELSE 0 END,6) AS inbound_share,
  CASE WHEN p>0 AND up/p>=0.8 THEN 'UDP_FLOOD' WHEN p>0 AND ip/p>=0.8 THEN 'ICMP_FLOOD' WHEN p>0 AND tp/p>=0.8 AND syn/tp>=0.8 AND ack/tp<=0.2 THEN 'SYN_FLOOD'
    WHEN p>0 AND tp/p>=0.8 THEN 'TCP_FLOOD' ELSE 'MIXED' END AS subtype FROM a""",
)
def rolling_ddos(t: Tables):
    out = T.rolling_ddos(_tagged_flows(t), seconds=21_600, step=3_600, reply="pkts", flags={"syn": "syn", "ack": "ack"}, inbound=F.col("from_outside"), exact=True)
    return rounded(out)


@query(
    "rolling_ddos_sketches",
    f"""WITH {V.FLOW_RECORDS_SQL}, {_TAGGED_SQL}, a AS (SELECT DISTINCT dst, window_start FROM x) SELECT dst, count(*) AS windows, count(*) AS near FROM a GROUP BY 1""",
)
def rolling_ddos_sketches(t: Tables):
    """How many windows have a sketched source count within 5 % (or one) of the exact one."""
    of = lambda exact: T.rolling_ddos(V.flows(t), seconds=21_600, step=3_600, exact=exact).select("dst", "window_start", "unique_source_ips")
    both = of(False).join(of(True).withColumnRenamed("unique_source_ips", "exact"), ["dst", "window_start"])
    near = F.abs(F.col("unique_source_ips") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.05 * F.col("exact"))
    return both.groupBy("dst").agg(F.count(F.lit(1)).alias("windows"), F.count_if(near).alias("near"))


@query(
    "rolling_scan",
    f"""WITH {V.FLOW_RECORDS_SQL}, {_TAGGED_SQL},
a AS (SELECT src, window_start, count(*) AS n, count(*) FILTER (failed) AS f, count(*) FILTER (pkts%4=0) AS u, count(*) FILTER (pkts%6=0) AS s, avg(bytes/100.0) AS dm, stddev_pop(bytes/100.0) AS ds,
  count(DISTINCT dst_port) AS d, count(DISTINCT dst) AS h FROM x GROUP BY 1,2)
SELECT src, window_start, n AS connection_count, f AS failed_connections, u AS unanswered_connections, s AS syn_only_connections, d AS unique_ports, h AS unique_hosts,
  round((d+h)/21600,6) AS fanout_rate, round(f/n,6) AS failed_ratio, round(u/n,6) AS unanswered_ratio, round(s/n,6) AS syn_only_ratio, round(dm,4) AS duration_mean, round(ds,4) AS duration_std,
  CASE WHEN d>=h THEN 'vertical' ELSE 'horizontal' END AS scan_shape, round(least(1.0, greatest(d,h)/50.0),6)::double AS heuristic_score FROM a""",
)
def rolling_scan(t: Tables):
    rows = _tagged_flows(t)
    out = T.rolling_scan(rows, seconds=21_600, step=3_600, unanswered=F.col("unanswered"), syn_only=F.col("syn_only"), duration="seconds", exact=True)
    return rounded(out, duration_mean=4, duration_std=4)


@query(
    "exfil_volume",
    f"""WITH {V.FLOW_RECORDS_SQL}, x AS (SELECT *, (t//86400000000)*86400 AS window_start FROM v_flows),
f AS (SELECT src, dst, min(window_start) AS w0 FROM x GROUP BY 1,2),
a AS (SELECT x.src, window_start, sum(bytes)::double AS ob, sum(pkts)::bigint AS ib, sum(pkts)::bigint AS op, sum(dst_port)::bigint AS ip, count(*) AS n,
  count(DISTINCT x.dst) AS dc, count(DISTINCT CASE WHEN w0=window_start THEN x.dst END) AS nd, (max(t)-min(t))/1e6 AS act
  FROM x JOIN f ON x.src=f.src AND x.dst=f.dst GROUP BY 1,2),
g AS (SELECT src, window_start, (t-lag(t) OVER (PARTITION BY src, window_start ORDER BY t, event_id))/1e6 AS gap FROM x),
gs AS (SELECT src, window_start, avg(gap) AS gm, stddev_samp(gap) AS gd FROM g GROUP BY 1,2),
s AS (SELECT src, window_start, min(window_start) OVER w AS m0, count(*) OVER w AS m FROM a
  WINDOW w AS (PARTITION BY src ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT a.src, a.window_start, ob AS outbound_bytes, ib AS inbound_bytes, op AS outbound_packets, ip AS inbound_packets, n AS connection_count,
  dc AS destination_count, nd AS new_destinations, round(act,6) AS active_seconds, round(CASE WHEN ib<>0 THEN ob/ib ELSE 0 END,6) AS outbound_inbound_ratio,
  round(CASE WHEN ip<>0 THEN op/ip ELSE 0 END,6) AS packet_ratio, round(CASE WHEN act<>0 THEN ob/act ELSE 0 END,6) AS outbound_bytes_per_second,
  round(CASE WHEN act<>0 THEN ib/act ELSE 0 END,6) AS inbound_bytes_per_second, round(nd/dc,6) AS destination_novelty,
  round(m/((a.window_start-m0)/86400+1),6) AS temporal_persistence, round(n/dc,6) AS repetition,
  round(CASE WHEN gd+gm>0 THEN (gd-gm)/(gd+gm) END,6)+0.0 AS burstiness
FROM a JOIN s ON a.src=s.src AND a.window_start=s.window_start JOIN gs ON a.src=gs.src AND a.window_start=gs.window_start""",
)
def exfil_volume(t: Tables):
    flows = V.flows(t)
    return rounded(T.exfil_volume(flows, out_bytes="bytes", in_bytes="pkts", out_pkts="pkts", in_pkts="dst_port"))


@query(
    "dns_tunnel_features",
    f"""WITH {V.EVENTS_SQL}, x AS (SELECT *, event_type||'-'||k||'.example' AS q, (t//86400000000)*86400 AS window_start FROM v_events),
g AS (SELECT *, (t-lag(t) OVER (PARTITION BY sensor, window_start ORDER BY t, event_id))/1e6 AS gap FROM x),
a AS (SELECT sensor, window_start, count(*) AS n, avg(length(q)) AS ql, avg(CASE WHEN k%4=0 THEN 1.0 ELSE 0.0 END) AS txt,
  avg(CASE WHEN k%6=0 THEN 1.0 ELSE 0.0 END) AS nx, sum(k)::bigint AS rq, sum(k*3+1)::bigint AS rs, count(DISTINCT q) AS uq, avg(gap) AS m, stddev_samp(gap) AS d
  FROM g GROUP BY 1,2),
letters AS (SELECT q, unnest(string_split(q, '')) AS letter FROM (SELECT DISTINCT q FROM x)),
ent AS (SELECT q, entropy(letter) AS e FROM letters WHERE letter<>'' GROUP BY q),
qe AS (SELECT sensor, window_start, avg(e) AS query_entropy FROM x JOIN ent USING (q) GROUP BY 1,2)
SELECT a.sensor, a.window_start, round(query_entropy,6) AS query_entropy, n AS queries_per_window, round(ql,6) AS query_length, round(txt,6) AS txt_ratio, round(nx,6) AS nxdomain_ratio,
  rq AS request_bytes, rs AS response_bytes, uq AS unique_queries, round(m,3) AS iat_mean, round(d,3) AS iat_std, round(uq/n,6) AS unique_subdomain_ratio,
  round(n/86400,6) AS query_frequency, round(rq/rs,6) AS request_response_ratio, round(CASE WHEN m>0 THEN d/m END,6) AS iat_cv,
  round(CASE WHEN d+m>0 THEN (d-m)/(d+m) END,6)+0.0 AS burstiness FROM a JOIN qe ON a.sensor=qe.sensor AND a.window_start=qe.window_start""",
)
def dns_tunnel_features(t: Tables):
    k = F.col("k")
    rows = V.events(t).select(
        "sensor", "ts", F.concat(F.col("event_type"), F.lit("-"), k.cast("string"), F.lit(".example")).alias("query"),
        F.when(k % 4 == 0, "txt").otherwise("A").alias("qtype"), F.when(k % 6 == 0, "NXDOMAIN").otherwise("NOERROR").alias("rcode"),
        k.alias("request_bytes"), (k * 3 + 1).alias("response_bytes"),
    )
    return rounded(T.dns_tunnel_features(rows, ["sensor"], seconds=86_400), iat_mean=3, iat_std=3)


@query(
    "domain_lexical",
    f"""WITH {V.DOMAINS_SQL}, d AS (SELECT *, string_split(domain,'.') AS p, greatest(length(domain),1) AS n FROM v_domains),
c AS (SELECT page_id, ch, count(*) AS m FROM (SELECT page_id, unnest(string_split(domain,'')) AS ch FROM v_domains) GROUP BY 1,2),
e AS (SELECT c.page_id, -sum(m/n*log2(m/n)) AS ent, count(*) AS u FROM c JOIN d ON c.page_id=d.page_id GROUP BY 1),
w AS (SELECT page_id, avg(CASE WHEN word IN ('example','com','net','org','blog','casino') THEN 1.0 ELSE 0.0 END) AS hit FROM
  (SELECT page_id, unnest(regexp_split_to_array(domain,'[.\\-_0-9]+')) AS word FROM v_domains) WHERE word<>'' GROUP BY 1)
SELECT d.page_id, domain, length(domain) AS full_domain_length, length(p[len(p)-1]) AS sld_length, length(p[len(p)]) AS tld_length, round(ent,6)+0.0 AS entropy,
  round(length(regexp_replace(domain,'[^0-9]','','g'))/n,6) AS digit_ratio, round(length(regexp_replace(domain,'[^aeiou]','','g'))/n,6) AS vowel_ratio,
  round(length(regexp_replace(domain,'[^b-df-hj-np-tv-z]','','g'))/n,6) AS consonant_ratio,
  round(length(regexp_replace(domain,'[^aeiou]','','g'))/greatest(length(regexp_replace(domain,'[^b-df-hj-np-tv-z]','','g')),1),6) AS vowel_consonant_ratio,
  round(u/n,6) AS unique_character_ratio, round(hit,6) AS dictionary_match_ratio FROM d JOIN e ON d.page_id=e.page_id LEFT JOIN w ON w.page_id=d.page_id""",
)
def domain_lexical(t: Tables):
    words = t.spark.createDataFrame([(w,) for w in ("example", "com", "net", "org", "blog", "casino")], "word string")
    return rounded(T.domain_lexical(V.domains(t), "domain", words))


@query(
    "domain_ngrams",
    f"""WITH {V.DOMAINS_SQL}, d AS (SELECT DISTINCT domain FROM v_domains),
g AS (SELECT domain, substr(domain, i::bigint, 2) AS gram FROM d, (SELECT unnest(range(1,300)) AS i) WHERE i<length(domain)),
c AS (SELECT domain, gram, count(*) AS tf FROM g GROUP BY 1,2)
SELECT gram, sum(tf)::bigint AS occurrences, count(*) AS documents, round(ln(((SELECT count(*) FROM d)+1)/(count(*)+1)),6)+0.0 AS idf FROM c GROUP BY 1""",
)
def domain_ngrams(t: Tables):
    return rounded(T.domain_ngrams(V.domains(t), "domain", 2))


@query(
    "domain_trigrams",
    f"""WITH {V.DOMAINS_SQL}, d AS (SELECT DISTINCT domain FROM v_domains),
g AS (SELECT domain, substr(domain, i::bigint, 3) AS gram FROM d, (SELECT unnest(range(1,300)) AS i) WHERE i<length(domain)-1),
c AS (SELECT domain, gram, count(*) AS tf FROM g GROUP BY 1,2)
SELECT gram, sum(tf)::bigint AS occurrences, count(*) AS documents, round(ln(((SELECT count(*) FROM d)+1)/(count(*)+1)),6)+0.0 AS idf FROM c GROUP BY 1""",
)
def domain_trigrams(t: Tables):
    return rounded(T.domain_ngrams(V.domains(t), "domain", 3))


@query("domain_tfidf")
def domain_tfidf(t: Tables):
    frame, _ = T.domain_tfidf(V.domains(t), "domain", features=1 << 12)
    from pyspark.ml.functions import vector_to_array

    total = F.aggregate(vector_to_array("tfidf"), F.lit(0.0), lambda a, x: a + x)
    return frame.select("page_id", "domain", F.round(total, 6).alias("tfidf_sum"))


@query(
    "hash_split",
    """WITH h AS (SELECT event_id, user_id, ((((event_id%2147483647)*48271+11)%2147483647)*16807)%2147483647/2147483647.0::double AS u FROM events)
SELECT CASE WHEN u<0.7 THEN 'train' WHEN u<0.7+0.1 THEN 'validation' ELSE 'test' END AS split, count(*) AS rows FROM h GROUP BY 1""",
)
def hash_split(t: Tables):
    out = L.stratified_split(t.events, "event_id", {"train": 0.7, "validation": 0.1, "test": 0.2})
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))

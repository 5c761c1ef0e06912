"""Run reports: rates, loss by stage, latency, threat totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import threat_family
from .chunks import exact_percentiles

# Latency names with the stage marks they lie between.
MARK_DURATIONS = {
    "queue_wait": ("ingested_at", "ordered_at"),
    "window_wait": ("ordered_at", "feature_ready_at"),
    "feature_time": ("feature_ready_at", "inference_started_at"),
    "inference_time": ("inference_started_at", "inference_finished_at"),
    "alert_generation_time": ("inference_finished_at", "alert_created_at"),
    "delivery_time": ("alert_created_at", "delivered_at"),
    "zeek_to_ingest": ("zeek_available_at", "ingested_at"),
}
CAPTURE_DURATIONS = {
    "capture_to_alert": ("observed_at", "alert_created_at"),
    "capture_to_dashboard": ("observed_at", "delivered_at"),
}


def run_report(
    df: DataFrame, kind: str, packets: str, size: str, elapsed_seconds: float | Column, packet_kind: str = "packet"
) -> DataFrame:
    """One row: records in total and per second, connections, packets and megabits per second.

    A packet or byte rate is null unless every packet record carries the count.
    """
    elapsed = elapsed_seconds if isinstance(elapsed_seconds, Column) else F.lit(float(elapsed_seconds))
    is_packet = F.col(kind) == packet_kind
    totals = df.agg(
        F.count(F.lit(1)).alias("input_records"),
        F.count_if(F.col(kind) == "conn").alias("conn_records"),
        F.count_if(is_packet).alias("packet_records"),
        F.count_if(is_packet & F.col(packets).isNotNull()).alias("_with_packets"),
        F.count_if(is_packet & F.col(size).isNotNull()).alias("_with_bytes"),
        F.sum(F.when(is_packet, F.col(packets))).alias("_packets"),
        F.sum(F.when(is_packet, F.col(size))).alias("_bytes"),
        F.max(elapsed).alias("elapsed_seconds"),
    )
    rate = lambda c: F.when(F.col("elapsed_seconds") > 0, c / F.col("elapsed_seconds"))
    whole = lambda n: (F.col("packet_records") > 0) & (F.col(n) == F.col("packet_records"))
    return totals.select(
        "input_records", "elapsed_seconds", rate(F.col("input_records")).alias("input_records_per_second"),
        "conn_records", F.when(F.col("conn_records") > 0, rate(F.col("conn_records"))).alias("flows_per_second"),
        "packet_records",
        F.when(whole("_with_packets"), F.col("_packets")).alias("packet_count"),
        F.when(whole("_with_packets"), rate(F.col("_packets"))).alias("packets_per_second"),
        F.when(whole("_with_bytes"), F.col("_bytes")).alias("packet_bytes"),
        F.when(whole("_with_bytes"), rate(F.col("_bytes") * 8) / 1_000_000).alias("megabits_per_second"),
    )


def records_by_type(df: DataFrame, kind: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(kind), F.lit("unknown")).alias(kind)).agg(F.count(F.lit(1)).alias("records"))


def stage_accounting(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Rows lost per stage, from one pass. ``stages`` maps a stage name to its loss condition."""
    one = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(c).alias(n) for n, c in stages.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).alias("records")) for n in stages])
    return one.select("_all", F.explode(pairs).alias("_p")).select(
        "_p.stage", "_p.records", F.when(F.col("_all") > 0, F.col("_p.records") / F.col("_all")).alias("share")
    )


def latency_durations(df: DataFrame, capture: Column | bool = True, name: str = "durations") -> DataFrame:
    """Add a map of durations in seconds, floored at 0; pairs without both marks have no entry.

    ``capture`` says whether capture times are real; replays have none.
    """
    allowed = capture if isinstance(capture, Column) else F.lit(capture)
    seconds = lambda a, b: (F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / F.lit(1e6)
    entries = []
    for group, gate in ((MARK_DURATIONS, F.lit(True)), (CAPTURE_DURATIONS, allowed)):
        for key, (a, b) in group.items():
            if a in df.columns and b in df.columns:
                # greatest would skip a null and report 0, so missing marks are tested first
                value = F.when(gate & F.col(a).isNotNull() & F.col(b).isNotNull(), F.greatest(F.lit(0.0), seconds(a, b)))
                entries.append(F.struct(F.lit(key).alias("key"), value.alias("value")))
    present = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    return df.withColumn(name, F.map_from_entries(present))


def latency_report(df: DataFrame, metric: str, value: str) -> DataFrame:
    """Count, exact interpolated percentiles and maximum per metric."""
    basics = {"count": F.sum("_n"), "max": F.max("_x")}
    return exact_percentiles(df, [metric], value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, basics=basics)


def threat_matrix(
    alerts: DataFrame, threat_class: str = "threat_class", ts: str = "ts", arrival: str = "alert_id",
    latest: Sequence[str] = ("model", "src_ip", "dst_ip"), status: str = "status", severity: str = "severity",
) -> DataFrame:
    """Per threat family: alerts, last seen, latest non-null values, active and critical counts."""
    order = F.struct(F.col(ts), F.col(arrival))
    return alerts.withColumn("family", threat_family(F.col(threat_class))).groupBy("family").agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.max(ts).alias("last_seen"),
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(f"latest_{c}") for c in latest],
        F.count_if(F.col(status) != "RESOLVED").alias("active_count"),
        F.count_if(F.col(severity) == "CRITICAL").alias("critical_count"),
    )


def score_summary(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """One row on a scored scan: malware and benign counts and shares, extremes, mean, exact median."""
    hit = F.col(score) >= threshold
    basic = df.agg(
        F.count(F.lit(1)).alias("flows"), F.count_if(hit).alias("malware"), F.count_if(~hit).alias("benign"),
        F.min(score).alias("min"), F.avg(score).alias("mean"), F.max(score).alias("max"),
        F.count_if(F.col(score) > 0.5).alias("over_50"), F.count_if(F.col(score) > 0.8).alias("over_80"),
        F.count_if(F.col(score) > 0.95).alias("over_95"),
    )
    share = lambda c: F.col(c) / F.greatest(F.col("flows"), F.lit(1)) * 100
    median = exact_percentiles(df, [], score, {"median": 0.5})
    return basic.withColumn("malware_percent", share("malware")).withColumn("benign_percent", share("benign")).withColumn(
        "median", median.scalar()
    )


def replay_schedule(df: DataFrame, mode: str, seq: str = "arrival_seq", ts: str = "observed_at", rate: float = 500.0) -> DataFrame:
    """Seconds after the start at which each record is due: FAST, FIXED_RATE or TIMESTAMP_PRESERVING."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    if mode == "FAST":
        due = F.lit(0.0)
    elif mode == "FIXED_RATE":
        due = F.col(seq) / F.lit(float(rate))
    elif mode == "TIMESTAMP_PRESERVING":
        due = (micros - df.agg(F.min(micros)).scalar()) / F.lit(1e6)
    else:
        raise ValueError(f"unknown replay mode {mode}")
    return df.withColumn("due_seconds", due)

"""Decisions, alerts, their store, deduplication, incidents, lineage."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import evaluated
from ..functions.scoring import alert_confidence, alert_id, raw_model_score
from ..session import stage
from .beacon import micros
from .chunks import CHUNK_ROWS, join_on, over_previous, running
from .graph import connected_components
from .normalize import missing_fields, select_contract
from .threats import time_bucket

# Alert enumerations.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
STATUSES = ("NEW", "ACKNOWLEDGED", "RESOLVED")
INCIDENT_STATES = ("NEW", "ACKNOWLEDGED", "INVESTIGATING", "CONFIRMED", "FALSE_POSITIVE", "RESOLVED")


# The texts of failure rows.
MISSING_INPUTS = "Skipped: current event raw metadata is missing required detector inputs: "
MISSING_FLOW_INPUTS = "Skipped: packet-derived flow output is missing required detector inputs: "
INCOMPLETE_FLOW = "Skipped: packet-derived flow feature contract is incomplete: "
NOT_READY = "Detector is not ready_for_inference"


def input_failure(names: Column, of_flow: bool) -> Column:
    return F.concat(F.lit(MISSING_FLOW_INPUTS if of_flow else MISSING_INPUTS), F.array_join(names, ", "))


def flow_failure(df: DataFrame) -> Column:
    """Why a flow cannot be scored, from its own reasons."""
    reasons = F.col("incomplete_reasons") if "incomplete_reasons" in df.columns else F.array().cast("array<string>")
    return F.concat(F.lit(INCOMPLETE_FLOW), F.array_join(reasons, "; "))


@dataclass(frozen=True)
class Detector:
    """A detector: contract, feature function and scorer, all over whole DataFrames.

    ``scorer`` is a column expression or a function DataFrame to DataFrame that adds ``score``, such
    as the transform of a fitted model.
    """

    name: str
    contract: tuple[str, ...]
    threshold: float
    score_type: str
    scorer: Column | Callable[[DataFrame], DataFrame]
    features: Callable[[DataFrame], DataFrame] | None = None
    version: str = "1.0"
    labels: tuple[str, str] = ("Benign", "Threat")
    inputs: tuple[str, ...] = ()

    def run(self, df: DataFrame) -> DataFrame:
        """Predictions for rows that satisfy the contract; the others get a reject reason and no score.

        What goes into the features is checked first, as features turn nulls into zeros: a flow must be
        ``complete`` where the rows say so, and no column of ``inputs`` may be null.
        """
        of_flow = "complete" in df.columns
        whole = F.coalesce("complete", F.lit(False)) if of_flow else F.lit(True)
        absent = [c for c in self.inputs if c not in df.columns]
        lost = F.concat(missing_fields([c for c in self.inputs if c in df.columns]), F.array(*[F.lit(c) for c in absent]).cast("array<string>"))
        df = df.withColumn("_unfit", F.when(~whole, flow_failure(df)).when(F.size(lost) > 0, input_failure(lost, of_flow)))
        prepared = self.features(df) if self.features else df
        if "_unfit" not in prepared.columns:
            raise ValueError("the feature function must keep the column _unfit")
        # features and score are used by several columns and filters: each is computed once
        prepared = evaluated(prepared, [], {c: F.col(f"`{c}`") for c in prepared.columns})
        checked = select_contract(prepared, self.contract)
        checked = checked.withColumn("vector", F.when(F.col("_unfit").isNull(), F.col("vector")))
        scored = self.scorer(checked) if callable(self.scorer) else checked.withColumn("score", self.scorer)
        ready = F.col("vector").isNotNull()
        others = [c for c in scored.columns if c != "score"]
        scored = evaluated(scored, [f"`{c}`" for c in others], {"score": F.when(ready, F.col("score"))})
        out = decide(scored, "score", self.threshold, self.labels)
        why = F.coalesce("_unfit", input_failure(F.col("missing_inputs"), of_flow))
        return (
            out.withColumn("reject_reason", F.when(~ready, why)).drop("_unfit")
            .withColumn("detector", F.lit(self.name))
            .withColumn("detector_version", F.lit(self.version))
            .withColumn("score_type", F.lit(self.score_type))
        )


def decide(df: DataFrame, score: str, threshold: float | Column, names: tuple[str, str] = ("Benign", "Threat")) -> DataFrame:
    """Add ``status`` and ``threat_class`` by threshold; a null score stays undecided."""
    cut = threshold if isinstance(threshold, Column) else F.lit(threshold)
    hit = F.col(score) >= cut
    return df.withColumn("status", F.when(hit, "DETECTED").when(~hit, "BENIGN").otherwise("INSUFFICIENT_CONTEXT")).withColumn(
        "threat_class", F.when(hit, names[1]).when(~hit, names[0])
    )


def to_alerts(predictions: DataFrame, identity: Sequence[str], score: str = "score", score_type: str = "score_type", status: str = "status") -> DataFrame:
    """Alerts of the detected predictions. ``identity`` names the columns of the alert id."""
    detected = predictions.filter(F.col(status) == "DETECTED").drop(status)
    confidence = alert_confidence(F.col(score), F.col(score_type))
    return detected.select(
        "*",
        alert_id(*[F.col(c) for c in identity]).alias("alert_id"),
        confidence.alias("confidence"),
        confidence.alias("raw_model_probability"),
        raw_model_score(F.col(score), F.col(score_type)).alias("raw_model_score"),
        F.lit("NEW").alias("status"),
    )


def gate_ready(df: DataFrame, status: DataFrame, name: str = "detector") -> tuple[DataFrame, DataFrame]:
    """Part rows whose detector is ready from failure rows. ``status``: name, ready, error_reason."""
    joined = join_on(df, status.select(name, "ready", "error_reason"), [name])
    ready = F.coalesce("ready", F.lit(False))
    reason = F.concat(F.lit("Skipped: "), F.coalesce("error_reason", F.lit(NOT_READY)))
    good = joined.filter(ready).drop("ready", "error_reason")
    bad = joined.filter(~ready).withColumn("reject_reason", reason).drop("ready", "error_reason")
    return good, bad


def failure_ledger(*rejects: DataFrame, detector: str = "detector", reason: str = "reject_reason") -> DataFrame:
    """Failures per detector and reason over any number of reject frames."""
    rows = [r.filter(F.col(reason).isNotNull()).select(detector, reason) for r in rejects]
    return reduce(DataFrame.unionByName, rows).groupBy(detector, reason).agg(F.count(F.lit(1)).alias("failures"))


def route(events: DataFrame, detectors: Sequence[str], flow_detectors: Sequence[str] = ("ddos", "portscan"), kind: str = "event_type", flow_kind: str = "flow_features") -> DataFrame:
    """Copy events to their detectors: completed flows feed the flow detectors, others the rest.

    Raw packets reach a flow detector only as the flow they complete.
    """
    flow = F.array(*[F.lit(d) for d in detectors if d in flow_detectors]).cast("array<string>")
    rest = F.array(*[F.lit(d) for d in detectors if d not in flow_detectors]).cast("array<string>")
    targets = F.when(F.col(kind) == flow_kind, flow).otherwise(rest)
    return events.withColumn("detector", F.explode(targets))


def review_reasons(probability: Column, unstable: Column, outlier: Column, low: float = 0.15, high: float = 0.35) -> Column:
    """Why a verdict needs an analyst; empty when it does not."""
    return F.array_compact(
        F.array(
            F.when(probability.between(low, high), "ambiguous_model_probability"),
            F.when(unstable, "evasion_sensitivity"),
            F.when(outlier, "local_baseline_outlier"),
        )
    )


def review_records(df: DataFrame, reasons: str, context: str, features: Sequence[str]) -> DataFrame:
    """Stored review rows: redacted context and the model features, never payload."""
    from ..functions.scoring import redact

    return df.filter(F.size(reasons) > 0).withColumn(context, redact(F.col(context))).withColumn(
        "model_features", F.struct(*features)
    )


def keep_latest(df: DataFrame, id_column: str, arrival: str, n: int = 1000) -> DataFrame:
    """The newest ``n`` alerts by arrival; a repeated id is refused, so its first arrival counts.

    The limit is the store's capacity. Spark takes it per partition before it merges.
    """
    others = [c for c in df.columns if c != id_column]
    first = df.groupBy(id_column).agg(F.min_by(F.struct(*others), F.col(arrival)).alias("_row"))
    unique = first.select(*[F.col(c) if c == id_column else F.col(f"_row.{c}").alias(c) for c in df.columns])
    return unique.orderBy(F.desc(arrival), id_column).limit(n)


def dedup_alerts(
    alerts: DataFrame, key: Sequence[str], ts: str = "ts", flow: str = "flow_id", seconds: int = 300, rate_cap: int | None = None
) -> DataFrame:
    """One alert per key and time bucket, with its evidence.

    Every aggregate combines on the map side, so an alert storm on one key shrinks before the
    shuffle. Representative flows are the first and the last. With ``rate_cap``, rows beyond the cap
    of a bucket's most supported alerts are marked, not dropped.
    """
    bucketed = alerts.withColumn("time_bucket", time_bucket(ts, seconds))
    order = F.struct(F.col(ts), F.col(flow))
    out = bucketed.groupBy(*key, "time_bucket").agg(
        F.count(F.lit(1)).alias("evidence_count"),
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
        F.min_by(F.col(flow), order).alias("first_flow_id"),
        F.max_by(F.col(flow), order).alias("last_flow_id"),
    )
    if rate_cap is None:
        return out
    # how many alerts of the bucket have more evidence, from counts per evidence value
    counts = out.groupBy("time_bucket", "evidence_count").agg(F.count(F.lit(1)).alias("_n"))
    above = running(counts, ["time_bucket"], "evidence_count", {"_above": ("sum", F.col("_n"), False)}, descending=True)
    joined = join_on(out, above.select("time_bucket", "evidence_count", "_above"), ["time_bucket", "evidence_count"])
    return joined.withColumn("over_cap", F.col("_above") >= rate_cap).drop("_above")


def correlate_alerts(
    alerts: DataFrame, entity: str, ts: str = "ts", threat_class: str = "threat_class", gap_seconds: int = 3600,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Incidents: alerts of an entity with no pause longer than the gap, and their ordered threat chain.

    Alerts of one time are counted first, pauses found with chunked lags, and incident numbers are a
    chunked running count, so a busy entity is spread over tasks.
    """
    timed = alerts.withColumn("_t", micros(ts))
    slots = timed.groupBy(entity, "_t").agg(F.lit(1).alias("_one"))
    gap = F.lit(gap_seconds * 1_000_000).cast("long")
    starts = over_previous(
        slots, [entity], "_t", 1, {"_new": lambda w: F.coalesce(F.col("_t") - F.lag("_t").over(w) > gap, F.lit(True)).cast("long")}, rows
    )
    numbered = running(stage(starts), [entity], "_t", {"incident_no": ("sum", F.col("_new"), True)}, rows=rows)
    per_class = join_on(timed, numbered.select(entity, "_t", "incident_no"), [entity, "_t"]).groupBy(
        entity, "incident_no", threat_class
    ).agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.count(F.lit(1)).alias("_n"))
    # one row per threat class of an incident
    chain = F.transform(F.array_sort(F.collect_list(F.struct("_first", threat_class))), lambda x: x[threat_class])
    return per_class.groupBy(entity, "incident_no").agg(
        F.sum("_n").alias("alert_count"),
        F.count(F.lit(1)).alias("class_count"),
        F.timestamp_micros(F.min("_first")).alias("first_seen"),
        F.timestamp_micros(F.max("_last")).alias("last_seen"),
        F.array_join(chain, " > ").alias("threat_chain"),
    )


def asset_incidents(
    alerts: DataFrame, assets: Sequence[str] = ("source_ip", "destination_ip", "flow_id"), alert: str = "alert_id", ts: str = "ts",
    gap_seconds: int = 3600, rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Alerts with ``incident_id``: alerts belong together that share an asset with no pause longer than the gap, and so on.

    An asset is a value of any column of ``assets``; the same value in two of them (a host that was attacked and now attacks)
    is one asset. ``incident_id`` is the least alert id of the incident. An alert without an asset or a time is an incident of
    its own. Sessions of an asset come from counts per time, cut in chunks, so a busy asset is spread over
    tasks; every alert is linked with the first of its sessions, and links are closed by ``connected_components``.
    """
    kept = stage(alerts.select(F.col(alert).alias("_id"), micros(ts).alias("_t"), F.array_distinct(F.array_compact(F.array(*[F.col(c).cast("string") for c in assets]))).alias("_assets")))
    seen = kept.filter("_t IS NOT NULL").select("_id", "_t", F.explode("_assets").alias("_asset"))
    slots = seen.groupBy("_asset", "_t").agg(F.min("_id").alias("_least"))
    gap = F.lit(gap_seconds * 1_000_000).cast("long")
    opens = {"_new": lambda w: F.coalesce(F.col("_t") - F.lag("_t").over(w) > gap, F.lit(True)).cast("long")}
    numbered = running(stage(over_previous(slots, ["_asset"], "_t", 1, opens, rows)), ["_asset"], "_t", {"_session": ("sum", F.col("_new"), True)}, rows=rows)
    numbered = stage(numbered)
    first = numbered.groupBy("_asset", "_session").agg(F.min("_least").alias("_first"))
    placed = join_on(seen, numbered.select("_asset", "_t", "_session"), ["_asset", "_t"], "inner", null_safe=False)
    links = join_on(placed, first, ["_asset", "_session"], "inner", null_safe=False).select("_id", "_first").distinct()
    found = connected_components(links, "_id", "_first").withColumnsRenamed({"node": alert, "component": "incident_id"})
    return join_on(alerts, found, [alert]).withColumn("incident_id", F.coalesce("incident_id", alert))


def incident_summary(members: DataFrame, assets: Sequence[str] = ("source_ip", "destination_ip"), ts: str = "ts", threat_class: str = "threat_class") -> DataFrame:
    """Per ``incident_id``: alerts, distinct assets, time span and the ordered threat chain."""
    key = "incident_id"
    per_class = members.groupBy(key, threat_class).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count(F.lit(1)).alias("_n"))
    # one row per threat class of an incident
    chain = F.transform(F.array_sort(F.collect_list(F.struct("_first", threat_class))), lambda x: x[threat_class])
    out = per_class.groupBy(key).agg(
        F.sum("_n").alias("alert_count"), F.count(threat_class).alias("class_count"), F.min("_first").alias("first_seen"),
        F.max("_last").alias("last_seen"), F.array_join(chain, " > ").alias("threat_chain"),
    )
    held = members.select(key, F.explode(F.array(*[F.col(c).cast("string") for c in assets])).alias("_asset")).filter("_asset IS NOT NULL").distinct()
    return join_on(out, held.groupBy(key).agg(F.count(F.lit(1)).alias("asset_count")), [key])


def incident_state(events: DataFrame, incident: str = "incident_id", state: str = "state", ts: str = "ts", alert: str | None = None) -> DataFrame:
    """Latest valid state per incident, when it was reached, and how many alerts link to it."""
    valid = events.filter(F.col(state).isin(*INCIDENT_STATES))
    order = F.struct(F.col(ts), F.col(state))
    aggs = [F.max_by(F.col(state), order).alias("state"), F.max(ts).alias("since"), F.count(F.lit(1)).alias("changes")]
    out = valid.groupBy(incident).agg(*aggs)
    if alert is None:
        return out
    linked = events.select(incident, alert).distinct().groupBy(incident).agg(F.count(alert).alias("linked_alerts"))
    return join_on(out, linked, [incident])


def evidence_hash(df: DataFrame, columns: Sequence[str], version: str = "v1") -> DataFrame:
    """SHA-256 over the columns in name order as JSON with nulls, and the missing lineage links."""
    ordered = sorted(columns)
    body = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in ordered]), {"ignoreNullFields": "false"})
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ordered]))
    return (
        df.withColumn("evidence_hash", F.sha2(body, 256))
        .withColumn("hash_version", F.lit(f"sha256-json-{version}"))
        .withColumn("missing_lineage", missing)
    )


def evidence_bundle(alerts: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One JSON document per alert for export."""
    return alerts.select("alert_id", F.to_json(F.struct(*(columns or alerts.columns))).alias("bundle"))


# Own documented weights: the specification names the parts of a risk score but no numbers.
RISK_WEIGHTS = {"score": 0.4, "criticality": 0.3, "persistence": 0.2, "impact": 0.1}
CRITICALITY = {"LOW": 0.25, "MEDIUM": 0.5, "HIGH": 0.75, "CRITICAL": 1.0}


def risk_score(df: DataFrame, score: str, criticality: str, persistence: str, impact: str, weights: dict[str, float] = RISK_WEIGHTS) -> DataFrame:
    """Weighted risk in [0,1] and its severity; all parts are in [0,1].

    An unknown criticality is left out and its weight shared by the rest, never read as low. The severity goes by
    the risk to nine digits, so that a sum just below a limit in binary is not a level too low.
    """
    weighed = F.create_map(*[x for k, v in CRITICALITY.items() for x in (F.lit(k), F.lit(v))])
    known = F.try_element_at(weighed, F.upper(F.coalesce(F.col(criticality), F.lit(""))))
    parts = {"score": F.col(score), "criticality": known, "persistence": F.col(persistence), "impact": F.col(impact)}
    total = reduce(lambda a, b: a + b, [F.coalesce(v * weights[k], F.lit(0.0)) for k, v in parts.items()])
    weight = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, v in parts.items()])
    risk = F.when(weight > 0, total / weight)
    level = F.round(risk, 9)
    return df.withColumn("risk_score", risk).withColumn(
        "severity", F.when(level >= 0.8, "CRITICAL").when(level >= 0.6, "HIGH").when(level >= 0.4, "MEDIUM").otherwise("LOW")
    )


def filter_alerts(df: DataFrame, severity: str | None = None, status: str | None = None, active: bool = False) -> DataFrame:
    out = df if severity is None else df.filter(F.col("severity") == severity)
    out = out if status is None else out.filter(F.col("status") == status)
    return out.filter(F.col("status") != "RESOLVED") if active else out


def acknowledge(alerts: DataFrame, ids: DataFrame, id_column: str = "alert_id") -> DataFrame:
    """Alerts with the listed new ones set to ACKNOWLEDGED."""
    marked = join_on(alerts, ids.select(id_column).distinct().withColumn("_ack", F.lit(True)), [id_column])
    status = F.when(F.col("_ack") & (F.col("status") == "NEW"), "ACKNOWLEDGED").otherwise(F.col("status"))
    return marked.withColumn("status", status).drop("_ack")


def apply_retention(df: DataFrame, ts: str, reference: Column, days: int) -> DataFrame:
    """Rows not older than the period. It reads all rows; ``stores.read_days`` reads only the days of a table stored by day."""
    return df.filter(F.col(ts) >= reference - F.expr(f"INTERVAL {int(days)} DAYS"))

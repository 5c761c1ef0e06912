"""From live logs to alert rows: the chain of streaming operators, and repeats within a span of event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.alerts import Detector, to_alerts
from ..sources.tail import tail_records
from ..sources.zeek import packet_rows
from .flows import packets_to_flows_stream
from .ledger import observed

OPPORTUNITY = ("detector", "grouping_key", "scoring_start", "scoring_end", "context")


def drop_repeats_stream(df: DataFrame, keys: Sequence[str], ts: str, within_seconds: float) -> DataFrame:
    """First row of each key; later ones are dropped while its state lasts, ``within_seconds`` of event time.

    A repeat after that span comes through again, so state is bounded by the keys of the span. ``keys`` may
    be an event id, an alert id or a scoring opportunity (``OPPORTUNITY``).
    """
    return df.withWatermark(ts, f"{within_seconds} seconds").dropDuplicatesWithinWatermark(list(keys))


def predictions_stream(packets: DataFrame, detector: Detector, quiet_seconds: float = 300.0, late_seconds: float = 5.0) -> DataFrame:
    """``Detector.run`` over the flows of a packet stream: scores of complete flows, reasons for the others."""
    return detector.run(packets_to_flows_stream(packets, quiet_seconds=quiet_seconds, late_seconds=late_seconds, nameless=False))


def alerts_of_stream(predictions: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Alerts of a prediction stream, each id once within the watermark's delay."""
    return to_alerts(predictions, identity).dropDuplicatesWithinWatermark(["alert_id"])


def alert_stream(
    spark: SparkSession, folder: str, detector: Detector, identity: Sequence[str] = ("detector", "detector_version", "flow_id"),
    names: Sequence[str] = ("packet.log",), start: str = "end", quiet_seconds: float = 300.0, late_seconds: float = 5.0,
) -> DataFrame:
    """Alerts from the packet logs of a folder while they grow.

    The same operators as for finished files: decode, packets, flows, contract, features, score, threshold, alert. What is
    counted on the way is observed (``ledger``). A flow ends at its marker; alerts come out in the micro-batch that reads it.
    """
    records = observed(tail_records(spark, folder, list(names), start), "records", {
        "received": F.lit(True), "refused": F.col("reject_reason").isNotNull(),
    })
    packets = packet_rows(records.filter(F.col("reject_reason").isNull()).drop("reject_reason"))
    packets = observed(packets, "packets", {"packets": F.lit(True), "without_id": F.col("uid").isNull()})
    predictions = observed(predictions_stream(packets, detector, quiet_seconds, late_seconds), "flows", {
        "flows": F.lit(True), "incomplete": F.col("reject_reason").isNotNull(), "detected": F.coalesce(F.col("status") == "DETECTED", F.lit(False)),
    })
    return alerts_of_stream(predictions, identity)

"""Enrichment joins and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .chunks import join_on, running


def attach_pattern_stats(scored: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Add the training statistics of each row's pattern; patterns not seen in training are Unseen."""
    joined = join_on(scored, stats, [key])
    count = F.coalesce(F.col("train_count"), F.lit(0))
    attacks = F.coalesce(F.col("train_attack_count"), F.lit(0))
    return (
        joined.withColumn("seen_in_train", count > 0)
        .withColumn("seen_as_attack", attacks > 0)
        .withColumn(
            "pattern_type",
            F.when(count == 0, "Unseen").when(attacks == 0, "Benign-only").when(attacks == count, "Attack-only").otherwise("Mixed"),
        )
    )


def merge_rankings(*rankings: DataFrame, on: str = "feature") -> DataFrame:
    """Rankings side by side for the features all of them know."""
    return reduce(lambda a, b: a.join(b, on), rankings)


def filter_sources(df: DataFrame, split: DataFrame, column: str = "source") -> DataFrame:
    """Rows of the captures a split lists."""
    return join_on(df, split.select(column), [column], "left_semi")


def split_leakage(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row on two splits: sizes, overlap, union, differences, and whether they are disjoint or equal."""
    sides = (
        a.select(column).withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0))
        .unionByName(b.select(column).withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1)))
        .groupBy(column)
        .agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    )
    n = lambda cond: F.count_if(cond).cast("long")
    in_a, in_b = F.col("_a") == 1, F.col("_b") == 1
    return sides.agg(
        n(in_a).alias("in_a"), n(in_b).alias("in_b"), n(in_a & in_b).alias("in_both"),
        F.count(F.lit(1)).alias("in_either"), n(in_a & ~in_b).alias("only_a"), n(in_b & ~in_a).alias("only_b"),
    ).withColumn("disjoint", F.col("in_both") == 0).withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def concat(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_latest(df: DataFrame, id_column: str, arrival: str) -> DataFrame:
    """The newest row of each id by arrival. The aggregate keeps one row per id on the map side."""
    others = [c for c in df.columns if c != id_column]
    best = df.groupBy(id_column).agg(F.max_by(F.struct(*others), F.col(arrival)).alias("_row"))
    return best.select(*[F.col(c) if c == id_column else F.col(f"_row.{c}").alias(c) for c in df.columns])


def key_overlap(train: DataFrame, test: DataFrame, engineered: str, raw: str) -> DataFrame:
    """How many test rows have their engineered key, their raw key, or both among the training rows."""
    known = lambda c, flag: train.select(c).distinct().withColumn(flag, F.lit(True))
    joined = join_on(join_on(test, known(engineered, "_e"), [engineered]), known(raw, "_r"), [raw])
    e, r = F.coalesce("_e", F.lit(False)), F.coalesce("_r", F.lit(False))
    return joined.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(e).alias("engineered_seen"),
        F.count_if(r).alias("raw_seen"),
        F.count_if(e & r).alias("both_seen"),
        F.count_if(e & ~r).alias("engineered_only"),
        F.count_if(r & ~e).alias("raw_only"),
    )


def enrich_assets(df: DataFrame, assets: DataFrame, ip: str, sides: dict[str, str]) -> DataFrame:
    """Asset columns for each side of a flow, prefixed. ``sides`` maps a prefix to the IP column.

    The registry has one row per address. No side is forced to be broadcast: adaptive execution does
    so when the registry's measured size allows.
    """
    out = df
    for prefix, column in sides.items():
        renamed = assets.select(
            *[F.col(c).alias(f"{prefix}_{c}") if c != ip else F.col(c).alias(column) for c in assets.columns]
        )
        out = join_on(out, renamed, [column])
    return out


def unexpected_flows(flows: DataFrame, expected: DataFrame, on: Sequence[str]) -> DataFrame:
    """Flows without a matching expectation on peer, port, protocol or whatever ``on`` names."""
    return join_on(flows, expected.select(*on), list(on), "left_anti")


def match_dns(
    queries: DataFrame, responses: DataFrame, on: Sequence[str], max_delay: float, query_ts: str = "query_ts",
    response_ts: str = "response_ts", query_id: str = "query_id",
) -> DataFrame:
    """Each query with its first response on the same tuple and transaction within the delay.

    An as-of join: the next response time is a running minimum from the end over the distinct times of a
    tuple, so no pairs are formed and a busy client is cut like any hot key.
    """
    on = list(on)
    width = F.lit(max(int(max_delay * 1_000_000), 1)).cast("long")
    none = F.lit(None).cast(responses.schema[response_ts].dataType)
    times = responses.select(*on, _micros(response_ts).alias("_t"), F.col(response_ts).alias("_response"))
    times = times.unionByName(queries.select(*on, _micros(query_ts).alias("_t"), none.alias("_response")))
    points = stage(times.filter("_t IS NOT NULL").groupBy(*on, "_t").agg(F.min("_response").alias("_response")))
    ahead = running(points, on, "_t", {"_next": ("min", F.col("_response"), True)}, descending=True)
    found = join_on(queries.withColumn("_t", _micros(query_ts)), ahead.select(*on, "_t", "_next"), [*on, "_t"])
    near = _micros("_next") - F.col("_t") <= width
    return found.withColumn(response_ts, F.when(near, F.col("_next"))).drop("_t", "_next")


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def match_ground_truth(
    alerts: DataFrame, scenarios: DataFrame, on: Sequence[str], ts: str = "ts", start: str = "start_time",
    end: str = "end_time", slot_seconds: int = 3600,
) -> DataFrame:
    """Alert/scenario pairs where the alert falls into the scenario's time.

    Scenarios are listed once per time slot they touch, so the range join is an equi-join on target
    and slot.
    """
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    slot = lambda c: F.floor(seconds(c) / slot_seconds)
    spread = scenarios.withColumn("_slot", F.explode(F.sequence(slot(start), slot(end))))
    pairs = join_on(alerts.withColumn("_slot", slot(ts)), spread, [*on, "_slot"], "inner")
    return pairs.filter((F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end))).drop("_slot")


def detection_latency(
    alerts: DataFrame, scenarios: DataFrame, on: Sequence[str], scenario_id: str = "scenario_id", ts: str = "ts",
    start: str = "start_time", end: str = "end_time",
) -> DataFrame:
    """Per scenario: alerts, first detection, latency in seconds and whether it was missed.

    No alert/scenario pairs are formed: alerts are counted per (target, time), and a scenario's number is
    the difference of the running counts at its end and before its start; its first alert is the next one
    from its start on.
    """
    on = list(on)
    counts = alerts.select(*on, _micros(ts).alias("_t"), F.lit(1).alias("_n"), F.col(ts).alias("_at"))
    none = F.lit(None).cast(alerts.schema[ts].dataType).alias("_at")
    marks = [scenarios.select(*on, _micros(c).alias("_t"), F.lit(0).alias("_n"), none) for c in (start, end)]
    every = counts.unionByName(marks[0]).unionByName(marks[1]).filter("_t IS NOT NULL")
    points = stage(every.groupBy(*on, "_t").agg(F.sum("_n").cast("long").alias("_n"), F.min("_at").alias("_at")))
    summed = running(points, on, "_t", {"_before": ("sum", F.col("_n"), False)})
    ahead = running(points, on, "_t", {"_next": ("min", F.col("_at"), True)}, descending=True)
    table = stage(join_on(summed, ahead.select(*on, "_t", "_next"), [*on, "_t"]))
    at_start = table.select(*on, F.col("_t").alias("_s"), F.col("_before").alias("_from"), "_next")
    at_end = table.select(*on, F.col("_t").alias("_e"), (F.col("_before") + F.col("_n")).alias("_upto"))
    joined = join_on(scenarios.withColumn("_s", _micros(start)).withColumn("_e", _micros(end)), at_start, [*on, "_s"])
    joined = join_on(joined, at_end, [*on, "_e"])
    joined = joined.withColumn("_count", F.greatest(F.coalesce(F.col("_upto") - F.col("_from"), F.lit(0)), F.lit(0)))
    joined = joined.withColumn("first_detection", F.when(F.col("_count") > 0, F.col("_next")))
    return joined.select(
        *scenarios.columns,
        F.col("_count").alias("alert_count"),
        "first_detection",
        ((_micros("first_detection") - _micros(start)) / F.lit(1e6)).alias("detection_latency"),
        F.col("first_detection").isNull().alias("missed"),
    )

"""Scoring windows over context: emissions anchored at a key's first event.

An event at time t is the trigger of every scoring interval that ends in (previous event, t]. The
context of an emission is the trigger and the events not older than the context span. Events must be
in time order per key; rows that break it are rejected first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .beacon import micros
from .chunks import CHUNK_ROWS, join_on, over_previous, running


def order_violations(df: DataFrame, by: Sequence[str], ts: str, seq: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``reject_reason`` to rows whose time is below one accepted before in ``seq`` order.

    A refused row does not move the key's clock, so the rule is: below the running maximum.
    """
    seen = running(
        df.withColumn("_t", micros(ts)), by, seq, {"_max": ("max", F.col("_t"), False)}, rows=rows
    )
    broken = F.col("_t") < F.col("_max")
    return seen.withColumn(
        "reject_reason", F.when(broken, F.lit("Window events must be timestamp-ordered"))
    ).drop("_t", "_max")


def _floating(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("double", "float")


def _span(seconds: float) -> Column:
    return F.lit(int(round(seconds * 1_000_000))).cast("long")


def context_triggers(
    df: DataFrame, by: Sequence[str], ts: str, seq: str, context: float, interval: float,
    sums: Sequence[str] = (), rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per triggering event: its intervals ``first_k..last_k`` and its context totals.

    Only the first row at a time can trigger, and its context is all earlier rows within the span
    and itself. Context counts and sums are differences of running totals over distinct times, so a
    key's events are never gathered. Differences are exact for integers and decimals only;
    ``context_windows`` sums floating-point columns over the members of each context.
    """
    by = list(by)
    if broken := [c for c in sums if _floating(df, c)]:
        raise ValueError(f"running totals of floating-point columns would cancel: {broken}")
    step, span = _span(interval), _span(context)
    first_row = F.struct(F.col(seq).cast("long").alias("seq"), *[F.col(c) for c in sums])
    timed = df.withColumn("_t", micros(ts))
    slots = timed.groupBy(*by, "_t").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_s_{c}") for c in sums],
        F.min(first_row).alias("_first"),
    )
    anchors = timed.groupBy(*by).agg(F.min("_t").alias("_t0"))
    ordered = over_previous(slots, by, "_t", 1, {"_prev": lambda w: F.lag("_t").over(w)}, rows)
    placed = join_on(ordered, anchors, by)
    index = lambda c: F.floor((c - F.col("_t0")) / step)
    triggers = placed.withColumn("first_k", index(F.col("_prev")) + 1).withColumn("last_k", index(F.col("_t")))
    triggers = stage(triggers.filter(F.col("last_k") >= F.col("first_k")))
    # running totals at each trigger and at the start of its context
    cuts = triggers.select(*by, (F.col("_t") - span).alias("_t")).unionByName(triggers.select(*by, "_t"))
    zero = [F.lit(0).cast("long").alias("_n"), *[F.lit(None).cast(slots.schema[f"_s_{c}"].dataType).alias(f"_s_{c}") for c in sums]]
    points = (
        slots.select(*by, "_t", "_n", *[f"_s_{c}" for c in sums])
        .unionByName(cuts.select(*by, "_t", *zero))
        .groupBy(*by, "_t")
        .agg(F.sum("_n").alias("_n"), *[F.sum(f"_s_{c}").alias(f"_s_{c}") for c in sums])
    )
    totals = {"_c_n": ("sum", F.col("_n"), False)}
    totals |= {f"_c_{c}": ("sum", F.coalesce(F.col(f"_s_{c}"), F.lit(0)), False) for c in sums}
    cumulative = stage(running(stage(points), by, "_t", totals, rows=rows).select(*by, "_t", *totals))
    at = join_on(triggers, cumulative, [*by, "_t"])
    start = cumulative.select(*by, F.col("_t").alias("_from"), *[F.col(c).alias(f"{c}0") for c in totals])
    at = join_on(at.withColumn("_from", F.col("_t") - span), start, [*by, "_from"])
    return at.select(
        *by,
        F.timestamp_micros("_t").alias("triggered_at"),
        F.col("_first.seq").alias("trigger_seq"),
        "first_k",
        "last_k",
        (F.col("_c_n") - F.col("_c_n0") + 1).alias("context_count"),
        *[(F.col(f"_c_{c}") - F.col(f"_c_{c}0") + F.col(f"_first.{c}")).alias(f"context_{c}") for c in sums],
        F.timestamp_micros("_t0").alias("anchor_at"),
    )


def context_windows(
    df: DataFrame, by: Sequence[str], ts: str, seq: str, context: float, interval: float,
    sums: Sequence[str] = (), rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per emission: a trigger after a pause emits every interval passed, with one context."""
    by = list(by)
    floating = [c for c in sums if _floating(df, c)]
    triggers = context_triggers(df, by, ts, seq, context, interval, [c for c in sums if c not in floating], rows)
    if floating:
        members = context_members(df, by, ts, seq, context, interval, rows)
        totals = members.groupBy(*by, "trigger_seq").agg(*[F.sum(c).alias(f"context_{c}") for c in floating])
        triggers = join_on(triggers, totals, [*by, "trigger_seq"])
    step = _span(interval)
    spread = triggers.withColumn("k", F.explode(F.sequence("first_k", "last_k")))
    edge = lambda offset: F.timestamp_micros(F.unix_micros("anchor_at") + (F.col("k") - offset) * step)
    return spread.select(
        *by, "k", edge(1).alias("scoring_start"), edge(0).alias("scoring_end"), "triggered_at", "trigger_seq",
        "context_count", *[f"context_{c}" for c in sums],
    )


def context_members(
    df: DataFrame, by: Sequence[str], ts: str, seq: str, context: float, interval: float, rows: int = CHUNK_ROWS
) -> DataFrame:
    """One row per (emission trigger, context event).

    Triggers of a key have distinct interval numbers, so an event looks its triggers up by the at
    most ``context/interval + 2`` numbers its context can reach: an equi-join with a fixed fan-out.
    """
    by = list(by)
    step, span = _span(interval), _span(context)
    triggers = context_triggers(df, by, ts, seq, context, interval, (), rows)
    anchors = df.groupBy(*by).agg(F.min(micros(ts)).alias("_t0"))
    reach = int(-(-context // interval)) + 1
    events = join_on(df, anchors, by).withColumn("_e", F.floor((micros(ts) - F.col("_t0")) / step))
    spread = events.withColumn("last_k", F.explode(F.sequence(F.col("_e"), F.col("_e") + reach)))
    paired = join_on(spread, triggers, [*by, "last_k"], "inner")
    now = F.unix_micros("triggered_at")
    inside = ((micros(ts) < now) & (micros(ts) >= now - span)) | (F.col(seq).cast("long") == F.col("trigger_seq"))
    return paired.filter(inside).drop("_t0", "_e", "anchor_at")


def window_flush(
    df: DataFrame, by: Sequence[str], ts: str, seq: str, context: float, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Remaining context per key at the end: start and end are the last event's time."""
    by = list(by)
    last = df.groupBy(*by).agg(F.max(micros(ts)).alias("_last"), F.max_by(F.col(seq).cast("long"), F.struct(micros(ts), F.col(seq))).alias("last_seq"))
    inside = micros(ts) >= F.col("_last") - _span(context)
    counts = join_on(df, last, by).filter(inside).groupBy(*by).agg(
        F.count(F.lit(1)).alias("context_count"), F.first("_last").alias("_last"), F.first("last_seq").alias("last_seq")
    )
    moment = F.timestamp_micros("_last")
    return counts.select(*by, moment.alias("scoring_start"), moment.alias("scoring_end"), "last_seq", "context_count")


def expire_keys(df: DataFrame, by: Sequence[str], ts: str, reference: Column, context: float) -> DataFrame:
    """Keys whose last event is at least the context span before the reference time."""
    last = df.groupBy(*by).agg(F.max(micros(ts)).alias("_last"))
    expired = F.unix_micros(reference.cast("timestamp")) - F.col("_last") >= _span(context)
    return last.filter(expired).select(*by, F.timestamp_micros("_last").alias("last_observed_at"))


def dedup_scoring(opportunities: DataFrame, identity: Sequence[str]) -> DataFrame:
    """One row per scoring opportunity: (detector, event) or (detector, key, interval, context)."""
    return opportunities.dropDuplicates(list(identity))


def window_agg(
    df: DataFrame, by: Sequence[str], ts: str, width: str, slide: str | None, aggs: dict[str, Column], watermark: str | None = None
) -> DataFrame:
    """Epoch-aligned tumbling or sliding aggregates; the same call serves batch and streams."""
    source = df.withWatermark(ts, watermark) if watermark else df
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    grouped = source.groupBy(*by, window.alias("w")).agg(*[v.alias(k) for k, v in aggs.items()])
    return grouped.select(*by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *aggs)

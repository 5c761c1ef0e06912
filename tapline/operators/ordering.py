"""Event-time order under a lateness limit, from an arrival order.

Per key, the watermark after arrival i is the largest time seen up to i less the lateness. A row is
late when a later time arrived before it and too late when it is below its own watermark. Other rows
are released, in (time, arrival) order, as soon as the watermark reaches their time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .beacon import micros
from .chunks import CHUNK_ROWS, join_on, row_numbers, running


def late_flags(
    df: DataFrame, by: Sequence[str], ts: str, seq: str, lateness: float, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add ``late`` and ``too_late``. ``lateness`` is in seconds."""
    timed = df.withColumn("_t", micros(ts))
    seen = running(
        timed, by, seq,
        {"_before": ("max", F.col("_t"), False), "_max": ("max", F.col("_t"), True)}, rows=rows,
    )
    limit = F.lit(int(round(lateness * 1_000_000))).cast("long")
    return (
        seen.withColumn("late", F.coalesce(F.col("_t") < F.col("_before"), F.lit(False)))
        .withColumn("too_late", F.col("_t") < F.col("_max") - limit)
        .drop("_before")
        .withColumnRenamed("_max", "_seen")
    )


def reorder(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    seq: str,
    lateness: float,
    late: str = "quarantine",
    number: bool = False,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Release order of every row for an unbounded buffer.

    Adds ``late``, ``too_late``, ``quarantined`` and ``release_arrival``: the arrival number that
    triggers the release, null for rows left to the final flush or quarantined. The output order is
    (release_arrival nulls last, time, arrival); ``number`` adds it as ``release_seq``.

    The first arrival whose running maximum reaches time + lateness is the smallest arrival among
    the record times at or above it. So the record times and the wanted limits are put together, one
    row per distinct value, and a running minimum from above gives the answer: no range join.
    """
    if late not in ("release", "quarantine"):
        raise ValueError("late must be release or quarantine")
    by = list(by)
    limit = F.lit(int(round(lateness * 1_000_000))).cast("long")
    flagged = stage(late_flags(df, by, ts, seq, lateness, rows))
    wanted = flagged.withColumn("_wanted", F.col("_t") + limit)
    # running minimum of the arrivals over falling values: rows below the maximum never win
    points = flagged.select(*by, F.col("_t").alias("_value"), F.col(seq).cast("long").alias("_arrival"))
    limits = wanted.select(*by, F.col("_wanted").alias("_value"), F.lit(None).cast("long").alias("_arrival"))
    values = points.unionByName(limits).groupBy(*by, "_value").agg(F.min("_arrival").alias("_arrival"))
    reached = running(
        values, by, "_value", {"_reached": ("min", F.col("_arrival"), True)}, descending=True, rows=rows
    ).select(*by, F.col("_value").alias("_wanted"), "_reached")
    joined = join_on(wanted, reached, [*by, "_wanted"])
    quarantined = F.col("too_late") & F.lit(late == "quarantine")
    release = (
        F.when(quarantined, F.lit(None).cast("long"))
        .when(F.col("too_late"), F.col(seq).cast("long"))
        .when(F.col("_reached").isNotNull(), F.greatest(F.col("_reached"), F.col(seq).cast("long")))
    )
    out = (
        joined.withColumn("quarantined", quarantined)
        .withColumn("release_arrival", release)
        .drop("_seen", "_wanted", "_reached")
    )
    if number:
        end = F.lit(9_223_372_036_854_775_807).cast("long")
        kept = out.filter(~F.col("quarantined")).withColumn("_rel", F.coalesce("release_arrival", end))
        kept = row_numbers(kept.withColumn("_seq", F.col(seq).cast("long")), by, ["_rel", "_t", "_seq"], "release_seq", rows)
        out = kept.drop("_rel", "_seq").unionByName(out.filter("quarantined"), allowMissingColumns=True)
    return out.drop("_t")


def reorder_stats(reordered: DataFrame, by: Sequence[str], seq: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Counts of a reordered frame per key, with the peak depth of the unbounded buffer.

    Depth after arrival i is the rows buffered so far less those released so far; a row enters and
    is counted before what it triggers leaves, as in a push that buffers first.
    """
    by = list(by)
    reordered = stage(reordered)
    buffered = ~F.col("too_late")
    counts = reordered.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(~F.col("quarantined")).alias("events_accepted"),
        F.count_if(~F.col("quarantined")).alias("events_released"),
        F.count_if("late").alias("late_events"),
        F.count_if("too_late").alias("too_late_events"),
    )
    enters = reordered.filter(buffered).select(*by, F.col(seq).cast("long").alias("_at"), F.lit(1).alias("_in"), F.lit(0).alias("_out"))
    leaves = reordered.filter(buffered & F.col("release_arrival").isNotNull()).select(
        *by, F.col("release_arrival").alias("_at"), F.lit(0).alias("_in"), F.lit(1).alias("_out")
    )
    steps = enters.unionByName(leaves).groupBy(*by, "_at").agg(F.sum("_in").alias("_in"), F.sum("_out").alias("_out"))
    moved = running(
        stage(steps), by, "_at",
        {"_entered": ("sum", F.col("_in"), True), "_left": ("sum", F.col("_out"), False)}, rows=rows,
    )
    peak = moved.groupBy(*by).agg(F.max(F.col("_entered") - F.col("_left")).alias("peak_buffer_depth"))
    return join_on(counts, peak, by).withColumn("peak_buffer_depth", F.coalesce("peak_buffer_depth", F.lit(0)))

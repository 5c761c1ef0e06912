"""Beacon features: gaps between flows, anchored windows, periodicity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .chunks import CHUNK_ROWS, exact_percentiles, if_small, join_on, over_previous, row_numbers

# Order of the beacon vector; the protocol columns are one-hot.
BEACON_FEATURES = (
    "Dur", "Pkts", "Bytes", "IAT", "IAT_Variance", "IAT_Std", "Bytes_Variance", "Bytes_Per_Packet", "Proto_esp",
    "Proto_icmp", "Proto_igmp", "Proto_ipv6", "Proto_ipv6-icmp", "Proto_ipx/spx", "Proto_pim", "Proto_rarp",
    "Proto_rtcp", "Proto_rtp", "Proto_tcp", "Proto_udp", "Proto_udt", "Proto_unas", "FlowDir_Reverse",
)
PROTOCOLS = tuple(n.removeprefix("Proto_") for n in BEACON_FEATURES if n.startswith("Proto_"))


def micros(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast("timestamp"))


def iat(
    df: DataFrame, by: Sequence[str], seq: str, ts: str, name: str = "iat_seconds", rows: int = CHUNK_ROWS
) -> DataFrame:
    """Seconds since the previous row of the key in ``seq`` order; null for the first row."""
    gap = lambda w: (micros(ts) - F.lag(micros(ts)).over(w)) / F.lit(1e6)
    return over_previous(df, by, seq, 1, {name: gap}, rows)


def gaps_by_time(df: DataFrame, by: Sequence[str], ts: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Gap statistics per key in seconds: mean, median-free moments, extremes and lag-1 correlation.

    Rows with equal times only add gaps of zero, so they are counted before anything is ordered.
    """
    by = list(by)
    slots = df.groupBy(*by, micros(ts).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    gapped = over_previous(
        slots, by, "_t", 1, {"_gap": lambda w: (F.col("_t") - F.lag("_t").over(w)) / F.lit(1e6)}, rows
    )
    n = F.col("_gaps")
    # gaps: one per distinct time after the first, plus a zero gap for every repeat
    summed = gapped.groupBy(*by).agg(
        F.sum("_n").alias("flow_count"),
        (F.sum("_n") - 1).alias("_gaps"),
        F.coalesce(F.sum("_gap"), F.lit(0.0)).alias("_sum"),
        F.avg("_gap").alias("_mean_pos"),
        F.coalesce(F.var_pop("_gap"), F.lit(0.0)).alias("_var_pos"),
        F.count("_gap").alias("_pos"),
        F.max("_gap").alias("_max"),
        F.min("_gap").alias("_min_pos"),
    )
    mean = F.col("_sum") / n
    # total squared deviation: of the positive gaps around their mean, moved to the overall mean, plus the zeros
    around = F.col("_pos") * (F.col("_var_pos") + F.pow(F.coalesce("_mean_pos", F.lit(0.0)) - mean, 2))
    m2 = around + (n - F.col("_pos")) * F.pow(mean, 2)
    return summed.select(
        *by,
        "flow_count",
        F.when(n > 0, mean).alias("iat_mean"),
        F.when(n > 1, F.sqrt(m2 / (n - 1))).alias("iat_std"),
        F.when(n > 0, m2 / n).alias("iat_var_pop"),
        F.when(n > 0, F.when(n > F.col("_pos"), F.lit(0.0)).otherwise(F.col("_min_pos"))).alias("iat_min"),
        F.when(n > 0, F.coalesce("_max", F.lit(0.0))).alias("iat_max"),
    )


def anchored_windows(
    df: DataFrame, by: Sequence[str], ts: str, width: float, step: float
) -> DataFrame:
    """Copy each row into the windows that hold it. Windows start at the key's first row.

    Window k covers [t0 + k*step, t0 + k*step + width) and exists while its start is before the
    key's last row. ``width`` must be a multiple of ``step``; a row falls into at most width/step
    windows. Adds ``window_index`` and ``window_start`` (in the unit of ``ts``, seconds for
    timestamps).
    """
    overlap = round(width / step)
    by = list(by)
    double = df.schema[ts].dataType.typeName() in ("double", "float")
    at = F.col(ts) if double else micros(ts)
    unit = 1.0 if double else 1_000_000
    hop = F.lit(step) if double else F.lit(int(step * 1_000_000)).cast("long")
    spans = stage(df.groupBy(*by).agg(F.min(at).alias("_t0"), F.max(at).alias("_t1")))
    placed = join_on(df, if_small(spans), by)
    last = F.floor((at - F.col("_t0")) / hop)
    first = F.greatest(last - (overlap - 1), F.lit(0))
    spread = placed.withColumn("window_index", F.explode(F.sequence(first, last)))
    start = F.col("_t0") + F.col("window_index") * hop
    return (
        spread.withColumn("_start", start)
        .filter(F.col("_start") < F.col("_t1"))
        .withColumn("window_start", F.col("_start") / F.lit(unit))
        .drop("_t0", "_t1", "_start")
    )


def beacon_features(
    df: DataFrame,
    by: Sequence[str] = ("src", "dst"),
    ts: str = "timestamp_unix",
    width: float = 300.0,
    step: float = 150.0,
    label: str | None = "target",
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The 23 beacon features per key and anchored window of at least two flows.

    Columns read: ``ts``, ``bytes``, ``pkts``, ``protocol``, ``flow_dir_reverse`` and the label,
    whose window value is the largest. All but the gap variance add up on the map side. Gaps come
    from the distinct times of a key, which are ordered in chunks once for all of its windows: a gap
    belongs to every window that holds both of its ends.
    """
    by = list(by)
    windows = anchored_windows(df, by, ts, width, step)
    key = [*by, "window_index"]
    double = df.schema[ts].dataType.typeName() in ("double", "float")
    seconds = F.col(ts) if double else micros(ts) / F.lit(1e6)
    lowered = F.lower(F.col("protocol").cast("string"))
    pkts, size = F.col("pkts").cast("double"), F.col("bytes").cast("double")
    sums = windows.groupBy(*key).agg(
        F.first("window_start").alias("window_start"),
        F.count(F.lit(1)).alias("flows"),
        (F.max(seconds) - F.min(seconds)).alias("Dur"),
        F.sum(pkts).alias("Pkts"),
        F.sum(size).alias("Bytes"),
        F.var_pop(size).alias("Bytes_Variance"),
        *[F.max((lowered == p).cast("double")).alias(f"Proto_{p}") for p in PROTOCOLS],
        F.max(F.col("flow_dir_reverse").cast("double")).alias("FlowDir_Reverse"),
        *([F.max(label).alias("label")] if label else []),
    )
    # distinct times of the key, each with the gap to the time before it
    # doubles near today's epoch are 0.24 microseconds apart, so nanoseconds order them all
    order = F.round(F.col(ts) * F.lit(1e9), 0).cast("long") if double else micros(ts)
    slots = df.groupBy(*by, F.col(ts), order.alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    gap = lambda w: seconds - F.lag(seconds).over(w)
    before = lambda w: F.lag(F.col(ts)).over(w)
    gapped = over_previous(
        slots, by, "_k", 1, {"_gap": gap, "_before": before}, rows
    )
    in_windows = anchored_windows(gapped, by, ts, width, step)
    unit = F.lit(1.0) if double else F.lit(1e6)
    reached = (F.col("_before") if double else micros("_before")) >= F.col("window_start") * unit
    inside = F.when(reached, F.col("_gap"))
    moments = in_windows.groupBy(*key).agg(
        F.count(inside).alias("_pos"), F.avg(inside).alias("_mean"), F.var_pop(inside).alias("_var")
    )
    joined = join_on(sums.filter("flows >= 2"), moments, key)
    n = (F.col("flows") - 1).cast("double")
    mean = F.col("Dur") / n
    positive = F.coalesce(F.col("_mean"), F.lit(0.0))
    m2 = F.col("_pos") * (F.coalesce("_var", F.lit(0.0)) + F.pow(positive - mean, 2)) + (n - F.col("_pos")) * F.pow(mean, 2)
    derived = {
        "IAT": mean,
        "IAT_Variance": m2 / n,
        "IAT_Std": F.sqrt(m2 / n),
        "Bytes_Per_Packet": F.when(F.col("Pkts") != 0, F.col("Bytes") / F.col("Pkts")).otherwise(F.lit(0.0)),
    }
    names = lambda c: derived[c] if c in derived else F.col(f"`{c}`")
    return joined.select(
        *key, "window_start", "flows", *[names(c).alias(c) for c in BEACON_FEATURES], *(["label"] if label else [])
    )


def beacon_periodicity(
    df: DataFrame, by: Sequence[str], ts: str, seq: str, port: str | None = None, rows: int = CHUNK_ROWS, destination: str | None = None,
    lags: Sequence[int] = (1,), tolerance: float = 0.1,
) -> DataFrame:
    """Periodicity of a conversation: gap moments and exact median, variation, burstiness and autocorrelation of the gaps.

    Gaps follow (time, seq). Equal times are broken by ``seq`` through a dense row number. ``autocorrelation`` is that at lag
    1, ``autocorrelation_<k>`` those of further ``lags``. ``periodicity_score`` is the share of gaps within ``tolerance`` of
    the median gap; it is no probability. ``destination_repetition`` is the share of flows to a destination that the key has had before.
    """
    by, furthest = list(by), max(lags)
    timed = df.withColumn("_t", micros(ts)).withColumn("_s", F.col(seq).cast("long"))
    numbered = stage(row_numbers(timed, by, ["_t", "_s"], "_i", rows))
    gap = lambda k: lambda w: (F.lag("_t", k).over(w) - F.lag("_t", k + 1).over(w)) / F.lit(1e6) if k else (F.col("_t") - F.lag("_t").over(w)) / F.lit(1e6)
    gapped = over_previous(numbered, by, "_i", furthest + 1, {f"_gap{k}": gap(k) for k in (0, *lags)}, rows)
    gapped = stage(gapped.select(*by, *[f"_gap{k}" for k in (0, *lags)]))

    def correlation(k: int) -> Column:
        both = F.col(f"_gap{k}").isNotNull()
        x, y = F.when(both, F.col("_gap0")), F.when(both, F.col(f"_gap{k}"))
        return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.corr(x, y)).alias("autocorrelation" if k == 1 else f"autocorrelation_{k}")

    stats = gapped.groupBy(*by).agg(
        F.count(F.lit(1)).alias("flow_count"),
        F.avg("_gap0").alias("iat_mean"),
        F.stddev_pop("_gap0").alias("iat_std"),
        F.min("_gap0").alias("iat_min"),
        F.max("_gap0").alias("iat_max"),
        *[correlation(k) for k in lags],
    )
    medians = stage(exact_percentiles(gapped, by, "_gap0", {"iat_median": 0.5}, rows))
    # Regularity from counts per distinct gap, so a busy key is not joined row by row.
    per_gap = gapped.filter("_gap0 IS NOT NULL").groupBy(*by, "_gap0").agg(F.count(F.lit(1)).alias("_n"))
    near = F.abs(F.col("_gap0") - F.col("iat_median")) <= tolerance * F.col("iat_median")
    regular = join_on(per_gap, medians, by).groupBy(*by).agg((F.sum(F.when(near, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("periodicity_score"))
    mean, std = F.col("iat_mean"), F.col("iat_std")
    stats = join_on(join_on(stats, medians, by), regular, by)
    stats = stats.withColumn("iat_cv", F.when(mean > 0, std / mean)).withColumn("burstiness", F.when(std + mean > 0, (std - mean) / (std + mean)))
    if destination:
        kinds = df.groupBy(*by, destination).agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg((1 - F.count(F.lit(1)) / F.sum("_n")).alias("destination_repetition"))
        stats = join_on(stats, kinds, by)
    if port:
        stats = join_on(stats, group_entropy(df, by, port, "destination_port_entropy"), by)
    return stats


def group_entropy(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Shannon entropy in bits of a column per key, from counts per value."""
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    n, total = F.col("_n").cast("double"), F.sum("_n").cast("double")
    out = F.log2(total) - F.sum(n * F.log2(n)) / total
    return counts.groupBy(*by).agg(out.alias(name))

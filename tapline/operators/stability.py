"""How stable a score is when timing and volume features are shaken."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which features may be perturbed, by name.
TIMING_TOKENS = ("iat", "duration", "time", "interval", "freq")
VOLUME_TOKENS = ("byte", "pkt", "packet", "payload", "size")
FIXED_PREFIXES = ("has_", "is_", "tls_", "proto_", "cert_")


def is_perturbable(name: str) -> bool:
    lowered = name.lower()
    return not lowered.startswith(FIXED_PREFIXES) and any(t in lowered for t in TIMING_TOKENS + VOLUME_TOKENS)


def _uniform(*parts: Column) -> Column:
    """Uniform in (0,1) from a hash, so a task that runs again draws the same noise."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def normal_noise(*parts: Column) -> Column:
    u, v = _uniform(*parts, F.lit("u")), _uniform(*parts, F.lit("v"))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * pi * v)


def perturbed(name: str, row_id: Column, sample: Column, seed: int, relative: float, absolute: float) -> Column:
    """A feature in one variant of a row; sample 0 is the row itself. Counts stay whole."""
    value = F.col(name).cast("double")
    if not is_perturbable(name):
        return value
    sigma = F.greatest(F.abs(value) * relative, F.lit(absolute))
    moved = F.greatest(F.lit(0.0), value + sigma * normal_noise(row_id, sample, F.lit(name), F.lit(seed)))
    if "count" in name.lower() or "pkt" in name.lower():
        moved = F.rint(moved)
    return F.when(sample == 0, value).otherwise(moved)


def _verdict(df: DataFrame, threshold: float, max_std: float, min_agreement: float) -> DataFrame:
    return df.withColumn(
        "adversarially_unstable",
        (F.col("probability_stddev") >= max_std) | (F.col("decision_stability") < min_agreement),
    )


def stability(
    df: DataFrame, row_id: str, columns: Sequence[str], score: Callable[[dict[str, Column]], Column], threshold: float,
    samples: int = 25, relative: float = 0.08, absolute: float = 0.001, max_std: float = 0.08,
    min_agreement: float = 0.80, seed: int = 42,
) -> DataFrame:
    """Robust score of each row for a scorer that is a column expression.

    Variants live in an array of ``samples`` scores within the row: no rows are multiplied and
    nothing is shuffled.
    """
    variant = lambda s: score({c: perturbed(c, F.col(row_id), s, seed, relative, absolute) for c in columns})
    out = df.withColumn("_s", F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), variant))
    ordered = F.array_sort("_s")
    mid = samples // 2
    median = F.element_at(ordered, mid + 1)
    if samples % 2 == 0:
        median = (F.element_at(ordered, mid) + F.element_at(ordered, mid + 1)) / 2
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda x, y: x + f(y))
    out = out.withColumn("robust_probability", median).withColumn("raw_probability", F.element_at("_s", 1))
    mean = total(F.col("_s"), lambda y: y) / samples
    out = out.withColumn("_m", mean).withColumn(
        "probability_stddev", F.sqrt(total(F.col("_s"), lambda y: (y - F.col("_m")) * (y - F.col("_m"))) / samples)
    )
    side = F.col("robust_probability") >= threshold
    agree = F.size(F.filter("_s", lambda y: (y >= threshold) == side)) / F.lit(float(samples))
    return _verdict(out.withColumn("decision_stability", agree), threshold, max_std, min_agreement).drop("_s", "_m")


def stability_with_model(
    df: DataFrame, row_id: str, columns: Sequence[str], score: Callable[[DataFrame], DataFrame], threshold: float,
    samples: int = 25, relative: float = 0.08, absolute: float = 0.001, max_std: float = 0.08,
    min_agreement: float = 0.80, seed: int = 42, score_column: str = "score",
) -> DataFrame:
    """The same for a fitted model that transforms DataFrames. Each row becomes ``samples`` rows."""
    spread = df.select(row_id, *columns).withColumn("_sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    noisy = spread.select(
        row_id, "_sample",
        *[perturbed(c, F.col(row_id), F.col("_sample"), seed, relative, absolute).alias(c) for c in columns],
    )
    s = F.col(score_column)
    # `samples` values per row id: a fixed small group
    out = score(noisy).groupBy(row_id).agg(
        F.percentile(s, F.lit(0.5)).alias("robust_probability"),
        F.max(F.when(F.col("_sample") == 0, s)).alias("raw_probability"),
        F.stddev_pop(s).alias("probability_stddev"),
        F.avg((s >= threshold).cast("double")).alias("_over"),
    )
    agree = F.when(F.col("robust_probability") >= threshold, F.col("_over")).otherwise(1 - F.col("_over"))
    return _verdict(out.withColumn("decision_stability", agree), threshold, max_std, min_agreement).drop("_over")

"""Data-set profiles: distributions, duplicates, label conflicts, patterns, correlation, information."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import safe_divide
from .chunks import exact_percentiles, join_on


def class_distribution(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per value combination with their share of all rows."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("share", F.col("rows") / df.agg(F.count(F.lit(1))).scalar())


def source_label_matrix(df: DataFrame, source: str, label: str, values: Sequence[int] = (0, 1)) -> DataFrame:
    """Source by label counts; the values are given, so no extra pass looks for them."""
    counted = [F.count_if(F.col(label) == v).alias(f"label_{v}") for v in values]
    return df.groupBy(source).agg(*counted, F.count(F.lit(1)).alias("rows"))


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), value_type: str = "double") -> DataFrame:
    """One row per (row, column) as ``feature``/``value``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(value_type).alias("value")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.feature", "_p.value")


def with_spans(df: DataFrame, columns: Sequence[str], of: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``unpivot`` without nulls, and the least and largest value (``_lo``, ``_hi``) of each feature among the rows of ``of``.

    The spans are one row of numbers, read as a scalar: no row is shuffled to meet them.
    """
    number = {c: F.col(c).cast("double") for c in columns}
    spans = of.agg(*[f(v).alias(f"{n}_{i}") for i, v in enumerate(number.values()) for n, f in (("lo", F.min), ("hi", F.max))])
    spans = spans.select(F.struct("*").alias("_spans")).scalar()
    part = lambda i, c: F.struct(F.lit(c).alias("feature"), number[c].alias("value"), F.col(f"_spans.lo_{i}").alias("_lo"), F.col(f"_spans.hi_{i}").alias("_hi"))
    pairs = F.array(*[part(i, c) for i, c in enumerate(columns)])
    long = df.withColumn("_spans", spans).select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.*")
    return long.filter(F.col("value").isNotNull())


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: nulls, distinct values with null as one, the dominant value and its share.

    Values are counted per (column, value) first, so distinct counts are exact and no group grows
    beyond one row per distinct value. Ties of the dominant value go to the smallest.
    """
    counts = unpivot(df, columns, value_type="string").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_n"))
    out = counts.groupBy("feature").agg(
        F.sum("_n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("_n"))), F.lit(0)).alias("nulls"),
        F.count(F.lit(1)).alias("distinct_values"),
        F.max("_n").alias("dominant_count"),
        F.min(F.struct((-F.col("_n")).alias("n"), F.col("value"))).getField("value").alias("dominant_value"),
    )
    return out.withColumn("dominant_share", F.col("dominant_count") / F.col("rows")).withColumn(
        "constant", F.col("distinct_values") == 1
    )


def describe(df: DataFrame, columns: Sequence[str], quantiles: dict[str, float] | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per numeric column."""
    long = unpivot(df, columns)
    basic = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    marks = quantiles or {"p25": 0.25, "median": 0.5, "p75": 0.75}
    return join_on(basic, exact_percentiles(long, ["feature"], "value", marks), ["feature"])


def class_compare(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Means and exact medians per class and feature with their differences, from one pass of counts per value."""
    long = unpivot(df.filter(F.col(label).isin(0, 1)), columns, [label])
    basics = {"mean": F.sum(F.col("_n") * F.col("_x")) / F.nullif(F.sum("_n"), F.lit(0))}
    found = exact_percentiles(long, ["feature", label], "value", {"median": 0.5}, basics=basics)
    of = lambda name, c: F.max(F.when(F.col(label) == c, F.col(name))).alias(f"{name}_{c}")
    wide = found.groupBy("feature").agg(*[of(name, c) for name in ("mean", "median") for c in (0, 1)])
    return wide.withColumn("mean_difference", F.col("mean_1") - F.col("mean_0")).withColumn(
        "median_difference", F.col("median_1") - F.col("median_0")
    )


def pattern_counts(df: DataFrame, columns: Sequence[str], label: str | None = None, source: str | None = None) -> DataFrame:
    """Rows per distinct feature vector, with attacks and the spread over sources if asked for."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    if label:
        aggs += [F.sum(F.col(label).cast("long")).alias("attacks")]
    if source:
        aggs += [F.min(source).alias("first_source"), F.max(source).alias("last_source")]
    return df.groupBy(*columns).agg(*aggs)


def duplicate_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row on exact copies: unique vectors, rows in duplicated patterns, multiplicities."""
    n = F.col("rows")
    return pattern_counts(df, columns).agg(
        F.sum(n).alias("total_rows"),
        F.count(F.lit(1)).alias("unique_vectors"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("rows_in_duplicated"),
        F.sum(n - 1).alias("surplus_rows"),
        F.max(n).alias("max_multiplicity"),
        F.count_if(n > 1).alias("patterns_over_1"),
        F.count_if(n >= 5).alias("patterns_5_plus"),
        F.count_if(n >= 10).alias("patterns_10_plus"),
    )


def duplicate_rate_by_source(df: DataFrame, columns: Sequence[str], source: str) -> DataFrame:
    """Share of each source's rows that repeat an earlier vector of the same source."""
    counts = df.groupBy(source, *columns).agg(F.count(F.lit(1)).alias("_n"))
    out = counts.groupBy(source).agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("unique_vectors"))
    return out.withColumn("duplicate_rate", (F.col("rows") - F.col("unique_vectors")) / F.col("rows"))


def label_conflicts(df: DataFrame, columns: Sequence[str], label: str, source: str) -> DataFrame:
    """One row: patterns with both labels, patterns over several sources, and their rows."""
    counts = pattern_counts(df, columns, label, source)
    mixed = (F.col("attacks") > 0) & (F.col("attacks") < F.col("rows"))
    spread = F.col("first_source") != F.col("last_source")
    rows = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("rows"))), F.lit(0))
    return counts.agg(
        F.count(F.lit(1)).alias("patterns"),
        F.count_if(mixed).alias("conflicting_patterns"), rows(mixed).alias("conflicting_rows"),
        F.count_if(spread).alias("cross_source_patterns"), rows(spread).alias("cross_source_rows"),
    )


def pattern_stats(df: DataFrame, key: Sequence[str], label: str) -> DataFrame:
    """Per pattern: count, attacks, attack rate, kind, majority accuracy and ambiguity."""
    out = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("train_count"), F.sum(F.col(label).cast("long")).alias("train_attack_count")
    )
    rate = F.col("train_attack_count") / F.col("train_count")
    return (
        out.withColumn("train_attack_rate", rate)
        .withColumn(
            "pattern_type", F.when(rate == 0, "Benign-only").when(rate == 1, "Attack-only").otherwise("Mixed")
        )
        .withColumn("majority_accuracy", F.greatest(rate, 1 - rate))
        .withColumn("ambiguity", 0.5 - F.abs(rate - 0.5))
    )


def fp_contribution(df: DataFrame, source: str, label: str, predicted: str) -> DataFrame:
    """False positives per source: count, rate within the source's benign rows, share of all."""
    benign = F.col(label) == 0
    out = df.groupBy(source).agg(
        F.count_if(benign).alias("benign_rows"), F.count_if(benign & (F.col(predicted) == 1)).alias("false_positives")
    )
    everything = F.sum("false_positives").over(Window.partitionBy())
    return out.withColumn("fpr", safe_divide(F.col("false_positives"), F.col("benign_rows"))).withColumn(
        "fp_share", safe_divide(F.col("false_positives"), everything)
    )


def fp_patterns(df: DataFrame, key: Sequence[str], label: str, predicted: str, n: int = 20) -> DataFrame:
    """The patterns with most false positives; ties by key."""
    wrong = df.filter((F.col(label) == 0) & (F.col(predicted) == 1))
    counts = wrong.groupBy(*key).agg(F.count(F.lit(1)).alias("false_positives"))
    return counts.orderBy(F.desc("false_positives"), *key).limit(n)


def score_distribution(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Count, extremes, mean and exact percentiles of the score per group."""
    basic = df.groupBy(*by).agg(
        F.count(score).alias("count"), F.min(score).alias("min"), F.max(score).alias("max"), F.avg(score).alias("mean")
    )
    marks = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.90, "p95": 0.95}
    return join_on(basic, exact_percentiles(df, by, score, marks), by)


def correlation_pairs(df: DataFrame, columns: Sequence[str], at_least: float | None = None) -> DataFrame:
    """Pearson correlation of every column pair in one pass, optionally only the strong ones.

    The number of pairs depends on the columns, not on the rows.
    """
    pairs = list(combinations(columns, 2))
    # corr of a constant column is undefined, so it is guarded by the deviations
    value = lambda a, b: F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b))
    one = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).agg(
        *[value(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"_{i}").alias("correlation"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    out = one.select(F.explode(rows).alias("_p")).select("_p.*")
    return out if at_least is None else out.filter(F.abs("correlation") >= at_least)


def mutual_information(df: DataFrame, columns: Sequence[str], label: str, bins: int = 20) -> DataFrame:
    """Mutual information in nats between each feature and the label over equal-width bins.

    Own deterministic estimate from contingency counts; a nearest-neighbour estimate is randomised
    and not reproduced.
    """
    placed = with_spans(df, columns, df, [label])
    width = F.col("_hi") - F.col("_lo")
    slot = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("_lo")) * bins / width), F.lit(bins - 1))).otherwise(F.lit(0))
    joint = placed.groupBy("feature", slot.alias("_bin"), label).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n").cast("double")
    per_feature = Window.partitionBy("feature")  # at most bins x classes rows
    margin = lambda c: F.sum(n).over(Window.partitionBy("feature", c))
    total = F.sum(n).over(per_feature)
    term = n / total * F.log(n * total / (margin("_bin") * margin(label)))
    return joint.select("feature", term.alias("_term")).groupBy("feature").agg(F.sum("_term").alias("mutual_information"))


def rank_features(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Rank of each score, highest first and ties to the best place, with the mean rank."""
    ranks = [F.rank().over(Window.orderBy(F.desc(s))).alias(f"{s}_rank") for s in scores]  # one row per feature
    out = df.select("*", *ranks)
    return out.withColumn("mean_rank", sum(F.col(f"{s}_rank") for s in scores) / len(scores))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def best_per_group(df: DataFrame, by: Sequence[str], score: Column, tie: Column) -> DataFrame:
    """The row with the highest score per group; the smaller tie value wins."""
    others = [c for c in df.columns if c not in by]
    ranked = F.min_by(F.struct(*others), F.struct(-score, tie))
    out = df.groupBy(*by).agg(ranked.alias("_row"))
    return out.select(*by, *[F.col(f"_row.{c}").alias(c) for c in others])


def series_peak(df: DataFrame, by: Sequence[str], ts: str, value: str) -> DataFrame:
    """When each series peaks and how high; the earliest of equal peaks."""
    at = F.min_by(F.col(ts), F.struct(-F.col(value), F.col(ts)))
    return df.groupBy(*by).agg(at.alias("peak_at"), F.max(value).alias("peak_value"))

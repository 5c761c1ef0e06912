"""Evaluation of scored rows: confusion metrics, threshold sweeps, ranking metrics, calibration, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import safe_divide
from ..session import stage
from .chunks import CHUNK_ROWS, if_small, join_on, running_by_value
from .profile import unpivot, with_spans

# Threshold grids as (first, last, step).
GRIDS = {
    "coarse": (0.05, 0.95, 0.01),
    "fine": (0.01, 0.995, 0.005),
    "dense": (0.001, 0.999, 0.001),
    "wide": (0.2, 0.85, 0.05),
}


def threshold_grid(name: str) -> list[float]:
    first, last, step = GRIDS[name]
    return [round(first + i * step, 6) for i in range(int(round((last - first) / step)) + 1)]


def confusion_metrics(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Rates from confusion counts; a rate over nothing is 0."""
    f1 = safe_divide(2 * tp, 2 * tp + fp + fn)
    f1_negative = safe_divide(2 * tn, 2 * tn + fp + fn)
    return {
        "accuracy": safe_divide(tp + tn, tp + fp + tn + fn),
        "precision": safe_divide(tp, tp + fp),
        "recall": safe_divide(tp, tp + fn),
        "f1": f1,
        "fpr": safe_divide(fp, fp + tn),
        "fnr": safe_divide(fn, fn + tp),
        "specificity": safe_divide(tn, tn + fp),
        "macro_f1": (f1 + f1_negative) / 2,
    }


def binary_metrics(
    df: DataFrame, label: str, score: str, threshold: float | Column, by: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts and rates at one threshold, overall or per group."""
    cut = threshold if isinstance(threshold, Column) else F.lit(threshold)
    hit, positive = F.col(score) >= cut, F.col(label) == 1
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(hit & positive).alias("tp"), F.count_if(hit & ~positive).alias("fp"),
        F.count_if(~hit & ~positive).alias("tn"), F.count_if(~hit & positive).alias("fn"),
    )
    rates = confusion_metrics(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    return counts.select("*", *[v.alias(k) for k, v in rates.items()])


def grid_bucket(score: Column, grid: Sequence[float]) -> Column:
    """How many of the ascending thresholds a score reaches, exactly and in constant time.

    The even spacing gives a guess; comparing with the neighbouring thresholds corrects rounding.
    """
    step = (grid[-1] - grid[0]) / (len(grid) - 1)
    values = F.array(*[F.lit(float(g)) for g in grid])
    guess = F.floor((score - F.lit(grid[0])) / F.lit(step)).cast("int") + 1
    guess = F.greatest(F.lit(0), F.least(F.lit(len(grid)), guess))
    at = lambda i: F.try_element_at(values, i)
    up = (guess < len(grid)) & (score >= at(F.least(guess + 1, F.lit(len(grid)))))
    down = (guess > 0) & (score < at(F.greatest(guess, F.lit(1))))
    return F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)


def threshold_sweep(
    df: DataFrame, label: str, score: str, grid: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts and rates at every threshold of an evenly spaced grid.

    Rows are counted once per score bucket; the counts at a threshold are sums over the buckets at
    or above it, so work does not multiply with the grid.
    """
    by = list(by)
    bucket = grid_bucket(F.col(score), grid)
    counts = df.groupBy(*by, bucket.alias("_b")).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_q")
    )
    # at most grid + 1 rows per group: gathered into one small map per group, read per threshold
    packed = counts.groupBy(*by).agg(
        F.collect_list(F.struct("_b", "_p", "_q")).alias("_counts"), F.sum("_p").alias("_P"), F.sum("_q").alias("_Q")
    )
    steps = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(float(g)).alias("t")) for i, g in enumerate(grid)])
    spread = packed.select(*by, "_counts", "_P", "_Q", F.explode(steps).alias("_s"))
    above = lambda f: F.aggregate(
        F.filter("_counts", lambda c: c["_b"] >= F.col("_s.i")), F.lit(0).cast("long"), lambda a, c: a + c[f]
    )
    out = spread.select(*by, F.col("_s.t").alias("threshold"), above("_p").alias("tp"), above("_q").alias("fp"), "_P", "_Q")
    out = out.select(*by, "threshold", "tp", "fp", (F.col("_Q") - F.col("fp")).alias("tn"), (F.col("_P") - F.col("tp")).alias("fn"))
    rates = confusion_metrics(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    return out.select("*", *[v.alias(k) for k, v in rates.items()])


def pick_threshold(sweep: DataFrame, by: Sequence[str] = (), min_recall: float | None = None) -> DataFrame:
    """The sweep row of the best F1 (the lowest threshold of equals), among those with enough recall."""
    eligible = sweep if min_recall is None else sweep.filter(F.col("recall") >= min_recall)
    others = [c for c in sweep.columns if c not in by]
    best = F.min_by(F.struct(*others), F.struct(-F.col("f1"), F.col("threshold")))
    picked = eligible.groupBy(*by).agg(best.alias("_r")).filter(F.col("_r").isNotNull())
    return picked.select(*by, *[F.col(f"_r.{c}").alias(c) for c in others])


def precision_targets(sweep: DataFrame, targets: Sequence[float]) -> DataFrame:
    """For each wanted precision the sweep row of the highest recall that reaches it."""
    wanted = F.explode(F.array(*[F.lit(float(t)) for t in targets]))
    spread = sweep.withColumn("target", wanted).filter(F.col("precision") >= F.col("target"))
    row = F.struct("threshold", "precision", "recall", "f1", "fpr")
    best = spread.groupBy("target").agg(F.min_by(row, F.struct(-F.col("recall"), F.col("threshold"))).alias("_r"))
    return best.select("target", "_r.*")


def nearest_threshold(sweep: DataFrame, value: float) -> DataFrame:
    """The sweep row closest to a threshold."""
    row = F.min_by(F.struct(*sweep.columns), F.struct(F.abs(F.col("threshold") - value), F.col("threshold")))
    return sweep.agg(row.alias("_r")).select("_r.*")


def threshold_neighbourhood(sweep: DataFrame, value: float, reach: float = 0.05) -> DataFrame:
    return sweep.filter(F.abs(F.col("threshold") - value) <= reach + 1e-9)


def _by_score(df: DataFrame, label: str, score: str, by: Sequence[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """Positives and negatives per distinct score with those strictly below, and the group totals."""
    by = list(by)
    counts = stage(
        df.filter(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    )
    below = {"p_below": ("sum", F.col("p"), False), "q_below": ("sum", F.col("q"), False)}
    summed = running_by_value(counts, by, "score", below, rows=rows)
    totals = counts.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    if by:
        return join_on(summed, if_small(stage(totals)), by)
    both = totals.select(F.struct("all_p", "all_q").alias("_t"))
    return summed.withColumn("_t", both.scalar()).select("*", "_t.all_p", "_t.all_q").drop("_t")


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC by ranks, equal scores counting half. Null when a group has one class only."""
    points = _by_score(df, label, score, by)
    wins = F.sum(F.col("p") * (F.col("q_below") + F.col("q") / 2.0))
    p, q = F.first("all_p"), F.first("all_q")
    auc = F.when((p > 0) & (q > 0), wins / (p.cast("double") * q))
    return points.groupBy(*by).agg(auc.alias("roc_auc"), p.alias("positives"), q.alias("negatives"))


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Average precision: the sum over distinct scores of recall gain times precision."""
    points = _by_score(df, label, score, by)
    tp = F.col("all_p") - F.col("p_below")
    seen = tp + F.col("all_q") - F.col("q_below")
    term = F.when(F.col("all_p") > 0, F.col("p") / F.col("all_p") * tp / seen)
    return points.groupBy(*by).agg(F.sum(term).alias("average_precision"))


def roc_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score: rates when everything at or above it is flagged.

    A rate over no rows is 0, as in the confusion metrics; average precision without a positive is null,
    as it would be the mean of nothing.
    """
    points = _by_score(df, label, score, by)
    tp, fp = F.col("all_p") - F.col("p_below"), F.col("all_q") - F.col("q_below")
    precision, recall = safe_divide(tp, tp + fp), safe_divide(tp, F.col("all_p"))
    fpr = safe_divide(fp, F.col("all_q"))
    return points.select(
        *by, "score", tp.alias("tp"), fp.alias("fp"), recall.alias("tpr"), fpr.alias("fpr"), precision.alias("precision"),
        (recall - fpr).alias("youden_j"),
        safe_divide(2 * precision * recall, precision + recall).alias("f1"),
    )


def best_points(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The score of the largest Youden J and of the largest F1; equal ones go to the higher score."""
    at = lambda c: F.max_by(F.col("score"), F.struct(F.round(F.col(c), 12), F.col("score")))
    return points.groupBy(*by).agg(
        at("youden_j").alias("youden_score"), F.max("youden_j").alias("youden_j"),
        at("f1").alias("f1_score"), F.max("f1").alias("max_f1"),
    )


def metrics_by_group(df: DataFrame, label: str, score: str, threshold: float, by: Sequence[str]) -> DataFrame:
    """Confusion metrics and AUC per capture; AUC is null where only one class occurs."""
    out = binary_metrics(df, label, score, threshold, by)
    return join_on(out, roc_auc(df, label, score, by).select(*by, "roc_auc"), by)


def univariate_auc(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """AUC of each feature alone, folded to at least one half, with its direction."""
    long = unpivot(df, columns, [label])
    auc = roc_auc(long, label, "value", ["feature"])
    raw = F.coalesce("roc_auc", F.lit(0.5))
    return auc.select(
        "feature",
        raw.alias("raw_auc"),
        F.greatest(raw, 1 - raw).alias("auc"),
        F.when(raw > 0.5, "positive").when(raw < 0.5, "negative").otherwise("none").alias("direction"),
    )


def calibration_report(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Reliability bins: rows, mean score, observed rate and each bin's share of the calibration error."""
    slot = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    y = (F.col(label) == 1).cast("double")
    out = df.groupBy(slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(score).alias("mean_score"),
        F.avg(y).alias("observed_rate"),
        F.sum(F.pow(F.col(score) - y, 2)).alias("_sq"),
    )
    total = F.sum("rows").over(Window.partitionBy())  # at most `bins` rows
    gap = F.abs(F.col("mean_score") - F.col("observed_rate"))
    return out.withColumn("ece_part", gap * F.col("rows") / total).withColumn("brier_part", F.col("_sq") / total).drop("_sq")


def calibration_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.sum("brier_part").alias("brier"), F.sum("ece_part").alias("ece"))


def drift_score(training: DataFrame, live: DataFrame, columns: Sequence[str], bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability index and Kolmogorov-Smirnov distance per feature.

    PSI uses equal-width bins over the training range, with live values outside put into the end
    bins and empty shares floored. KS uses all distinct values.
    """
    side = lambda df, tag: with_spans(df, columns, training).withColumn("_live", F.lit(tag))
    placed = side(training, 0).unionByName(side(live, 1))
    tagged = placed.drop("_lo", "_hi")
    width = F.col("_hi") - F.col("_lo")
    raw = F.when(width > 0, F.floor((F.col("value") - F.col("_lo")) * bins / width)).otherwise(F.lit(0))
    slot = F.greatest(F.lit(0), F.least(F.lit(bins - 1), raw)).cast("int")
    counts = placed.groupBy("feature", slot.alias("_bin")).agg(
        F.count_if(F.col("_live") == 0).alias("_a"), F.count_if(F.col("_live") == 1).alias("_b")
    )
    whole = Window.partitionBy("feature")  # at most `bins` rows
    share = lambda c: F.greatest(F.col(c) / F.sum(c).over(whole), F.lit(floor))
    psi = counts.select("feature", share("_a").alias("_a"), share("_b").alias("_b")).groupBy("feature").agg(
        F.sum((F.col("_b") - F.col("_a")) * F.log(F.col("_b") / F.col("_a"))).alias("psi")
    )
    points = _by_score(tagged, "_live", "value", ["feature"])
    share_of = lambda below, at, total: (F.col(below) + F.col(at)) / F.col(total)
    gap = F.abs(share_of("p_below", "p", "all_p") - share_of("q_below", "q", "all_q"))
    return join_on(psi, points.groupBy("feature").agg(F.max(gap).alias("ks")), ["feature"])


def score_report(df: DataFrame, label: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Confusion metrics of stored scores at a few fixed thresholds, in one pass.

    Thresholds need not be evenly spaced, so each row is spread over the ones given.
    """
    grid = sorted(thresholds)
    spread = df.select(label, score, F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("threshold"))
    return binary_metrics(spread, label, score, F.col("threshold"), ["threshold"])


def false_negatives(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    return df.filter((F.col(label) == 1) & (F.col(score) < threshold))

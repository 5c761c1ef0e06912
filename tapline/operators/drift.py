"""Drift of live feature values against a stored profile, from mergeable sketches alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import unpivot

SKETCH_K = 1_600  # size of a quantile sketch; its rank error is about 0.2 %
POINTS = 1_000


def profile_features(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """Profile of features: ``feature``, ``n``, ``low``, ``high`` and a KLL ``sketch``, per ``by`` (a day, a sensor) if given.

    One pass that combines on the map side; a profile is a few kilobytes a feature and can be stored as a table. Nulls and
    NaN are left out; a feature without a value has no row.
    """
    long = unpivot(df, list(columns), list(by)).filter("value IS NOT NULL AND NOT isnan(value)")
    value = F.col("value").cast("double")
    return long.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.kll_sketch_agg_double(value, k).alias("sketch"))


def merge_profiles(profiles: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """One profile of each feature from those of several days, sensors or micro-batches."""
    return profiles.groupBy("feature").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def _share_up_to(quantiles: str, x: Column) -> Column:
    """Share of the values up to x, from quantiles at even steps."""
    return F.size(F.filter(quantiles, lambda q: q <= x)) / F.size(quantiles)


def drift_from_profiles(stored: DataFrame, live: DataFrame, bins: int = 10, floor: float = 1e-4, points: int = POINTS) -> DataFrame:
    """PSI and KS distance per feature, as ``metrics.drift_score`` has them, of two profiles.

    PSI bins are of equal width over the stored range, outer bins open; KS is the largest gap at the quantiles of both.
    Shares come from ``points`` quantiles of each sketch, so each is off by the rank error of a sketch and half a step (about
    0.3 % together, which moves PSI by up to 0.05 where bins are nearly empty); a value that lies on a bin's edge counts below it here. Reads one row a feature; a
    feature of one profile only is left out.
    """
    ranks = F.array(*[F.lit(i / points) for i in range(points + 1)])
    side = lambda df, x: df.select("feature", F.col("low").alias(f"{x}_low"), F.col("high").alias(f"{x}_high"), F.kll_sketch_get_quantile_double("sketch", ranks).alias(x))
    both = side(stored, "a").join(side(live, "b"), "feature")
    width = (F.col("a_high") - F.col("a_low")) / F.lit(bins)
    edges = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.col("a_low") + i * width)
    gaps = F.transform(F.concat("a", "b"), lambda q: F.abs(_share_up_to("a", q) - _share_up_to("b", q)))
    placed = both.select("feature", "a", "b", (width > 0).alias("_wide"), edges.alias("_edges"), F.array_max(gaps).alias("ks"))
    ends = lambda x: F.concat(F.array(F.lit(0.0)), F.transform("_edges", lambda e: _share_up_to(x, e)), F.array(F.lit(1.0)))
    below = placed.select("feature", "_wide", "ks", ends("a").alias("below_a"), ends("b").alias("below_b"))
    shares = lambda x: F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda i: F.greatest(F.get(x, i) - F.get(x, i - 1), F.lit(floor)))
    part = F.zip_with(shares("below_a"), shares("below_b"), lambda a, b: (b - a) * F.log(b / a))
    psi = F.when(F.col("_wide"), F.aggregate(part, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))
    return below.select("feature", psi.alias("psi"), "ks")

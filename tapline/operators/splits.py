"""Deterministic splits and folds that keep captures whole."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import join_on

_PRIME = 2_147_483_647


def unit_hash(key: Column, salt: int = 0) -> Column:
    """A fixed pseudo-random number in [0,1) of an integer key, by arithmetic any engine can repeat."""
    mixed = F.pmod(F.pmod(key.cast("long"), F.lit(_PRIME)) * 48_271 + (salt * 69_621 + 11), F.lit(_PRIME))
    mixed = F.pmod(mixed * 16_807, F.lit(_PRIME))
    return mixed / F.lit(float(_PRIME))


def stratified_split(
    df: DataFrame, key: str, shares: dict[str, float], salt: int = 0, name: str = "split"
) -> DataFrame:
    """Assign each row a part by its key's hash.

    The hash does not depend on the class, so every class is cut in the same proportions, and a
    row's part never changes when others are added. No shuffle.
    """
    unit, edge, chain = unit_hash(F.col(key), salt), 0.0, None
    parts = list(shares.items())
    for part, share in parts[:-1]:
        edge += share
        chain = (F if chain is None else chain).when(unit < F.lit(edge), F.lit(part))
    return df.withColumn(name, chain.otherwise(F.lit(parts[-1][0])) if chain is not None else F.lit(parts[0][0]))


def group_kfold(df: DataFrame, group: str, label: str, folds: int = 3) -> DataFrame:
    """Fold of each capture. Captures of one majority class are dealt back and forth by size.

    Only the capture totals are ordered, one row each.
    """
    totals = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"), F.sum((F.col(label) == 1).cast("long")).alias("attack_rows")
    )
    majority = (2 * F.col("attack_rows") >= F.col("rows")).cast("int")
    place = F.row_number().over(Window.partitionBy("majority").orderBy(F.desc("rows"), group)) - 1
    turn, step = F.floor(F.col("_place") / folds), F.pmod(F.col("_place"), F.lit(folds))
    forth = F.pmod(turn + F.col("majority"), F.lit(2)) == 0
    return (
        totals.withColumn("majority", majority)
        .withColumn("_place", place)
        .withColumn("fold", F.when(forth, step).otherwise(folds - 1 - step).cast("int"))
        .drop("_place")
    )


def assign_folds(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """Rows with the fold of their capture; the fold table is small, so it is usually broadcast."""
    return join_on(df, folds.select(group, "fold"), [group])


def fold_report(df: DataFrame, group: str, label: str) -> DataFrame:
    """Per fold: rows, captures, class counts, and how many of its captures leak into another fold."""
    per_group = df.groupBy("fold", group).agg(
        F.count(F.lit(1)).alias("_n"), F.sum((F.col(label) == 1).cast("long")).alias("_p")
    )
    spread = df.groupBy(group).agg(F.min("fold").alias("_lo"), F.max("fold").alias("_hi"))
    joined = join_on(per_group, spread, [group])
    return joined.groupBy("fold").agg(
        F.sum("_n").alias("validation_rows"), F.count(F.lit(1)).alias("validation_sources"),
        F.sum("_p").alias("validation_attack"), (F.sum("_n") - F.sum("_p")).alias("validation_benign"),
        F.count_if(F.col("_lo") != F.col("_hi")).alias("leaking_sources"),
    )


def oof_predict(
    df: DataFrame, folds: int, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]
) -> DataFrame:
    """Out-of-fold predictions: each fold is scored by a model fitted on the others.

    ``df`` carries ``fold``. ``fit`` returns the scoring function of a fitted model. Every input row
    occurs once in the result.
    """
    parts = []
    for k in range(folds):
        score = fit(df.filter(F.col("fold") != k))
        parts.append(score(df.filter(F.col("fold") == k)))
    return reduce(DataFrame.unionByName, parts)


def oof_coverage(rows: DataFrame, predictions: DataFrame, key: str, score: str) -> DataFrame:
    """One row: development rows, those with a prediction and those without."""
    joined = join_on(rows.select(key), predictions.select(key, F.col(score).alias("_s")), [key])
    return joined.agg(
        F.count(F.lit(1)).alias("rows"), F.count("_s").alias("predicted"),
        F.count_if(F.col("_s").isNull()).alias("unpredicted"),
    )


def kfold_by_row(df: DataFrame, key: str, folds: int, salt: int = 0) -> DataFrame:
    """Row-wise folds by hash, equal in every class."""
    return df.withColumn("fold", F.floor(unit_hash(F.col(key), salt) * folds).cast("int"))

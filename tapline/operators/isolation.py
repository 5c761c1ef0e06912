"""Isolation forest as a Spark job: one bounded sample per tree, vectorised scoring."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import exact_percentiles

EULER = 0.5772156649015329
TREE_SCHEMA = "tree int, n int, feature array<int>, cut array<double>, left array<int>, right array<int>, size array<int>"


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Expected depth of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    return np.where(n > 2, 2.0 * (np.log(big - 1.0) + EULER) - 2.0 * (big - 1.0) / big, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class IsolationModel:
    """Fitted trees (a fixed number of small rows) and the outlier limit."""

    columns: tuple[str, ...]
    trees: list
    sample_size: int
    limit: float | None
    baseline_rows: int


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> dict[str, list]:
    nodes: dict[str, list] = {"feature": [], "cut": [], "left": [], "right": [], "size": []}

    def add(feature: int, cut: float, size: int) -> int:
        for key, value in zip(nodes, (feature, cut, -1, -1, size)):
            nodes[key].append(value)
        return len(nodes["size"]) - 1

    def split(rows: np.ndarray, depth: int) -> int:
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else np.array([], dtype=int)
        if depth >= max_depth or not len(spread):
            return add(-1, 0.0, len(rows))
        feature = int(rng.choice(spread))
        column = rows[:, feature]
        cut = float(rng.uniform(column.min(), column.max()))
        here = add(feature, cut, len(rows))
        below = column < cut
        if not below.any():  # the draw fell on the minimum
            below = column <= cut
        nodes["left"][here] = split(rows[below], depth + 1)
        nodes["right"][here] = split(rows[~below], depth + 1)
        return here

    split(x, 0)
    return nodes


def fit_isolation(
    trusted: DataFrame, columns: Sequence[str], row_id: str, trees: int = 200, sample_size: int = 256,
    contamination: float = 0.02, seed: int = 42, min_rows: int = 20,
) -> IsolationModel:
    """Fit on reviewed benign rows.

    Each row joins a hashed number of trees such that a tree gets about ``sample_size`` rows, however
    many rows there are; every tree is grown from its sample in one task. The limit is the exact
    ``1 - contamination`` percentile of the training scores.
    """
    columns = list(columns)
    values = trusted.select(F.col(row_id).alias("_id"), *[F.col(c).cast("double").alias(c) for c in columns])
    rows = values.count()
    if rows < min_rows:
        raise ValueError(f"At least {min_rows} reviewed benign flows are required for a baseline")
    size = min(sample_size, rows)
    rate = trees * size / rows
    unit = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = (F.floor(F.lit(rate)) + (unit < F.lit(rate - int(rate))).cast("long")).cast("int")
    first = F.pmod(F.xxhash64("_id", F.lit(seed + 1)), F.lit(trees))
    bags = values.filter(copies > 0).withColumn("_j", F.explode(F.sequence(F.lit(0), F.least(copies, F.lit(trees)) - 1)))
    bags = bags.withColumn("tree", F.pmod(first + F.col("_j"), F.lit(trees)).cast("int")).select("tree", "_id", *columns)
    depth = int(np.ceil(np.log2(max(size, 2))))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        x = group.sort_values(["_id", *columns])[columns].to_numpy(dtype=float)
        nodes = _grow(x, np.random.default_rng([seed, tree]), depth)
        return pd.DataFrame({"tree": [tree], "n": [len(x)], **{k: [v] for k, v in nodes.items()}})

    # at most `trees` rows of at most 2 * sample size nodes each, whatever the data
    grown = bags.groupBy("tree").applyInPandas(grow, TREE_SCHEMA).orderBy("tree").collect()
    model = IsolationModel(tuple(columns), [r.asDict() for r in grown], size, None, rows)
    scores = anomaly_scores(values, model)
    limit = exact_percentiles(scores, [], "anomaly_score", {"limit": 1.0 - contamination}).first()["limit"]
    return IsolationModel(tuple(columns), model.trees, size, float(limit), rows)


def _depths(x: np.ndarray, trees: list[dict]) -> np.ndarray:
    total = np.zeros(len(x))
    for tree in trees:
        feature, cut, left, right, size = (np.asarray(tree[k]) for k in ("feature", "cut", "left", "right", "size"))
        at = np.zeros(len(x), dtype=int)
        depth = np.zeros(len(x))
        inner = feature[at] >= 0
        while inner.any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            below = x[rows, feature[node]] < cut[node]
            at[rows] = np.where(below, left[node], right[node])
            depth[rows] += 1
            inner = feature[at] >= 0
        total += depth + mean_path(size[at])
    return total / max(len(trees), 1)


def anomaly_scores(df: DataFrame, model: IsolationModel, name: str = "anomaly_score") -> DataFrame:
    """Add the anomaly score in (0,1]; larger means less like the baseline. No shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model.trees)
    columns, base = list(model.columns), float(mean_path(model.sample_size))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[columns].to_numpy(dtype=float)
            yield batch.assign(**{name: np.power(2.0, -_depths(x, shared.value) / max(base, 1e-9))})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(score, f"{fields}, {name} double")


def assess(df: DataFrame, model: IsolationModel) -> DataFrame:
    """Anomaly score and outlier flag of each row against the fitted baseline."""
    return anomaly_scores(df, model).withColumn("is_outlier", F.col("anomaly_score") > F.lit(model.limit)).withColumn(
        "baseline_samples", F.lit(model.baseline_rows)
    )

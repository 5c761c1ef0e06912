"""Training and scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import severity_from_score
from ..session import stage
from . import metrics
from .chunks import if_small, join_on
from .splits import kfold_by_row

WEIGHT = "_weight"


def class_weights(df: DataFrame, label: str, positive: float | None = None) -> DataFrame:
    """Add a weight column: ``positive`` for attacks, or balanced by class frequency."""
    if positive is not None:
        return df.withColumn(WEIGHT, F.when(F.col(label) == 1, F.lit(float(positive))).otherwise(1.0))
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    balanced = counts.withColumn(WEIGHT, F.sum("_n").over(_everything()) / (2.0 * F.col("_n"))).drop("_n")
    return join_on(df, if_small(stage(balanced)), [label])


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy()  # over the class counts only: one row per class


def _fit(estimator, df: DataFrame, columns: Sequence[str], label: str) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(columns), outputCol="_features", handleInvalid="error")
    estimator = estimator.setFeaturesCol("_features").setLabelCol("_label").setWeightCol(WEIGHT)
    prepared = df.withColumn("_label", F.col(label).cast("double")).select(*columns, "_label", WEIGHT)
    return Pipeline(stages=[assembler, estimator]).fit(prepared)


def fit_gbt(
    df: DataFrame, columns: Sequence[str], label: str, weight: float | None = None, rounds: int = 50, depth: int = 5,
    rate: float = 0.1, rows: float = 0.8, features: str = "0.8", seed: int = 42,
) -> PipelineModel:
    """Gradient-boosted binary classifier with row and column subsampling."""
    estimator = GBTClassifier(
        maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=rows, featureSubsetStrategy=features, seed=seed
    )
    return _fit(estimator, class_weights(df, label, weight), columns, label)


def fit_forest(
    df: DataFrame, columns: Sequence[str], label: str, trees: int = 150, depth: int = 8, min_leaf: int = 2, seed: int = 42
) -> PipelineModel:
    """Balanced random forest."""
    estimator = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed)
    return _fit(estimator, class_weights(df, label), columns, label)


def scorer(model: PipelineModel, name: str = "score") -> Callable[[DataFrame], DataFrame]:
    """Function that adds the attack probability as a plain column."""

    def apply(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        return out.withColumn(name, vector_to_array("probability")[1]).drop(
            "_features", "rawPrediction", "probability", "prediction"
        )

    return apply


def score(df: DataFrame, model: PipelineModel, threshold: float | Column) -> DataFrame:
    """Probability, flag, severity and alert text per flow."""
    cut = threshold if isinstance(threshold, Column) else F.lit(threshold)
    hit = F.col("malware_probability") >= cut
    return (
        scorer(model, "malware_probability")(df)
        .withColumn("is_malware", hit)
        .withColumn("severity", severity_from_score(F.col("malware_probability")))
        .withColumn("alert", F.when(hit, "MALWARE_DETECTED").otherwise("benign"))
    )


def feature_importance(model: PipelineModel, columns: Sequence[str], spark, n: int = 25) -> DataFrame:
    """The ``n`` most important features; one number per feature, so a driver-side vector."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    table = spark.createDataFrame(list(zip(columns, values)), "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(n)


def tune(
    train: DataFrame, validation: DataFrame, test: DataFrame, columns: Sequence[str], label: str,
    weights: Sequence[float], grid: Sequence[float], rounds: int = 20, min_recall: float | None = None, seed: int = 42,
) -> tuple[PipelineModel, dict, DataFrame]:
    """Choose the class weight and threshold of the best validation F1, refit, and test once.

    The frames should be checkpointed or stored features, as every weight trains on them anew.
    Returns the refitted model, the choice, and the test metrics.
    """
    trials = []
    for weight in weights:
        model = fit_gbt(train, columns, label, weight, rounds=rounds, seed=seed)
        sweep = metrics.threshold_sweep(scorer(model)(validation), label, "score", grid)
        best = metrics.pick_threshold(sweep, min_recall=min_recall).first()  # one row
        if best is not None:
            trials.append({"weight": weight, "threshold": best["threshold"], "f1": best["f1"]})
    if not trials:
        raise ValueError("no threshold reaches the wanted recall")
    choice = max(trials, key=lambda t: (t["f1"], -t["weight"]))
    final = fit_gbt(train.unionByName(validation), columns, label, choice["weight"], rounds=rounds, seed=seed)
    report = metrics.binary_metrics(scorer(final)(test), label, "score", choice["threshold"])
    return final, choice, report


def kfold_auc(
    df: DataFrame, key: str, columns: Sequence[str], label: str, folds: int, fit: Callable[[DataFrame], PipelineModel]
) -> DataFrame:
    """Mean and deviation of the fold AUCs."""
    from .splits import oof_predict

    scored = oof_predict(kfold_by_row(df, key, folds), folds, lambda part: scorer(fit(part)))
    per_fold = metrics.roc_auc(scored, label, "score", ["fold"])
    return per_fold.agg(
        F.count("roc_auc").alias("folds"), F.avg("roc_auc").alias("mean_auc"), F.stddev_pop("roc_auc").alias("std_auc")
    )


def pick_examples(
    flows: DataFrame, by: Sequence[str], ts: str, seq: str, label: str,
    score_pair: Callable[[DataFrame], DataFrame], max_gap: float = 300.0,
) -> DataFrame:
    """The most typical flow pair per class: the highest-scored attack, the lowest-scored benign.

    Candidates are the first two flows of each conversation, at most ``max_gap`` seconds apart.
    ``score_pair`` turns the candidate flows into one row per conversation with ``score``. The row
    number filter is a group limit that Spark applies before the shuffle.
    """
    from pyspark.sql import Window

    first = Window.partitionBy(label, *by).orderBy(ts, seq)
    two = flows.withColumn("_i", F.row_number().over(first)).filter(F.col("_i") <= 2)
    ends = two.groupBy(label, *by).agg(
        F.count(F.lit(1)).alias("_n"), (F.max(F.col(ts).cast("double")) - F.min(F.col(ts).cast("double"))).alias("_gap")
    )
    near = ends.filter((F.col("_n") == 2) & (F.col("_gap") <= max_gap)).select(label, *by)
    scored = score_pair(join_on(two.drop("_i"), near, [label, *by], "left_semi"))
    others = [c for c in scored.columns if c != label]
    rank = F.when(F.col(label) == 1, -F.col("score")).otherwise(F.col("score"))
    best = scored.groupBy(label).agg(F.min_by(F.struct(*others), F.struct(rank, *[F.col(c) for c in by])).alias("_r"))
    return best.select(label, *[F.col(f"_r.{c}").alias(c) for c in others])


def cross_eval(
    datasets: dict[str, DataFrame], label: str, fit: Callable[[DataFrame], PipelineModel], threshold: float
) -> DataFrame:
    """Metrics of every (training set, test set) pair."""
    cells = []
    for train_name, train in datasets.items():
        apply = scorer(fit(train))
        for test_name, test in datasets.items():
            scored = apply(test).select(label, "score").withColumn("train", F.lit(train_name)).withColumn("test", F.lit(test_name))
            cells.append(metrics.metrics_by_group(scored, label, "score", threshold, ["train", "test"]))
    out = cells[0]
    for cell in cells[1:]:
        out = out.unionByName(cell)
    return out

"""Classifiers and regressors on tabular features, with folds, importances and a permutation test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def estimator(kind: str, label: str, seed: int = 0, classify: bool = True):
    """tree, forest or linear (logistic or ridge)."""
    options = {"labelCol": label, "featuresCol": "features"}
    if kind == "tree":
        return (DecisionTreeClassifier if classify else DecisionTreeRegressor)(seed=seed, **options)
    if kind == "forest":
        return (RandomForestClassifier if classify else RandomForestRegressor)(seed=seed, numTrees=100, **options)
    if kind == "linear":
        return LogisticRegression(**options) if classify else LinearRegression(regParam=1.0, elasticNetParam=0.0, **options)
    raise ValueError(f"unknown model {kind}")


def pipeline(kind: str, features: Sequence[str], label: str, seed: int = 0, classify: bool = True) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="features", withMean=True),
            estimator(kind, label, seed, classify),
        ]
    )


def constant_prediction(df: DataFrame, label: str, classify: bool = True) -> float:
    """The majority class (the smaller of equal ones) or the mean."""
    if not classify:
        return float(df.agg(F.avg(label)).first()[0] or 0.0)
    counted = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    row = counted.agg(F.max_by(label, F.struct("n", -F.col(label))).alias("c")).first()
    return float(row["c"] or 0.0)


def with_folds(df: DataFrame, key: str, folds: int, seed: int = 0) -> DataFrame:
    """``fold`` from a hash of the key: the same rows fall together on every run."""
    name = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("fold", F.conv(F.substr(name, F.lit(1), F.lit(8)), 16, 10).cast("bigint") % folds)


def cross_validate(
    df: DataFrame, kind: str, features: Sequence[str], label: str, key: str, folds: int = 5, seed: int = 0, classify: bool = True
) -> list[float]:
    """Accuracy (or R squared) per fold; ``kind`` is also ``dummy``, a constant prediction."""
    marked = with_folds(df.withColumn(label, F.col(label).cast("double")), key, folds, seed)
    judge = (
        MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy") if classify
        else RegressionEvaluator(labelCol=label, metricName="r2")
    )
    out = []
    for fold in range(folds):
        if kind == "dummy":
            rest, own = marked.filter(F.col("fold") != fold), marked.filter(F.col("fold") == fold)
            out.append(judge.evaluate(own.withColumn("prediction", F.lit(constant_prediction(rest, label, classify)))))
            continue
        model = pipeline(kind, features, label, seed, classify).fit(marked.filter(F.col("fold") != fold))
        out.append(judge.evaluate(model.transform(marked.filter(F.col("fold") == fold))))
    return out


def permutation_p_value(
    df: DataFrame, kind: str, features: Sequence[str], label: str, key: str, rounds: int = 20, folds: int = 3, seed: int = 0
) -> tuple[float, float]:
    """(mean score, share of label shuffles that score at least as well, counting the real one).

    A shuffle sorts keys and labels by two seeded hashes and meets them by position.
    """
    from exonloom.operators.scan import Running, prefix_scan

    real = sum(cross_validate(df, kind, features, label, key, folds, seed)) / folds
    as_good = 1
    bits = max(4, (df.count() // 32_768).bit_length())
    for r in range(rounds):
        def numbered(column: str, salt: int) -> DataFrame:
            h = F.xxhash64(F.lit(seed + salt), F.lit(r), F.col(key).cast("string"))
            # hashes are even, so blocks of one range of hashes are too; their number follows the rows
            rows = df.select(F.lit(0).alias("_g"), F.col(column).alias("_v"), h.alias("_h"), F.col(key).alias("_k"))
            block = F.shiftright(F.col("_h"), 64 - bits)
            return prefix_scan(rows, ["_g"], block, ["_h", "_k"], [Running("_n", "sum", F.lit(1), True)])
        shuffled = numbered(key, 1).select("_n", F.col("_v").alias(key)).join(
            numbered(label, 2).select("_n", F.col("_v").alias(label)), "_n"
        ).drop("_n")
        mixed = df.drop(label).join(shuffled, key)
        as_good += sum(cross_validate(mixed, kind, features, label, key, folds, seed)) / folds >= real
    return real, as_good / (rounds + 1)


def importances(model, features: Sequence[str]) -> dict[str, float]:
    """Feature importances (trees) or absolute coefficients (linear models) of a fitted pipeline."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    else:
        values = abs(last.coefficients.toArray())
    return dict(zip(features, map(float, values)))


def closest_to_chance(scores: dict[str, list[float]], chance: float = 0.5) -> str:
    """The configuration whose median score is closest to chance (well-paired groups look alike)."""
    from statistics import median

    return min(scores, key=lambda k: (abs(median(scores[k]) - chance), k))

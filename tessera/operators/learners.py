"""Supervised models over a table with a row per bag or subject: cross-validation, scores, Shapley attributions."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model as MlModel
from pyspark.ml import classification as mlc
from pyspark.ml import regression as mlr
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_corr
from . import gradient_models, ranks
from .models import fold_of

#: Rows that the nearest-neighbour model holds in each task; more is an error.
NEIGHBOUR_ROWS = 100_000
_COLUMNS = {"featuresCol": "_x", "labelCol": "_y"}


def _classifier(name: str, classes: int, width: int, seed: int):
    c = _COLUMNS
    if name == "ElasticNet":
        return mlc.LogisticRegression(**c, elasticNetParam=0.5, regParam=0.01)
    if name == "RandomForest":
        return mlc.RandomForestClassifier(**c, numTrees=100, maxDepth=8, seed=seed)
    if name == "ExtraTrees":  # whole samples and few candidate cuts
        return mlc.RandomForestClassifier(**c, numTrees=100, maxDepth=8, bootstrap=False, maxBins=8, seed=seed)
    if name == "GradientBoosting":
        boosted = mlc.GBTClassifier(**c, maxIter=50, maxDepth=3, seed=seed)
        return boosted if classes == 2 else mlc.OneVsRest(**c, classifier=boosted)
    if name == "GaussianNB":
        return mlc.NaiveBayes(**c, modelType="gaussian")
    if name == "MLP":
        return mlc.MultilayerPerceptronClassifier(**c, layers=[width, 64, 32, classes], maxIter=200, seed=seed)
    if name == "SVM":
        linear = mlc.LinearSVC(**c, regParam=0.01, maxIter=20)
        return linear if classes == 2 else mlc.OneVsRest(**c, classifier=linear)
    raise ValueError(f"unknown classifier {name}")


def _regressor(name: str, seed: int):
    c = _COLUMNS
    if name == "ElasticNet":
        return mlr.LinearRegression(**c, elasticNetParam=0.5, regParam=0.01)
    if name == "RandomForest":
        return mlr.RandomForestRegressor(**c, numTrees=100, maxDepth=8, seed=seed)
    if name == "ExtraTrees":
        return mlr.RandomForestRegressor(**c, numTrees=100, maxDepth=8, bootstrap=False, maxBins=8, seed=seed)
    if name == "GradientBoosting":
        return mlr.GBTRegressor(**c, maxIter=50, maxDepth=3, seed=seed)
    raise ValueError(f"unknown regressor {name}")


CLASSIFIERS = ("ElasticNet", "RandomForest", "ExtraTrees", "GradientBoosting", "GaussianNB", "MLP", "SVM", "KNeighbors")
REGRESSORS = ("ElasticNet", "RandomForest", "ExtraTrees", "GradientBoosting", "MLP", "SVM", "KNeighbors")


def rbf_features(x: Column, width: int, n: int = 128, gamma: float | None = None, seed: int = 42) -> Column:
    """array<double> whose dot products approximate exp(-gamma |x - y|^2) of array x (random Fourier features)."""
    gamma = gamma or 1 / width
    rng = np.random.default_rng(seed)
    w, b = rng.normal(scale=math.sqrt(2 * gamma), size=(n, width)), rng.uniform(0, 2 * math.pi, size=n)
    table = F.array(*[F.struct(F.array(*map(F.lit, w[i].tolist())).alias("w"), F.lit(float(b[i])).alias("b")) for i in range(n)])
    dot = lambda row: F.aggregate(F.zip_with(x, row, lambda p, q: p * q), F.lit(0.0), lambda a, v: a + v)
    return F.transform(table, lambda r: F.cos(dot(r["w"]) + r["b"]) * math.sqrt(2 / n))


class Neighbours:
    """k nearest training rows; the training table is held in each task and may have NEIGHBOUR_ROWS rows."""

    def __init__(self, train: DataFrame, k: int, classes: int | None):
        rows = train.select(vector_to_array("_x").alias("x"), "_y").limit(NEIGHBOUR_ROWS + 1).toPandas()
        if len(rows) > NEIGHBOUR_ROWS:
            raise ValueError(f"nearest neighbours need {NEIGHBOUR_ROWS} training rows or fewer")
        rows = rows.sort_values(["_y", "x"], key=lambda s: s.map(tuple) if s.name == "x" else s)
        self.x, self.y, self.k, self.classes = np.stack(rows["x"]), rows["_y"].to_numpy(), min(k, len(rows)), classes

    def transform(self, df: DataFrame) -> DataFrame:
        x, y, k, classes = self.x, self.y, self.k, self.classes

        @F.pandas_udf("prediction double, probability array<double>")
        def vote(v: pd.Series) -> pd.DataFrame:
            out = []
            for row in v:
                near = y[np.argsort(((x - np.asarray(row)) ** 2).sum(axis=1), kind="stable")[:k]]
                share = np.bincount(near.astype(int), minlength=classes) / k if classes else None
                out.append((float(share.argmax()), share.tolist()) if classes else (float(near.mean()), None))
            return pd.DataFrame(out, columns=["prediction", "probability"])

        return df.withColumn("_v", vote(vector_to_array("_x"))).select("*", "_v.*").drop("_v")


def scaled(df: DataFrame, train: Column, features: Sequence[str]) -> DataFrame:
    """z-scores of features by the mean and population SD of the rows where `train` holds."""
    at = df.where(train).agg(*[a for f in features for a in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]).first()
    return df.withColumns({f: (F.col(f).cast("double") - F.lit(at[f"m_{f}"])) / F.lit(at[f"s_{f}"] or 1.0) for f in features})


def _assembled(df: DataFrame, features: Sequence[str], kernel: bool, seed: int) -> DataFrame:
    if kernel:
        return df.withColumn("_x", array_to_vector(rbf_features(F.array(*[F.col(f).cast("double") for f in features]), len(features), seed=seed)))
    return VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)


def fit(train: DataFrame, features: Sequence[str], name: str, classes: int | None, seed: int = 42) -> tuple[Callable[[DataFrame], DataFrame], MlModel | Neighbours | gradient_models.GradientModel]:
    """Fit on rows with a numeric label _y; returns what adds `prediction` and (where the model has one) `score`, and the model."""
    kernel = name == "SVM"
    rows = _assembled(train, features, kernel, seed)
    if name == "KNeighbors":
        model = Neighbours(rows, 5, classes)
    elif classes is None and name in gradient_models.REGRESSORS:
        model = gradient_models.fit(rows, name, seed=seed)
    else:
        estimator = _classifier(name, classes, len(features), seed) if classes else _regressor(name, seed)
        model = estimator.fit(rows.select("_x", "_y"))

    def predict(df: DataFrame) -> DataFrame:
        got = model.transform(_assembled(df, features, kernel, seed))
        if classes is None:
            score = F.col("prediction")
        elif "probability" in got.columns:
            p = F.col("probability")
            score = F.get(p if name == "KNeighbors" else vector_to_array(p), F.lit(1))
        elif "rawPrediction" in got.columns:
            score = F.get(vector_to_array("rawPrediction"), F.lit(1))
        else:
            score = F.lit(None).cast("double")
        return got.withColumn("score", score).drop("_x", "rawPrediction", "probability")

    return predict, model


def held_out_predictions(
    df: DataFrame, features: Sequence[str], label: str, group: str, name: str = "RandomForest", task: str = "classification", folds: int | None = 5, standardize: bool = True, seed: int = 42
) -> DataFrame:
    """Rows of df with a label and all features, with fold, _y (label index or value), prediction and score from models that saw no row of their group.

    folds: that many, dealt by a digest of the group; None: one per group, meant for few groups
    (a fit each). Scaling is learnt from the training rows of each fold.
    """
    rows = df.dropna(subset=[label, group, *features])
    classes = None
    if task == "classification":
        text = rows.withColumn("_label", F.col(label).cast("string"))
        indexer = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc").fit(text)
        classes, rows = len(indexer.labels), indexer.transform(text).drop("_label")
        if classes < 2:
            raise ValueError("a classifier needs two labels or more")
    else:
        rows = rows.withColumn("_y", F.col(label).cast("double"))
    if folds is None:
        names = [r[0] for r in rows.select(F.col(group).cast("string")).distinct().orderBy(group).collect()]
        rows, folds = rows.withColumn("fold", F.array_position(F.array(*map(F.lit, names)), F.col(group).cast("string")) - 1), len(names)
    else:
        rows = rows.withColumn("fold", fold_of([group], folds, seed))
    out = None
    for f in range(folds):
        train = F.col("fold") != f
        z = scaled(rows, train, features) if standardize else rows
        if z.where(~train).isEmpty() or (classes and z.where(train).select("_y").distinct().count() < 2):
            continue
        predict, _ = fit(z.where(train), features, name, classes, seed)
        got = predict(z.where(~train))
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no fold can be evaluated")
    return out


def class_scores(predictions: DataFrame) -> DataFrame:
    """One row: n, accuracy over all rows, mean and sample SD of the folds' accuracies, and AUC of class 1 (two classes only)."""
    hit = (F.col("prediction") == F.col("_y")).cast("double")
    per = predictions.groupBy("fold").agg(F.avg(hit).alias("a"), F.sum(hit).alias("s"), F.count(F.lit(1)).alias("c"), F.max("_y").alias("top"))
    total = per.agg(F.sum("c").alias("n"), (F.sum("s") / F.sum("c")).alias("accuracy"), F.avg("a").alias("mean_accuracy"), F.stddev_samp("a").alias("sd_accuracy"), F.max("top").alias("top"))
    area = ranks.auc(predictions.withColumn("_y", F.col("_y").cast("int")), "_y", "score")
    return total.join(area).withColumn("auc", F.when(F.col("top") == 1, F.col("auc"))).drop("top")  # one row each


def subject_scores(predictions: DataFrame, subject: str) -> DataFrame:
    """One row of a regression: the mean prediction of each subject against its label: n, r2, mae, rmse, pearson."""
    per = predictions.groupBy(subject).agg(F.avg("prediction").alias("p"), F.avg("_y").alias("y"))
    gap = F.col("p") - F.col("y")
    r2 = 1 - F.sum(gap * gap) / (F.var_pop("y") * F.count(F.lit(1)))
    return per.agg(F.count(F.lit(1)).alias("n"), F.when(F.var_pop("y") > 0, r2).alias("r2"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), safe_corr("p", "y").alias("pearson"))


def subset_challenge(df: DataFrame, subsets: Mapping[str, Sequence[str]], label: str, group: str, **options) -> DataFrame:
    """One row of scores per named feature subset, best first."""
    out = None
    for title, features in subsets.items():
        row = class_scores(held_out_predictions(df, features, label, group, **options)).select(F.lit(title).alias("subset"), F.lit(len(features)).alias("n_features"), "*")
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("accuracy"), "subset")


def coalitions(p: int, permutations: int = 16, seed: int = 42) -> list[tuple[tuple[bool, ...], tuple[float, ...]]]:
    """(which features are present, weight of that score in each feature's Shapley value): all subsets up to 7 features, else prefixes of random orders and of their reverses."""
    weights: dict[tuple[bool, ...], np.ndarray] = {}
    if p <= 7:
        for mask in itertools.product((False, True), repeat=p):
            s = sum(mask)
            ins = math.factorial(s - 1) * math.factorial(p - s) / math.factorial(p) if s else 0.0
            outs = math.factorial(s) * math.factorial(p - s - 1) / math.factorial(p) if s < p else 0.0
            weights[mask] = np.array([ins if m else -outs for m in mask])
    else:
        rng = np.random.default_rng(seed)
        drawn = [rng.permutation(p) for _ in range(permutations)]
        orders = [o for d in drawn for o in (d, d[::-1])]
        for order in orders:
            mask = np.zeros(p, dtype=bool)
            for j in order:
                before = weights.setdefault(tuple(mask.tolist()), np.zeros(p))
                mask = mask.copy()
                mask[j] = True
                after = weights.setdefault(tuple(mask.tolist()), np.zeros(p))
                before[j] -= 1 / len(orders)
                after[j] += 1 / len(orders)
    return [(m, tuple(w.tolist())) for m, w in sorted(weights.items())]


def shapley(df: DataFrame, features: Sequence[str], key: Sequence[str], predict: Callable[[DataFrame], DataFrame], background: Mapping[str, float], permutations: int = 16, seed: int = 42) -> DataFrame:
    """Rows (key..., {feature}__shap): Shapley values of `score` that predict() adds; an absent feature has its background value.

    They sum to the score less the score of the background. Each row becomes one row per
    coalition (2^p, or 2 x permutations x p at most) and is added up again before the shuffle.
    """
    features = list(features)
    table = coalitions(len(features), permutations, seed)
    literal = F.array(*[F.struct(F.array(*map(F.lit, m)).alias("m"), F.array(*map(F.lit, w)).alias("w")) for m, w in table])
    spread = df.select(*key, *[f for f in features if f not in key], F.explode(literal).alias("_c"))
    for j, f in enumerate(features):
        spread = spread.withColumn(f, F.when(F.col("_c.m")[j], F.col(f).cast("double")).otherwise(F.lit(float(background[f]))))
    return predict(spread).groupBy(*key).agg(*[F.sum(F.col("score") * F.col("_c.w")[j]).alias(f"{f}__shap") for j, f in enumerate(features)])


def importances(values: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows (feature, importance): mean absolute Shapley values, made to sum to 1."""
    total = sum((F.avg(F.abs(f"{f}__shap")) for f in features), F.lit(0.0))
    row = F.array(*[F.struct(F.lit(f).alias("feature"), (F.avg(F.abs(f"{f}__shap")) / F.when(total > 0, total)).alias("importance")) for f in features])
    return values.agg(row.alias("r")).select(F.explode("r").alias("r")).select("r.*")

"""Exact Shapley values of trees, forests and boosted trees, by the training rows that went each way.

The nodes of a fitted model become a table, each leaf with the features on its path, the interval
that each must lie in, and the share of the parent's training rows that followed it. A row meets
some of these conditions and not others; a leaf's contribution depends on that pattern only, so it
is computed once for each pattern that a batch of rows has and looked up for the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.dataset import work_folder
from . import density_trees, models
from .layers import fit_layer


class Leaf(NamedTuple):
    """Weighted value, and for each feature on the path: its number, bounds (low, high], and the share of rows that stay within."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shares: np.ndarray


def node_table(model, spark) -> DataFrame:
    """Rows (tree, id, prediction, stats, left, right, feature, threshold): the nodes as the model is saved."""
    path = work_folder(spark, "trees")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    if "nodeData" in saved.columns:
        saved = saved.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        saved = saved.withColumn("tree", F.lit(0))
    return saved.select(
        "tree", "id", "prediction", F.col("impurityStats").alias("stats"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), (F.col("split.numCategories") >= 0).alias("categories"),
    )


def leaves_of(model, spark, label: int | None = None) -> list[Leaf]:
    """The leaves of all trees; values add up to the model's output: the probability of class `label`, the margin of a boosted classifier, or a regression's prediction."""
    nodes = node_table(model, spark).toPandas()  # as many rows as the model has nodes
    if nodes["categories"].any():
        raise ValueError("splits into categories aren't supported")
    boosted = type(model).__name__.startswith("GBT")
    counted = not boosted and label is not None
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    if not boosted:
        weights = [w / sum(weights) for w in weights]
    out: list[Leaf] = []
    for tree, own in nodes.groupby("tree"):
        at = {r.id: r for r in own.itertuples(index=False)}
        cover = {i: float(np.sum(r.stats)) if counted else float(r.stats[0]) for i, r in at.items()}
        todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while todo:
            i, path = todo.pop()
            r = at[i]
            if r.left < 0:
                value = r.stats[label] / np.sum(r.stats) if counted else r.prediction
                names = sorted(path)
                low, high, shares = (np.array([path[f][c] for f in names]) for c in range(3))
                out.append(Leaf(float(weights[int(tree)] * value), np.array(names, dtype=int), low, high, shares))
                continue
            a, b, s = path.get(r.feature, (-math.inf, math.inf, 1.0))
            todo.append((r.left, path | {r.feature: (a, min(b, r.threshold), s * cover[r.left] / cover[i])}))
            todo.append((r.right, path | {r.feature: (max(a, r.threshold), b, s * cover[r.right] / cover[i])}))
    return out


def expected(leaves: Sequence[Leaf]) -> float:
    """The model's output where no feature is known."""
    return float(sum(leaf.value * np.prod(leaf.shares) for leaf in leaves))


def _of_patterns(leaf: Leaf, met: np.ndarray) -> np.ndarray:
    """Patterns by features of the path: Shapley values of the game in which an absent feature passes its share and a present one all or nothing."""
    u, m = met.shape
    poly = np.zeros((u, m + 1))  # coefficients of the product of (share + met * t)
    poly[:, 0] = 1
    for j in range(m):
        poly[:, 1 : j + 2] = poly[:, 1 : j + 2] * leaf.shares[j] + poly[:, : j + 1] * met[:, j, None]
        poly[:, 0] *= leaf.shares[j]
    weight = np.array([math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)])
    out = np.empty((u, m))
    for j, z in enumerate(leaf.shares):
        with_ = np.zeros((u, m))  # the product without this factor, where it is met: divided from the top
        carry = np.zeros(u)
        for s in range(m - 1, -1, -1):
            carry = poly[:, s + 1] - z * carry
            with_[:, s] = carry
        without = poly[:, :m] / z
        rest = np.where(met[:, j, None], with_, without)
        out[:, j] = (rest @ weight) * (met[:, j] - z)
    return out * leaf.value


def shap_values(leaves: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    """Rows by features."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        if not len(leaf.features):
            continue
        v = x[:, leaf.features]
        met = (v > leaf.low) & (v <= leaf.high)
        code = met @ (1 << np.arange(met.shape[1], dtype=np.int64))
        _, first, back = np.unique(code, return_index=True, return_inverse=True)
        out[:, leaf.features] += _of_patterns(leaf, met[first].astype(float))[back]
    return out


def tree_shap(df: DataFrame, features: Sequence[str], key: Sequence[str], model, label: int | None = None) -> DataFrame:
    """Rows (key..., {feature}__shap, expected): Shapley values of a tree model of Spark, fitted on the features in this order.

    They and `expected` sum to the model's output. Rows with a missing feature are left out.
    """
    features, key = list(features), list(key)
    leaves = leaves_of(model, df.sparkSession, label)
    base = expected(leaves)

    def explain(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = shap_values(leaves, pdf[[f"_v{i}" for i in range(len(features))]].to_numpy(dtype=float))
            yield pd.concat([pdf[key], pd.DataFrame(got, columns=[f"{f}__shap" for f in features], index=pdf.index)], axis=1).assign(expected=base)

    known = df.dropna(subset=features).select(*key, *[F.col(f).cast("double").alias(f"_v{i}") for i, f in enumerate(features)])
    kinds = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key] + [f"`{f}__shap` double" for f in features])
    return known.mapInPandas(explain, f"{kinds}, expected double")


def shap_scores(by_class: Mapping[object, DataFrame] | DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Mean absolute Shapley value of each feature over rows, and over classes if there are several; features without values score 0."""
    tables = list(by_class.values()) if isinstance(by_class, Mapping) else [by_class]
    total = dict.fromkeys(features, 0.0)
    for table in tables:
        own = [f for f in features if f"{f}__shap" in table.columns]
        row = table.agg(*[F.avg(F.abs(f"{f}__shap")).alias(f) for f in own]).first() if own else {}
        for f in own:
            total[f] += (row[f] or 0.0) / len(tables)
    return total


def endotypes(values: DataFrame, features: Sequence[str], key: Sequence[str], method: str = "hdbscan", n_clusters: int | None = None, min_cluster_size: int = 5, top: int = 3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Clusters of rows by why the model decides as it does: values with `endotype`, and a row per endotype (n, and its `top` features by mean absolute Shapley value).

    Shapley values are standardised first. hdbscan: -1 is noise; kmeans: n_clusters of them, numbered by size.
    """
    shap = [f"{f}__shap" for f in features]
    z = fit_layer(values, shap).apply(values.select(*key, *shap))
    if method == "hdbscan":
        named = density_trees.hdbscan(z, key, shap, min_cluster_size, name="endotype")
    elif method == "kmeans":
        if not n_clusters:
            raise ValueError("kmeans needs n_clusters")
        model = models.fit_clusters(z, shap, n_clusters, key, seed=seed)
        named = model.assign(z, "c").select(*key, (F.regexp_extract("c", r"\d+", 0).cast("long") - 1).alias("endotype"))
    else:
        raise ValueError("method must be hdbscan or kmeans")
    found = values.join(named, list(key))
    of_feature = F.array(*[F.struct(F.avg(F.abs(s)).alias("v"), F.lit(-i).alias("i"), F.lit(f).alias("f")) for i, (f, s) in enumerate(zip(features, shap, strict=True))])
    ranked = F.slice(F.sort_array(of_feature, asc=False), 1, min(top, len(shap)))
    return found, found.groupBy("endotype").agg(F.count("*").alias("n"), F.transform(ranked, lambda r: r["f"]).alias("top_features"))

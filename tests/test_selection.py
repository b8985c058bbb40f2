"""Shapley values of trees, neighbour information, and what is built on them, against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml import classification as mlc
from pyspark.ml import regression as mlr
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.operators import neighbour_information as ni
from tessera.operators import tree_shap

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    rows = [(i, *map(float, r), float(t), float(2 * r[0] - r[3] ** 2)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, d double, y double, t double")
    return VectorAssembler(inputCols=NAMES, outputCol="x").transform(df).persist(), x


def brute(leaves, row):
    """Shapley values from all subsets, absent features passing shares of rows."""
    p = len(row)

    def value(present):
        total = 0.0
        for leaf in leaves:
            w = leaf.value
            for f, low, high, share in zip(leaf.features, leaf.low, leaf.high, leaf.shares, strict=True):
                w *= float(low < row[f] <= high) if f in present else share
            total += w
        return total

    out = np.zeros(p)
    for j in range(p):
        others = [f for f in range(p) if f != j]
        for s in range(p):
            for chosen in itertools.combinations(others, s):
                out[j] += math.factorial(s) * math.factorial(p - s - 1) / math.factorial(p) * (value({*chosen, j}) - value(set(chosen)))
    return out


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted", "regression", "boosted regression"])
def test_values_of_trees(spark, table, kind):
    df, x = table
    how = {"featuresCol": "x", "maxDepth": 4}
    model, label = {
        "tree": lambda: (mlc.DecisionTreeClassifier(labelCol="y", **how), 1),
        "forest": lambda: (mlc.RandomForestClassifier(labelCol="y", numTrees=5, seed=1, **how), 1),
        "boosted": lambda: (mlc.GBTClassifier(labelCol="y", maxIter=4, **how), None),
        "regression": lambda: (mlr.RandomForestRegressor(labelCol="t", numTrees=5, seed=1, **how), None),
        "boosted regression": lambda: (mlr.GBTRegressor(labelCol="t", maxIter=4, **how), None),
    }[kind]()
    model = model.fit(df)
    leaves = tree_shap.leaves_of(model, spark, label)
    got = {r["i"]: r for r in tree_shap.tree_shap(df, NAMES, ["i"], model, label).collect()}
    for i in range(0, 300, 60):
        assert np.allclose([got[i][f"{n}__shap"] for n in NAMES], brute(leaves, x[i]), atol=1e-10)
    for r in model.transform(df).collect():
        out = r["probability"][1] if label is not None else r["rawPrediction"][1] if kind == "boosted" else r["prediction"]
        own = got[r["i"]]
        assert sum(own[f"{n}__shap"] for n in NAMES) + own["expected"] == pytest.approx(out, abs=1e-9)


def test_scores_and_endotypes(spark, table):
    df, x = table
    model = mlc.RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=8, seed=1).fit(df)
    zero, one = (tree_shap.tree_shap(df, NAMES, ["i"], model, label) for label in (0, 1))
    scores = tree_shap.shap_scores({0: zero, 1: one}, [*NAMES, "unused"])
    assert scores["unused"] == 0 and min(scores[f] for f in "abc") > scores["d"] > 0
    assert scores == pytest.approx(tree_shap.shap_scores(one, [*NAMES, "unused"]))  # two classes mirror each other
    found, listed = tree_shap.endotypes(one, NAMES, ["i"], "kmeans", 2)
    assert found.count() == 300 and {r["endotype"] for r in listed.collect()} == {0, 1} and all(r["top_features"][0] in "abc" and len(r["top_features"]) == 3 for r in listed.collect())
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal((3, 0) if i < 30 else (-3, 1), 0.1))) for i in range(60)]
    found, listed = tree_shap.endotypes(spark.createDataFrame(rows, "i long, u__shap double, v__shap double"), ["u", "v"], ["i"])
    assert sorted((r["endotype"], r["n"], r["top_features"][0]) for r in listed.where("endotype >= 0").collect())[0][2] == "u" and listed.where("endotype >= 0").count() == 2
    with pytest.raises(ValueError):
        tree_shap.endotypes(one, NAMES, ["i"], "other")


def plain_information(v, y, k):
    keep = [i for i in range(len(v)) if list(y).count(y[i]) > 1]
    v, y = np.asarray(v)[keep], np.asarray(y)[keep]
    total = 0.0
    for i in range(len(v)):
        d, same = np.abs(v - v[i]), y == y[i]
        kk = min(k, same.sum() - 1)
        r = np.sort(d[same])[kk] * (1 + 1e-12) + 1e-14
        total += special.digamma((same & (d <= r)).sum() - 1) - special.digamma(same.sum()) - special.digamma((d <= r).sum() - 1)
    return max(0.0, special.digamma(len(v)) + total / len(v))


@pytest.mark.parametrize("parts", [256, 5])
def test_neighbour_information(spark, parts):
    rng = np.random.default_rng(3)
    y = rng.choice(["p", "q", "r"], 240, p=[0.5, 0.4, 0.1])
    columns = {"far": rng.normal(0, 1, 240) + 2 * (y == "p"), "none": rng.normal(0, 1, 240), "grid": np.round(rng.normal(0, 2, 240) + (y == "q")), "same": np.zeros(240)}
    rows = [(str(t), *(float(c[i]) for c in columns.values())) for i, t in enumerate(y)] + [("alone", 0.5, 0.5, 1.0, 0.0), (None, 0.1, 0.1, 1.0, 0.0), ("p", None, float("nan"), None, None)]
    df = spark.createDataFrame(rows, "y string, " + ", ".join(f"{c} double" for c in columns)).repartition(4)
    got = {r["feature"]: r["mi"] for r in ni.neighbour_information(df, list(columns), "y", parts=parts, task_rows=10 if parts == 5 else 1000).collect()}
    for name, c in columns.items():
        assert got[name] == pytest.approx(plain_information([*c, {"far": 0.5, "none": 0.5, "grid": 1.0, "same": 0.0}[name]], [*y, "alone"], 3), abs=1e-9)
    assert got["far"] > got["none"] + 0.1 and got["same"] == pytest.approx(0, abs=0.02)
    assert ni.neighbour_information(df.limit(0), ["far"], "y").count() == 0


def test_digamma(spark):
    ns = [1, 2, 5, 19, 20, 21, 1000, 10**9]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in ns], "n long").select(ni.digamma(F.col("n"))).collect()]
    assert got == pytest.approx([special.digamma(n) for n in ns], rel=1e-12)

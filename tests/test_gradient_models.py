"""Regressors fitted by summed gradients, against differences, closed forms and the same fit in memory."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import gradient_models as gm
from tessera.operators import learners


@pytest.fixture(scope="module")
def curve(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2 + rng.normal(0, 0.05, 400)
    rows = [(f"s{i % 20}", float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "subject string, u double, v double, t double").repartition(5)


def as_rows(df, *features):
    return df.select(array_to_vector(F.array(*features)).alias("_x"), F.col("t").alias("_y"))


@pytest.mark.parametrize("loss, width", [(lambda p, x, y: gm.squared_loss(p, x, y, (3, 4, 2, 1)), 3 * 4 + 4 + 4 * 2 + 2 + 2 + 1), (lambda p, x, y: gm.tube_loss(p, x, y, 0.1), 4)])
def test_gradients_equal_differences(loss, width):
    rng = np.random.default_rng(0)
    at, x, y = rng.normal(size=width), rng.normal(size=(30, 3)), rng.normal(size=30)
    slope = loss(at, x, y)[1]
    h = 1e-6 * np.eye(width)
    near = [(loss(at + e, x, y)[0] - loss(at - e, x, y)[0]) / 2e-6 for e in h]
    assert np.allclose(slope, near, rtol=1e-4, atol=1e-5)


def test_sums_do_not_depend_on_partitions(curve):
    rows = curve.select(F.array("u", "v").alias("x"), F.col("t").alias("y"))
    at = np.array([0.3, -0.2, 0.1])
    loss = lambda p, x, y: gm.tube_loss(p, x, y, 0.1)
    pdf = rows.toPandas()
    want = loss(at, np.stack(pdf["x"]), pdf["y"].to_numpy())
    for n in (1, 7, 64):  # of 64 some are empty
        value, slope = gm.summed(rows.repartition(n), loss, at)
        assert np.isclose(value, want[0]) and np.allclose(slope, want[1])


def test_minimum_of_a_quadratic():
    a = np.diag([1.0, 10.0, 100.0]) + 0.5
    b = np.array([1.0, 2.0, 3.0])
    got = gm.minimise(lambda x: (0.5 * x @ a @ x - b @ x, a @ x - b), np.zeros(3), 200, 1e-12)
    assert np.allclose(got, np.linalg.solve(a, b), atol=1e-5)


def test_linear_tube_of_no_width_is_ridge(curve):
    model = gm.fit(as_rows(curve, "u", "v"), "SVM", cost=0.01, epsilon=0.0, steps=300)
    pdf = curve.toPandas()
    x, t = pdf[["u", "v"]].to_numpy(), pdf["t"].to_numpy()
    z = (t - t.mean()) / t.std()
    one = np.column_stack([x, np.ones(len(x))])
    want = np.linalg.solve(2 * 0.01 * one.T @ one + np.diag([1.0, 1.0, 0.0]), 2 * 0.01 * one.T @ z)
    assert np.allclose(model.at, want, atol=5e-3)


@pytest.mark.parametrize("name", gm.REGRESSORS)
def test_held_out_regression_beats_a_line(curve, name):
    score = lambda n: curve_score(curve, n)
    assert score(name) < 0.35 * score("ElasticNet")


def curve_score(curve, name):
    got = learners.held_out_predictions(curve, ["u", "v"], "t", "subject", name, "regression", folds=2)
    assert got.count() == 400
    return got.agg(F.avg(F.pow(F.col("prediction") - F.col("t"), 2.0))).first()[0]


def test_equal_labels_no_rows_and_unknown_names(spark, curve):
    same = as_rows(curve.withColumn("t", F.lit(4.0)), "u", "v")
    for name in gm.REGRESSORS:
        assert {r[0] for r in gm.fit(same, name).transform(same).select("prediction").collect()} == {4.0}
        with pytest.raises(ValueError, match="no rows"):
            gm.fit(same.limit(0), name)
    with pytest.raises(ValueError, match="unknown"):
        gm.fit(same, "other")

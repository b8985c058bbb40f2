"""The structure of many groups at once against that of one group at a time."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import group_kernels as kernels
from tessera.operators import heterogeneity as het


def test_dips_of_many_series_equal_those_of_each():
    rng = np.random.default_rng(0)
    series = [rng.normal(size=n) for n in (0, 1, 4, 5, 30, 900)] + [np.zeros(5), np.array([1.0, 2, 2, 2]), rng.integers(0, 4, 100).astype(float)]
    series += [np.r_[rng.normal(size=90), rng.normal(9, 1, 90)], np.arange(300.0) ** 3, np.linspace(-2, 2, 401) ** 3, -np.exp(-np.linspace(0, 9, 400))]
    assert kernels.dips(series) == pytest.approx([het.dip(s) for s in series], abs=1e-12, nan_ok=True)


@pytest.mark.parametrize("d", [1, 3])
def test_mixtures_of_many_groups_equal_those_of_each_in_less_time(d):
    rng = np.random.default_rng(1)
    groups = [np.r_[rng.normal(size=(n, d)), rng.normal(3, 0.5, (20, d))] for n in range(200, 224)] + [np.repeat(rng.normal(size=(3, d)), 70, axis=0)]
    for k in (2, 3):
        begin = time.perf_counter()
        plain = [max(het.gaussian_mixture(x, k, 42 + s)[0] for s in range(3)) for x in groups]
        middle = time.perf_counter()
        assert kernels.log_likelihoods(groups, k) == pytest.approx(plain, rel=1e-6)
        assert time.perf_counter() - middle < (middle - begin) / 2
    assert [kernels.one_part(x) for x in groups] == pytest.approx([het.gaussian_mixture(x, 1)[0] for x in groups], rel=1e-9)


def test_structure_depends_neither_on_row_order_nor_on_groups_worked_together(spark):
    rng = np.random.default_rng(2)
    sizes = {f"g{i}": n for i, n in enumerate([4, 5, 9, 10, 60, 61, 400, *range(20, 40)])}
    rows = [(g, *map(float, rng.normal(3.0 * (i % 2), 1, 3))) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0)], "g string, a double, b double, c double")
    turned = spark.createDataFrame(rows[::-1], "g string, a double, b double, c double").repartition(5)
    got = [{r["g"]: r for r in het.structure(table, "g", ["a", "b", "c"], together=t).collect()} for table, t in ((df.where("g is not null"), 16384), (turned, 16384), (turned, 50))]
    assert {g: r["n"] for g, r in got[0].items()} == {g: n for g, n in sizes.items() if n >= 5}
    for other in got[1:]:
        for g, r in got[0].items():
            assert list(other[g])[1:] == pytest.approx(list(r)[1:], rel=1e-6, abs=1e-9, nan_ok=True)
    assert math.isnan(got[0]["g2"]["delta_bic"]) and got[0]["g2"]["best_k"] == 1
    assert got[0]["g6"]["best_k"] == 2 and got[0]["g6"]["dip_p"] < 0.01
    whole = np.array([r[1:] for r in rows])
    x = np.array([r[1:] for r in rows if r[0] == "g6"])
    x = x[np.lexsort(x.T)]
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    assert got[0]["g6"]["knn_entropy"] == pytest.approx(het.knn_entropy(z))
    apart = (x - x.mean(axis=0)) / whole.std(axis=0)
    assert got[0]["g6"]["distance_dip"] == pytest.approx(het.dip(np.linalg.norm(apart, axis=1)), abs=1e-9)
    assert het.structure(df, "g", ["a", "b", "c"]).where(F.col("g").isNull()).count() == 0

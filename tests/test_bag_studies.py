"""Nested bags against bags of one size, their clusters, and selection within folds or before them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bag_studies, learners, models


def test_nested_bags_are_the_bags_of_each_size(spark):
    rng = np.random.default_rng(0)
    rows = [(f"s{s}", i, float(a), float(b)) for s in range(6) for i, (a, b) in enumerate(rng.normal(size=(30 if s else 7, 2)))]
    df = spark.createDataFrame(rows + [(None, 99, 1.0, 1.0)], "subject string, i long, u double, v double")
    got = bag_studies.nested_bags(df, "subject", ["u", "v"], (20, 5, 10), 4, ["subject", "i"], ("mean", "std", "skew"))
    for size in (5, 10, 20):
        own = {(r["subject"], r["bag"]): r.asDict() for r in got.where(F.col("size") == size).drop("size").collect()}
        want = {(r["subject"], r["bag"]): r.asDict() for r in models.bags(df, "subject", ["u", "v"], 4, size, ["subject", "i"], ("mean", "std", "skew")).collect()}
        assert own.keys() == want.keys() and len(own) == 24
        for k, r in want.items():
            assert own[k] == pytest.approx(r)


def test_bag_sizes_compared(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{s}", "ab"[s % 2], i, float(x)) for s in range(12) for i, x in enumerate(rng.normal(3.0 * (s % 2), 2.5, 80))]
    df = spark.createDataFrame(rows, "subject string, arm string, i long, u double")
    table, bags = bag_studies.compare_bag_sizes(df, "subject", ["u"], (2, 40), 5, ["subject", "i"], "arm", ("mean",), 8)
    got = {r["size"]: r for r in table.collect()}
    assert set(got) == {2, 40} and got[2]["n_bags"] == got[40]["n_bags"] == 60 and bags.count() == 120
    assert got[40]["clusters"] == 2 and got[40]["purity"] == 1.0 and got[40]["silhouette"] > 0.7 and got[40]["noise"] < 0.3
    assert got[2]["clusters"] != 2 or got[2]["silhouette"] < got[40]["silhouette"]


def test_names():
    names = ["a__mean", "a__std", "b__mean", "c"]
    assert bag_studies.of_statistics(names, ["mean"]) == ["a__mean", "b__mean"] and bag_studies.base_names(names) == ["a", "b", "c"]


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(2)
    n, p = 80, 12
    x = rng.normal(size=(n, p))
    y = (np.arange(n) // 4) % 2  # twenty groups of four rows
    x[:, 1] = x[:, 0] + 0.01 * rng.normal(size=n)
    x[:, 5] += 3.0 * y
    x[:, 7] *= 9
    rows = [(f"g{i // 4}", "no yes".split()[y[i]], *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "g string, y string, " + ", ".join(f"f{j} double" for j in range(p))).persist(), [f"f{j}" for j in range(p)]


def test_selection(wide):
    df, names = wide
    assert bag_studies.select_features(df, names, "y", ["CorrFilter"]) == [f for f in names if f != "f1"]
    assert bag_studies.select_features(df, names, "y", ["HighVariance"], top_k=1) == ["f7"]
    assert bag_studies.select_features(df, names, "y", ["CorrFilter", "MIM"], top_k=1) == ["f5"]
    got = bag_studies.select_features(df, names, "y", ["CMI", "PCALoadings"], top_k=4)
    assert len(got) == 4 and got == [f for f in names if f in got] and "f5" in bag_studies.select_features(df, names, "y", ["CMI"], top_k=2)
    with pytest.raises(ValueError):
        bag_studies.select_features(df, names, "y", ["Other"])


def test_selection_within_folds_and_before(spark, wide):
    df, names = wide
    got, chosen = bag_studies.held_out_selected(df, names, "y", "g", ["MIM"], top_k=2, folds=2, name="ElasticNet")
    assert got.count() == 80 and learners.class_scores(got).first()["accuracy"] > 0.85
    per = {}
    for r in chosen.collect():
        per.setdefault(r["fold"], []).append(r["feature"])
    assert len(per) == 2 and all("f5" in fs and len(fs) == 2 for fs in per.values())
    # labels of a fold's held-out rows don't change what is selected for it; before the folds, one selection serves all
    turned = df.withColumn("y", F.when(models.fold_of(["g"], 2) == 0, F.when(F.rand(3) < 0.5, "no").otherwise("yes")).otherwise(F.col("y")))
    again = bag_studies.held_out_selected(turned, names, "y", "g", ["MIM"], top_k=2, folds=2, name="ElasticNet")[1].where("fold = 0").collect()
    assert [r["feature"] for r in again] == per[0]
    once = bag_studies.held_out_selected(df, names, "y", "g", ["HighVariance"], top_k=3, before=True, folds=2, name="ElasticNet")[1].collect()
    assert [r["feature"] for r in once if r["fold"] == 0] == [r["feature"] for r in once if r["fold"] == 1] and len(once) == 6


def test_bags_are_drawn_once_for_all_sizes(spark, monkeypatch):
    df = spark.createDataFrame([(f"s{s}", "ab"[s % 2], i, float((s * i) % 7)) for s in range(4) for i in range(12)], "subject string, arm string, i long, u double")
    seen, plain = [], bag_studies.written
    monkeypatch.setattr(bag_studies, "written", lambda df, name: seen.append(name) or plain(df, name))
    bag_studies.compare_bag_sizes(df, "subject", ["u"], (2, 5), 2, ["subject", "i"], "arm", ("mean",), 8)
    assert seen.count("bags") == 1 and seen.count("named") == 2

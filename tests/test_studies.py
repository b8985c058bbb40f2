"""Supervised studies: settings that can't run, tables that don't fit them, and what a study returns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bag_studies, models
from tessera.plans.studies import Study, bag_table, run

KEY = ("subject", "i")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{s}", "ab"[s % 2], f"g{s // 4}", i, *map(float, rng.normal(1.5 * (s % 2), 1, 2)), float(rng.normal())) for s in range(12) for i in range(20)]
    return spark.createDataFrame(rows, "subject string, y string, g string, i long, u double, v double, noise double").persist()


BASE = {"label": "y", "subject": "subject"}


@pytest.mark.parametrize(
    "settings, word",
    [
        ({"label": "y"}, "subject: is missing"),
        (BASE | {"bagz": 3}, "bagz: there is no such setting"),
        (BASE | {"bags": "3"}, "bags: '3' has the wrong type"),
        (BASE | {"folds": True}, "folds: True has the wrong type"),
        (BASE | {"standardize": 1}, "standardize: 1 has the wrong type"),
        (BASE | {"statistics": ("mean", 3)}, "statistics"),
        (BASE | {"label": " "}, "label: a column is needed"),
        (BASE | {"task": "ranking"}, "task"),
        (BASE | {"strategy": "heaps"}, "strategy"),
        (BASE | {"bags": 0}, "bags: 0 is less than 1"),
        (BASE | {"statistics": ("mean", "mode")}, "mode"),
        (BASE | {"strategy": "bags", "statistics": ()}, "bags need statistics"),
        (BASE | {"bag_clusters": 1}, "two clusters or more"),
        (BASE | {"overlap": 0.0}, "overlap"),
        (BASE | {"methods": ("Oracle",)}, "Oracle"),
        (BASE | {"methods": ("MIM",), "task": "regression"}, "in folds only"),
        (BASE | {"evaluation": "none"}, "evaluation"),
        (BASE | {"folds": 1}, "folds: 1 is less than 2"),
        (BASE | {"strategy": "attention", "group": "g"}, "attention"),
        (BASE | {"model": "GaussianNB", "task": "regression"}, "GaussianNB"),
    ],
)
def test_settings_that_cannot_run(settings, word):
    with pytest.raises(ValueError, match=word):
        Study.of(settings)


def test_all_faults_are_named_together():
    found = Study("y", "s", task="x", folds=0, overlap=2.0).faults()
    assert [f.split(":")[0] for f in found] == ["task", "folds", "overlap"]
    assert Study.of(BASE).faults() == []


def test_tables_that_do_not_fit(table):
    study = Study("y", "subject", strategy="bags")
    for features, word in ((["u", "w"], "no such columns"), ([], "no features"), (["u", "g"], "aren't numbers")):
        with pytest.raises(ValueError, match=word):
            run(study, table, features, KEY)
    mixed = table.withColumn("y", F.when(F.col("i") == 0, "a").otherwise(F.col("y")))
    with pytest.raises(ValueError, match="several labels"):
        run(study, mixed, ["u"], KEY)
    with pytest.raises(ValueError, match="say what is asked"):
        run(Study("u", "subject", task="regression"), table, ["u", "v"], KEY)


def test_bags_with_shares_equal_bags_and_clusters(table):
    study = Study("y", "subject", strategy="bags", bags=2, bag_size=7, statistics=("mean",), bag_clusters=2, group="g")
    made, names = bag_table(table, ["u", "v"], KEY, study)
    assert names == ["u__mean", "v__mean", "cluster_1__share", "cluster_2__share"]
    rows = made.collect()
    assert len(rows) == 24 and all(r["n_rows"] == 7 and abs(r["cluster_1__share"] + r["cluster_2__share"] - 1) < 1e-12 for r in rows)
    assert {(r["subject"], r["y"], r["g"]) for r in rows} == {(r["subject"], r["y"], r["g"]) for r in table.collect()}
    plain = {(r["subject"], r["bag"]): r["u__mean"] for r in models.bags(table, "subject", ["u"], 2, 7, KEY, ("mean",)).collect()}
    assert plain == {(r["subject"], r["bag"]): r["u__mean"] for r in rows}


def test_shares_of_rows_without_place(table):
    holes = table.withColumn("u", F.when(F.col("i") >= 10, F.col("u")))
    model = models.Clusters(("u",), ((-100.0,), (100.0,)), 0.0)
    for r in bag_studies.cluster_shares(holes, model, "subject", 1, 20, KEY).collect():
        assert r["n_rows"] == 20 and abs(r["cluster_1__share"] + r["cluster_2__share"] - 0.5) < 1e-12
    empty = bag_studies.cluster_shares(holes.limit(0), model, "subject", 1, 20, KEY)
    assert empty.count() == 0


def test_overlap(table):
    got = bag_studies.bag_overlap(table, "subject", 5, 0.2).collect()
    assert {(r["n_rows"], r["overlap"], r["flagged"]) for r in got} == {(20, 0.25, True)}
    assert {r["overlap"] for r in bag_studies.bag_overlap(table, "subject", 30).collect()} == {1.0}


def test_a_study_of_bags_holds_groups_out(table):
    study = Study("y", "subject", strategy="bags", bags=3, bag_size=10, statistics=("mean", "std"), bag_clusters=2, model="GaussianNB", evaluation="groups", group="g")
    got = run(study, table, ["u", "v"], KEY)
    assert got.predictions.count() == 36 and got.scores.first()["accuracy"] > 0.9
    assert got.predictions.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    assert got.overlaps.where("flagged").count() == 12 and got.chosen is None


def test_a_study_with_selection_and_one_of_attention(table):
    chosen = run(Study("y", "subject", model="GaussianNB", methods=("HighVariance",), top=2, folds=2), table, ["u", "v", "noise"], KEY)
    assert {r["feature"] for r in chosen.chosen.collect()} == {"u", "v"} and chosen.scores.first()["accuracy"] > 0.7
    seen = run(Study("y", "subject", strategy="attention", folds=2), table, ["u", "v"], KEY)
    assert seen.predictions.count() == 12 and seen.scores.first()["n"] == 12


def test_a_study_of_numbers(table):
    target = table.withColumn("t", F.when(F.col("y") == "a", 1.0).otherwise(3.0))
    got = run(Study("t", "subject", task="regression", strategy="bags", bags=2, bag_size=10, statistics=("mean",), model="ElasticNet", folds=3), target, ["u", "v"], KEY)
    row = got.scores.first()
    assert row["n"] == 12 and row["r2"] > 0.5

"""Learners, attention, maps, density clusters, group tests and file names against closed forms and planted structure."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import images
from tessera.operators import attention, chimeras, density, learners, maps, models, significance, trees
from tessera.sources import reports


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{s}", "ab"[s % 2], float(a), float(b), i) for s in range(12) for i, (a, b) in enumerate(rng.normal(2.0 * (s % 2), 0.5, size=(8, 2)))]
    return spark.createDataFrame(rows, "subject string, y string, u double, v double, i long").persist()


@pytest.mark.parametrize("name", ["ElasticNet", "ExtraTrees", "GaussianNB", "GradientBoosting", "KNeighbors", "SVM", "MLP"])
def test_classifiers_learn(labelled, name):
    got = learners.held_out_predictions(labelled, ["u", "v"], "y", "subject", name, folds=2)
    row = learners.class_scores(got).first()
    assert row["n"] == 96
    assert row["accuracy"] > 0.9
    assert row["auc"] > 0.95


def test_one_fold_per_group_and_regression(labelled):
    target = labelled.where("subject in ('s0', 's1', 's2')").withColumn("t", 3 * F.col("u") - F.col("v"))
    got = learners.held_out_predictions(target, ["u", "v"], "t", "subject", "KNeighbors", "regression", folds=None)
    assert got.select("fold").distinct().count() == 3
    assert learners.subject_scores(got, "subject").first()["n"] == 3


def test_unusable_labels(labelled):
    with pytest.raises(ValueError, match="two labels"):
        learners.held_out_predictions(labelled.where("y = 'a'"), ["u"], "y", "subject", "GaussianNB")
    with pytest.raises(ValueError, match="unknown"):
        learners.fit(labelled.withColumn("_y", F.lit(0.0)), ["u"], "Oracle", 2)


@pytest.mark.parametrize("p", [3, 9])
def test_shapley_of_a_linear_model(spark, p):
    names = [f"f{j}" for j in range(p)]
    df = spark.createDataFrame([(i, *[float(i * j % 5) for j in range(p)]) for i in range(6)], f"id long, {', '.join(f'{n} double' for n in names)}")
    got = learners.shapley(df, names, ["id"], lambda d: d.withColumn("score", sum(((j + 1) * F.col(n) for j, n in enumerate(names)), F.lit(0.0))), dict.fromkeys(names, 1.0), permutations=3)
    for r in got.collect():
        assert [r[f"{n}__shap"] for n in names] == pytest.approx([(j + 1) * (r["id"] * j % 5 - 1) for j in range(p)])
    assert sum(r["importance"] for r in learners.importances(got, names).collect()) == pytest.approx(1)


def test_attention_gradients_and_learning(spark):
    rng = np.random.default_rng(0)
    model, x = attention.GatedAttention(3, 2, hidden=4, gate=3), rng.normal(size=(6, 3))
    _, grads = model.gradients(x, 1)
    for k, g in grads.items():
        at = (0,) * g.ndim
        loss = []
        for step in (1e-6, -2e-6):
            model.p[k][at] += step
            loss.append(model.gradients(x, 1)[0])
        model.p[k][at] += 1e-6
        assert g[at] == pytest.approx((loss[0] - loss[1]) / 2e-6, abs=1e-6)
    rows = [(f"s{s}", s % 2, i, float(a), float(b)) for s in range(16) for i, (a, b) in enumerate(rng.normal(0, 1, (20, 2)) + (3 * (s % 2), 0))]
    df = spark.createDataFrame(rows, "subject string, y int, i long, a double, b double")
    got = attention.attention_weights(df, ["a", "b"], "subject", "y", ["subject", "i"], folds=2, epochs=60)
    per = got.groupBy("subject", "label", "predicted").agg(F.sum("attention").alias("w"), F.count(F.lit(1)).alias("n")).collect()
    assert len(per) == 16
    assert all(r["w"] == pytest.approx(1) and r["n"] == 20 for r in per)
    assert sum(r["label"] == r["predicted"] for r in per) >= 15


def test_map_keeps_groups_apart_and_sample_rows_in_place(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"g{i % 3}", *(rng.normal(6 * (i % 3), 1, 4)).tolist()) for i in range(240)]
    df = spark.createDataFrame([*rows, (999, "g0", None, 1.0, 1.0, 1.0)], "id long, g string, a double, b double, c double, d double")
    fitted = maps.fit_map(df, ["a", "b", "c", "d"], "g", ["id"])
    got = fitted.apply(df).orderBy("id").toPandas()
    assert got.iloc[-1][["map_1", "map_2"]].isna().all()
    places = got.iloc[:-1][["map_1", "map_2"]].to_numpy()
    assert places == pytest.approx(fitted.places)
    assert models.silhouette(places, got["g"].iloc[:-1].to_numpy()) > 0.6
    assert maps.curve(0.1) == pytest.approx((1.577, 0.895), abs=2e-3)


def test_hdbscan_finds_blobs():
    rng = np.random.default_rng(0)
    x = np.concatenate([*[rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (5, 5), (0, 6))], [[30.0, 30.0], [-30.0, 5.0]]])
    labels = density.hdbscan(x, 10)
    assert [len(set(labels[i * 60 : i * 60 + 50])) for i in range(3)] == [1, 1, 1]
    assert len(set(labels[[0, 60, 120]])) == 3
    assert labels[180:].tolist() == [-1, -1]
    assert density.clustering_quality(x, labels)["clusters"] == 3
    assert density.hdbscan(x[:3], 10).tolist() == [-1] * 3
    assert density.hdbscan(np.zeros((20, 2)), 5).tolist() == [-1] * 20


def test_exact_u_equals_enumeration():
    for n1, n2 in ((3, 4), (2, 5), (4, 4)):
        every = [sum(c) - n1 * (n1 - 1) // 2 for c in itertools.combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            high = max(u, n1 * n2 - u)
            assert significance.exact_u(u, n1, n2) == pytest.approx(min(1, 2 * sum(v >= high for v in every) / len(every)))


def test_subject_tests(spark):
    rows = [("a", float(i)) for i in range(6)] + [("b", float(i + 10)) for i in range(6)]
    df = spark.createDataFrame([*rows, (None, 3.0), ("a", None)], "g string, v double").withColumn("same", F.lit(1.0))
    got = {r["metric"]: r for r in significance.subject_tests(df, "g", ["v", "same"], permutations=500).collect()}
    assert got["v"]["statistic"] == 0
    assert got["v"]["p"] == pytest.approx(2 / 924)
    assert got["v"]["permutation_p"] == 1
    assert got["v"]["p_min"] == pytest.approx(1 / 924)
    assert got["same"]["test"] == "none"
    assert significance.pairwise({"a": np.arange(4.0), "b": np.arange(4.0) + 9, "c": np.arange(4.0) + 20})[0][2:] == (0, pytest.approx(3 * 2 / 70))


def test_leaf_order_is_the_best_of_all_turns():
    d = trees.distances(np.random.default_rng(3).normal(size=(6, 4)), "euclidean")
    tree = trees.linkage(d)

    def orders(v):
        if v < 6:
            return [(v,)]
        a, b = (orders(w) for w in tree[v - 6][:2])
        return [p + q for x, y in ((a, b), (b, a)) for p in x for q in y]

    cost = lambda o: sum(d[i, j] for i, j in itertools.pairwise(o))
    assert cost(trees.ordered_leaves(tree, d)) == pytest.approx(min(map(cost, orders(10))))


def test_image_names(spark):
    names = {
        "KFishYoung1fish565x1200grille2Dfield2_MITO_measurements.txt": ("KFish", "Young", None, "565"),
        "Oldkilli1569grille4bx1200field7_MITO_measurements.TXT": ("KFish", "Old", None, "1569"),
        "OldZebrafish42518grille4Bx1200field4_MITO_measurements.txt": ("ZFish", "Old", None, "42518"),
        "SourisJ3_Prot1533_Ech1755_Grille13E_x1500_field_19_MITO_measurements.txt": ("Mouse", None, None, "1533"),
        "/in/WormIFold7Grille3_MITO_measurements.txt": ("Worm", "Old", "IF", "7"),
        "unknown.txt": (None, None, None, None),
    }
    df = spark.createDataFrame([(n,) for n in [*names, None]], "n string").select("n", images.metadata(F.col("n")).alias("m"))
    got = {r["n"]: r["m"] for r in df.collect()}
    assert {n: tuple(got[n]) for n in names} == names
    picked = spark.createDataFrame([("Old", "Young"), (None, "Young"), (None, "x"), ("Old", None)], "a string, b string")
    assert [tuple(r[0]) for r in picked.select(images.resolve_condition(F.col("a"), F.col("b"))).collect()] == [("Old", True), ("Young", False), (None, False), ("Old", False)]


def test_chimeras_refuse_small_subjects(spark):
    df = spark.createDataFrame([("a", i) for i in range(4)] + [("b", i) for i in range(9)], "s string, i long")
    assert {r["s"]: r["count"] for r in chimeras.chimeras(df, "s", "a", "b", ["s", "i"], (0.25,), 2).groupBy("s").count().collect()} == {"chimera_axb_r0.25_0": 4, "chimera_axb_r0.25_1": 4}
    with pytest.raises(ValueError, match="too few"):
        chimeras.chimeras(df, "s", "a", "b", ["s", "i"], (0.9,), n=9)


def test_report_pages_and_inspection(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 1.5)], "i long, v double")
    seen = {r["column"]: r for r in reports.inspect(df).collect()}
    assert (seen["v"]["missing"], seen["i"]["missing"], seen["i"]["maximum"]) == (2, 0, "3")
    made = reports.pdf([("Title (1)", reports.table_text(df)), ("Long", ["x"] * 130)])
    assert made.startswith(b"%PDF-1.4")
    assert made.count(b"/Type /Page ") == 4
    start = int(made.split(b"startxref\n")[1].split(b"\n")[0])
    assert made[start:].startswith(b"xref\n0 12\n")
    reports.write_csv(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3

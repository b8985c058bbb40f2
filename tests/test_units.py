"""Closed-form checks of functions and kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import special, tokens
from tessera.operators import heterogeneity as het
from tessera.operators import flow, models, ranks, rows, trees
from tessera.sources import fcs, tables


def test_special():
    assert special.normal_sf(1.959963984540054) == pytest.approx(0.025, rel=1e-9)
    assert special.chi2_sf(5.991464547107979, 2) == pytest.approx(0.05, rel=1e-9)
    assert special.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-7)
    assert special.digamma(1) == pytest.approx(-0.5772156649015329, rel=1e-9)


def test_conditions(spark):
    names = ["WORM_001_D08_AL_DR", "WORM_001_D08_AL_PGM_DR", "WORM_001_D08_AL_PGM_ADP_1min_DR", "WORM_001_D08_AL_PGM_ADP_30min_DR", "WORM_001_30min_PGM_X_DR.fcs"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", tokens.condition(tokens.words(F.col("n")), ["PGM", "ADP"], ["WORM"]).alias("c"))
    got = {r["n"]: (r["c"]["condition"], r["c"]["additions"], r["c"]["minutes"], r["c"]["unrecognised"]) for r in df.collect()}
    assert [got[n][:3] for n in names] == [("No_addition", 0, None), ("PGM", 1, None), ("PGM_ADP_1min", 2, 1.0), ("PGM_ADP_30min", 2, 30.0), ("PGM", 1, None)]
    assert got[names[4]][3] == ["30min", "X"]


def test_sentinel_and_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("", float("nan")), (None, 3.0), ("b", None)], "k string, v double")
    assert df.where(rows.matches(F.col("k"), ["a", ""])).count() == 3
    assert df.where(rows.by_value(F.col("v"), "above", 1.0)).count() == 2
    assert [r["v"] for r in rows.fraction(df, "v", 0.5, ["k"]).collect()] == [3.0]


def test_fraction_rounds_half_to_even_and_takes_later_ties(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(5)], "id long, v double")
    assert sorted(r["id"] for r in rows.fraction(df, "v", 0.5, ["id"]).collect()) == [3, 4]
    assert sorted(r["id"] for r in rows.fraction(df, "v", 0.5, ["id"], "lowest").collect()) == [0, 1]


def test_sample_with_replacement(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 40), ("b", 5)) for i in range(n)] + [(None, 1)], "g string, i long")
    got = rows.sample_per_group(df, "g", 30, ["g", "i"], replace_if_short=True)
    assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {"a": 30, "b": 30}


def test_mann_whitney_p(spark):
    a, b = [float(v) for v in range(1, 7)], [float(v) for v in range(4, 10)]
    df = spark.createDataFrame([("x", v) for v in a] + [("y", v) for v in b] + [("y", None)], "g string, v double")
    r = ranks.compare_groups(df, "g", ["v"]).first()
    assert (r["statistic"], r["effect"]) == (4.5, 0.75)
    assert r["p"] == pytest.approx(0.0362, abs=5e-4)


def test_heterogeneity_orders(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (60, 3)), rng.normal(0, 3, (60, 3))]).tolist()
    df = spark.createDataFrame([(f"s{i // 60}", *v) for i, v in enumerate(x)] + [("few", 0.0, 0.0, 0.0)], "s string, a double, b double, c double")
    d = {r["s"]: r for r in het.dispersion(df, "s", ["a", "b", "c"]).collect()}
    assert set(d) == {"s0", "s1"} and d["s1"]["mhi_d"] > d["s0"]["mhi_d"] and d["s0"]["q25"] <= d["s0"]["mhi_d"] <= d["s0"]["q75"]


def test_dip_tells_two_peaks_from_one():
    rng = np.random.default_rng(1)
    one, two = rng.normal(0, 1, 400), np.concatenate([rng.normal(-4, 1, 200), rng.normal(4, 1, 200)])
    assert het.dip(two) > 3 * het.dip(one)
    x = two[:, None]
    assert het.bic(x, 2) < het.bic(x, 1)


def test_quality_kernels():
    impulse = flow.cycle(np.array([0.0, 0, 1, 0, 0]))
    assert impulse[2] == pytest.approx(0.75)
    assert impulse[1] == pytest.approx((math.sin(math.pi) - math.sin(math.pi / 4)) / math.pi)
    rng = np.random.default_rng(2)
    assert flow.changepoints(np.concatenate([rng.normal(0, 1, 50), rng.normal(8, 1, 50)]), penalty=20)[0] == 50
    assert flow.changepoints(np.zeros(100)) == [100]


def test_trees():
    d = np.array([trees.DIVERGENCE[s] for s in trees.SPECIES])
    trees.check_ultrametric(d)
    tree = trees.linkage(d)
    assert set(trees.EXPECTED_CLADES) <= trees.clades(tree, trees.SPECIES)
    assert np.allclose(trees.cophenetic(tree, 6), d)
    gamma, p = trees.baker_gamma(tree, tree, 6)
    assert gamma == pytest.approx(1) and p == pytest.approx(8 / 720)
    assert trees.crossings("abc", "cba") == 3
    with pytest.raises(ValueError):
        trees.check_ultrametric(np.array([[0.0, 1, 5], [1, 0, 2], [5, 2, 0]]))


def test_label_assignments():
    every = models.label_assignments(["a", "a", "b", "b", "b"])
    assert len(every) == len(set(every)) == 10 and every[0] == ("a", "a", "b", "b", "b")


def test_fcs_round_trip(spark, tmp_path):
    rng = np.random.default_rng(3)
    ev = fcs.FcsEvents(["FSC-A", "Time"], ["", "t"], rng.normal(100, 10, (50, 2)).astype("<f4").astype(float), {"$cyt": "Auro/ra"})
    mask = np.arange(50) % 2 == 0
    data = fcs.write(ev, mask, {"FlowAI": np.arange(50.0)})
    back = fcs.parse(data)
    assert back.names == ["FSC-A", "Time", "FlowAI"] and np.array_equal(back.values[:, :2], ev.values[mask]) and back.text["$cyt"] == "Auro/ra"
    assert back.ranges()["FlowAI"] == 20000
    (tmp_path / "a.fcs").write_bytes(data)
    (tmp_path / "b.fcs").write_bytes(b"no")
    got = fcs.read(spark, str(tmp_path), ["FSC-A"])
    assert got.where("error is null").count() == 25 and got.where("error is not null").count() == 1
    with pytest.raises(ValueError):
        fcs.write(ev, None, {"Time": np.zeros(50)})


def test_clinical(spark, tmp_path):
    (tmp_path / "c.csv").write_text('MNMS,Age,BMI (kg/m2),Cholestérol total,"Glucose\n*aléatoire*"\nMNMS 001,50,-1.0,2,x\nnone,1,1,1,1\nMNMS 002,60,20,3,y\n')
    got = {r["subject_ID"]: r for r in tables.read_clinical(spark, str(tmp_path / "c.csv")).collect()}
    assert set(got) == {"001", "002"} and got["001"]["bmi_kg_m2"] is None and got["002"]["age"] == 60 and got["002"]["glucose_aleatoire"] == "y"
    events = spark.createDataFrame([("001",)] * 4 + [("999",)] * 2, "subject_ID string")
    assert tables.enrich(events, tables.read_clinical(spark, str(tmp_path / "c.csv"))).where("age is null").count() == 2

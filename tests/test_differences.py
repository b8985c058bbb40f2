"""Queries that once differed from their SQL on larger tables."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import scalars
from tessera.operators import aggregates, gates, models, ordered, quality

from .oracle import same


def test_file_names_that_several_organ_remainders_share(spark, tmp_path):
    """Suppliers 3 and 3999 have one file name, but other remainders modulo 5."""
    spark.range(1, 8001).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    same(catalog.QUERIES["annotated_files"](spark, str(tmp_path)), con, catalog.ORACLE_SQL["annotated_files"])


def test_drawn_gate_holds_rows_on_its_lower_edge(spark, tmp_path):
    """Prices of 10000 and 50000 lie on the gate's edges, quantities of 20 and 40 likewise."""
    rows = [("F", float(q), float(p)) for q in (19, 20, 30, 39, 40, 41) for p in (9999.99, 10000.0, 10000.01, 30000.0, 49999.99, 50000.0, 50000.01)]
    spark.createDataFrame(rows, "l_linestatus string, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    same(catalog.QUERIES["drawn_gate"](spark, str(tmp_path)), con, catalog.ORACLE_SQL["drawn_gate"])
    assert catalog.QUERIES["drawn_gate"](spark, str(tmp_path)).first()["n"] == 12


def test_arcsinh_of_large_values_below_zero(spark):
    df = spark.createDataFrame([(v,) for v in (-1e12, -20000.0, -1.0, 0.0, 20000.0, 1e12, None, float("nan"))], "v double")
    got = [r[0] for r in df.select(scalars.arcsinh(F.col("v"), 250.0)).collect()]
    assert [got[0], got[1]] == [-got[5], -got[4]] and got[6] is None and got[7] != got[7]
    assert [r[0] for r in df.where("v < 0").select(gates.shown(F.col("v"), "biex")).collect()] == got[:3]


def test_weights_shuffle_no_more_than_rows_and_units(spark):
    """A window with the set of all units in every row once made the rows grow by the number of units."""
    df = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("a", 2, 2), ("b", 3, 3), ("b", None, 4), (None, 5, 5)], "g string, s long, i long")
    got = aggregates.nested_weights(df, ["g", "s"])
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["i"]: r["weight"] for r in got.collect()} == {0: 1 / 8, 1: 1 / 8, 2: 1 / 4, 3: 1 / 2, 4: 1 / 2, 5: 1 / 2}


def test_quantiles_compare_each_row_with_few_edges(spark):
    """All edges were once compared with every row, and again for the row above."""
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=4000), np.repeat(0.5, 500), [7.0] * 90])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)] * 700, "v double")
    for share in (0.0, 0.01, 0.3, 0.5, 0.731, 0.99, 1.0):
        assert abs(ordered.quantile(df, "v", share, task_rows=50, parts=16) - np.quantile(v, share)) < 1e-12
    ranks = np.sort(np.append(np.full(700, -np.inf), v))
    for down in (False, True):
        for k in (1, 650, 900, 3000, len(ranks)):
            want = ranks[-k] if down else ranks[k - 1]
            assert ordered.row_at(df, ["v"], down, k, 50, 16)[0] == (None if want == -np.inf else want)
    assert all(len(ordered._around(sorted(rng.normal(size=255)), 1000, k)) <= 2 for k in (0, 5, 500, 999))


def test_clusters_are_summed_in_batches(spark):
    """A Lloyd step in numpy gives what a grouped table gives, weights included."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in (0.0, 3.0)])
    df = spark.createDataFrame([(i, float(a), float(b), 1.0 + i % 3) for i, (a, b) in enumerate(x)], "i long, a double, b double, w double")
    w = 1.0 + np.arange(len(x)) % 3
    for weight in (None, "w"):
        model = models.fit_clusters(df, ["a", "b"], 2, ["i"], weight=weight)
        halves = [np.average(x[h], axis=0, weights=w[h] if weight else None) for h in (slice(0, 60), slice(60, 120))]
        assert np.allclose(sorted(model.centroids), sorted(map(tuple, halves)))
    seen = models._cluster_sums(df.repartition(3), ["a", "b"], np.array([[0.0, 0.0], [3.0, 3.0], [99.0, 99.0]]), None)
    assert sorted((r["c"], r["n"]) for r in seen) == [(0, 60), (1, 60)]


def test_best_pairs_meet_prefixes_not_files(spark):
    """Stained files were once joined with all unstained ones that share two tokens: rows times rows."""
    files = ["a_b_c_S1.fcs", "a_b_d_S2", "a_x_S3", "a_b_S4", "one", "a_b_c_U1.FCS", "a_b_c_U2", "a_b_U3", "lone_U", "q_q_S5", "q_q_U9", "q_q_S5"]
    got = quality.best_pairs(spark.createDataFrame([(f,) for f in files], "file string"), ~F.col("file").rlike("_U"))
    want = {"a_b_c_S1.fcs": ("a_b_c_U1.FCS", 3, True), "a_b_d_S2": ("a_b_U3", 2, True), "a_b_S4": ("a_b_U3", 2, True), "a_x_S3": (None, None, False), "one": (None, None, False), "q_q_S5": ("q_q_U9", 2, True)}
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want and got.count() == len(want)
    many = spark.range(3000).select(F.concat(F.lit("a_b_"), F.when(F.col("id") % 2 == 0, "S").otherwise("U"), F.col("id").cast("string")).alias("file"))
    assert quality.best_pairs(many, F.col("file").rlike("_S[0-9]+$")).where("several and unstained_file = 'a_b_U1'").count() == 1500
    plan = quality.best_pairs(many, F.col("file").rlike("_S[0-9]+$"))._jdf.queryExecution().optimizedPlan().toString()
    assert "k0" not in plan and "Window" not in plan


def test_scan_looks_for_no_limits_and_sums_inertia_in_batches(spark, monkeypatch):
    """Limits of each number of clusters were once found and thrown away."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.3, (50, 2)) for c in (0.0, 3.0)])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i long, a double, b double")
    fitted = models.fit_clusters(df, ["a", "b"], 2, ["i"])
    monkeypatch.setattr(models, "quantile", None)
    got = {r["n_clusters"]: r for r in models.scan_clusters(df, ["a", "b"], (2, 3), ["i"])}
    apart = ((x[:, None] - np.array(fitted.centroids)[None]) ** 2).sum(axis=2).min(axis=1)
    assert abs(got[2]["inertia"] - apart.sum()) < 1e-9 and got[2]["smallest_share"] == 0.5 and got[3]["inertia"] < got[2]["inertia"]

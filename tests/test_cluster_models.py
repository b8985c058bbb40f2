"""Mixtures against a fit that has all rows; spaces and models replayed, saved and told apart."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster_models, mixtures, models, ordered, spaces
from tessera.sources.dataset import Dataset


def plain_mixture(x, k, seed, starts=3):
    """EM in memory: best of the same starts."""
    best = None
    for s in range(starts):
        resp = np.eye(k)[((x[:, None] - mixtures.starting_centres(x, k, seed + s)[None]) ** 2).sum(axis=2).argmin(axis=1)]
        last = -np.inf
        for _ in range(101):
            n = resp.sum(axis=0) + 10 * np.finfo(float).eps
            means = resp.T @ x / n[:, None]
            cov = [(resp[:, j, None] * (x - means[j])).T @ (x - means[j]) / n[j] + 1e-6 * np.eye(x.shape[1]) for j in range(k)]
            logs = np.stack([math.log(n[j] / n.sum()) - 0.5 * np.log(np.linalg.det(2 * np.pi * cov[j])) - 0.5 * np.einsum("ij,jk,ik->i", x - means[j], np.linalg.inv(cov[j]), x - means[j]) for j in range(k)], axis=1)
            norm = np.log(np.exp(logs).sum(axis=1))
            resp, mean = np.exp(logs - norm[:, None]), norm.mean()
            if abs(mean - last) < 1e-3:
                break
            last = mean
        if best is None or mean > best[0]:
            best = (mean, norm.sum())
    d = x.shape[1]
    return (k - 1 + k * d + k * d * (d + 1) // 2) * math.log(len(x)) - 2 * best[1]


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.multivariate_normal(m, c, n) for m, c, n in (((0, 0), ((1, 0.8), (0.8, 1)), 300), ((6, 1), ((0.5, 0), (0, 2)), 200), ((2, 7), ((1, -0.5), (-0.5, 1)), 100))])
    df = spark.createDataFrame([(i, f"s{i % 7}", *map(float, row)) for i, row in enumerate(x)], "i long, subject string, u double, v double").repartition(5).persist()
    return df, x


def test_mixtures_equal_a_plain_fit(clouds):
    df, x = clouds
    got = mixtures.fit_mixtures(df.unionByName(df.limit(3).withColumn("u", F.lit(None).cast("double"))), ["u", "v"], (2, 3, 4), ["i"])
    digest = df.orderBy(models.sample_order(["i"], 42), "i").select("u", "v").toPandas().to_numpy()  # starts depend on the order
    for k, m in got.items():
        assert m.rows == 600 and m.bic == pytest.approx(plain_mixture(digest, k, 42), abs=0.5)
        assert np.isclose(m.weights.sum(), 1)
    assert min(got, key=lambda k: got[k].bic) == 3
    best = got[3]
    assert np.allclose(best.weights, [0.5, 1 / 3, 1 / 6], atol=0.02) and np.allclose(best.means[1], [6, 1], atol=0.3)
    place, density = best.columns()
    rows = df.select("u", "v", place.alias("j"), density.alias("d")).collect()
    logs = best.log_densities(np.array([[r["u"], r["v"]] for r in rows]))
    assert [r["j"] for r in rows] == logs.argmax(axis=1).tolist()
    assert np.allclose([r["d"] for r in rows], np.log(np.exp(logs).sum(axis=1)))
    again = mixtures.from_lists(json.loads(json.dumps(mixtures.as_lists(best))))
    assert np.array_equal(again.covariances, best.covariances) and again.bic == best.bic
    with pytest.raises(ValueError):
        mixtures.fit_mixtures(df.limit(2), ["u", "v"], (2,), ["i"])


@pytest.mark.parametrize("algorithm", ["kmeans", "gmm"])
def test_models_are_saved_and_replayed(spark, clouds, tmp_path, algorithm):
    df, x = clouds
    space = spaces.fit_space(df, ["u", "v"], "pca", components=2)
    model = cluster_models.fit(df, "m", space, ["i"], algorithm, max_clusters=4, subject="subject", counted=["subject"])
    assert model.k == 3 and [r["chosen"] for r in model.selection] == [False, True, False]
    again = cluster_models.ClusterModel.from_json(model.to_json())
    assert again.describe() == model.describe() and model.provenance["subjects"] == 7 and sum(model.provenance["counts"]["subject"].values()) == 600
    a, b = (sorted((r["i"], r["cluster"], r["cluster_atypical"]) for r in m.assign(df).collect()) for m in (model, again))
    assert a == b and sum(r[2] for r in a) == 6  # one of a hundred
    sizes = [sum(r[1] == c for r in a) for c in model.labels]
    assert sizes == sorted(sizes, reverse=True) == [p["n"] for p in model.profiles] and abs(sizes[0] - 300) < 10
    # a dataset that holds the space's coordinates, and one that only claims so
    data = Dataset(spark, str(tmp_path / "d"))
    stored = space.project(df).withColumn("source_filename", F.lit("f"))
    files = spark.createDataFrame([("f", "ok")], "source_filename string, status string")
    data.write(stored, files, space.stated())
    placed, how = again.place(data.rows(), data.metadata())
    assert how["used"] == "stored" and how["largest_gap"] < 1e-9 and placed.where("cluster = 'Cluster_1'").count() == sizes[0]
    placed, how = again.place(stored.withColumn("pc1", F.col("pc1") + F.when(F.col("i") == 7, 0.01).otherwise(0.0)), space.stated())
    assert how["used"] == "projected" and how["fingerprints_equal"] and how["largest_gap"] == pytest.approx(0.01) and placed.where("cluster = 'Cluster_1'").count() == sizes[0]
    other = spaces.fit_space(df.where("i < 500"), ["u", "v"], "pca", components=2)
    assert not space.matches(other.stated()) and again.place(stored, other.stated())[1]["used"] == "projected"
    assert again.assign(df.limit(1).withColumn("u", F.lit(None).cast("double"))).first()["cluster"] is None


def test_spaces(spark, clouds):
    df, x = clouds
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    values, vectors = np.linalg.eigh(np.cov(z.T, bias=True))
    full = spaces.fit_space(df, ["u", "v"], "pca", components=None)
    got = {r["i"]: (r["pc1"], r["pc2"]) for r in full.project(df).collect()}
    want = z @ vectors[:, ::-1]
    assert np.allclose(np.abs([got[i] for i in range(600)]), np.abs(want), atol=1e-9) and full.rows_fitted == 600 and np.allclose(full.mean, 0, atol=1e-9)
    assert len(spaces.fit_space(df, ["u", "v"], "pca", components=0.5).names) == 1
    scaled = spaces.fit_space(df, ["u", "v"], "scaled", "arcsinh", "minmax_col")
    assert scaled.names == ("u__scaled", "v__scaled") and spaces.Space.from_json(scaled.to_json()).fingerprint == scaled.fingerprint != full.fingerprint
    data = json.loads(full.to_json())
    data["axes"]["loadings"][0][0] += 1e-12
    with pytest.raises(ValueError, match="fingerprint"):
        spaces.Space.from_json(json.dumps(data))
    with pytest.raises(ValueError, match="version"):
        spaces.Space.from_json(json.dumps(data | {"version": 9}))
    with pytest.raises(ValueError, match="missing"):
        full.project(df.drop("u"))
    with pytest.raises(ValueError):
        spaces.fit_space(df, ["u"], "umap")
    with pytest.raises(ValueError, match="10 rows"):
        spaces.fit_reference(df.limit(9), ["u", "v"])
    row = spaces.reference_row(df, full, "AllMean", "subject").where("subject = 'AllMean'").first()
    assert (row["u"], row["v"]) == pytest.approx(tuple(x.mean(axis=0))) and row["i"] is None
    assert spaces.offsets(spaces.reference_row(df, full, "AllMean", "subject"), full).where("subject = 'AllMean'").first()["offset"] == pytest.approx(0, abs=1e-9)
    # weighted: one subject counts as much as all others together
    heavy = df.withColumn("w", F.when(F.col("subject") == "s0", 0.5 / 86).otherwise(0.5 / 514))
    weighted = spaces.fit_space(heavy, ["u", "v"], "pca", components=2, weight="w")
    w = np.array([0.5 / 86 if i % 7 == 0 else 0.5 / 514 for i in range(600)])
    m = (w[:, None] * z).sum(axis=0)
    assert np.allclose(weighted.axes.values, np.linalg.eigvalsh((w[:, None] * (z - m)).T @ (z - m))[::-1])


def test_weighted_clusters_and_quantiles(spark):
    rows = [(i, "a" if i < 90 else "b", float(i % 2 * 10) if i < 90 else 30.0) for i in range(92)]
    df = spark.createDataFrame(rows, "i long, subject string, u double")
    space = spaces.fit_space(df, ["u"], "scaled")
    plain = cluster_models.fit(df, "m", space, ["i"], n_clusters=2)
    even = cluster_models.fit(df, "m", space, ["i"], n_clusters=2, weight_by=["subject"])
    split = lambda m: sorted(r["n"] for r in m.profiles)
    assert split(even) == [2, 90] and split(plain) in ([2, 90], [45, 47])
    with pytest.raises(ValueError):
        cluster_models.fit(df, "m", space, ["i"], "gmm", weight_by=["subject"])
    with pytest.raises(ValueError, match="too few"):
        cluster_models.fit(df.limit(2), "m", space, ["i"])
    values = [3.0, 1.0, 2.0, float("nan"), None, 10.0]
    small = spark.createDataFrame([(v,) for v in values], "v double")
    for p in (0.0, 0.3, 0.5, 0.99, 1.0):
        assert ordered.quantile(small, "v", p) == pytest.approx(np.quantile([1, 2, 3, 10], p))
    assert ordered.quantile(small.limit(0), "v", 0.5) is None

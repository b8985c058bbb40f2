"""Density clusters of tables against the kernel that has all rows."""

import numpy as np
import pytest

from tessera.operators import density, density_trees


def same_clusters(a, b):
    pairs = set(zip(a.tolist(), b.tolist(), strict=True))
    return len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs}) and all((p < 0) == (q < 0) for p, q in pairs)


def rows_of(spark, x):
    names = [f"f{j}" for j in range(x.shape[1])]
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], f"i long, {', '.join(f'{n} double' for n in names)}")
    return df.repartition(3), names


@pytest.mark.parametrize("block", [60, 1000])
def test_tables_give_the_kernels_clusters(spark, block):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, s, (n, 2)) for c, s, n in ((0, 0.3, 60), (4, 0.5, 50), (8, 0.2, 40))] + [rng.uniform(-3, 11, (30, 2))])
    df, names = rows_of(spark, x)
    got = {r["i"]: r["cluster"] for r in density_trees.hdbscan(df, ["i"], names, 8, block=block).collect()}
    mine, want = np.array([got[i] for i in range(len(x))]), density.hdbscan(x, 8)
    assert want.max() >= 2 and same_clusters(mine, want)
    sizes = np.bincount(mine[mine >= 0])
    assert (np.diff(sizes) <= 0).all()


def test_five_thousand_rows(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(rng.uniform(-20, 20, 3), rng.uniform(0.2, 1), (450, 3)) for _ in range(10)] + [rng.uniform(-25, 25, (500, 3))])
    df, names = rows_of(spark, x)
    got = {r["i"]: r["cluster"] for r in density_trees.hdbscan(df, ["i"], names, 25, 10, block=1700).collect()}
    assert same_clusters(np.array([got[i] for i in range(len(x))]), density.hdbscan(x, 25, 10))


def test_spanning_tree_of_ties_and_parts(spark):
    edges = [(a, b, float((a * b) % 4)) for a in range(25) for b in range(a + 1, 25)] + [(100, 101, 2.0), (101, 102, 2.0), (100, 102, 2.0), (100, 100, 0.0)]
    got = [tuple(r) for r in density_trees.least_spanning_tree(spark.createDataFrame(edges * 2, density_trees.EDGE)).select("u", "v", "w").collect()]
    root, want = {}, []

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for w, u, v in sorted((w, u, v) for u, v, w in edges):
        if find(u) != find(v):
            root[find(u)] = find(v)
            want.append((u, v, w))
    assert sorted(got) == sorted(want)


def test_awkward_tables(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, None), (3, float("nan"))], "i long, f0 double")
    assert sorted(tuple(r) for r in density_trees.hdbscan(df, ["i"], ["f0"], 3).collect()) == [(1, -1), (1, -1)]
    assert density_trees.hdbscan(df.limit(0), ["i"], ["f0"]).count() == 0
    alike = spark.createDataFrame([(i, float(i % 2)) for i in range(20)], "i long, f0 double")
    got = {r["i"]: r["cluster"] for r in density_trees.hdbscan(alike, ["i"], ["f0"], 5, block=7).collect()}
    assert len(got) == 20 and len({got[i] for i in range(0, 20, 2)}) == 1 and len({got[i] for i in range(1, 20, 2)}) == 1


def test_rows_visit_few_cells(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df, names = rows_of(spark, rng.normal(size=(3000, 2)))
    seen, plain = {}, density_trees.written
    monkeypatch.setattr(density_trees, "written", lambda df, name: seen.setdefault(name, []).append(plain(df, name)) or seen[name][-1])
    assert density_trees.hdbscan(df, ["i"], names, 5, block=60).count() == 3000
    cells = seen["placed"][0].select("cell").distinct().count()
    met = seen["near"][0].selectExpr("avg(size(others))").first()[0]
    assert cells >= 40 and met < 3  # every other cell, when pairs of blocks were compared


def test_copies_join_as_in_the_kernel(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.4, (40, 2)) for c in (0, 3)] + [rng.uniform(-2, 5, (15, 2))]).round(1)
    x = x[rng.permutation(np.repeat(np.arange(len(x)), rng.integers(1, 5, len(x))))]
    df, names = rows_of(spark, x)
    for block in (25, 1000):
        got = {r["i"]: r["cluster"] for r in density_trees.hdbscan(df, ["i"], names, 9, block=block).collect()}
        assert same_clusters(np.array([got[i] for i in range(len(x))]), density.hdbscan(x, 9))

"""Tables and choices behind figures, and helpers of indices, layers, trees and mixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chimeras, figures, indices, layers, trees
from tessera.sources import tables


def test_colours_orders_and_names(spark):
    got = figures.palette(["x", "Young", "w", "x"], {"w": "#000000"})
    assert got == {"w": "#000000", "Young": "#1f77b4", "x": figures.PALETTE[0]} and got == figures.palette(["Young", "x"], got)
    assert figures.young_and_old(["Very young", "OLD", "n"]) == ("Very young", "OLD") and figures.young_and_old([]) == (None, None)
    assert figures.map_key(15, 0.1) == "X_umap_n15_d0.1" and figures.map_key(15, 0.1, 3) == "X_umap_pca3_n15_d0.1"
    head, tail = figures.head_and_tail(spark.range(20), ["id"], 3)
    assert [r[0] for r in head.collect()] == [0, 1, 2] and [r[0] for r in tail.collect()] == [17, 18, 19]


def test_features_in_category_blocks(spark):
    df = spark.createDataFrame([(1, 2.0, "s")], "a int, b double, name string")
    assert figures.shown_features(df) == ["a", "b"] and figures.shown_features(df, leave_out=["a"]) == ["b"] and figures.shown_features(df, ["b"]) == ["b"]
    with pytest.raises(ValueError, match="no such features"):
        figures.shown_features(df, ["c"])
    kinds = {"p": "size", "q": "shape", "r": "size"}
    assert figures.category_blocks(["p", "q", "r"], kinds, ["shape", "size"]) == ["q", "p", "r"]
    with pytest.warns(UserWarning, match="z"):
        assert figures.category_blocks(["z", "p", "q"], kinds, ["shape", "size"]) == ["q", "p", "z"]


def test_rings(spark):
    points = [("a", 3.0, 4.0), ("a", 0.0, 1.0), ("b", 0.0, 10.0), ("b", None, 1.0), (None, 0.0, 10.1)]
    df = spark.createDataFrame(points, "g string, x double, y double")
    got = {r["g"]: r for r in figures.distance_rings(df, ["g"], ["x", "y"]).collect()}
    assert {r["radius"] for r in got.values()} == {7.5}
    assert (got["a"]["n"], got["a"]["x"], got["a"]["y"], got["a"]["inside_1"]) == (2, 1.5, 2.5, 1.0)
    assert (got["b"]["n"], got["b"]["inside_1"], got["b"]["inside_2"]) == (1, 0.0, 1.0) and got[None]["n"] == 1
    assert figures.distance_rings(df.limit(0), ["g"], ["x", "y"]).count() == 0


def test_individual_column_and_summary(spark):
    assert indices.check_individual(["subject_ID", "x"], None) == "subject_ID"
    assert indices.check_individual(["subject_ID", "unique_subject_ID"], None) == "unique_subject_ID" and indices.check_individual(["s"], "s") == "s"
    for columns, asked in ((["x"], None), (["subject_ID"], "mouse")):
        with pytest.raises(ValueError, match="no individual column"):
            indices.check_individual(columns, asked)
    far = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("mean", 9.0), ("c", None)], "s string, offset double")
    spread = spark.createDataFrame([("a", 5.0, 0.0), ("b", 6.0, 0.0), ("mean", 7.0, 0.0), ("c", 8.0, 0.0)], "s string, mhi double, offset double")
    got = indices.summarize_absolute(far, spread, "s", "mean").collect()
    assert [(r["s"], r["offset"], r["mhi"]) for r in got] == [("b", 3.0, 6.0), ("a", 1.0, 5.0), ("c", None, 8.0)]
    assert indices.summarize_absolute(far, spread, "s").count() == 4


def test_means_of_colours(spark):
    df = spark.createDataFrame([(1, 2.0, 4.0, 10.0, 7.0), (2, None, 4.0, 10.0, 7.0)], "id int, `R1-A` double, `R2-A` double, `R1-H` double, `Time` double")
    got = layers.color_means(df, ["R1-A", "R2-A", "R1-H", "Time"]).collect()
    assert [r.asDict() for r in got] == [{"id": 1, "R-A": 3.0, "R-H": 10.0}, {"id": 2, "R-A": None, "R-H": 10.0}]


def test_support_of_clades():
    rng = np.random.default_rng(0)
    profiles = {g: rng.normal(c, 0.1, size=(6, 2)) for g, c in (("a", 0), ("b", 1), ("c", 9), ("d", 10))}
    build = lambda m: trees.linkage(np.sqrt(((m[:, None] - m[None]) ** 2).sum(axis=2)))
    got = trees.clade_support(profiles, build, 50)
    assert got == {frozenset("ab"): 1.0, frozenset("cd"): 1.0} and got == trees.clade_support(profiles, build, 50)

    def fails(m):
        raise ValueError("no tree")

    assert trees.clade_support(profiles, fails, 5) == {}


def test_mixtures_of_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(s, g, i, float(x)) for s, g, n in (("a", "y", 30), ("b", "o", 30), ("c", "o", 0), ("d", "y", 30)) for i, x in enumerate(rng.normal(0 if g == "y" else 5, 1, n))]
    df = spark.createDataFrame(rows, "s string, g string, i long, x double")
    got = chimeras.validate_all(df, "s", "g", ["x"], ["s", "i"], ("y", "o"), ratios=(0.5,), repeats=1)
    assert {(r["first"], r["second"]) for r in got.select("first", "second").distinct().collect()} == {("a", "b"), ("d", "b")}
    one = chimeras.validate(df, "s", "a", "b", ["x"], ["s", "i"], ratios=(0.5,), repeats=1).collect()
    assert sorted(map(tuple, one)) == sorted(tuple(r)[2:] for r in got.where("first = 'a'").collect())
    with pytest.raises(ValueError, match="no pair"):
        chimeras.validate_all(df.where(F.col("g") == "y"), "s", "g", ["x"], ["s", "i"], ("y", "o"))


def test_pairs_from_a_file(spark, tmp_path):
    path = tmp_path / "pairs.csv"
    path.write_text("stained_file,unstained_file,note\na.fcs,n.fcs,x\nb.fcs, ,y\n")
    assert [tuple(r) for r in tables.read_pairs(spark, str(path)).orderBy("stained_file").collect()] == [("a.fcs", "n.fcs", "x"), ("b.fcs", None, "y")]
    path.write_text("stained_file,other\na.fcs,n.fcs\n")
    with pytest.raises(ValueError, match="unstained_file"):
        tables.read_pairs(spark, str(path))
    path.write_text("stained_file,unstained_file\na.fcs,n.fcs\na.fcs,m.fcs\n")
    with pytest.raises(ValueError, match="several partners"):
        tables.read_pairs(spark, str(path))
